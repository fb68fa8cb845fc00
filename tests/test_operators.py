"""Operators on hand-written tables, against pandas or published figures."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlab.functions import columns
from seqlab.operators import boosting, evaluate, folds, models, panel, rollup, search
from seqlab.sources import files

BOOSTED = [[129, 70, 14], [35, 87, 39], [18, 64, 41]]
RIDGE = [[128, 70, 15], [36, 87, 38], [15, 60, 48]]


def from_matrix(spark, m, model="m"):
    rows = [(model, t, p) for t in range(3) for p in range(3) for _ in range(m[t][p])]
    return spark.createDataFrame(rows, "model string, true_class int, predicted_class int")


@pytest.mark.parametrize("matrix,want", [
    (BOOSTED, (0.5171026156941649, 0.49311326898589597, 0.49551404116425846, 0.5472837022132797)),
    (RIDGE, (0.5291750503018109, 0.510518513460876, 0.5139833711262283, 0.5311871227364185)),
    ([[213, 0, 0], [161, 0, 0], [123, 0, 0]], (0.42857142857142855, 1 / 3, 0.2, 0.8189134808853119)),
])
def test_published_metrics(spark, matrix, want):
    row = evaluate.metrics(from_matrix(spark, matrix), ["model"]).head()
    got = (row["accuracy"], row["balanced_accuracy"], row["macro_f1"], row["ordinal_mae"])
    assert got == pytest.approx(want, abs=1e-12)
    rows = evaluate.confusion(from_matrix(spark, matrix), "model").orderBy("true_class").collect()
    assert [[r[f"pred_{k}"] for k in range(3)] for r in rows] == matrix


def test_metrics_of_absent_classes(spark):
    row = evaluate.metrics(spark.createDataFrame([("m", 0, 0), ("m", 0, 2)], "model string, true_class int, predicted_class int"), ["model"]).head()
    assert row["balanced_accuracy"] == 0.5 and row["macro_f1"] == pytest.approx((2 / 3 + 0) / 2)


def test_published_stability(spark):
    df = spark.createDataFrame([("b", x, 0.0, 0.0) for x in (54.27, 53.57, 55.83)], "model string, balanced_accuracy double, macro_f1 double, ordinal_mae double")
    row = evaluate.stability(df, ["model"]).head()
    assert (round(row["mean_balanced_accuracy"], 2), round(row["std_balanced_accuracy"], 2)) == (54.56, 0.94)
    assert row["stability_score"] == pytest.approx(54.09, abs=0.01)  # the published inputs are rounded


def test_agreement(spark):
    rows = [(0, 0, 0)] * 243 + [(0, 1, 1)] * 212 + [(0, 0, 1)] * 14 + [(0, 1, 0)] * 20 + [(0, 1, 2)] * 8
    wide = spark.createDataFrame(rows, "true_class int, first_class int, second_class int").withColumn("models_agree", F.expr("first_class = second_class"))
    r = evaluate.agreement(wide).head()
    assert (r["n"], r["n_agree"]) == (497, 455)
    assert [round(100 * r[c], 2) for c in ("agreement_rate", "accuracy_agree", "first_accuracy_disagree", "second_accuracy_disagree")] == [91.55, 53.41, 33.33, 47.62]


def test_side_by_side_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a", 0, 0), (1, "a", 0, 1)], "k int, model string, true_class int, predicted_class int")
    with pytest.raises(Exception, match="more than one prediction"):
        evaluate.side_by_side(df, ["k"], "model", "a", "b").collect()


def days(n, step=7, start=dt.date(2019, 10, 1)):
    return [start + dt.timedelta(days=step * i) for i in range(n)]


def test_history_and_ewma_like_pandas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e, n in enumerate([1, 2, 3, 4, 6, 30]):
        v = rng.normal(size=n)
        v[rng.random(n) < 0.25] = np.nan
        if n > 10:
            v[[3, 4, 5, 6, 7, 8]] = np.nan
            v[20] = np.inf
        rows += [(e, d, float(x)) for d, x in zip(days(n), v)]
    df = spark.createDataFrame(rows, "entity int, day date, v double")
    found = panel.ewma_prior(panel.history(df, "entity", "day", ["v"]), "entity", "day", "v", [2, 4, 8]).orderBy("entity", "day").toPandas()
    pdf = pd.DataFrame(rows, columns=["entity", "day", "v"]).replace(np.inf, np.nan)

    def slope(w):
        k = ~np.isnan(w)
        return np.polyfit(np.arange(len(w))[k], w[k], 1)[0] if k.sum() >= 2 else np.nan

    by = pdf.groupby("entity")["v"]
    mean = by.transform(lambda s: s.shift(1).rolling(5, min_periods=1).mean())
    slopes = by.transform(lambda s: s.shift(1).rolling(5, min_periods=2).apply(slope, raw=True))
    assert np.allclose(found["v_mean5"].astype(float), mean, equal_nan=True)
    assert np.allclose(found["v_slope5"].astype(float), slopes, equal_nan=True, atol=1e-9)
    for s in (2, 4, 8):
        want = by.transform(lambda x: x.shift(1).ewm(span=s, adjust=False).mean())
        assert np.allclose(found[f"ewma{s}"].astype(float), want, equal_nan=True, atol=1e-12), s


def _all_features(df):
    found = panel.season_workload(df, "entity", "day", ties=["grp"])
    found = panel.prior_value(panel.history(found, "entity", "day", ["v"], ties=["grp"]), "entity", "day", "v", ties=["grp"])
    return panel.ewma_prior(found, "entity", "day", "v", [2, 8], ties=["grp"])


def test_blocks_of_a_long_entity_give_the_same(spark, monkeypatch):
    """One entity with 90 % of the rows, days with several rows, long runs without a value, blocks of few rows."""
    rng = np.random.default_rng(9)
    rows = []
    for e, n in ((1, 900), (2, 60), (3, 40)):
        at = np.sort(rng.integers(0, n * 2, n))
        for i in range(n):
            rows.append((e, dt.date(2015, 1, 1) + dt.timedelta(days=int(at[i])), i, int(rng.integers(1, 90)), None if rng.random() < 0.2 or 300 < i < 380 else float(rng.normal())))
    df = spark.createDataFrame(rows, "entity int, day date, grp int, event_count int, v double").repartition(5)
    want = _all_features(df).orderBy("entity", "day", "grp").toPandas()
    split = panel.split_long(df, "entity", "day", rows=70)
    sizes = {(r["entity"], r["_block"]): r["count"] for r in split.groupBy("entity", "_block").count().collect()}
    assert sizes[(2, 0)] == 60 and sizes[(3, 0)] == 40 and len(sizes) > 10 and max(sizes.values()) < 3 * np.median(list(sizes.values()))
    got = _all_features(split).drop("_block").orderBy("entity", "day", "grp").toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-9)
    assert "_block" not in panel.split_long(df, "entity", "day").columns


@pytest.mark.parametrize("spans", [[2, 3], [2, 200]])
def test_ewma_of_long_series(spark, spans):
    """Segments end and carry on; runs without a value are longer than a segment."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=6000) + 5
    v[rng.random(6000) < 0.3] = np.nan
    v[1000:3000] = np.nan
    rows = [(1, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    got = panel.ewma_prior(spark.createDataFrame(rows, "entity int, day date, v double"), "entity", "day", "v", spans).orderBy("day").toPandas()
    for s in spans:
        want = pd.Series(v).shift(1).ewm(span=s, adjust=False).mean()
        assert np.allclose(got[f"ewma{s}"].astype(float), want, equal_nan=True, rtol=1e-11)


def test_features_do_not_see_the_future(spark):
    rows = [(1, d, float(i % 7)) for i, d in enumerate(days(12))]
    make = lambda rs: panel.ewma_prior(panel.history(spark.createDataFrame(rs, "entity int, day date, v double"), "entity", "day", ["v"]), "entity", "day", "v", [4]).orderBy("day").drop("v").collect()
    assert make(rows)[:9] == make(rows[:8] + [(1, d, 99.0) for d in days(12)[8:]])[:9]
    assert make(rows) == make(rows[::-1])


def test_workload_borders(spark):
    d = [dt.date(2020, 1, 1)]
    for gap in (7, 7, 7, 21, 22, 7, 7, 7):
        d.append(d[-1] + dt.timedelta(days=gap))
    df = spark.createDataFrame([(1, x, 10 + i) for i, x in enumerate(d)] + [(1, dt.date(2021, 1, 2), 50)], "entity int, day date, event_count int")
    got = [r["density"] for r in panel.season_workload(df, "entity", "day").orderBy("day").collect()]
    assert [x is not None for x in got] == [False, False, False, True, True, False, False, False, True, False]
    assert got[3] == (12 + 11 + 10) / 21 and got[4] == (13 + 12 + 11) / 35


def test_rollup_edges(spark):
    rows = [(1, "2020-01-01", 3, "R", "r", "A", 1), (1, "2020-01-01", None, None, None, None, 1), (1, "2020-01-01", 1, "L", "L", "zz", 2), (None, "2020-01-01", 1, "L", "L", "A", 1), (1, None, 1, "L", "L", "A", 1)]
    df = spark.createDataFrame(rows, "entity int, day string, turn int, hand string, side string, cat string, per int").withColumn("day", F.to_date("day"))
    measures = [*rollup.opponents_faced(df, "no", "turn", "per"), *rollup.matchup(df, "hand", "side"), *rollup.category_shares(df, "cat", {"a": ["a"]}), *rollup.mix_wide(df, "cat", ["A", "B"]), *rollup.circular_mean(df, "no"), *rollup.means(df, ["no", "turn"]), *rollup.first_known(df, ["cat"], ["turn"])]
    got = rollup.roll_up(df, ["entity", "day"], measures).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["event_count"], r["faced"], r["a_share"], r["mix_A"], r["mix_B"], r["turn"], r["cat"]) == (3, 3, 1.0, 0.5, 0.0, 2.0, "zz")
    assert r["same_side_share"] == pytest.approx(2 / 3) and r["left_share"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("n,want", [(1, 1), (6, 2), (10, 2), (14, 4)])
def test_quarter_rounds_half_to_even(spark, n, want):
    df = spark.range(n).selectExpr("1 as entity", "date'2020-01-01' as day")
    assert rollup.roll_up(df, ["entity", "day"], rollup.opponents_faced(df, "x", "y", "z")).head()["faced"] == want


def test_starts_and_roles(spark):
    rows = [(1, 10, 5, 1), (2, 10, 1, 1), (2, 11, None, 1), (3, 11, 4, 2), (None, 11, 0, 1)]
    ev = spark.createDataFrame(rows, "entity int, grp int, inning int, turn int")
    assert {r["grp"]: r["first_entity"] for r in rollup.first_entity(ev, "grp", "entity", ["inning", "turn"]).collect()} == {10: 2, 11: 3}
    with pytest.raises(ValueError):
        rollup.only_starts(ev, "entity", "grp", least=0)
    with pytest.raises(ValueError):
        rollup.only_relief(ev)
    with pytest.raises(ValueError):
        rollup.roll_up(ev, ["entity", "nothing"], [])


def test_panel_joins(spark):
    o = spark.createDataFrame([(1, dt.date(2020, 1, 1), 60, 5), (1, dt.date(2020, 1, 1), 70, 7), (1, dt.date(2020, 1, 8), 40, 8)], "entity int, day date, event_count int, grp int")
    log = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0, 0), (1, dt.date(2020, 1, 1), 2.0, 1), (1, dt.date(2020, 1, 8), 3.0, 0)], "entity int, day date, score double, src int")
    got = panel.join_scores(o, log, "entity", "day", "src", ["grp"], "event_count", 50).collect()
    assert [(r["grp"], r["score"]) for r in got] == [(7, 2.0)]
    for left, right in ((o, log), (log.filter("src = 0"), log), (log, log.filter("src = 0"))):
        with pytest.raises(Exception, match="not unique by entity=1, day=2020-01-01"):
            panel.join_one_to_one(left, right, ["entity", "day"]).collect()
    assert panel.join_one_to_one(o.filter("grp > 5"), log.filter("src = 0"), ["entity", "day"]).count() == 2
    years = [(1, y, i) for y in (2020, 2021) for i in range(20)] + [(2, 2020, i) for i in range(30)] + [(3, y, i) for y, k in ((2020, 20), (2021, 19)) for i in range(k)]
    df = spark.createDataFrame([(e, dt.date(y, 1, 1) + dt.timedelta(days=i)) for e, y, i in years], "entity int, day date")
    assert [r["entity"] for r in panel.qualified(df, "entity", "day", (2020, 2021), 20).collect()] == [1]
    first = panel.keep_first(log, ["entity"], ["src", "day"]).head()
    assert (first["day"], first["score"]) == (dt.date(2020, 1, 1), 1.0)


def test_folds(spark):
    df = spark.createDataFrame([(1, dt.date(y, 6, 1), float(v)) for y in range(2015, 2021) for v in range(10)], "entity int, day date, v double")
    f = folds.fold_table(df, "day", (2018, 2019), 2016)
    assert {(r["fold"], r["split"]): r["count"] for r in f.groupBy("fold", "split").count().collect()} == {(2018, "train"): 20, (2018, "test"): 10, (2019, "train"): 30, (2019, "test"): 10}
    t = {r["fold"]: r for r in folds.thresholds(f, ["entity", "fold"], "v", 25).collect()}
    want = np.quantile(np.tile(np.arange(10.0), 3), [1 / 3, 2 / 3])
    assert list(t) == [2019] and (t[2019]["q33"], t[2019]["q67"]) == pytest.approx(tuple(want))
    with pytest.raises(Exception, match="must not be seen"):
        folds.guard_development(df, "day", 2019).count()
    assert folds.guard_development(df, "day", 2020).count() == df.count()
    tie = spark.createDataFrame([(1, "train", c) for c in (2, 1, 1, 2, 0)], "k int, split string, true_class int")
    assert folds.majority(tie, ["k"]).head()["majority_class"] == 1
    bad = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "v double")
    assert folds.complete_cases(bad, ["v"]).count() == 1


def test_tertile_borders(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.1,), (None,)], "s double")
    assert [r[0] for r in df.select(columns.tertile(F.col("s"), F.lit(1.0), F.lit(2.0))).collect()] == [0, 1, 2, 2]


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1, 10, 0] + [0, 5, 7]
    y = x[:, 0] * 2 - x[:, 1] * 0.1 + rng.normal(size=60)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y)], "k int, a double, b double, c double, y double").repartition(5)
    fit = models.fit_ridge(df, ["k"], ["a", "b", "c"], "y", [10.0]).head()
    sd = x.std(axis=0)
    sd[2] = 1
    z = (x - x.mean(axis=0)) / sd
    want = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(fit["coefficients"], want, atol=1e-8) and fit["intercept"] == pytest.approx(y.mean())


def plain_boost(x, y, rounds, rate, lam, least):
    """Depth one, every distinct value an edge."""
    p = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, best = p - y, (0.0, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[:-1]:
                m = x[:, f] <= v
                if m.sum() >= least and (~m).sum() >= least:
                    gain = 0.5 * (g[m].sum() ** 2 / (m.sum() + lam) + g[~m].sum() ** 2 / ((~m).sum() + lam) - g.sum() ** 2 / (len(g) + lam))
                    if gain > best[0] + 1e-9:
                        best = (gain, m)
        for m in [np.ones(len(g), bool)] if best[1] is None else [best[1], ~best[1]]:
            p[m] -= rate * g[m].sum() / (m.sum() + lam)
    return p


def test_boosting_like_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, size=(80, 2)).astype(float)
    y = (x[:, 0] > 3) * 2.0 + rng.normal(size=80)
    df = spark.createDataFrame([(1, i, "train", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "k int, i int, split string, a double, b double, y double")
    got = boosting.boost(df, ["k"], ["a", "b"], "y", rounds=3, depth=1, rate=0.3, min_child=4.0, reg_lambda=1.0, bins=400).orderBy("i").toPandas()["correction"]
    assert np.allclose(got, plain_boost(x, y, 3, 0.3, 1.0, 4), atol=1e-8)


def plain_trees(bins, y, train, key, row, rounds, depth, rate=0.05, min_child=8.0, reg_lambda=10.0, reg_alpha=0.0, gamma=0.0, row_share=1.0, column_share=1.0, seed=42):
    """One key and one candidate, node by node."""
    soft = lambda g: math.copysign(max(abs(g) - reg_alpha, 0.0), g)
    out = np.full(len(y), y[train].mean())
    for turn in range(rounds):
        taken = train & (boosting.draws(seed, turn, np.array([key]), row) < int(row_share * 1_000_000))
        may = [boosting.draws(seed + 1, turn, np.array([key]), np.array([f]))[0] < int(column_share * 1_000_000) for f in range(bins.shape[1])]
        g = out - y

        def grow(rows, level):
            best = (0.0, None)
            mine = rows & taken
            for f in range(bins.shape[1]) if level < depth else []:
                for v in range(int(bins.max())) if may[f] else []:
                    left = mine & (bins[:, f] <= v)
                    gl, hl, gr, hr = g[left].sum(), left.sum(), g[mine & ~left].sum(), (mine & ~left).sum()
                    if hr > 0 and hl >= min_child and hr >= min_child:
                        gain = 0.5 * (soft(gl) ** 2 / (hl + reg_lambda) + soft(gr) ** 2 / (hr + reg_lambda) - soft(gl + gr) ** 2 / (hl + hr + reg_lambda)) - gamma
                        if gain > 0 and round(gain, 9) > round(best[0], 9):
                            best = (gain, (f, v))
            if best[1]:
                side = bins[:, best[1][0]] <= best[1][1]
                grow(rows & side, level + 1)
                grow(rows & ~side, level + 1)
            elif mine.any():
                out[rows] -= rate * soft(g[mine].sum()) / (mine.sum() + reg_lambda)

        grow(np.ones(len(y), bool), 0)
    return out


TUNED = [
    {"rounds": 4, "depth": 1, "rate": 0.3, "min_child": 4.0, "reg_lambda": 1.0},
    {"rounds": 3, "depth": 2, "reg_alpha": 0.2, "rate": 0.2, "min_child": 3.0, "reg_lambda": 2.0},
    {"rounds": 2, "depth": 3, "gamma": 0.05, "rate": 0.5, "min_child": 2.0, "reg_lambda": 1.0, "row_share": 0.7, "column_share": 0.6},
]


def candidate_rows(keys=3, n=70):
    rng = np.random.default_rng(5)
    rows = []
    for e in range(keys):
        x = np.round(rng.normal(size=(n, 3)), 1)
        y = np.where(x[:, 0] > 0, 1.0, -1.0) * x[:, 1] + rng.normal(size=n) * 0.3
        rows += [(e, 2000, i, "train" if i < n - 15 else "test", float(y[i]), -0.4, 0.4, 1, 0.01 * i, 0.5 - 0.02 * i, *map(float, x[i])) for i in range(n)]
    rows += [(90, 2000, 0, "train", 0.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0, 0.0, 0.0), (91, 2000, 0, "test", 0.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0, 0.0, 0.0)]
    return rows


CANDIDATE_SCHEMA = "entity int, fold int, day int, split string, score double, q33 double, q67 double, true_class int, ewma4 double, ewma2 double, a double, b double, c double"


@pytest.mark.parametrize("key_rows,cells", [(10**9, 3_000_000), (10**9, 100), (69, 0)])
def test_boosted_candidates_like_plain_trees(spark, monkeypatch, key_rows, cells):
    """In tasks with whole keys (in one lot or key by key), and by aggregation, as keys are too large for a task."""
    monkeypatch.setattr(models, "CELLS", cells or models.CELLS)
    df = spark.createDataFrame(candidate_rows(2 if key_rows < 100 else 5), CANDIDATE_SCHEMA).repartition(4)
    few = [{"candidate": f"{span}{i}", "family": "boosted", "span": span, "feature_set": "all" if i else "two", "scale": 0.5, "bins": 16, **how} for i, how in enumerate(TUNED) for span in ((4, 2) if key_rows > 100 else (4,))]
    sets = {"all_4": ["a", "b", "c"], "all_2": ["c", "b", "a"], "two_4": ["c", "a"], "two_2": ["b"]}
    got = models.candidate_predictions(df, ["entity", "fold"], few, sets, "score", carry=["day"], key_rows=key_rows).toPandas()
    assert len(got) == len(few) * 15 * (2 if key_rows < 100 else 5)
    hashed = df.withColumns({"train": F.col("split") == "train"}).select("entity", "fold", "day", "train", "true_class", "a", "b", "c", *sorted({f"ewma{c['span']}" for c in few}), "score", "q33", "q67")
    hashed = hashed.withColumn("_row", F.xxhash64(*hashed.columns)).withColumn("_key", F.xxhash64("entity", "fold")).toPandas()
    for (e, c), part in got.groupby(["entity", "candidate"]):
        one = hashed[hashed.entity == e].sort_values("day")
        how = next(f for f in few if f["candidate"] == c)
        names = sets[f"{how['feature_set']}_{how['span']}"]
        every = ["a", "b", "c"]
        bins = boosting.binned(one[every].to_numpy(), one["train"].to_numpy(), 16)
        for i, f in enumerate(every):
            if f not in names:
                bins[:, i] = 0
        base = one[f"ewma{how['span']}"].to_numpy()
        tuned = TUNED[int(c[1:])]
        want = base + 0.5 * plain_trees(bins, one["score"].to_numpy() - base, one["train"].to_numpy(), one["_key"].iloc[0], one["_row"].to_numpy(), **tuned)
        assert np.allclose(part.sort_values("day")["score"], want[~one["train"].to_numpy()], atol=1e-8), (e, c)


def test_stumps_and_depth_two_with_64_bins(spark):
    rows = candidate_rows(1, 120)[:120]
    df = spark.createDataFrame(rows, CANDIDATE_SCHEMA)
    v = df.toPandas()
    train = (v["split"] == "train").to_numpy()
    hashed = df.select("day", F.xxhash64(*df.columns).alias("r"), F.xxhash64("entity").alias("k")).toPandas()
    for depth in (1, 2):
        want = boosting.boost(df, ["entity"], ["a", "b", "c"], "score", rounds=3, depth=depth, rate=0.2, min_child=4.0, reg_lambda=1.0).orderBy("day").toPandas()["correction"]
        plain = plain_trees(boosting.binned(v[["a", "b", "c"]].to_numpy(), train, 64), v["score"].to_numpy(), train, hashed["k"][0], hashed["r"].to_numpy(), 3, depth, 0.2, 4.0, 1.0)
        assert np.allclose(want, plain, atol=1e-8)


@pytest.mark.parametrize("scale", [1.0, 300.0, 1e-9, 0.0])
def test_pruned_lockstep_to_the_bit(scale):
    """Keys of several sizes, repeated values, twin features, and parameters of every kind; most features need no exact sums."""
    rng = np.random.default_rng(5)
    sizes = [70, 31, 8, 120, 2, 64]
    key, n = np.repeat(np.arange(len(sizes)), sizes), sum(sizes)
    x = np.column_stack([rng.normal(size=(n, 5)), rng.integers(0, 3, n), rng.integers(0, 12, (n, 2)), np.zeros(n)])
    x = np.column_stack([x, -x[:, 0], x[:, 6]])
    train = rng.random(n) < 0.8
    train[np.cumsum(sizes) - 1], train[np.cumsum(sizes) - 2] = False, True
    bins = np.concatenate([boosting.binned(x[key == k], train[key == k], 64) for k in range(len(sizes))])
    key_hash, row_hash = rng.integers(-(2**63), 2**63 - 1, len(sizes)), rng.integers(-(2**63), 2**63 - 1, n)
    base = {"rate": 0.1, "reg_lambda": 3.0, "row_share": 0.8, "column_share": 0.7}
    fits = [
        {"rounds": 12, "depth": 1, "min_child": 5.0, **base}, {"rounds": 9, "depth": 3, "min_child": 2.5, **base, "row_share": 1.0}, {"rounds": 12, "depth": 2, "min_child": 3.0, **base, "reg_alpha": 0.7 * scale},
        {"rounds": 8, "depth": 3, "min_child": 2.0, **base, "gamma": 0.5 * scale, "column_share": 1.0, "seed": 7}, {"rounds": 10, "depth": 2, "min_child": 0.0, **base}, {"rounds": 6, "depth": 2, "min_child": 2.0, **base, "reg_alpha": 1e4, "gamma": 0.01},
    ]
    columns = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [0, 2, 5, 9], [1, 3, 6, 10], [0, 1, 2, 3, 4, 5, 6, 7], [8, 9, 10], [0, 4]]
    y = scale * (rng.normal(size=(len(fits), n)) + 2 * (x[:, 0] > 0.3))
    y[1] = np.rint(y[1])  # many equal gains
    seen: list = []
    args = (bins, key, key_hash, row_hash, train, y, columns, fits)
    got = boosting.pruned_lockstep(*args, seen)
    assert np.array_equal(got, boosting.lockstep(*args)) and len(seen) == 33
    summed, every = np.sum(seen, axis=0)
    assert summed < 0.4 * every
    large = {**fits[0], "reg_lambda": 2e3}
    assert np.array_equal(boosting.pruned_lockstep(*args[:-1], [large, *fits[1:]]), boosting.lockstep(*args[:-1], [large, *fits[1:]]))


def test_candidates_of_a_key(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(60, 2)), rng.normal(size=60)
    rows = [(e, 2000, i, "train" if i < 45 else "test", float(y[i]), -0.4, 0.4, 1, 0.1 * i, *map(float, x[i])) for e in (1, 2) for i in range(60)] + [(3, 2000, 0, "train", 0.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "entity int, fold int, day int, split string, score double, q33 double, q67 double, true_class int, ewma4 double, a double, b double")
    few = [{"candidate": "e", "family": "ewma", "span": 4}, {"candidate": "r", "family": "ridge", "span": 4, "feature_set": "s", "alpha": 10.0, "scale": 0.5}, {"candidate": "b", "family": "boosted", "span": 4, "feature_set": "s", "scale": 0.25, "rounds": 3, "depth": 1, "bins": 8}]
    got = models.candidate_predictions(df, ["entity", "fold"], few, {"s_4": ["a", "b"]}, "score", carry=["day"]).toPandas()
    assert len(got) == 2 * 15 * 3
    other = models.candidate_predictions(df, ["entity", "fold"], few, {"s_4": ["a", "b"]}, "score", carry=["day"], key_rows=10).toPandas()
    order = ["entity", "day", "candidate"]
    pd.testing.assert_frame_equal(got.sort_values(order)[other.columns].reset_index(drop=True), other.sort_values(order).reset_index(drop=True))
    base = df.withColumn("residual", F.col("score") - F.col("ewma4"))
    fits = models.fit_ridge(base.filter("split = 'train'"), ["entity", "fold"], ["a", "b"], "residual", [10.0])
    ridge = models.score_ridge(base.filter("split = 'test'").drop("score"), fits, ["entity", "fold"], ["a", "b"], "ewma4", [0.5]).toPandas().sort_values(["entity", "day"])["score"]
    assert np.allclose(got[got.candidate == "r"].sort_values(["entity", "day"])["score"], ridge)
    fix = boosting.boost(base.filter("entity < 3"), ["entity", "fold"], ["a", "b"], "residual", rounds=3, depth=1, bins=8).filter("split = 'test'").toPandas().sort_values(["entity", "day"])
    assert np.allclose(got[got.candidate == "b"].sort_values(["entity", "day"])["score"], fix["ewma4"] + 0.25 * fix["correction"])
    e = got[got.candidate == "e"]
    assert np.allclose(e["score"], 0.1 * e["day"]) and set(e["predicted_class"]) == {2}


def test_strict_dates(spark, tmp_path):
    spark.createDataFrame([("2020-01-02",), (None,)], "day string").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([("soon",)], "day string").write.parquet(f"{tmp_path}/b")
    assert files.read_logs(spark, [f"{tmp_path}/a"], day="day").filter("day = date'2020-01-02'").count() == 1
    with pytest.raises(Exception, match="not a date"):
        files.read_logs(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], day="day").collect()


def test_candidates(spark):
    grid = search.candidate_grid(spark)
    assert grid.count() == 222 and grid.select("model_id").distinct().count() == 222
    assert grid.filter("model_id = 'ridge_span4_compact_alpha100_scale0.5'").count() == 1
    some = search.sampled_candidates(spark, 32)
    assert some.count() == 32 and some.collect() == search.sampled_candidates(spark, 32).collect()
    assert some.filter("rate < 0.01 or rate > 0.15 or depth not between 1 and 3 or rounds not between 50 and 300").count() == 0


def test_promotion_and_simplest(spark):
    board = spark.createDataFrame([("a", 0.54), ("b", 0.536)], "model_id string, stability_score double")
    assert search.promotion(board, "a", "b").head()["promoted"] is False
    b = spark.createDataFrame([(1, 3, 0.5, 1.0, 1.0, 50, 0.540), (2, 1, 1.0, 1.0, 1.0, 50, 0.538), (3, 1, 0.5, 9.0, 1.0, 50, 0.5375), (4, 1, 0.1, 9.0, 1.0, 50, 0.5)], "candidate int, depth int, scale double, reg_lambda double, min_child double, rounds int, stability_score double")
    assert search.simplest(b).head()["candidate"] == 3


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        files.read_directory(spark, f"{p}/none")
    spark.range(3).write.csv(f"{p}/c", header=True)
    assert files.read_directory(spark, f"{p}/c").count() == 3
    files.write_table(spark.range(3).withColumn("a", F.lit(1)), f"{p}/x")
    spark.range(2).write.parquet(f"{p}/y")
    assert files.read_directory(spark, f"{p}/x").count() == 3
    both = files.read_directories(spark, [f"{p}/x", f"{p}/y"])
    assert both.count() == 5 and set(both.columns) == {"id", "a"}
    with pytest.raises(ValueError):
        files.read_directories(spark, f"{p}/none")
    assert [r["source_order"] for r in files.read_logs(spark, [f"{p}/x", f"{p}/y"]).select("source_order").distinct().orderBy("source_order").collect()] == [0, 1]
    spark.createDataFrame([(1, "b"), (1, "a")], "player_id int, name string").write.parquet(f"{p}/n")
    assert files.read_names(spark, f"{p}/n").collect()[0]["name"] == "a"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "12_34.json").write_text('{"rows": [{"gamedate": "2020-01-01", "GS": "1"}, {"gamedate": "2020-01-02", "GS": 0}]}')
    (tmp_path / "j" / "13_35.json").write_text('{"rows": []}')
    (tmp_path / "j" / "14_36.json").write_text("{}")
    (tmp_path / "j" / "15_37.json").write_text('{"rows": [{"gamedate"')
    rows, bad = files.read_payloads(spark, f"{p}/j", "rows", "gamedate string, GS string")
    assert [(r["entity"], r["source_id"], r["GS"]) for r in rows.collect()] == [(12, 34, "1"), (12, 34, "0")]
    assert sorted((r["path"][-10:], r["problem"]) for r in bad.collect()) == [("14_36.json", "missing"), ("15_37.json", "corrupt")]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "1_2.json").write_text("{}")
    with pytest.raises(ValueError, match="no usable document"):
        files.read_payloads(spark, f"{p}/k", "rows", "gamedate string, GS string")
    files.write_report_csv(spark.range(2), f"{p}/r")
    found = files.report(spark, {"seed": "42"}, {"one": spark.createDataFrame([(1.5, None)], "a double, b string")}, {"board": spark.range(2)})
    files.write_report_json(found, f"{p}/s")
    back = files.read_report_json(spark, f"{p}/s", found)
    assert back.collect() == found.collect() and back.head()["settings"] == {"seed": "42"} and back.schema == found.schema


def test_landing_in_runs(spark, tmp_path):
    path, asked = f"{tmp_path}/landed", []
    rows = spark.createDataFrame([(1, 2020, 5.0), (1, 2020, 6.0), (1, 2021, 7.0), (2, 2020, 8.0)], "entity int, season int, v double")

    def collect(todo):
        asked.append(sorted(map(tuple, todo.collect())))
        return rows.join(todo, ["entity", "season"], "left_semi")

    def failing(todo):
        return collect(todo).withColumn("v", F.when(F.col("entity") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))

    keys = ["entity", "season"]
    wanted = spark.createDataFrame([(1, 2020), (1, 2020), (9, 2020)], "entity int, season int")
    assert files.land(wanted, collect, path, keys) == 2 and files.read_landed(spark, path).count() == 2
    before = sorted(f.name for f in (tmp_path / "landed").rglob("*.parquet"))
    assert files.land(wanted, collect, path, keys) == 0 and len(asked) == 1
    assert sorted(f.name for f in (tmp_path / "landed").rglob("*.parquet")) == before
    more = wanted.unionByName(rows.select("entity", "season"))
    with pytest.raises(Exception, match="lost"):
        files.land(more, failing, path, keys)
    assert files.read_landed(spark, path).count() == 2
    assert files.land(more, collect, path, keys) == 2 and asked[-1] == [(1, 2021), (2, 2020)]
    assert sorted(r["v"] for r in files.read_landed(spark, path).collect()) == [5.0, 6.0, 7.0, 8.0]


@pytest.mark.parametrize("most", [20_000, 50])
def test_exact_quantiles_like_numpy(spark, monkeypatch, most):
    from seqlab.operators import quantiles

    monkeypatch.setattr(quantiles, "ALL", most)
    monkeypatch.setattr(quantiles, "MARGIN", 0.02)
    rng = np.random.default_rng(3)
    values = {1: rng.normal(size=900), 2: rng.integers(0, 4, 500).astype(float), 3: np.array([2.5]), 4: np.array([1.0, 9.0]), 5: np.concatenate([np.zeros(400), [1e300, -1e300]])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [(1, None), (6, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r["k"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, ["k"], "v", (0.0, 1 / 3, 0.5, 2 / 3, 1.0)).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, [0, 1 / 3, 0.5, 2 / 3, 1]), rtol=1e-12)


def test_folds_that_leak_are_refused(spark):
    rows = [(1, dt.date(2019, 5, 1), 2020, "train"), (1, dt.date(2020, 5, 1), 2020, "test")]
    make = lambda more: folds.guard_folds(spark.createDataFrame(rows + more, "entity int, day date, fold int, split string"), "day")
    assert make([]).count() == 2
    for late in ((1, dt.date(2020, 1, 1), 2020, "train"), (1, dt.date(2021, 1, 1), 2020, "test"), (1, None, 2020, "train")):
        with pytest.raises(Exception, match="row of .*in the fold of 2020|USER_RAISED"):
            make([late]).count()


def test_search_fits_each_pair_once(spark, tmp_path):
    candidates, calls = search.sampled_candidates(spark, 32), []

    def fit(todo):
        calls.append(sorted((r["fold"], r["candidate"]) for r in todo.collect()))
        score = (F.col("candidate") * 7 % 32).cast("double") / 100 + F.when(F.col("candidate") == 9, 1.0).otherwise(0.0)
        return todo.select("candidate", "fold", score.alias("balanced_accuracy"), F.lit(0.1).alias("macro_f1"), F.lit(0.2).alias("ordinal_mae"))

    stages = [((2000,), 10), ((2000, 2001), 3), ((2000, 2001, 2002), 1)]
    winner, boards = search.staged_search(candidates, fit, stages, f"{tmp_path}/ledger")
    assert [len(c) for c in calls] == [32, 10, 3] and [{f for f, _ in c} for c in calls] == [{2000}, {2001}, {2002}]
    assert winner.head()["candidate"] == 9
    assert {r["stage"]: r["count"] for r in boards.groupBy("stage").count().collect()} == {1: 32, 2: 10, 3: 3}
    again, _ = search.staged_search(candidates, fit, stages, f"{tmp_path}/ledger")
    assert len(calls) == 3 and again.collect() == winner.collect()


def test_lots_are_whole_keys():
    assert models._lots(np.array([0, 3, 5, 20, 21]), 5) == [(0, 2), (2, 3), (3, 4)]
    assert models._lots(np.array([0, 3, 5]), 1) == [(0, 1), (1, 2)]


def test_ridge_corrections_solve_all_keys_at_once(monkeypatch):
    """One solution for each group of fits, not for each key; the same numbers to the bit as key by key."""
    rng = np.random.default_rng(9)
    sizes, n = [40, 25, 60], 125
    bounds = np.append(0, np.cumsum(sizes))
    v = {c: rng.normal(size=n) for c in ("a", "b", "c", "score", "ewma2", "ewma4")}
    v["c"][:40] = 2.0
    train = rng.random(n) < 0.7
    fits = [{"span": s, "columns": list(c), "alpha": x} for s, c in ((2, "ab"), (4, "abc")) for x in (1.0, 30.0)]
    calls, solve = [], models.solve_ridge_keys
    monkeypatch.setattr(models, "solve_ridge_keys", lambda m, p, alphas: calls.append(len(m)) or solve(m, p, alphas))
    got = models._ridge_corrections(v, fits, "score", train, bounds)
    assert calls == [3, 3]
    for f, found in zip(fits, got):
        x, y = np.stack([v[c] for c in f["columns"]], axis=1), v["score"] - v[f"ewma{f['span']}"]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            t = lo + np.flatnonzero(train[lo:hi])
            one = np.column_stack([np.ones(len(t)), x[t], y[t]])
            s = models.solve_ridge((one.T @ one)[np.triu_indices(len(f["columns"]) + 2)], len(f["columns"]), [f["alpha"]])[0]
            assert np.array_equal(found[lo:hi], s["intercept"] + ((x[lo:hi] - s["means"]) / s["deviations"]) @ s["coefficients"])


def test_ridge_solves_many_keys_at_once():
    rng = np.random.default_rng(8)
    rows = [np.column_stack([np.ones(30), rng.normal(size=(30, 2)), np.full(30, 7.0), rng.normal(size=30)]) for _ in range(4)]
    moments = np.stack([(r.T @ r)[np.triu_indices(5)] for r in rows])
    coefficients, means, deviations, intercepts = models.solve_ridge_keys(moments, 3, [1.0, 10.0])
    for k, r in enumerate(rows):
        z, y = (r[:, 1:3] - r[:, 1:3].mean(axis=0)) / r[:, 1:3].std(axis=0), r[:, 4] - r[:, 4].mean()
        for i, alpha in enumerate((1.0, 10.0)):
            assert np.allclose(coefficients[k, i, :2], np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ y)) and coefficients[k, i, 2] == pytest.approx(0, abs=1e-9)
        assert deviations[k, 2] == 1.0 and means[k, 2] == pytest.approx(7) and intercepts[k] == pytest.approx(r[:, 4].mean())


def test_short_keys_need_no_sketch(spark):
    """Keys whose values fit a row are sorted; only longer ones are sketched and selected."""
    from seqlab.operators import quantiles

    df = spark.createDataFrame([(k, float(v)) for k in range(3) for v in range(10)] + [(9, None)], "k int, v double")
    found = quantiles.exact_quantiles(df, ["k"], "v", (0.0, 1 / 3, 1.0))
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    assert {r["k"]: (r["n"], r["quantiles"]) for r in found.collect()} == {k: (10, [0.0, 3.0, 9.0]) for k in range(3)}


def test_scores_join_the_orders_once(spark):
    from seqlab.plans import fixture

    plan = fixture.scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_splits_of_guarded_folds_need_no_table(spark):
    """A filter by split beside the guard leaves right rows alone, and wrong ones are still refused."""
    df = spark.createDataFrame([(1, dt.date(y, 6, 1)) for y in range(2015, 2021)], "entity int, day date")
    rows = folds.guard_folds(folds.fold_table(df, "day", (2018, 2019), 2016), "day")
    assert [rows.filter(F.col("split") == s).count() for s in ("train", "test")] == [5, 2]
    late = spark.createDataFrame([(1, dt.date(2020, 1, 1), 2020, "train")], "entity int, day date, fold int, split string")
    with pytest.raises(Exception, match="row of .*in the fold of 2020|USER_RAISED"):
        folds.guard_folds(late, "day").filter("split = 'train'").count()


def test_averages_need_two_sorts(spark):
    """One in the order of days, one in the order of segments, however many spans there are."""
    df = spark.createDataFrame([(1, dt.date(2015, 1, 1), 1.0)], "entity int, day date, score double")
    found = panel.ewma_prior(panel.prior_value(panel.history(df, "entity", "day", ["score"]), "entity", "day", "score"), "entity", "day", "score", (3, 4, 8))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2 and plan.count("Exchange") == 1


def test_outings_and_scores_from_one_aggregation(spark, tmp_path):
    """What the join of outings and logged scores gives, with repeated orders, orders without a total, pending ones and lines without an order."""
    from seqlab.plans import fixture, queries

    at = dt.datetime(2020, 1, 6)
    line = lambda e, o, day, p: (o, 1, e, 1, 1.0, p, 0.0, 0.0, "A", "F", at + dt.timedelta(days=day))
    lines = [line(3, 1, 0, 10.0), line(3, 2, 1, 30.0), line(3, None, 2, 50.0), line(4, 1, 0, 1.0), line(4, 3, 0, 2.0), line(5, 4, 0, 3.0), line(5, 5, 0, 4.0), line(6, 6, 0, 5.0), line(6, 6, 0, None), line(None, 1, 0, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, "F", 997.0), (1, "O", 1994.0), (2, "O", 9970.0), (3, "P", 5.0), (4, "P", 5.0), (6, "F", None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = ({r["entity"]: r.asDict() for r in f(spark, str(tmp_path)).collect()} for f in (queries.scored, queries.joined))
    assert got == want and sorted(got) == [3, 4, 6] and got[6]["score"] is None and got[3]["event_count"] == 3
    plan = queries.scored(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and len(fixture.scores(spark, str(tmp_path)).columns) == 4


def test_averages_of_short_entities_need_one_sort(spark):
    rng = np.random.default_rng(4)
    v = [None if rng.random() < 0.3 else float(x) for x in rng.normal(size=120)]
    df = spark.createDataFrame([(1 + (i > 80), dt.date(2015, 1, 1) + dt.timedelta(days=i), x) for i, x in enumerate(v)], "entity int, day date, v double")
    n = panel.longest(df, "entity")
    assert n == 81
    short = panel.ewma_prior(df, "entity", "day", "v", (2, 8), most_rows=n)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "_segment" not in plan
    assert short.orderBy("day").collect() == panel.ewma_prior(df, "entity", "day", "v", (2, 8)).orderBy("day").collect()
    many = panel.ewma_prior(df, "entity", "day", "v", (2, 8), most_rows=100_000)
    assert "_segment" in many._jdf.queryExecution().executedPlan().toString()


def test_last_round_is_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(boosting, "cut", lambda df, name="cut": written.append(name) or df)
    df = spark.createDataFrame([(1, i, "train" if i < 20 else "test", float(i % 7), float(i % 7 > 3)) for i in range(25)], "k int, i int, split string, a double, y double")
    found = boosting.boost(df, ["k"], ["a"], "y", rounds=2, depth=1, min_child=2.0, bins=4, cut_every=1)
    assert len(written) == 2 and found.filter("split = 'test'").count() == 5
