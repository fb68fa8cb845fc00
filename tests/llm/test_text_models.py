"""Language ID, quality, mixing and fingerprints: held-out accuracy, brute force, edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlab.llm import fingerprint, language_id, mixing, quality
from seqlab.llm.common import held_out
from seqlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("score", "lang_pred", "p", "rate", "_text", "hash")])


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "the " * 40_000), (6, "a"), (6, "a"), (None, "the house"), (7, "É")]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    judged = got.join(docs.select("doc_id", "lang", "text"), "doc_id").filter("held_out and lang is not null")
    assert judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.95
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    words = {"en": "the house of and is that with this for", "de": "das haus und ist nicht der mit einem für"}
    rng = random.Random(2)
    rows = [(lang, " ".join(rng.choices(w.split(), k=40)), i) for lang, w in words.items() for i in range(30)]
    labelled = spark.createDataFrame(rows + [(None, "x", 1), ("fr", None, 2), ("fr", "x", None)], "lang string, text string, doc_id long")
    known = language_id.fit(labelled)
    assert set(known) == {"en", "de"}
    docs = docs_of(spark, EDGES + [(8, "das haus ist nicht mit einem haus und der mit")])
    got = language_id.classify(docs, known)
    assert got.columns == ["doc_id", "text", "p", "rate", "_text", "hash", "lang_pred", "score", "rejected"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(EDGES) + 1 and 0 <= by[8]["score"] <= 1
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3, 4)) and by[8]["lang_pred"] == "de" and by[5]["lang_pred"] == "en"
    stay = language_id.keep_known(docs, known)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == {i for i, r in by.items() if not r["rejected"]} and {r["score"] for r in stay.collect()} == {"x"}
    assert {r["lang_pred"] for r in language_id.classify(docs_of(spark, EDGES), {}).collect()} == {"und"}
    assert language_id.fit(labelled.limit(0)) == {} and language_id.classify(docs_of(spark, []), known).count() == 0
    strict = language_id.classify(docs_of(spark, [(1, "the house of")]), known, min_margin=1.1).head()
    assert strict["rejected"] and strict["lang_pred"] == "en" and strict["score"] > 0


def test_language_by_definition(spark):
    """Dictionaries hold pieces of whole texts; sizes are those of plain compression of equal blocks."""
    import zstandard as zstd

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    known = language_id.fit(docs)
    rows = [r for r in docs.collect() if r["text"]]
    texts = {lang: " ".join(r["text"].lower() for r in rows if r["lang"] == lang) for lang in known}
    for lang, raw in known.items():
        lines = raw.decode("utf-8", "ignore")
        assert len(raw) <= language_id.DICT_BYTES and lines[1:200] in texts[lang] or lines[1:40] in texts[lang]
    got = {r["doc_id"]: r for r in language_id.classify(docs, known).collect()}
    how = zstd.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=3, target_length=16, strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in rows:
        raw = r["text"].lower().encode()
        k = -(-len(raw) // 2048)
        step = -(-len(raw) // max(1, k))
        sizes = {}
        for lang, d in known.items():
            z = zstd.ZstdCompressor(compression_params=how, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT))
            lead = d[len(d) // 2 :][:256]
            sizes[lang] = sum(len(z.compress(lead + raw[i : i + step])) for i in range(0, len(raw), step))
        first, second = sorted(sizes.values())[:2]
        if not any(map(str.isalpha, r["text"])):
            continue
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - first / second, abs=5e-3) and (first == second or abs(first - second) < 3 or got[r["doc_id"]]["lang_pred"] == min(sizes, key=sizes.get))


def test_one_id_of_most_rows_teaches_once(spark):
    rows = [("en", f"the house of number {i % 5} and more", 1) for i in range(3000)] + [("de", f"das haus nummer {i} und mehr", i) for i in range(40)]
    known = language_id.fit(spark.createDataFrame(rows, "lang string, text string, doc_id long"))
    assert list(known) == ["en", "de"] and len(known["en"]) < 60 and len(known["de"]) > 600


def test_quality_held_out(spark):
    got = QUERIES["op7_quality"](spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    rank = got["score"].rank()
    good = got["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_quality_edges(spark):
    none = quality.fit(docs_of(spark, EDGES), spark.createDataFrame([], "doc_id long, y int"), "y")
    assert {r["quality_score"] for r in quality.score(docs_of(spark, EDGES), none).collect()} == {0.5}
    rows = [(i, "fine words here" if i % 2 else "### bad !! $$$") for i in range(60)]
    model = quality.fit(docs_of(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 9), (None, 1)], "doc_id long, y int"), "y")
    scored = quality.score(docs_of(spark, EDGES + [(90, "fine words"), (91, "### !!")]).withColumn("Quality_Score", F.lit("x")), model)
    assert scored.columns == [*docs_of(spark, []).columns, "quality_score"]
    got = scored.collect()
    by = {r["doc_id"]: r["quality_score"] for r in got}
    assert len(got) == len(EDGES) + 2 and by[90] > 0.5 > by[91] and by[1] == by[2] == by[3] and all(0 <= s <= 1 for s in by.values())
    assert quality.score(docs_of(spark, []), model).count() == 0


def test_features_do_not_depend_on_batching():
    texts = ["The CAT sat, 12 times!", None, "", "x", " the the  the", "É" * 50]
    numbers, rows = quality.features(pa.array(texts))
    for k, t in enumerate(texts):
        one = quality.features(pa.array([t], pa.string()))[0]
        assert (numbers[rows[k] : rows[k + 1]] == one).all()
    w = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    whole = quality.scores_of(pa.array(texts), w, 0.1)
    assert whole[0] == pytest.approx(1 / (1 + np.exp(-(quality.SCALE * w[quality.features(pa.array(texts[:1]))[0]].astype(float).mean() + 0.1))), rel=1e-6)


def test_ftrl_like_plain_python():
    import math

    rng = np.random.default_rng(7)
    rows = [(np.unique(rng.integers(0, 40, 6)), None, int(rng.integers(0, 2))) for _ in range(60)]
    rows = [(u, rng.random(len(u)) + 0.1, y) for u, _, y in rows]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= (quality.L1 if i != "bias" else 0.0):
            return 0.0
        l1, l2 = (quality.L1, quality.L2) if i != "bias" else (0.0, 0.0)
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + l2)

    for _ in range(2):
        for u, v, y in rows:
            x = [(int(i), float(k)) for i, k in zip(u, v)] + [("bias", 1.0)]
            w = {i: weight(i) for i, _ in x}
            g = 1 / (1 + math.exp(-sum(w[i] * k for i, k in x))) - y
            for i, k in x:
                s = (math.sqrt(n[i] + (g * k) ** 2) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g * k - s * w[i]
                n[i] += (g * k) ** 2
    w, bias = quality.ftrl(rows, 2)
    assert np.allclose(w[:40], [weight(i) for i in range(40)], atol=1e-6) and bias == pytest.approx(weight("bias")) and np.abs(w[:40]).sum() > 0


def test_ftrl_learns_a_line():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        u = np.unique(rng.integers(0, 50, 8))
        rows.append((u, np.ones(len(u)), int((u < 25).sum() > (u >= 25).sum())))
    w, b = quality.ftrl(rows, 5)
    assert np.mean([(w[u] @ v + b > 0) == y for u, v, y in rows]) > 0.93


@pytest.mark.parametrize("weights,sharp", [([0.5, 0.3, 0.2], 0.3), ([0.97, 0.02, 0.01], 0.3), ([0.3, 0.2, 0.5], 3.0)])
def test_rates_like_numpy(spark, weights, sharp):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([sharp] * 3, 400)
    n = rng.integers(0, 500, 400)
    df = spark.createDataFrame([(i, int(n[i]), p[i].tolist()) for i in range(400)], "doc_id long, tokens long, p array<double>")
    got = mixing.fit_rates(df, weights).orderBy("doc_id").toPandas()["rate"].to_numpy()
    have = (got[:, None] * p * n[:, None]).sum(axis=0)
    assert np.allclose(have / have.sum(), weights, rtol=2e-4) and got.min() >= 0 and got.max() <= 1
    bound = ((p * n[:, None]).sum(axis=0) / weights).min()
    assert 0.05 * bound < have.sum() <= bound
    # the rates nearest to 1 that reach the totals are 1 - p x for one x, projected
    free = (got > 0) & (got < 1)
    x = np.linalg.lstsq(p[free], 1 - got[free], rcond=None)[0]
    assert free.sum() > 3 and np.allclose(got, np.clip(1 - p @ x, 0, 1), atol=1e-6)
    q, cells = mixing.cells(df, 3)
    assert len(q) <= mixing.CELLS and q.sum() == n.sum() and np.allclose(q @ cells, n @ p)


def test_totals_out_of_reach(spark):
    df = spark.createDataFrame([(1, 100, [0.9, 0.1]), (2, 50, [0.2, 0.8])], "doc_id long, tokens long, p array<double>")
    with pytest.raises(ValueError, match="no rates"):
        mixing.fit_rates(df, [0.99, 0.01], total=140.0)
    even = df.withColumn("p", F.array(F.lit(0.5), F.lit(0.5)))
    assert {(r["rate"], round(r["misfit"], 9)) for r in mixing.fit_rates(even, [0.9, 0.1]).collect()} == {(1.0, 0.4)}
    next_to_none = df.withColumn("p", F.array(F.lit(1 - 1e-6), F.lit(1e-6)))
    assert {(r["rate"], round(r["misfit"], 3)) for r in mixing.fit_rates(next_to_none, [0.5, 0.5]).collect()} == {(1.0, 0.5)}
    assert mixing.fit_rates(df.limit(0), [0.9, 0.1]).count() == 0


def test_memberships_by_definition(spark):
    import math

    import xxhash

    rng = random.Random(12)
    words = {"good": [f"g{i}" for i in range(30)], "bad": [f"b{i}" for i in range(30)]}
    rows = [(i, " ".join(rng.choices(words["good" if i % 3 else "bad"] + [f"n{j}" for j in range(20)], k=rng.randint(1, 60)))) for i in range(200)] + [(900, None), (901, " ")]
    known = [(i, "good" if i % 3 else "bad") for i in range(150)]
    model = mixing.fit_domains(docs_of(spark, rows), spark.createDataFrame(known, "doc_id long, domain string"), ["good", "bad"])
    got = {r["doc_id"]: r for r in mixing.memberships(docs_of(spark, rows), model).collect()}
    bucket = lambda w: ((xxhash.xxh64(w.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63) % mixing.BUCKETS
    sets = {i: {bucket(w) for w in (t or "").split()} for i, t in rows}
    held = Counter(d for _, d in known)
    n = {d: Counter(b for i, x in known if x == d for b in sets[i]) for d in held}
    total, smooth = 150, max(5.0, mixing.SMOOTH * 150)
    odds = {}
    for b in {b for s in sets.values() for b in s}:
        common = n["good"][b] + n["bad"][b]
        share = {d: math.log((n[d][b] + smooth * (common + 0.5) / (total + 1)) / (held[d] + smooth)) for d in held}
        if common >= max(4.0, mixing.SEEN * total) and abs(share["bad"] - share["good"]) >= mixing.WEAK:
            odds[b] = share["bad"] - share["good"]
    prior = {d: math.log((held[d] + 1) / (total + 2)) for d in held}
    for i, t in rows:
        x = max(-mixing.EVIDENCE, min(mixing.EVIDENCE, sum(odds.get(b, 0.0) for b in sets[i]))) + prior["bad"] - prior["good"]
        assert got[i]["p"][1] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9) and got[i]["tokens"] == len((t or "").split())


def test_mixing_edges(spark):
    rows = EDGES + [(100 + i, ("good text here " if i % 3 else "rude vile words ") * 5) for i in range(90)]
    labels = spark.createDataFrame([(100 + i, "good" if i % 3 else "toxic") for i in range(90)] + [(5, "else"), (None, "good")], "doc_id long, domain string")
    weights = {"good": 0.9, "toxic": 0.1, "never": 0.2}
    found = mixing.rates(docs_of(spark, rows), labels, weights)
    by = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(rows) and by[1]["tokens"] == 0 and by[101]["p"][0] > 0.9 > by[100]["p"][0]
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and 0 <= r["rate"] <= 1 for r in by.values())
    kept = mixing.mix(docs_of(spark, rows), labels, weights)
    assert kept.columns == docs_of(spark, rows).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    least = {i: r["rate"] for i, r in by.items()}
    want = {r[0]: r[1] for r in spark.createDataFrame([(i, least[i]) for i in least if i is not None], "i long, r double").select("i", mixing.chosen(F.col("i"), F.col("r"))).collect()}
    assert ids[None] == 1 and ids[6] == (2 if want[6] else 0) and all((ids[i] > 0) == want[i] for i in want)
    assert mixing.mix(docs_of(spark, []), labels, weights).count() == 0
    none = mixing.rates(docs_of(spark, rows), labels.limit(0), weights)
    assert {tuple(round(x, 6) for x in r["p"]) for r in none.collect()} == {(0.333333,) * 3}


def test_no_python_in_native_operators(spark):
    for name in ("op2_mixing", "op5_fingerprints"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def syncmers(words, k=5):
    """Positions whose run of k words has its least hash at an edge; hashes given."""
    return [i for i in range(len(words) - k + 1) if min(words[i], words[i + k - 1]) <= min(words[i + 1 : i + k - 1])]


def test_anchors_by_definition(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(500)}" for _ in range(300)]
    docs = docs_of(spark, [(1, " ".join(words)), (2, "new start " + " ".join(words[40:]))])
    found = fingerprint.anchors(docs)
    hashes = docs.filter("doc_id = 1").select(fingerprint.marked_hashes(fingerprint.words_of(F.col("text")), 5)).head()[0]
    assert len(hashes) == 308 and sorted(r["pos"] for r in found.filter("id = 1").collect()) == syncmers(hashes)
    one, two = found.filter("id = 1"), found.filter("id = 2")
    best = fingerprint.match_positions(one, two).orderBy(F.desc("matched")).head()
    assert best["shift"] == 2 - 40 and best["matched"] > 70


def aligned_by_definition(a, b):
    """near, shift, matched, aligned of two lists of (pos, hash)."""
    many = [Counter(h for _, h in x) for x in (a, b)]
    at = [{h: p for p, h in x if many[k][h] == 1} for k, x in enumerate((a, b))]
    shifts = [at[1][h] - p for h, p in at[0].items() if h in at[1]]
    often = Counter(shifts)
    shift = min((s for s in often if often[s] == max(often.values())), default=0)
    aligned = len({(p + shift, h) for p, h in a} & set(b))
    matched = len(shifts) - often[shift] + aligned
    return 2 * matched / (len(a) + len(b)) if a or b else 1.0, shift, matched, aligned


def test_alignment_by_definition(spark):
    rng = random.Random(8)
    words = lambda n, of=400: [f"w{rng.randrange(of)}" for _ in range(n)]
    base, line = words(300), words(12)
    pairs = [(base, base), (base, base[:150] + ["new"] + base[150:]), (base, words(40) + base[60:]), (line * 20, words(30) + line * 15), (["x"] * 5_000, ["x"] * 4_000), (base, []), ([], []), (words(4), words(3)), (words(900, 40), words(900, 40))]
    rows = spark.createDataFrame([(k, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    held = rows.select("k", *[fingerprint.marked_hashes(fingerprint.words_of(F.col(c)), 5).alias(c) for c in "ab"]).select("k", *[fingerprint.anchors_of(F.col(c)).alias(c) for c in "ab"])
    got = {r["k"]: r for r in fingerprint.with_alignment(held, {"x": ("a", "b")}).collect()}
    for k in range(len(pairs)):
        a, b = ([(x["pos"], x["hash"]) for x in got[k][c]] for c in "ab")
        assert tuple(got[k]["x"]) == pytest.approx(aligned_by_definition(a, b)), k
    near = [got[k]["x"]["near"] for k in range(len(pairs))]
    assert near[0] == near[6] == 1 and near[1] > 0.95 and got[2]["x"]["shift"] == 40 - 60 and near[5] == 0


def test_a_passage_shared_by_long_texts_is_found(spark, tmp_path):
    rng = random.Random(9)
    one, two = ([f"{c}{rng.randrange(10**6)}" for _ in range(20_000)] for c in "ab")
    two[7_000:7_060] = one[1_000:1_060]
    spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect()
    h = [set(r["hash"] for r in fingerprint.anchors(spark.createDataFrame([(1, " ".join(t))], "doc_id long, text string")).collect()) for t in (one, two)]
    want = 2 * len(h[0] & h[1]) / (len(h[0]) + len(h[1]))
    assert len(h[0] & h[1]) > 10 and all(r["near_next"] == pytest.approx(want) and r["near_edited"] > 0.7 for r in got)


def units_of(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return [u for w in words for u in (list(w) if len(w) > fingerprint.LONG else [w])]


def anchors_by_definition(units, k):
    """(pos, hash) of runs of k units, k - 1 marks about them."""
    import xxhash

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    one = lambda u: signed(xxhash.xxh64(u.encode(), seed=42).intdigest())
    h = [one("  ")] * (k - 1) + [one(u) for u in units] + [one("  ")] * (k - 1) if units else []
    out = []
    for i in range(len(h) - k + 1):
        run = h[i : i + k]
        if min(run[0], run[-1]) <= min(run[1:-1]):
            x = 42
            for v in run:
                x = xxhash.xxh64((v % 2**64).to_bytes(8, "little"), seed=x).intdigest()
            out.append((i, x >> (64 - 4 * fingerprint.DIGITS)))
    return out


def plain_fingerprint(t):
    both = [anchors_by_definition(units_of(t), 5), anchors_by_definition(list("".join(c.lower() if "A" <= c <= "Z" else c for c in t)), fingerprint.CHAR_K) if len(t) <= fingerprint.SHORT else None]
    text = [" ".join(f"{(p << 4 * fingerprint.DIGITS) + h:X}" for p, h in x or []) for x in both]
    return text[0] + (f"|{text[1]}" if text[1] else ""), both


def test_every_column_of_the_query_by_definition(spark, tmp_path):
    import hashlib

    rng = random.Random(10)
    words = [f"w{rng.randrange(300)}" for _ in range(900)]
    texts = [None, "", "a b", "A b", " \n", "x " * 3_000, "a b c d e f g h i j", "thirty letters are in this one", "q" * 700, "".join(rng.choices("日本語文字列", k=500)), " ".join(words), " ".join(words[100:]), " ".join(words[:60]) + " " + "z1" * 40]
    rows = [(10 * i if i else None, t) for i, t in enumerate(texts)] + [(30, "again"), (30, "a b")]
    docs_of(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op5_fingerprints"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    tie = {t or "": spark.range(1).select(F.xxhash64(F.lit(t or ""))).head()[0] for _, t in rows}
    order = sorted(((i is not None, i or 0, tie[t or ""], t or "") for i, t in rows))
    want = []
    for k, (known, i, _, t) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        n = len(t) // 4
        e = t[: len(t) - n] + following[:n]
        (f, a), (g, b), (_, c) = map(plain_fingerprint, (t, e, following))
        near = [aligned_by_definition(*((x[1], y[1]) if x[1] is not None and y[1] is not None else (x[0], y[0])))[0] for x, y in ((a, b), (a, c))]
        want.append((i if known else None, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, near[0], near[1]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[3], r[2])
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert r[:5] == w[:5] and r[5:] == pytest.approx(w[5:])
    near = {r["doc_id"]: r["near_edited"] for r in got}
    assert near[70] > 0.5 and near[80] > 0.6 and near[90] > 0.5


def test_an_id_on_most_rows_is_dealt_to_many_ranges(spark):
    """One id, and rows without one, are cut by their texts' hashes; the order is still that of ids and hashes, and each row's next one is right."""
    rows = [(5, f"text {i} of one id and more words") for i in range(3000)] + [(None, f"none {i} without an id at all") for i in range(1200)] + [(i, f"other {i} " * 4) for i in range(300)] + [(5, "again again")] * 3
    docs = docs_of(spark, rows).repartition(5).cache()
    dealt = fingerprint.in_order(docs, ranges=24)[0].select("_part", "_id", "_tie").collect()
    sizes = Counter(r["_part"] for r in dealt)
    assert len(dealt) == len(rows) and max(sizes.values()) < 3 * len(rows) / 24
    key = lambda r: (r["_id"] is not None, r["_id"] or 0, r["_tie"])
    assert sorted(dealt, key=lambda r: (r["_part"], key(r))) == sorted(dealt, key=lambda r: (key(r), r["_part"]))
    tie = {r["text"]: r["tie"] for r in docs.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]))
    want = Counter((i, t, t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]) for k, (i, t) in enumerate(order))
    got = fingerprint.edited_pairs(docs).select("doc_id", "text", "edited").collect()
    assert Counter(map(tuple, got)) == want
    docs.unpersist()


def test_likeness_of_stored_fingerprints(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    QUERIES["op5_fingerprints"](spark, sf).write.parquet(f"{tmp_path}/f")
    got = spark.read.parquet(f"{tmp_path}/f")
    again = fingerprint.likeness(got, {"near": ("fingerprint", "edited_fingerprint")})
    assert again.filter("abs(near - near_edited) > 1e-9").count() == 0
    short = got.filter("n_chars between 30 and 400")
    assert short.count() > 5 and short.filter("near_edited <= 0.5").count() == 0


def test_fingerprint_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "x " * 30_000), (None, "n"), (9, " ")]
    fp = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs_of(spark, rows)).collect()}
    assert fp[1] == fp[2] == "" and fp[3] == fp[4] != "" and fp[5] != ""
    one = fingerprint.edited_pairs(docs_of(spark, [(3, "a b c d")])).head()
    assert one["text"] == "a b c d" and one["edited"] == "a b c a" and fingerprint.edited_pairs(docs_of(spark, [])).count() == 0
    e = spark.range(1).select(fingerprint.edited(F.lit("éabcdefgh"), F.lit("12345")), fingerprint.edited(F.lit("abcdefgh"), F.lit("1"))).head()
    assert tuple(e) == ("éabcdef12", "abcdef1")


def test_held_out_fold(spark):
    import zlib

    df = spark.range(200).withColumn("h", held_out(F.col("id")))
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in df.collect())
    assert spark.sql("select cast(null as bigint) as id").select(held_out(F.col("id"))).head()[0] is False


def test_one_id_on_most_rows_is_one_text_to_learn_from(spark, monkeypatch):
    """Rows of one id are no larger a sample, for the classifier's one task and for the token dictionary's."""
    import public_tokenizers

    from seqlab.llm import token_output

    rows = [(1, f"the same id {i} " * 3) for i in range(3000)] + [(i, f"text of its own {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.range(1, 60).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    weights, _ = quality.fit(docs, labels, "quality")
    once = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    assert (weights == quality.fit(once, labels, "quality")[0]).all()
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_output, "SAMPLE_DOCS", 40)
    # too little to train on, so the samples are the dictionary: 40 of them and no more
    assert len(token_output.fit_dictionary(docs, path, "doc_id", "text", 2)) <= 40 * 4 * 30


def test_duplicate_rows_keep_the_same_one_wherever_they_are(spark):
    from seqlab.llm import exact_dedup

    rows = [(1, "A b", i) for i in range(200)] + [(2, "a B", 0), (3, "c", 5)]
    got = [sorted(map(tuple, exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == [1, 3]
