"""From outings to a panel: score join, de-duplication, qualification, and features that look only backwards.

All windows are by entity, or by entity and year, and share one exchange. An entity with very many rows would be one task's work: ``split_long`` deals
such entities, and no others, into blocks of days. A block then gets the few rows before its first one as a halo, so that windows by (entity, block)
give what windows by entity would.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.columns import nullify, require
from ..sources.shared import cut

#: Rows of an entity that one task takes; longer ones are dealt into blocks of about so many.
LONG = 200_000
#: Blocks of an entity at most, each with so many rows more.
BLOCKS = 2_000
BLOCK, HALO = "_block", "_halo"


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order. max_by combines before the shuffle, so a hot key costs one row a task."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; reading it fails if a key repeats. The rows of a key are counted in the shuffle that brings them together, so a join by the same keys
    after it needs no other, and nothing is run beforehand."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    named = F.concat(F.lit("rows are not unique by "), F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]))
    return df.withColumn("_twice", twice).filter(F.when(F.col("_twice"), F.raise_error(named).cast("boolean")).otherwise(F.lit(True))).drop("_twice")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join; reading it fails if a key repeats on either side."""
    return unique(left, keys).join(unique(right, keys), list(keys), "inner")


def join_scores(outings: DataFrame, scores: DataFrame, entity: str, day: str, source_order: str | None = None, ties: Sequence[str] = (), count: str | None = None, least: int = 0) -> DataFrame:
    """Outings with a score on their day. Of scores of one key the last source's counts, within a source the last by the other columns in order of
    name; of outings of one day the last by ties."""
    rest = sorted(set(scores.columns) - {entity, day, source_order})
    log = scores if source_order is None else keep_last(scores, [entity, day], [source_order, *rest]).drop(source_order)
    found = outings.join(log, [entity, day], "inner")
    if count is not None:
        found = found.filter(F.col(count) >= least)
    return keep_last(found, [entity, day], list(ties)) if ties else found


def qualified(outings: DataFrame, entity: str, day: str, years: Sequence[int], least: int) -> DataFrame:
    """Entities with at least ``least`` outings in each of the years."""
    by_year = outings.filter(F.year(day).isin(*years)).groupBy(entity, F.year(day).alias("_year")).agg(F.count(F.lit(1)).alias("_n"))
    return by_year.filter(F.col("_n") >= least).groupBy(entity).agg(F.count(F.lit(1)).alias("_years")).filter(F.col("_years") == len(set(years))).select(entity)


def only_qualified(outings: DataFrame, entity: str, day: str, years: Sequence[int], least: int) -> DataFrame:
    return outings.join(qualified(outings, entity, day, years, least), entity, "left_semi")


def split_long(df: DataFrame, entity: str, day: str, rows: int | None = None) -> DataFrame:
    """df as it is where no entity has more than ``rows`` (LONG) rows. Otherwise with _block: 0 for the others, and for long entities the number of the
    block of days that a row is in. A day's rows are never parted."""
    most = LONG if rows is None else rows
    df = cut(df, "panel")
    long = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    n = long.agg(F.max("_n")).head()[0]
    if n is None:
        return df
    blocks = min(BLOCKS, -(-n // most))
    at = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    days = df.join(long.select(entity), entity, "left_semi").withColumn("_d", F.unix_date(F.col(day).cast("date")))
    edges = days.groupBy(entity).agg(F.array_distinct(F.percentile_approx("_d", at, 100_000)).alias("_edges"))
    found = df.join(cut(edges, "edges"), entity, "left")
    number = F.size(F.filter("_edges", lambda e: e < F.unix_date(F.col(day).cast("date"))))
    return found.withColumn(BLOCK, F.when(F.col("_edges").isNull(), 0).otherwise(number)).drop("_edges")


def _block_sizes(df: DataFrame, entity: str) -> DataFrame:
    """entity, _block, _n, _before: rows of the block, and of all blocks before it. One row a block."""
    before = Window.partitionBy(entity).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(entity, BLOCK).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def with_halo(df: DataFrame, entity: str, order: Sequence[str], rows: int, only: Column | None = None) -> DataFrame:
    """df with _halo (false), and for each block the ``rows`` rows before it (of those for which ``only`` holds) once more, with _halo true."""
    able = df if only is None else df.filter(only)
    sizes = _block_sizes(able, entity)
    back = Window.partitionBy(entity, BLOCK).orderBy(*[F.desc(c) for c in order])
    tails = able.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= rows)
    # a block's last rows go to each later one that has too few others before it
    blocks = df.select(entity, F.col(BLOCK).alias("_to")).distinct()
    ends = sizes.select(entity, F.col(BLOCK).alias("_from"), (F.col("_before") + F.col("_n")).alias("_end"))
    befores = blocks.join(ends, entity).filter("_from < _to").groupBy(entity, "_to").agg(F.max("_end").alias("_upto"))
    near = ends.join(befores, entity).filter((F.col("_from") < F.col("_to")) & (F.col("_upto") - F.col("_end") < rows)).select(F.col(entity).alias("_e"), "_from", "_to", (F.col("_upto") - F.col("_end")).alias("_between"))
    copies = tails.join(near, (F.col(entity) == F.col("_e")) & (F.col(BLOCK) == F.col("_from"))).filter(F.col("_back") + F.col("_between") <= rows)
    columns = [F.col(c) if c != BLOCK else F.col("_to").alias(BLOCK) for c in df.columns]
    return df.withColumn(HALO, F.lit(False)).unionByName(copies.select(*columns, F.lit(True).alias(HALO)))


def _by_entity(df: DataFrame, entity: str, order: Sequence[str], rows: int, add: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """add(df, keys of its windows); where df has blocks, with a halo of so many rows, which is dropped again."""
    if BLOCK not in df.columns:
        return add(df, [entity])
    return add(with_halo(cut(df, "blocks"), entity, order, rows), [entity, BLOCK]).filter(~F.col(HALO)).drop(HALO)


def season_workload(df: DataFrame, entity: str, day: str, count: str = "event_count", ties: Sequence[str] = (), most_gap: int = 21) -> DataFrame:
    """Within a season: rest_days, previous_count, and density: the last three counts by the days since the third last outing, where the three gaps
    up to now are known and none is longer than most_gap."""

    def add(df: DataFrame, keys: list[str]) -> DataFrame:
        season = Window.partitionBy(*keys, F.year(day)).orderBy(day, *ties)
        df = df.withColumn("rest_days", F.datediff(F.col(day), F.lag(day).over(season))).withColumn("previous_count", F.lag(count).over(season))
        three = season.rowsBetween(-2, 0)
        back = [F.lag(count, i).over(season) for i in (1, 2, 3)]
        days = F.datediff(F.col(day), F.lag(day, 3).over(season))
        ok = (F.count("rest_days").over(three) == 3) & (F.max("rest_days").over(three) <= most_gap)
        return df.withColumn("density", F.when(ok, F.try_divide((back[0] + back[1] + back[2]).cast("double"), days.cast("double"))))

    return _by_entity(df, entity, [day, *ties], 4, add)


def history(df: DataFrame, entity: str, day: str, columns: Sequence[str], rows: int = 5, ties: Sequence[str] = ()) -> DataFrame:
    """Of each column over the last ``rows`` outings before this one, whatever the season: <c>_mean, and <c>_slope by the outing's position."""
    require(df, entity, day, *columns)

    def add(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(day, *ties)
        before = w.rowsBetween(-rows, -1)
        df = df.withColumn("_pos", F.row_number().over(w).cast("double"))  # a slope does not depend on where counting starts
        out = {}
        for c in columns:
            v = nullify(F.col(c).cast("double"))
            out[f"{c}_mean{rows}"] = F.avg(v).over(before)
            out[f"{c}_slope{rows}"] = F.regr_slope(v, F.col("_pos")).over(before)
        return df.withColumns(out).drop("_pos")

    return _by_entity(df, entity, [day, *ties], rows, add)


def prior_value(df: DataFrame, entity: str, day: str, column: str, ties: Sequence[str] = (), name: str = "prior") -> DataFrame:
    add = lambda df, keys: df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(day, *ties)))
    return _by_entity(df, entity, [day, *ties], 1, add)


#: Decay (as a logarithm) of the fastest average within one segment at most: its products and their inverses stay far from a double's ends.
SEGMENT = 600.0
#: What is left of a value after so much decay is below a double's precision.
FORGOTTEN = 45.0


def longest(df: DataFrame, entity: str) -> int:
    """Rows of the entity that has most; for tables that are written, as it reads them."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).head()[0] or 0


def ewma_prior(df: DataFrame, entity: str, day: str, column: str, spans: Sequence[int], ties: Sequence[str] = (), most_rows: int | None = None) -> DataFrame:
    """ewma<s> for each span: the exponentially weighted mean of all outings before this one, recursive (the first value seeds it; a null lets the
    weight of the past decay and changes nothing else).

    The mean after a known value x is c m + (1 - c) x, where c follows from the number of rows since the known value before it: an affine step. Steps
    are composed by window functions: with P the running product of the c in a segment of rows, the mean is P times (carry + running sum of
    (1 - c) x / P), and the carry is the mean at the end of the segment before. A segment ends where P could become too small for a double; its decay
    is so strong that a carry needs only the segment before it, or as many as ``_segments`` says for spans that differ greatly.
    most_rows: what no entity has more rows than, where that is known; if one segment holds so many, nothing is carried and all windows share one sort.
    """
    q = {s: 1 - 2 / (s + 1) for s in spans}
    fast, slow = min(spans), max(spans)
    names = [f"ewma{s}" for s in spans]
    order = [day, *ties]
    df = df.drop(*names)
    value = nullify(F.col(column).cast("double"))
    known = F.col("_x").isNotNull()
    gap = lambda s: F.pow(F.lit(q[s]), F.col("_gap"))
    keeps = lambda s: F.when(F.col("_gap").isNull(), 0.0).otherwise(gap(s) / (gap(s) + (1 - q[s])))
    # a row decays by the logarithm of its gap's power at most, and gaps add up to rows
    single = BLOCK not in df.columns and most_rows is not None and most_rows * -math.log(q[fast]) < SEGMENT

    def add(df: DataFrame, keys: list[str]) -> DataFrame:
        # rows of blocks come in the order of their numbers, others still in the order that these were given in, which needs no other sort
        w = Window.partitionBy(*keys).orderBy(*(["_at", *order] if BLOCK in keys else order))
        past, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_gap", F.when(known, F.col("_at") - F.max(F.when(known, F.col("_at"))).over(past)).cast("double"))
        if not single:
            df, past, one = segmented(df, keys, upto)
        else:
            one = upto
        df = df.withColumn("_first", known & (F.count("_x").over(one) == 1))
        df = df.withColumns({f"_p{s}": F.product(F.when(known & ~F.col("_first"), keeps(s)).otherwise(1.0)).over(one) for s in spans})
        df = df.withColumns({f"_s{s}": F.sum(F.when(known, (1 - keeps(s)) * F.col("_x") / F.col(f"_p{s}"))).over(one) for s in spans})
        mean = lambda s, carry: F.when(known, F.col(f"_p{s}") * (F.col(f"_s{s}") + carry))
        df = df.withColumns({f"_m{s}": mean(s, F.lit(0.0)) for s in spans})
        for _ in range(0 if single else _segments(q[fast], q[slow])):
            df = df.withColumns({f"_c{s}": F.when(F.col("_first"), keeps(s) * F.coalesce(F.last(f"_m{s}", True).over(past), F.lit(0.0))) for s in spans})
            df = df.withColumns({f"_m{s}": mean(s, F.coalesce(F.max(f"_c{s}").over(one), F.lit(0.0))) for s in spans})
        df = df.withColumns({n: F.last(f"_m{s}", True).over(past) for n, s in zip(names, spans)})
        return df.drop("_gap", "_segment", "_first", *[f"_{c}{s}" for c in "psmc" for s in spans])

    def segmented(df: DataFrame, keys: list[str], upto: WindowSpec) -> tuple[DataFrame, WindowSpec, WindowSpec]:
        """df with _segment, and the windows of all rows before one and of a segment's rows up to one. Segments follow one another, so both are in one order."""
        decay = F.when(F.col("_gap").isNotNull(), F.log(gap(fast) + (1 - q[fast])) - F.col("_gap") * math.log(q[fast])).otherwise(0.0)
        df = df.withColumn("_segment", F.floor(F.sum(decay).over(upto) / SEGMENT))
        one = Window.partitionBy(*keys, "_segment").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        return df, Window.partitionBy(*keys).orderBy("_segment", "_at").rowsBetween(Window.unboundedPreceding, -1), one

    df = df.withColumn("_x", value)
    if BLOCK not in df.columns:
        df = df.withColumn("_at", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
        return add(df, [entity]).drop("_x", "_at")
    df = cut(df, "blocks")
    sizes = _block_sizes(df, entity).select(entity, BLOCK, "_before")
    df = df.join(sizes, [entity, BLOCK]).withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(entity, BLOCK).orderBy(*order))).drop("_before")
    rows = math.ceil(FORGOTTEN / -math.log(q[slow]))  # known values further back count for nothing
    return add(with_halo(cut(df, "blocks"), entity, ["_at"], rows, known), [entity, BLOCK]).filter(~F.col(HALO)).drop(HALO, "_x", "_at")


def _segments(fast: float, slow: float) -> int:
    """Segments before its own that a carry is made from: a segment decays by at least 0.4 times the ratio of the logarithms, long gaps included."""
    return math.ceil(FORGOTTEN / (SEGMENT * 0.4 * math.log(slow) / math.log(fast)))


def differences(df: DataFrame, spans: Sequence[int], prior: str = "prior", mean: str | None = None) -> DataFrame:
    """How far the prior value, and the recent mean, are from each moving average."""
    out: dict[str, Column] = {}
    for s in spans:
        out[f"prior_minus_ewma{s}"] = F.col(prior) - F.col(f"ewma{s}")
        if mean is not None:
            out[f"mean_minus_ewma{s}"] = F.col(mean) - F.col(f"ewma{s}")
    return df.withColumns(out)
