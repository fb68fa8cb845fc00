"""Exact quantiles of keys of any size, by distributed selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

#: Values of a key that one row may hold; of keys with more, only those near a wanted rank are counted one by one.
ALL = 20_000
#: Values that a sketch tells apart, and how far (as a share of the rows) the ends that it gives are set from the rank: ten times its error.
SKETCH, MARGIN = 10_000, 0.001


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """keys, n, quantiles: of each key's values that are not null how many there are, and the quantiles with linear interpolation between neighbours.

    Keys of at most ALL values have them sorted in one row. For the others a mergeable sketch gives for each share two values that the wanted ranks lie
    between. Values below them are only counted; of the few between them the histogram is exact, and its running sum meets the ranks. So no task
    needs all values of a long key, and no result is approximate: if the ranks were not between the two values, reading the result fails.
    """
    rows = cut(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"), "values")
    long = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ALL).select(*keys), "long")
    if long.isEmpty():
        return _sorted_quantiles(rows, keys, shares)
    by_sort = _sorted_quantiles(rows.join(long, list(keys), "left_anti"), keys, shares)
    return by_sort.unionByName(_selected_quantiles(rows.join(long, list(keys), "left_semi"), keys, shares))


def _sorted_quantiles(rows: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_all")).withColumn("n", F.size("_all").cast("long"))

    def at(share: float) -> Column:
        rank = F.lit(float(share)) * (F.col("n") - 1)
        below = F.floor(rank).cast("int")
        a, b = F.get("_all", below), F.get("_all", F.least(below + 1, F.col("n").cast("int") - 1))
        return F.when(rank == below, a).otherwise(a + (rank - below) * (b - a))

    return found.select(*keys, "n", F.array(*[at(s) for s in shares]).alias("quantiles"))


def _selected_quantiles(rows: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    bounded = [min(1.0, max(0.0, s + d)) for s in shares for d in (-MARGIN, MARGIN)]
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*[F.lit(b) for b in bounded]), SKETCH).alias("_ends"))
    one = lambda i, s: F.struct(F.lit(i).alias("_i"), F.col("_ends")[2 * i].alias("_from"), F.col("_ends")[2 * i + 1].alias("_to"), (F.lit(float(s)) * (F.col("n") - 1)).alias("_rank"))
    wanted = cut(ends.select(*keys, "n", F.inline(F.array(*[one(i, s) for i, s in enumerate(shares)]))), "ranks")
    by = [*keys, "_i"]
    near = rows.join(wanted, list(keys)).filter(F.col("_v") <= F.col("_to"))
    # one histogram: all values below the first end are one cell of it
    cell = F.when(F.col("_v") >= F.col("_from"), F.col("_v"))
    counts = near.groupBy(*by, cell.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_rank").alias("_rank"), F.first("n").alias("n"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    counts = counts.withColumn("_upto", upto).filter("_v is not null")
    has = lambda r: F.max(F.when((F.col("_upto") - F.col("_c") <= r) & (r < F.col("_upto")), F.col("_v")))
    below = F.floor(F.col("_rank"))
    part = F.max(F.col("_rank") - below)
    found = counts.groupBy(*by).agg(has(below).alias("_a"), has(F.least(below + 1, F.col("n") - 1)).alias("_b"), part.alias("_part"), F.max("n").alias("n"))
    missed = F.raise_error(F.lit("a quantile is not where the sketch says")).cast("double")
    q = F.when(F.col("_a").isNull() | F.col("_b").isNull(), missed).when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda x: x["q"])  # as many as there are shares
    return found.groupBy(*keys).agg(F.max("n").alias("n"), listed.alias("quantiles"))
