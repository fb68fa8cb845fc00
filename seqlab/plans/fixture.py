"""The driver's tables in the roles of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETS = {"fast": ["AF", "AO"], "breaking": ["RF", "RO"], "slow": ["NF"]}
ORDER = ["at_bat", "opponent", "entity", "shipped", "price"]
MEASURES = ["price", "quantity", "discount", "tax"]
LEAST_EVENTS = 2
QUALIFY = (1996, 1997, 1998, 1999, 2000)
LEAST_OUTINGS = 20
START, FOLDS, HOLDOUT = 1995, (1998, 1999, 2000), 2001
SPANS = (2, 3, 4, 5, 6, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as events. Some categories and taxes are made null, by rule, as the table itself has no nulls.

    Prices are in units of 997, so that no mean lies on the border of two rounded values.
    """
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("entity"),
        c("l_orderkey").alias("grp"),
        F.date_trunc("week", "l_shipdate").cast("date").alias("day"),
        c("l_shipdate").alias("shipped"),
        F.when(c("l_partkey") % 17 != 0, F.concat("l_returnflag", "l_linestatus")).alias("category"),
        (c("l_quantity") * 7.2).alias("angle"),
        c("l_partkey").alias("opponent"),
        c("l_linenumber").alias("at_bat"),
        c("l_returnflag").alias("hand"),
        F.when(c("l_partkey") % 13 != 0, c("l_linestatus")).alias("side"),
        (c("l_extendedprice") / 997).alias("price"),
        c("l_quantity").alias("quantity"),
        c("l_discount").alias("discount"),
        F.when(c("l_partkey") % 13 != 0, c("l_tax")).alias("tax"),
    )


#: The same as SQL.
EVENTS = """ev AS (
  SELECT l_suppkey AS entity, l_orderkey AS grp, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, l_shipdate AS shipped,
    CASE WHEN l_partkey % 17 <> 0 THEN l_returnflag || l_linestatus END AS category, l_quantity * 7.2 AS angle, l_partkey AS opponent,
    l_linenumber AS at_bat, l_returnflag AS hand, CASE WHEN l_partkey % 13 <> 0 THEN l_linestatus END AS side, l_extendedprice / 997 AS price,
    l_quantity AS quantity, l_discount AS discount, CASE WHEN l_partkey % 13 <> 0 THEN l_tax END AS tax
  FROM lineitem
)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each entity's day: the mean total of its orders that are not pending, in two sources of which the second counts."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("grp"), "o_totalprice")
    by_day = events(spark, sf_dir).select("entity", "day", "grp").join(o, "grp").groupBy("entity", "day").agg((F.avg("o_totalprice") / 997).alias("score"))
    # both sources from one reading, as a union of two would join the orders twice
    return by_day.select("entity", "day", F.inline(score_log())).select("entity", "day", "score", "source_order")


def score_log() -> Column:
    """The sources of a day's score, as an array of (source_order, score)."""
    one = lambda score, source: F.struct(F.lit(source).alias("source_order"), score.alias("score"))
    older = F.when(F.col("entity") % 3 == 0, one(F.col("score") + 1, 0))
    return F.array_compact(F.array(older, one(F.col("score"), 1)))


def events_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with what the day's score is made of: how many orders of an event's group are not pending, how many of those have a total, and its sum."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderkey").alias("grp"))
    # one row for a group, so that no event counts twice
    return events(spark, sf_dir).join(o.agg(F.count(F.lit(1)).alias("orders"), F.count("o_totalprice").alias("totals"), F.sum("o_totalprice").alias("total")), "grp", "left")


SCORES = """sc AS (
  SELECT ev.entity, ev.day, avg(o_totalprice) / 997 AS score FROM ev JOIN orders ON grp = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL
)"""
