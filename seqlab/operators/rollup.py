"""Event rows to outings: one row per entity, group and day, from one aggregation.

Every measure of an outing is an aggregate of the same group, so all of them go into one ``groupBy``: one shuffle with partial aggregation, and
no join between side tables. Each helper returns the aggregates that the columns at hand allow, and none where they are missing.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import age_years, bucket, is_left, present, require, same_side, try_date, try_double


def means(df: DataFrame, columns: Iterable[str]) -> list[Column]:
    """Null-skipping means of the columns there are."""
    return [F.avg(try_double(F.col(c))).alias(c) for c in present(df, columns)]


def first_known(df: DataFrame, columns: Iterable[str], order: Sequence[str]) -> list[Column]:
    """The first non-null value in the given order of rows."""
    at = F.struct(*[F.col(c) for c in order])
    return [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in present(df, columns)]


def first_and_last(df: DataFrame, column: str, first: str, last: str) -> list[Column]:
    return [F.min(try_double(F.col(column))).alias(first), F.max(try_double(F.col(column))).alias(last)] if column in df.columns else []


def opponents_faced(df: DataFrame, turn: str, opponent: str, period: str, name: str = "faced") -> list[Column]:
    """Distinct turns; without them distinct (opponent, period) pairs, nulls counted; without those a quarter of the events, half to even, 1 at least."""
    if turn in df.columns:
        return [F.count_distinct(F.col(turn)).alias(name)]
    if opponent in df.columns and period in df.columns:
        return [F.count_distinct(F.struct(opponent, period)).alias(name)]
    return [F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) / 4)).cast("long").alias(name)]


def matchup(df: DataFrame, hand: str, side: str) -> list[Column]:
    """Shares of events with the same hand and with a left-handed opponent."""
    if hand not in df.columns or side not in df.columns:
        return []
    return [F.avg(same_side(F.col(hand), F.col(side))).alias("same_side_share"), F.avg(is_left(F.col(side))).alias("left_share")]


def circular_mean(df: DataFrame, angle: str, prefix: str = "angle") -> list[Column]:
    """Mean sine and cosine of an angle in degrees."""
    if angle not in df.columns:
        return []
    r = F.radians(try_double(F.col(angle)))
    return [F.avg(F.sin(r)).alias(f"{prefix}_sin"), F.avg(F.cos(r)).alias(f"{prefix}_cos")]


def category_shares(df: DataFrame, category: str, sets: Mapping[str, Iterable[str]]) -> list[Column]:
    """Of the events in known sets, the share in each; null where an outing has none."""
    if category not in df.columns:
        return []
    kind = bucket(F.col(category), sets)
    known = F.count_if(kind != "other")
    return [F.try_divide(F.count_if(kind == name), known).alias(f"{name}_share") for name in sets]


def category_values(df: DataFrame, category: str, most: int = 1000) -> list[str]:
    """The categories there are, for a wide mix; ValueError beyond ``most``, as each becomes a column."""
    found = [r[0] for r in df.select(category).filter(F.col(category).isNotNull()).distinct().orderBy(category).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} categories; use the long form")
    return found


def mix_wide(df: DataFrame, category: str, values: Sequence[str], prefix: str = "mix_") -> list[Column]:
    """Each category's share of the events that have one: 0 where it is absent, null where no event has a category."""
    return [F.try_divide(F.count_if(F.col(category) == v), F.count(category)).alias(f"{prefix}{v}") for v in values]


def mix_long(df: DataFrame, keys: Sequence[str], category: str) -> DataFrame:
    """keys, category, n, share, for any number of categories."""
    n = df.filter(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return n.select(*keys, category, "n", (F.col("n") / total).alias("share"))


def roll_up(events: DataFrame, keys: Sequence[str], measures: Iterable[Column], count: str = "event_count") -> DataFrame:
    """One row per key; rows with a null key are dropped first. measures: what the helpers above return."""
    require(events, *keys)
    known = events.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *measures)


def coalesce_measures(df: DataFrame, name: str, columns: Sequence[str]) -> list[Column]:
    """The first mean that is not null, of the columns there are; null of type double without any."""
    found = [F.avg(try_double(F.col(c))) for c in present(df, columns)]
    return [(F.coalesce(*found) if found else F.lit(None).cast("double")).alias(name)]


def first_entity(events: DataFrame, group: str, entity: str, order: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """group, first_entity: the entity of the first event in order, events without an order key last. ties: columns that settle the rest."""
    keys = [F.coalesce(try_double(F.col(c)), F.lit(float("inf"))) for c in present(events, order)]
    at = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)], F.col(entity).alias("e"))
    return events.filter(F.col(entity).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.min_by(entity, at).alias("first_entity"))


def flag_starts(outings: DataFrame, firsts: DataFrame, group: str, entity: str, name: str = "is_start") -> DataFrame:
    """1 where the outing's entity was the first of its group, else 0."""
    return outings.join(firsts, group, "left").withColumn(name, F.coalesce((F.col("first_entity") == F.col(entity)).cast("int"), F.lit(0))).drop("first_entity")


def rest_days(outings: DataFrame, entity: str, day: str, ties: Sequence[str] = (), name: str = "rest_days") -> DataFrame:
    """Days since the entity's outing before."""
    w = Window.partitionBy(entity).orderBy(day, *ties)
    return outings.withColumn(name, F.datediff(F.col(day), F.lag(day).over(w)))


def only_starts(outings: DataFrame, entity: str, day: str, flag: str = "is_start", count: str = "event_count", least: int = 1, ties: Sequence[str] = ()) -> DataFrame:
    """Starts with enough events; rest is counted anew between those."""
    if least < 1:
        raise ValueError("least must be 1 or more")
    require(outings, entity, day, flag, count)
    return rest_days(outings.filter((F.col(flag) == 1) & (F.col(count) >= least)), entity, day, ties)


def only_relief(outings: DataFrame, flag: str = "is_start") -> DataFrame:
    require(outings, flag)
    return outings.filter(F.coalesce(F.col(flag), F.lit(0)) != 1)


def of_kind(events: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose value, whatever its case, is this one; null rows go."""
    require(events, column)
    return events.filter(F.upper(F.col(column)) == value.upper())


def with_age(outings: DataFrame, bio: DataFrame | None, entity: str, day: str, birth: str = "birth_date", name: str = "age") -> DataFrame:
    """Years since birth; null without a table of births."""
    if bio is None:
        return outings.withColumn(name, F.lit(None).cast("double"))
    known = bio.select(F.col(entity), try_date(F.col(birth)).alias("_birth"))
    return outings.join(known, entity, "left").withColumn(name, age_years(F.col(day), F.col("_birth"))).drop("_birth")
