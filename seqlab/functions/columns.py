"""Column expressions: coercion, buckets, classes, hands, ages, moving averages. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *columns: str) -> None:
    """ValueError unless df has all these columns. Looks at the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def nullify(c: Column) -> Column:
    """NaN and infinities as null. Spark orders NaN above infinity, so one comparison catches both."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def try_double(c: Column) -> Column:
    """A number, or null where it is none."""
    return nullify(c.try_cast("double"))


def try_date(c: Column) -> Column:
    return c.try_cast("date")


def strict_date(c: Column) -> Column:
    """A date; null stays null, and reading a text that is no date fails."""
    found = try_date(c)
    return F.when(found.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("not a date: "), c.cast("string"))).cast("date")).otherwise(found)


def clean_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Every named column as a finite double or null."""
    return df.withColumns({c: try_double(F.col(c)) for c in columns})


def bucket(category: Column, sets: Mapping[str, Iterable[str]], other: str = "other") -> Column:
    """The name of the set that the upper-cased code is in; unknown and null codes are other."""
    out = None
    for name, codes in sets.items():
        hit = F.upper(category).isin(*[c.upper() for c in codes])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def tertile(score: Column, low: Column, high: Column) -> Column:
    """0 up to the lower threshold, 1 up to the higher, else 2; a missing score is 2."""
    return F.when(score <= low, 0).when(score <= high, 1).otherwise(2)


def same_side(a: Column, b: Column) -> Column:
    """1.0 where the first characters agree; two missing ones do."""
    return F.substring(a, 1, 1).eqNullSafe(F.substring(b, 1, 1)).cast("double")


def is_left(a: Column) -> Column:
    return F.coalesce(F.upper(F.substring(a, 1, 1)) == "L", F.lit(False)).cast("double")


def age_years(day: Column, birth: Column) -> Column:
    return F.datediff(day, birth) / F.lit(365.25)


def general_number(c: Column) -> Column:
    """A number as text without trailing zeros: 100, 0.5, 0.25."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c.cast("double")), "0+$", ""), r"\.$", "")
