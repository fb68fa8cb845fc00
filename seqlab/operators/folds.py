"""Rolling-origin folds: train on the years before, test on the next one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nullify, tertile
from .quantiles import exact_quantiles


def fold_table(df: DataFrame, day: str, folds: Sequence[int], start: int) -> DataFrame:
    """Each row once for every fold it belongs to, with ``fold`` and ``split``: train from the start year, test in the fold's year.

    The folds of a row are told by its year, so there is no join at all.
    """
    y = F.year(day)
    rows = df.filter(y >= start).withColumn("fold", F.explode(F.array(*[F.lit(f) for f in sorted(folds)]))).filter(y <= F.col("fold"))
    return rows.withColumn("split", F.when(y == F.col("fold"), "test").otherwise("train"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which all these numbers are finite."""
    kind = dict(df.dtypes)
    clean = df.withColumns({c: nullify(F.col(c)) for c in columns if kind[c] in ("double", "float")})
    return clean.dropna(subset=list(columns))


def guard_development(df: DataFrame, day: str, end: int) -> DataFrame:
    """df itself; reading a row after the last development year fails."""
    late = F.raise_error(F.concat(F.lit("a row of "), F.year(day).cast("string"), F.lit(f" must not be seen before {end} is over"))).cast("boolean")
    return df.filter(F.when(F.year(day) > end, late).otherwise(F.lit(True)))


def guard_folds(rows: DataFrame, day: str, fold: str = "fold") -> DataFrame:
    """rows of folds; reading a training row of the fold's year or later, or a test row of another year, fails."""
    y = F.year(day)
    wrong = F.when(F.col("split") == "train", y >= F.col(fold)).otherwise(y != F.col(fold))
    leak = F.raise_error(F.concat(F.lit("a "), F.col("split"), F.lit(" row of "), y.cast("string"), F.lit(" in the fold of "), F.col(fold).cast("string"))).cast("string")
    # in the column itself: beside a filter by split, a guard would be tried with that filter's split on rows of the other one
    return rows.withColumn("split", F.when(F.coalesce(wrong, F.lit(True)), leak).otherwise(F.col("split"))).filter(F.col("split").isNotNull())


def thresholds(folds: DataFrame, keys: Sequence[str], target: str, least: int = 20) -> DataFrame:
    """keys, q33, q67, n_train: exact thirds of the training target, of keys with enough training rows. No task holds a key's values."""
    train = exact_quantiles(folds.filter(F.col("split") == "train"), keys, target, (1 / 3, 2 / 3))
    return train.filter(F.col("n") >= least).select(*keys, F.col("quantiles")[0].alias("q33"), F.col("quantiles")[1].alias("q67"), F.col("n").alias("n_train"))


def with_classes(folds: DataFrame, limits: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Rows of keys that have thresholds, with q33, q67 and true_class."""
    return folds.join(limits.select(*keys, "q33", "q67"), list(keys)).withColumn("true_class", tertile(F.col(target), F.col("q33"), F.col("q67")))


def majority(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, majority_class: the most frequent class among training rows, the lowest of equals."""
    n = rows.filter(F.col("split") == "train").groupBy(*keys, "true_class").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by("true_class", F.struct("n", -F.col("true_class"))).alias("majority_class"))


def baselines(rows: DataFrame, keys: Sequence[str], spans: Sequence[int], prior: str = "prior", carry: Sequence[str] = ()) -> DataFrame:
    """Test rows in long form, one for each model: ewma<s>, prior, majority (its score is null)."""
    test = rows.filter(F.col("split") == "test").join(majority(rows, keys), list(keys))
    scored = [F.struct(F.lit(f"ewma{s}").alias("model"), F.col(f"ewma{s}").alias("score"), tertile(F.col(f"ewma{s}"), F.col("q33"), F.col("q67")).alias("predicted_class")) for s in spans]
    scored.append(F.struct(F.lit("prior").alias("model"), F.col(prior).cast("double").alias("score"), tertile(F.col(prior), F.col("q33"), F.col("q67")).alias("predicted_class")))
    scored.append(F.struct(F.lit("majority").alias("model"), F.lit(None).cast("double").alias("score"), F.col("majority_class").alias("predicted_class")))
    return test.select(*keys, *carry, "true_class", F.inline(F.array(*scored)))
