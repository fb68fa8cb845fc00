"""Metrics of classes 0, 1, 2, agreement of two models, coefficient summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

CLASSES = (0, 1, 2)


def _n(true: int | None, pred: int | None) -> Column:
    cond = F.lit(True)
    if true is not None:
        cond = cond & (F.col("true_class") == true)
    if pred is not None:
        cond = cond & (F.col("predicted_class") == pred)
    return F.count_if(cond)


def metric_columns() -> list[Column]:
    """Aggregates over true_class and predicted_class.

    Balanced accuracy is the mean recall of the classes that occur in the truth; macro F1 the mean over classes that occur in truth or prediction,
    0 where neither precision nor recall is defined; ordinal MAE the mean distance of the classes.
    """
    recall = [F.try_divide(_n(c, c), _n(c, None)) for c in CLASSES]
    f1 = [F.try_divide(2 * _n(c, c), _n(c, None) + _n(None, c)) for c in CLASSES]  # null where the class occurs on neither side
    mean = lambda xs: F.try_divide(sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0)), sum((x.isNotNull().cast("int") for x in xs), F.lit(0)))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("true_class") == F.col("predicted_class")).cast("double")).alias("accuracy"),
        mean(recall).alias("balanced_accuracy"),
        mean(f1).alias("macro_f1"),
        F.avg(F.abs(F.col("true_class") - F.col("predicted_class")).cast("double")).alias("ordinal_mae"),
    ]


def metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(*metric_columns())


def metrics_by_sets(predictions: DataFrame, model: str, *within: str) -> DataFrame:
    """Metrics of each model, and of each model within each group, from one shuffle. Pooled rows have null groups and pooled = 1."""
    both = predictions.groupingSets([[model], [model, *within]], model, *within)
    return both.agg(F.grouping(within[0]).cast("int").alias("pooled"), *metric_columns())


def confusion(predictions: DataFrame, model: str) -> DataFrame:
    """model, true_class, pred_0, pred_1, pred_2; all three true classes of every model, zeros kept."""
    counts = predictions.groupBy(model).agg(*[F.array(*[_n(t, p) for p in CLASSES]).alias(f"r{t}") for t in CLASSES])
    rows = F.array(*[F.struct(F.lit(t).alias("true_class"), *[F.col(f"r{t}")[p].alias(f"pred_{p}") for p in CLASSES]) for t in CLASSES])
    return counts.select(model, F.inline(rows))


def stability(fold_metrics: DataFrame, keys: Sequence[str], penalty: float = 0.5) -> DataFrame:
    """Across folds: mean and population deviation of balanced accuracy, their score, mean F1 and MAE."""
    m, s = F.avg("balanced_accuracy"), F.stddev_pop("balanced_accuracy")
    return fold_metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), m.alias("mean_balanced_accuracy"), s.alias("std_balanced_accuracy"), (m - penalty * s).alias("stability_score"), F.avg("macro_f1").alias("mean_macro_f1"), F.avg("ordinal_mae").alias("mean_ordinal_mae")
    )


def side_by_side(predictions: DataFrame, keys: Sequence[str], model: str, first: str, second: str) -> DataFrame:
    """One row per key with both models' classes and models_agree; reading it fails if a key repeats within a model."""
    pair = predictions.filter(F.col(model).isin(first, second))
    at_most_once = lambda m: F.count_if(F.col(model) == m) <= 1
    of = lambda m: F.max(F.when(F.col(model) == m, F.col("predicted_class")))
    wide = pair.groupBy(*keys).agg(F.max("true_class").alias("true_class"), of(first).alias("first_class"), of(second).alias("second_class"), (at_most_once(first) & at_most_once(second)).alias("_once"))
    refused = F.raise_error(F.lit("a key has more than one prediction of a model")).cast("int")
    wide = wide.withColumn("first_class", F.when(F.col("_once"), F.col("first_class")).otherwise(refused)).drop("_once")
    return wide.filter("first_class is not null and second_class is not null").withColumn("models_agree", F.col("first_class") == F.col("second_class"))


def agreement(wide: DataFrame) -> DataFrame:
    """One row: n, n_agree, agreement_rate, accuracy where they agree, each model's where they do not."""
    agree = F.col("models_agree")
    right = lambda c: (F.col(c) == F.col("true_class")).cast("double")
    return wide.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(agree).alias("n_agree"),
        F.avg(agree.cast("double")).alias("agreement_rate"),
        F.avg(F.when(agree, right("first_class"))).alias("accuracy_agree"),
        F.avg(F.when(~agree, right("first_class"))).alias("first_accuracy_disagree"),
        F.avg(F.when(~agree, right("second_class"))).alias("second_accuracy_disagree"),
    )


def coefficient_summary(coefficients: DataFrame, feature: str = "feature", value: str = "coefficient") -> DataFrame:
    """Per feature: n, median, mean, quartiles, share above zero, median of the absolute values. A feature has as many values as there are fits, so its
    quantiles are selected, not gathered."""
    rows = coefficients.select(F.col(feature).alias("feature"), F.inline(F.array(F.struct(F.lit(False).alias("_abs"), F.col(value).alias("_c")), F.struct(F.lit(True).alias("_abs"), F.abs(F.col(value)).alias("_c")))))
    q = exact_quantiles(rows, ["feature", "_abs"], "_c", (0.25, 0.5, 0.75))
    plain = coefficients.groupBy(F.col(feature).alias("feature")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"))
    of = lambda absolute, i: F.max(F.when(F.col("_abs") == absolute, F.col("quantiles")[i]))
    wide = q.groupBy("feature").agg(of(False, 1).alias("median"), of(False, 0).alias("q25"), of(False, 2).alias("q75"), of(True, 1).alias("median_abs"))
    return plain.join(wide, "feature", "left").select(F.col("feature").alias(feature), "n", "median", "mean", "q25", "q75", "share_positive", "median_abs")
