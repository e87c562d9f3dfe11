"""Quality of predictions.  Every figure is derived from the nine cells of the confusion matrix,
so one combined count over the predictions is the only pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.settings import LABELS

TRUE, PREDICTED = "complexity_label", "predicted"


def confusion(df: DataFrame, true: str = TRUE, predicted: str = PREDICTED) -> DataFrame:
    """``(true_label, predicted_label, n)``, all nine cells, zeros included.

    The empty cells are added to the few counts and summed away, which needs no join.
    """
    counts = df.groupBy(
        F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")
    ).agg(F.count("*").alias("n"))
    cells = [
        F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"))
        for t in LABELS
        for p in LABELS
    ]
    empty = (
        df.sparkSession.range(1)
        .select(F.inline(F.array(*cells)))
        .withColumn("n", F.lit(0).cast("long"))
    )
    known = F.col("true_label").isin(*LABELS) & F.col("predicted_label").isin(*LABELS)
    return (
        counts.filter(known)
        .unionByName(empty)
        .groupBy("true_label", "predicted_label")
        .agg(F.sum("n").alias("n"))
    )


def _ratio(part, whole):
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from ``confusion``."""
    # Each cell counts once for its true class and once for its predicted class.
    roles = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(True).alias("is_true")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(False).alias("is_true")),
    )
    hit = (F.col("true_label") == F.col("predicted_label")) & F.col("is_true")
    sums = (
        cells.select("*", F.inline(roles))
        .groupBy("label")
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("_hits"),
            F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("is_true"), 0).otherwise(F.col("n"))).alias("_claimed"),
        )
    )
    precision = _ratio(F.col("_hits"), F.col("_claimed"))
    recall = _ratio(F.col("_hits"), F.col("support"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), "support").select(
        "label",
        "precision",
        "recall",
        _ratio(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ).alias("f1"),
        "support",
    )


def metrics(cells: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro F1, weighted F1, from ``confusion``."""
    right = F.sum(F.col("recall") * F.col("support"))
    return per_class(cells).agg(
        F.sum("support").alias("n"),
        _ratio(right, F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
    )


def verdict(cells: DataFrame) -> DataFrame:
    """One row: accuracy, a grade, the spread of the class F1s and whether it is too wide."""
    right = F.sum(F.col("recall") * F.col("support"))
    summary = per_class(cells).agg(
        _ratio(right, F.sum("support")).alias("accuracy"), F.stddev_pop("f1").alias("f1_std")
    )
    grade = (
        F.when(F.col("accuracy") < 0.7, "warning")
        .when(F.col("accuracy") >= 0.85, "excellent")
        .when(F.col("accuracy") >= 0.75, "good")
        .otherwise("moderate")
    )
    return summary.select(
        "accuracy", grade.alias("grade"), "f1_std", (F.col("f1_std") > 0.1).alias("imbalanced")
    )


def split_report(df: DataFrame, label: str = TRUE) -> DataFrame:
    """Rows per split and class."""
    return df.groupBy("split", label).agg(F.count("*").alias("n"))


def evaluation_report(cells: DataFrame) -> DataFrame:
    """Everything as one row of nested columns, ready to be written as JSON.

    Reads the nine cells several times: pass a written table, not a plan that counts anew.
    """
    matrix = cells.agg(
        F.array_sort(F.collect_list(F.struct("true_label", "predicted_label", "n"))).alias(
            "confusion_matrix"
        )
    )
    classes = per_class(cells).agg(
        F.array_sort(
            F.collect_list(F.struct("label", "precision", "recall", "f1", "support"))
        ).alias("classification_report")
    )
    return metrics(cells).select(
        "*",
        matrix.scalar().alias("confusion_matrix"),
        classes.scalar().alias("classification_report"),
    )
