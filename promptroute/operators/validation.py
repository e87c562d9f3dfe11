"""Does the small model do for prompts routed to it?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptroute.settings import LABELS, SMALL


def validation_table(predictions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Predictions ``(prompt_id, true_label, predicted, confidence)`` beside the comparison.

    Only prompts predicted small have one; the columns are NULL for all others.
    """
    compared = comparisons.withColumnRenamed("prompt_id", "_id")
    matched = (F.col("prompt_id") == F.col("_id")) & (F.col("predicted") == SMALL)
    return predictions.join(compared, matched, "left").drop("_id")


def validation_report(table: DataFrame) -> DataFrame:
    """Long report ``(metric, item, value)``; a metric that does not apply is left out.

    One pass: the table is reduced to one row per predicted class, and the report is unfolded
    from those few rows, the overall figures from the first of them.
    """
    tested = F.col("equivalent_quality").isNotNull()
    per_class = table.groupBy("predicted").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("true_label") == F.col("predicted")).alias("right"),
        F.count_if(tested).alias("tested"),
        F.count_if(F.col("equivalent_quality")).alias("equivalent"),
        F.avg(F.when(tested, F.col("energy_saved_pct"))).alias("saved_pct"),
        F.avg("confidence").alias("confidence"),
    )
    classes = Window.partitionBy()
    per_class = per_class.select(
        "*",
        F.sum("n").over(classes).alias("all"),
        F.sum("right").over(classes).alias("all_right"),
        (F.row_number().over(classes.orderBy("predicted")) == 1).alias("first"),
    )

    def line(metric: str, value: Column, item: Column | None = None) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            (F.lit(None).cast("string") if item is None else item).alias("item"),
            value.cast("double").alias("value"),
        )

    first, known = F.col("first"), F.col("predicted").isin(*LABELS)
    compared = (F.col("predicted") == SMALL) & (F.col("tested") > 0)
    rate = F.col("equivalent") / F.nullif(F.col("tested"), F.lit(0))
    lines = F.array(
        line("total_prompts", F.when(first, F.col("all"))),
        line("classifier_accuracy", F.when(first, F.col("all_right") / F.col("all"))),
        line("count", F.when(known, F.col("n")), F.col("predicted")),
        line("avg_confidence", F.when(known, F.col("confidence")), F.col("predicted")),
        line("total_routed", F.when(compared, F.col("n"))),
        line("total_tested", F.when(compared, F.col("tested"))),
        line("equivalent_quality_rate", F.when(compared, rate)),
        line("avg_energy_saved_pct", F.when(compared, F.col("saved_pct"))),
    )
    return per_class.select(F.inline(lines)).filter(F.col("value").isNotNull())
