"""Summary of a finished corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.operators.sampling import LABEL, SOURCE
from promptroute.session import materialise


def corpus_metadata(
    full: DataFrame, final: DataFrame, eval_set: DataFrame, judged: bool
) -> DataFrame:
    """One row: sizes, distribution maps and flags.  The final corpus is read once."""
    # Written: a row per source and class, read three times below.
    cells = materialise(final.groupBy(SOURCE, LABEL).agg(F.count("*").alias("_n")), "cells")

    def mix(col: str) -> DataFrame:
        counts = cells.filter(F.col(col).isNotNull()).groupBy(col).agg(F.sum("_n").alias("n"))
        return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))))

    original = full.agg(F.count("*")).scalar()
    return cells.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_samples")).select(
        "total_samples",
        mix(LABEL).scalar().alias("class_distribution"),
        mix(SOURCE).scalar().alias("source_distribution"),
        original.alias("original_size"),
        (F.col("total_samples") < original).alias("balancing_applied"),
        eval_set.agg(F.count("*")).scalar().alias("eval_set_size"),
        F.lit(judged).alias("llm_judge_used"),
    )


def metadata_lines(metadata: DataFrame) -> DataFrame:
    """The summary in long form: ``(item, value)`` as text."""

    def line(item, value):
        return F.struct(item.alias("item"), value.cast("string").alias("value"))

    def entries(col: str):
        return F.transform(
            F.map_entries(col),
            lambda e: line(F.concat(F.lit(f"{col}."), e["key"]), e["value"]),
        )

    plain = [c for c in metadata.columns if not c.endswith("_distribution")]
    return metadata.select(
        F.inline(
            F.concat(
                F.array(*[line(F.lit(c), F.col(c)) for c in plain]),
                entries("class_distribution"),
                entries("source_distribution"),
            )
        )
    )
