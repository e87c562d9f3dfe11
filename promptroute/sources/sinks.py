"""Writers of corpora, tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

CSV_COLUMNS = ("prompt", "source_dataset", "complexity_label", "llm_judge_label")
# Prompts hold line breaks, quotes and outer blanks: quote every field, double inner quotes and
# keep blanks, which Spark's CSV writer trims by default.
CSV_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), compact: bool = False
) -> None:
    """Overwrite ``path``; partition columns let later scans prune by source or class.

    Every task writes a file per partition value it holds.  ``compact`` shuffles the rows to
    few files of even size instead, splitting a value that holds much of the table.
    """
    if compact:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = CSV_COLUMNS) -> None:
    """Overwrite ``path`` with the given columns (those ``df`` has), or with all of them."""
    kept = df if columns is None else df.select(*[c for c in columns if c in df.columns])
    kept.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with one JSON object per row."""
    df.write.mode("overwrite").json(path)
