"""Tables for the operators' tests."""

from pyspark.sql import DataFrame, SparkSession


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def documents(spark: SparkSession, texts: list) -> DataFrame:
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")


def by_id(df: DataFrame, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
