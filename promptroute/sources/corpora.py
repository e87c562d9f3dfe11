"""Prompt corpora: scans and the filters that turn raw records into prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptroute.functions.text import strip
from promptroute.operators.once import with_computed_once
from promptroute.operators.sampling import first_by_hash
from promptroute.settings import CHAT_SOURCE, GOLD_SOURCE, MATH_SOURCE, SEED


def read_corpus(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet scan with a given schema: no inference, and only the columns used are read."""
    return spark.read.schema(schema).parquet(path)


def _usable_chat(role: Column, content: Column, min_len: int, max_len: int) -> Column:
    """The stripped text of a user turn of fitting length, else NULL."""
    text = strip(content)
    return F.when((role == "user") & F.length(text).between(min_len, max_len), text)


def _limited(df: DataFrame, key: str, limit: int | None, seed: int) -> DataFrame:
    return df if limit is None else first_by_hash(df, key, limit, seed=seed)


def chat_prompts(
    df: DataFrame,
    key: str = "row_key",
    lang: str | None = "English",
    min_len: int = 10,
    max_len: int = 2000,
    limit: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Opening user turns of chat records ``(key, language, conversation)``.

    Narrow: one scan that reads only the first element of each conversation.  ``limit``
    keeps that many prompts in hash order of ``key``.
    """
    if lang is not None:
        df = df.filter(F.col("language") == lang)
    opening = F.get("conversation", F.lit(0))
    usable = _usable_chat(opening["role"], opening["content"], min_len, max_len)
    kept = (
        with_computed_once(df.select(key, "conversation"), {"prompt": usable})
        .filter(F.col("prompt").isNotNull())
        .select(key, "prompt")
        .withColumn("source_dataset", F.lit(CHAT_SOURCE))
    )
    return _limited(kept, key, limit, seed)


def chat_prompts_from_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    lang: str | None = None,
    min_len: int = 10,
    max_len: int = 2000,
    limit: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """As ``chat_prompts`` for one row per turn: ``(conversation, turn, role, text)``.

    With ``lang`` only turns of that ``language`` count, a further column of ``df``.  One scan and one shuffle.  Text that cannot become a prompt is dropped before the
    aggregate, and the earliest turn is found per task first, so a conversation of any
    length sends one short row per task.
    """
    if lang is not None:
        df = df.filter(F.col("language") == lang)
    usable = _usable_chat(F.col("role"), F.col("text"), min_len, max_len)
    kept = (
        df.groupBy(conversation)
        .agg(F.min(F.struct("turn", usable.alias("prompt"))).alias("opening"))
        .select(conversation, F.col("opening.prompt").alias("prompt"))
        .filter(F.col("prompt").isNotNull())
        .withColumn("source_dataset", F.lit(CHAT_SOURCE))
    )
    return _limited(kept, conversation, limit, seed)


def qa_prompts(df: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Non-empty questions as prompts, with the answer kept beside them."""
    kept = df.withColumn("prompt", strip(F.coalesce(F.col(question), F.lit(""))))
    kept = kept.filter(F.length("prompt") > 0).withColumn("source_dataset", F.lit(MATH_SOURCE))
    if answer not in kept.columns:
        kept = kept.withColumn(answer, F.lit(""))
    drop = [] if question == "prompt" else [question]
    return kept.withColumn(answer, F.coalesce(F.col(answer), F.lit(""))).drop(*drop)


def gold_prompts(df: DataFrame) -> DataFrame:
    """A corpus with human labels, its columns brought to the engine's names."""
    out = df.withColumn("source_dataset", F.lit(GOLD_SOURCE)).withColumnRenamed("text", "prompt")
    if "label" in df.columns:
        out = out.withColumn("original_label", F.col("label"))
    return out
