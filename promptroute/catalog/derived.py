"""Engine tables derived from the given ones.

The given text hits few of the engine's keywords, so each prompt is a template, chosen by key,
in front of a whole text.  Labels, confidences, replies and errors are chosen by key as well.
``sql.py`` states the same tables in SQL.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.functions.text import literal
from promptroute.operators.responses import normalise_responses
from promptroute.operators.routing import model_registry
from promptroute.plans.corpus_build import KEY, label_and_combine
from promptroute.settings import CHAT_SOURCE, GOLD_SOURCE, LABELS, MATH_SOURCE, MODELS
from promptroute.sources.corpora import chat_prompts_from_turns, gold_prompts, qa_prompts

TEMPLATES = (
    "What is the capital of France?",
    "Prove that the theorem holds by induction.",
    "Write a Python function with error handling that should use logging, testing, validation, documentation and deployment.",
    "Explain in detail and analyze the implications step by step.",
    "First do this, then that, next several various things.",
    "Compare and contrast the research hypothesis.",
    "Translate",
    "List and define",
    "Solve for x = 3 + 4; calculate:\n    x",
    "How? Why? When?",
    "Create a class using code that must be complete",
    "Tell me about",
    "Implement code that should run",
)

REPLIES = (
    "Sentiment: POSITIVE\nConfidence: 85",
    "Confidence: 0.85, negative",
    "neutral 60%",
    "NEGATIVE 75",
    "not positive, 1",
    "positive 250",
    "positive",
    "confidence: 250 positive",
    "  Sentiment: NEUTRAL\nConfidence: 60  ",
    "negative",
    "no idea",
    "positive confidence:\u00a0150 then 20",
    "negative \u0668\u0665%",
    "neutral \u00e985 40",
    "positive confidence\u2003\uff19\uff15",
)

JUDGE_REPLIES = ("SMALL", " medium.", "LARGE", "That is Large", "SMALL or LARGE", "unsure")
UNLISTED_MODEL = "unlisted:1b"
EVENT_LABELS = {"click": "small", "signup": "small", "view": "medium", "error": "medium", "purchase": "large"}


# Schemas of the given tables: with them a scan starts without a job that reads file footers.
GIVEN = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    """The ``index``-th (from 0) of some constants: a lookup in the plan, not a join."""
    constants = F.expr(f"array({', '.join(map(literal, values))})")
    return F.element_at(constants, (index + 1).cast("int"))


def div(number: Column, by: int) -> Column:
    return F.floor(number / by)


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn and every document as a prompt: ``(prompt_id, n, prompt, source_dataset)``."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    n = F.col("n")
    opening = pick(TEMPLATES, n % len(TEMPLATES))
    chats = turns.select((F.col("conv_id") * 8 + F.col("turn")).alias("n"), "text").select(
        (n * 2).alias("prompt_id"),
        "n",
        F.concat(opening, F.repeat(F.concat(F.lit(" "), "text"), (n % 7).cast("int"))).alias("prompt"),
        pick((CHAT_SOURCE, MATH_SOURCE), div(n, 8) % 2).alias("source_dataset"),
    )
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("n"), "text").select(
        (n * 2 + 1).alias("prompt_id"),
        "n",
        F.concat(opening, F.lit(" "), F.col("text")).alias("prompt"),
        F.lit(GOLD_SOURCE).alias("source_dataset"),
    )
    return chats.unionByName(documents)


def _with_prediction(df: DataFrame, label: Column) -> DataFrame:
    """Given label and confidence; the other two classes share the rest of the probability."""
    shares = ", ".join(
        f"'{name}', if(predicted = '{name}', confidence, (1 - confidence) / 2)" for name in LABELS
    )
    return (
        df.withColumn("predicted", label)
        .withColumn("confidence", (F.col("n") % 49) / 100 + F.lit(0.5))
        .withColumn("all_probs", F.expr(f"map({shares})"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_prediction(workload(spark, sf_dir), pick(LABELS, div(F.col("n"), 96) % 3))


def labelled_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions beside a true label that differs from them by key."""
    truth = F.when(F.col("n") % 5 == 0, pick(LABELS, F.col("n") % 3)).otherwise(F.col("predicted"))
    return predictions(spark, sf_dir).withColumn("complexity_label", truth)


def event_predictions(events: DataFrame) -> DataFrame:
    """The event table (batch or stream) as predictions with an event time."""
    label = F.lit(None).cast("string")
    for kind, name in EVENT_LABELS.items():
        label = F.when(F.col("event_type") == kind, name).otherwise(label)
    n = F.col("event_id")
    prompts = events.select(
        n.alias("prompt_id"),
        n.alias("n"),
        F.concat_ws(" ", pick(TEMPLATES, n % len(TEMPLATES)), "event_type", "props").alias("prompt"),
        "event_type",
        F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")).alias("source_dataset"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return _with_prediction(prompts, label)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logged reply of every registered model, and one unlisted, to every prompt; some are tried twice."""
    ids = [m[0] for m in MODELS] + [UNLISTED_MODEL]
    n, number, attempt = F.col("n"), F.col("number").cast("long"), F.col("attempt")
    asked = workload(spark, sf_dir).select(
        "prompt_id", "n", F.posexplode(F.array(*[F.lit(i) for i in ids])).alias("number", "model")
    )
    tries = F.when((n + number) % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    tried = asked.select("*", F.explode(tries).alias("attempt"))
    failed = (n + number + attempt * 3) % 7 == 0
    reply = pick(REPLIES, (n * 5 + number * 3 + attempt * 4) % len(REPLIES))
    return tried.select(
        "prompt_id",
        "model",
        F.when(~failed, reply).alias("raw_response"),
        ((n * 31 + number * 17 + attempt * 5) % 997 + F.lit(0.5)).alias("latency_ms"),
        F.when(failed, F.when(n % 2 == 0, "Request timeout").otherwise("Connection refused")).alias("error"),
        "attempt",
    )


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_responses(responses(spark, sf_dir), model_registry(spark))


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each conversation: that of the document with its id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("conv_id"),
        F.when(F.col("lang") == "en", "English").otherwise(F.col("lang")).alias("language"),
    )


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested chat records: all turns of each conversation in order, as such records are given."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    talks = chat_turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    told = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    records = talks.select("conv_id", told.alias("conversation"))
    return records.join(languages(spark, sf_dir), "conv_id").withColumnRenamed("conv_id", "row_key")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("question"), F.length("text").cast("string").alias("answer")
    )


def gold_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a routing choice and a score, as a human would have given them."""
    d = F.col("doc_id")
    score = F.when(d % 11 != 0, (d % 9) * F.lit(0.5))
    choice = (
        F.when(F.col("toxic") == 1, "either model")
        .when(F.col("quality") == 1, "small model")
        .otherwise("big model")
    )
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "text")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            "doc_id",
            "text",
            choice.alias("routing_choice"),
            score.alias("complexity_score"),
            F.col("quality").alias("label"),
        )
    )


def chat_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_turns(spark, sf_dir).join(languages(spark, sf_dir), "conv_id")
    chats = chat_prompts_from_turns(turns, lang="English")
    return chats.withColumn(KEY, F.concat(F.lit("chat-"), "conv_id"))


def math_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = qa_prompts(questions(spark, sf_dir))
    return asked.withColumn(KEY, F.concat(F.lit("math-"), "item_id"))


def gold_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = gold_prompts(gold_records(spark, sf_dir))
    return gold.withColumn(KEY, F.concat(F.lit("gold-"), "doc_id"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three corpora, labelled and combined."""
    return label_and_combine(
        gold_corpus(spark, sf_dir), chat_corpus(spark, sf_dir), math_corpus(spark, sf_dir)
    )


def judge_replies(df: DataFrame) -> DataFrame:
    """What a judge said about each row of a corpus."""
    index = F.ascii(F.md5(KEY)) % len(JUDGE_REPLIES)
    return df.select(KEY, pick(JUDGE_REPLIES, index).alias("reply"))


def stream_folder(sf_dir: str, name: str) -> tuple[str, str]:
    """Folder and file pattern under which a table can be read as a stream.

    A table is a folder of files on a cluster, and may be a single file in a test.
    """
    path = f"{sf_dir}/{name}.parquet"
    if urlparse(path).scheme in ("", "file") and os.path.isfile(urlparse(path).path):
        return sf_dir, f"{name}.parquet"
    return path, "*.parquet"
