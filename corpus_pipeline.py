"""A training corpus from raw documents: good, unique, without repeats and benchmark text, encoded.

Every stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.llm import bpe, decontaminate, minhash, quality, repeats
from promptroute.llm.frames import table
from promptroute.llm.queries import vocabulary_path
from promptroute.session import materialise


#: Bytes of a passage that is removed where it repeats, and of its anchor.
PASSAGE_BYTES, ANCHOR_BYTES = repeats.PASSAGE, repeats.PASSAGE_ANCHOR


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all labelled ones among them, does not reject."""
    described = quality.with_statistics(docs.select("doc_id", "text")).select("doc_id", "statistics")
    labelled = quality.labelled_statistics(
        materialise(described, "statistics"), table(spark, sf_dir, "labels"), "doc_id", "quality"
    )
    return quality.keep_good(docs, quality.fit(labelled))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that stand in several places."""
    return _recounted(repeats.remove(docs, length=PASSAGE_BYTES, anchor=ANCHOR_BYTES))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are little else go."""
    return _recounted(decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, the number of them, and whether they decode to the text."""
    ids = bpe.encode(docs, vocabulary_path())
    back = bpe.decode(ids, vocabulary_path(), to="_decoded")
    same = F.col("_decoded") == F.coalesce("text", F.lit(""))
    return back.withColumns({"n_tokens": bpe.token_count(), "round_trip": same}).drop("_decoded")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", unique_documents),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: No stage but the last two could be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
