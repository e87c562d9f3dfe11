"""Labelling, combining and encoding corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.functions import labels as lb
from promptroute.functions import text as tx
from promptroute.operators.once import with_computed_once
from promptroute.settings import (
    ACADEMIC_WORDS,
    CODE_WORDS,
    DEPTH_WORDS,
    MAIN,
    MATH_SOURCE,
    PROOF_WORDS,
    REQUIREMENT_WORDS,
    SIMPLE_STARTS,
    STEP_WORDS,
    TECHNICAL_WORDS,
    Lexicon,
)

CORPUS_COLUMNS = ("prompt", "source_dataset", "complexity_label")


def _with_text(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``df`` with the prompt raw and lower-cased, computed once for all word lists."""
    text = tx.present(F.col(prompt))
    return with_computed_once(df, {"_text": text, "_lowered": F.lower(text)})


def heuristic_features(df: DataFrame, lex: Lexicon = MAIN, prompt: str = "prompt") -> DataFrame:
    """``df`` with the eight features the labeller looks at."""
    text, raw, lowered = F.col("_text"), "_text", "_lowered"
    return (
        _with_text(df, prompt)
        .select(
            *df.columns,
            tx.token_count(text).alias("token_count"),
            tx.char_count(text).alias("char_count"),
            tx.has_code_blocks(text, lex).alias("has_code_blocks"),
            tx.question_count(text).alias("question_count"),
            tx.has_multi_step(lowered, lex).alias("has_multi_step"),
            tx.has_math(raw, lowered, lex).alias("has_math"),
            tx.has_code(lowered, lex).alias("has_code"),
            tx.is_simple(raw, lowered, lex).alias("is_simple"),
        )
    )


def rule_features(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """``df`` with every feature of the rule layer, for reports.

    ``apply_rules`` does not use this: it computes a feature only where a rule needs it.
    """
    text, lowered = F.col("_text"), "_lowered"
    return (
        _with_text(df, prompt)
        .select(
            *df.columns,
            tx.word_count("_text").alias("word_count"),
            tx.any_hit(lowered, PROOF_WORDS).alias("proof_hit"),
            tx.count_hits(lowered, DEPTH_WORDS).alias("depth_count"),
            tx.count_hits(lowered, STEP_WORDS).alias("step_count"),
            tx.any_hit(lowered, CODE_WORDS).alias("code_hit"),
            tx.count_hits(lowered, REQUIREMENT_WORDS).alias("req_count"),
            tx.count_hits(lowered, TECHNICAL_WORDS).alias("tech_count"),
            tx.any_hit(lowered, ACADEMIC_WORDS).alias("academic_hit"),
            tx.starts_with_any(lowered, SIMPLE_STARTS).alias("simple_start"),
        )
    )


def label_gold(df: DataFrame) -> DataFrame:
    label = lb.gold_label(F.col("routing_choice"), F.col("complexity_score"))
    return df.withColumn("complexity_label", label)


def label_corpus(df: DataFrame, lex: Lexicon = MAIN) -> DataFrame:
    """``df`` with the heuristic label of each prompt; one narrow pass over the text."""
    text, lowered, source = "_text", "_lowered", F.col("source_dataset")
    reasoning, demanding = F.col("_reasoning"), F.col("_demanding")
    prompt = tx.present(F.col("prompt"))
    staged = df.select("*", prompt.alias("_text"), F.lower(prompt).alias("_lowered"))
    staged = staged.withColumn("_reasoning", lb.reasoning_cue(text, lowered, lex)).withColumn(
        "_demanding", lb.is_demanding(text, lowered, reasoning, lex) & ~source.eqNullSafe(MATH_SOURCE)
    )
    label = lb.heuristic_label(text, lowered, source, reasoning, demanding, lex)
    labelled = with_computed_once(staged, {"complexity_label": label})
    return labelled.drop("_text", "_lowered", "_reasoning", "_demanding")


def combine(*corpora: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bag union of labelled corpora, cut to the columns of a labelled corpus."""
    columns = [*keep, *CORPUS_COLUMNS]
    return reduce(DataFrame.unionByName, [c.select(*columns) for c in corpora])


def encode_labels(df: DataFrame) -> DataFrame:
    """``df`` with the numeric class ``label``."""
    return df.withColumn("label", lb.label_id(F.col("complexity_label")))
