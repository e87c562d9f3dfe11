"""Complexity labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.functions import text as tx
from promptroute.settings import LABELS, LARGE, LONG_TOKENS, MAIN, MATH_SOURCE, MEDIUM, SMALL, Lexicon


def gold_label(choice: Column, score: Column) -> Column:
    """Class of a human routing choice; an unknown score counts as high."""
    return (
        F.when(choice == "small model", SMALL)
        .when((choice == "big model") & (score <= 2), MEDIUM)
        .when(choice == "big model", LARGE)
        .otherwise(MEDIUM)
    )


def reasoning_cue(text: str, lowered: str, lex: Lexicon = MAIN) -> Column:
    """Does the prompt ask for reasoning?  Not looked up in long prompts, which are large anyway.

    ``text`` and ``lowered`` are the names of columns, here and below.
    """
    return (tx.token_count(F.col(text)) <= LONG_TOKENS) & tx.has_multi_step(lowered, lex)


def is_demanding(text: str, lowered: str, reasoning: Column, lex: Lexicon = MAIN) -> Column:
    """Reasoning, code blocks or mathematics; likewise not looked up in long prompts."""
    signs = reasoning | tx.has_code_blocks(F.col(text), lex) | tx.has_math(text, lowered, lex)
    return (tx.token_count(F.col(text)) <= LONG_TOKENS) & signs


def math_label(text: str, reasoning: Column, lex: Lexicon = MAIN) -> Column:
    short = tx.token_count(F.col(text)) < 40
    if lex.math_reads_reasoning:
        short = short & ~reasoning
    return F.when(short, MEDIUM).otherwise(LARGE)


def chat_label(text: str, lowered: str, demanding: Column, lex: Lexicon = MAIN) -> Column:
    """Label of a chat prompt.  The first branch that holds decides.

    Cheap length tests stand first in every conjunction: ``And`` stops at the first
    false operand, so long prompts skip the word lists of the short-prompt branches.
    """
    tokens = tx.token_count(F.col(text))
    trivial = (tokens < 30) & ~(demanding | tx.has_code(lowered, lex))
    long = tokens > LONG_TOKENS
    if lex.many_questions is not None:
        long = long | (tx.question_count(F.col(text)) >= lex.many_questions)
    return (
        F.when((tokens < 50) & tx.is_simple(text, lowered, lex), SMALL)
        .when(trivial, SMALL)
        .when(long | demanding, LARGE)
        .otherwise(MEDIUM)
    )


def heuristic_label(
    text: str,
    lowered: str,
    source: Column,
    reasoning: Column,
    demanding: Column,
    lex: Lexicon = MAIN,
) -> Column:
    return F.when(source == MATH_SOURCE, math_label(text, reasoning, lex)).otherwise(
        chat_label(text, lowered, demanding, lex)
    )


def label_id(label: Column) -> Column:
    """small, medium, large as 0, 1, 2; NULL for anything else."""
    expr = F.lit(None).cast("int")
    for i, name in enumerate(LABELS):
        expr = F.when(label == name, i).otherwise(expr)
    return expr


def id_label(number: Column) -> Column:
    expr = F.lit(None).cast("string")
    for i, name in enumerate(LABELS):
        expr = F.when(number == i, name).otherwise(expr)
    return expr


def stratum(label: Column, source: Column) -> Column:
    """Stratification key; NULL if either part is."""
    return F.concat(label, F.lit("_"), source)
