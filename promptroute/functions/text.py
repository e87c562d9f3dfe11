"""Text features as column expressions.

Everything is a built-in expression inside whole-stage codegen: no Python runs
per row, and no higher-order function, which would end the codegen span.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.settings import MAIN, WHITESPACE_CHARS, Lexicon

# The same characters as a Java pattern.  Far faster than a class that lists them: (?U) makes \s
# one test of the character's category; only the four separators \x1c-\x1f are not in it.
WHITESPACE = r"(?U)[\s\x1c-\x1f]"
_INDENTED_LINE = r"(?U)\n[\s\x1c-\x1f]{4}"


def strip(text: Column) -> Column:
    """``text`` without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def present(text: Column) -> Column:
    """``text`` with NULL as the empty string.

    Word lists are looked up in a column that cannot be NULL: the generated code then has no
    NULL checks between the words, and the loop stays small enough for the JIT compiler.
    """
    return F.coalesce(text, F.lit(""))


def literal(value: str) -> str:
    """``value`` as a SQL string literal; raw, so that backslashes need no escape."""
    quoted = value.replace("'", "''")
    return f"r'{quoted}'" if "\\" in value else f"'{quoted}'"


def _without_implied(words: Iterable[str]) -> list[str]:
    """Drop words that contain another word of the list: for an any-test they add nothing."""
    words = list(dict.fromkeys(words))
    return [w for w in words if not any(o != w and o in w for o in words)]


# The lookups of word lists and separators are written as one SQL expression over ``text``, a column name or
# itself an expression: one call to the JVM instead of several per word.


def any_hit(text: str, words: Iterable[str]) -> Column:
    """True if any word occurs anywhere in ``text`` (substring, not word, matching)."""
    lookups = [f"contains({text}, {literal(w)})" for w in _without_implied(words)]
    return F.expr(" OR ".join(lookups) or "false")


def count_hits(text: str, words: Iterable[str]) -> Column:
    """How many distinct words of the list occur in ``text``."""
    return F.expr(" + ".join(f"CAST(contains({text}, {literal(w)}) AS INT)" for w in words) or "0")


def starts_with_any(text: str, words: Iterable[str]) -> Column:
    return F.expr(" OR ".join(f"startswith({text}, {literal(w)})" for w in words) or "false")


def word_count(text: str, exact_to: int | None = None) -> Column:
    """Number of whitespace-separated words.

    With ``exact_to`` counting ends soon after that many words: the result is exact up to it, and
    some larger number for every longer text, so a comparison with any number up to it comes out
    the same.
    """
    # Three pieces more than words: the rest of the text, and an empty piece at either end.
    limit = -1 if exact_to is None else exact_to + 4
    column = F.expr(text)
    pieces = F.size(F.split(column, f"{WHITESPACE}+", limit))
    opens = F.substring(column, 1, 1).rlike(WHITESPACE).cast("int")
    # Taking the last character would walk through the whole text.
    closes = F.expr(" OR ".join(f"endswith({text}, {literal(c)})" for c in WHITESPACE_CHARS))
    return F.when(column == "", 0).otherwise(pieces - opens - closes.cast("int"))


def char_count(text: Column) -> Column:
    return F.length(text)


def token_count(text: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded down."""
    return F.shiftright(F.length(text), 2)


def question_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))


def has_code_blocks(text: Column, lex: Lexicon = MAIN) -> Column:
    fenced = text.contains("```")
    return fenced | text.rlike(_INDENTED_LINE) if lex.indented_code else fenced


def has_multi_step(lowered: str, lex: Lexicon = MAIN) -> Column:
    return any_hit(lowered, lex.reasoning)


def has_math(text: str, lowered: str, lex: Lexicon = MAIN) -> Column:
    """Symbols are looked up in the raw text, words in the lower-cased text."""
    return any_hit(text, lex.symbols) | any_hit(lowered, lex.math_words)


def has_code(lowered: str, lex: Lexicon = MAIN) -> Column:
    return any_hit(lowered, lex.code)


def is_simple(text: str, lowered: str, lex: Lexicon = MAIN) -> Column:
    """A lookup phrase within the first 50 characters (of a short prompt)."""
    phrase = any_hit(f"substring({lowered}, 1, 50)", lex.simple)
    if lex.simple_max_chars is None:
        return phrase
    return (F.length(text) < lex.simple_max_chars) & phrase


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters, with ``...`` appended if something was cut."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)
