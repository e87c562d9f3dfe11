"""Parsers for logged model replies, as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.settings import LARGE, MEDIUM, SMALL

# Where a reply states its confidence, in order of precedence.  Blanks, digits and word characters
# are those of Unicode; a number stands alone if no letter, digit or underscore touches it.
NUMBER = r"(\p{Nd}+\.?\p{Nd}*)"
STATED_CONFIDENCE = rf"(?U)confidence[:\s\x1c-\x1f]+{NUMBER}"
PERCENTAGE = f"{NUMBER}%"
BARE_NUMBER = rf"(?<![\p{{L}}\p{{N}}_]){NUMBER}(?![\p{{L}}\p{{N}}_])"

_DIGITS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_FROM, _TO = "".join(_DIGITS), "".join(str(unicodedata.digit(c)) for c in _DIGITS)


def parse_verdict(reply: Column) -> Column:
    """Class named in a judge's reply; ``small`` wins over ``medium`` over ``large``."""
    said = F.upper(reply)
    return (
        F.when(said.contains("SMALL"), SMALL)
        .when(said.contains("MEDIUM"), MEDIUM)
        .when(said.contains("LARGE"), LARGE)
    )


def _number(text: Column, pattern: str) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.translate(found, _FROM, _TO).try_cast("double")


def _as_share(value: Column) -> Column:
    return F.when(value > 1, value / 100).otherwise(value)


def stated_number(reply: Column) -> Column:
    """The number after the word confidence."""
    return _number(F.lower(reply), STATED_CONFIDENCE)


def percentage(reply: Column) -> Column:
    """The first number before a percent sign."""
    return _number(reply, PERCENTAGE)


def bare_number(reply: Column) -> Column:
    """The first number that stands alone."""
    return _number(reply, BARE_NUMBER)


def confidence_of(stated: Column, percent: Column, bare: Column) -> Column:
    """Confidence from the numbers found, or NULL.

    An explicit statement counts first, then a percentage, then a bare number if it lies between
    0 and 100.
    """
    plausible = F.when(bare.between(0, 100), _as_share(bare))
    return F.coalesce(_as_share(stated), percent / 100, plausible)


def reply_confidence(reply: Column) -> Column:
    return confidence_of(stated_number(reply), percentage(reply), bare_number(reply))


def reply_sentiment(reply: Column) -> Column:
    said = F.lower(reply)
    return (
        F.when(said.contains("positive"), "POSITIVE")
        .when(said.contains("negative"), "NEGATIVE")
        .when(said.contains("neutral"), "NEUTRAL")
    )


def verdict_of(label: Column, confidence: Column) -> dict[str, Column]:
    """``label``, ``confidence`` and ``ok``; a reply that lacks either part is not ok."""
    ok = label.isNotNull() & confidence.isNotNull()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return {
        "label": F.when(ok, label).otherwise("NEUTRAL"),
        "confidence": F.when(ok, clamped).otherwise(0.0),
        "ok": ok,
    }


def parse_reply(reply: Column) -> Column:
    """Struct (label, confidence, ok) of a reply."""
    parts = verdict_of(reply_sentiment(reply), reply_confidence(reply))
    return F.struct(*[c.alias(name) for name, c in parts.items()])
