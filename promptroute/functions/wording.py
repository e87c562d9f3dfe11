"""Readable explanations and request texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.functions.text import token_count
from promptroute.settings import JUDGE_PROMPT_CHARS, LARGE, MEDIUM, SMALL

JUDGE_TEMPLATE = """Judge how demanding a prompt is, so that it can be sent to a model of fitting size.

SMALL: a model of 1-2B parameters will do. Lookups, definitions, short translations, simple rewording, one step of reasoning.
MEDIUM: a model of 3-4B parameters is needed. Summaries, everyday code questions, writing with some constraints, two or three steps of reasoning.
LARGE: a model of 7B parameters or more is needed. Proofs, long chains of reasoning, architecture or larger code, expert knowledge, open problems.

The prompt:
"{prompt}"

Reply with one word: SMALL, MEDIUM or LARGE"""

SENTIMENT_TEMPLATE = """State the sentiment of a text in exactly two lines and nothing else:

Sentiment: POSITIVE, NEGATIVE or NEUTRAL
Confidence: a number from 0 to 100

The text: "{text}\""""


def fill(template: str, slot: str, value: Column) -> Column:
    """``template`` with ``slot`` replaced by the column (concat, so no regex escapes)."""
    before, after = template.split(slot)
    return F.concat(F.lit(before), value, F.lit(after))


def judge_text(prompt: Column, template: str = JUDGE_TEMPLATE) -> Column:
    return fill(template, "{prompt}", F.substring(prompt, 1, JUDGE_PROMPT_CHARS))


def sentiment_text(prompt: Column, template: str = SENTIMENT_TEMPLATE) -> Column:
    return fill(template, "{text}", prompt)


def percent(share: Column) -> Column:
    """Whole percent, rounded half to even."""
    return F.format_string("%d%%", F.bround(share * 100).cast("int"))


def _one_of(label: Column, small: str, medium: str, large: str) -> Column:
    return F.when(label == SMALL, small).when(label == MEDIUM, medium).when(label == LARGE, large)


def explain_route(
    complexity: Column, confidence: Column, prompt: Column, override: Column
) -> Column:
    """Why a prompt got its class; clauses that do not apply are left out."""
    tokens = token_count(prompt)
    small, medium, large = (complexity == c for c in (SMALL, MEDIUM, LARGE))
    return F.concat_ws(
        " • ",
        F.when(override, "Raised by rules"),
        _one_of(
            complexity,
            "Simple task, a small model (1-2B) is enough",
            "Moderate task, a medium model (3-4B) is needed",
            "Complex task, a large model (7B+) is needed",
        ),
        F.when(small & (confidence > 0.9), "Clearly a simple prompt"),
        F.when(small & (tokens < 50), "Short prompt"),
        F.when(medium & (tokens > 100), "Some context to read"),
        F.when(medium, "A few steps or some code"),
        F.when(large & (tokens > 200), "Long and detailed prompt"),
        F.when(large & (confidence > 0.85), "Clearly a complex prompt"),
        F.when(large, "Many steps, mathematics or demanding code"),
        F.when(
            confidence < 0.7,
            F.concat(F.lit("Only "), percent(confidence), F.lit(" sure, consider a fallback")),
        ),
    )


def explain_choice(
    complexity: Column, confidence: Column, model_name: Column, size_gb: Column
) -> Column:
    """Why a model was chosen."""
    return F.concat_ws(
        " | ",
        F.coalesce(
            _one_of(
                complexity,
                "Simple task: small model for efficiency",
                "Moderate task: medium model for balance",
                "Complex task: large model for quality",
            ),
            F.lit("Unknown complexity"),
        ),
        F.when(confidence > 0.9, F.concat(F.lit("Confidence high ("), percent(confidence), F.lit(")"))).when(
            confidence < 0.7,
            F.concat(F.lit("Confidence low ("), percent(confidence), F.lit("), watch quality")),
        ),
        F.concat(
            F.lit("Selected: "),
            model_name,
            F.format_string(" (%.1fGB)", F.coalesce(size_gb, F.lit(0.0))),
        ),
    )
