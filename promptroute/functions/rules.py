"""The rule layer on top of a predicted label, as column expressions.

Every rule looks at the *predicted* label, never at the outcome of another rule, and
the last rule that fires decides.  Each rule is therefore one nullable column, and the
outcome is the last of them that is not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptroute.functions.text import any_hit, count_hits
from promptroute.settings import (
    ACADEMIC_WORDS,
    CODE_WORDS,
    DEPTH_WORDS,
    LARGE,
    LONG_FOR_ANY,
    LONG_FOR_SMALL,
    MEDIUM,
    OVERRIDE_CONFIDENCE_CAP,
    PROOF_WORDS,
    REQUIREMENT_WORDS,
    SMALL,
    STEP_WORDS,
    TECHNICAL_WORDS,
    VERY_LONG_FOR_SMALL,
)


def needed_features(
    lowered: str, words: Column, predicted: Column, probs: Column, every_rule: bool = True
) -> dict:
    """Word-list features, each computed only on rows where a rule can use it.

    No rule touches a prompt predicted large, so those rows skip every word list; length
    and label tests stand before the word lists for the same reason.

    Without ``every_rule`` only rules that can still decide are looked at.  A medium prompt of
    more than ``LONG_FOR_ANY`` words becomes large by its length, whatever else fires; for a small
    one of more than ``VERY_LONG_FOR_SMALL`` the length rule outweighs the proof rule and agrees
    with the depth rule, and beyond ``LONG_FOR_SMALL`` it outweighs the proof rule.
    """
    small, medium = predicted == SMALL, predicted == MEDIUM
    small_proof = small_depth = small
    open_to_raise = ~predicted.eqNullSafe(LARGE)
    if not every_rule:
        small_proof, small_depth = small & (words <= LONG_FOR_SMALL), small & (words <= VERY_LONG_FOR_SMALL)
        medium = medium & (words <= LONG_FOR_ANY)
        open_to_raise = small | (open_to_raise & (words <= LONG_FOR_ANY))
    medium_share = F.coalesce(F.try_element_at(probs, F.lit(MEDIUM)), F.lit(0.0))
    return {
        "proof_hit": (small_proof | (medium & (words > 20))) & any_hit(lowered, PROOF_WORDS),
        "depth_count": F.when(small_depth | medium, count_hits(lowered, DEPTH_WORDS)),
        "step_count": F.when(
            small & (words > 30) & (medium_share > 0.1), count_hits(lowered, STEP_WORDS)
        ),
        "code_hit": open_to_raise & any_hit(lowered, CODE_WORDS),
        "academic_hit": small & (words > 20) & any_hit(lowered, ACADEMIC_WORDS),
    }


def needed_code_features(lowered: str, words: Column, code_hit: Column) -> dict:
    """Features that matter only for prompts that ask for code."""
    return {
        "tech_count": F.when(code_hit, count_hits(lowered, TECHNICAL_WORDS)),
        "req_count": F.when(code_hit & (words > 15), count_hits(lowered, REQUIREMENT_WORDS)),
    }


def proof_rule(predicted: Column, words: Column, proof_hit: Column) -> Column:
    long_medium = (predicted == MEDIUM) & (words > 20)
    return F.when(proof_hit & ((predicted == SMALL) | long_medium), LARGE)


def length_rule(predicted: Column, words: Column) -> Column:
    small = predicted == SMALL
    return (
        F.when((words > LONG_FOR_ANY) & ~predicted.eqNullSafe(LARGE), LARGE)
        .when((words > VERY_LONG_FOR_SMALL) & small, LARGE)
        .when((words > LONG_FOR_SMALL) & small, MEDIUM)
    )


def depth_rule(predicted: Column, depth_count: Column) -> Column:
    enough = F.when(predicted == SMALL, 2).when(predicted == MEDIUM, 3)
    return F.when(depth_count >= enough, LARGE)


def steps_rule(predicted: Column, words: Column, probs: Column, step_count: Column) -> Column:
    share = F.coalesce(F.try_element_at(probs, F.lit(MEDIUM)), F.lit(0.0))
    applies = (predicted == SMALL) & (words > 30) & (share > 0.1)
    return F.when(applies & (step_count >= 3), MEDIUM)


def code_rule(
    predicted: Column, words: Column, code_hit: Column, tech_count: Column, req_count: Column
) -> Column:
    small, medium = predicted == SMALL, predicted == MEDIUM
    return (
        F.when(code_hit & (tech_count >= 5) & ~predicted.eqNullSafe(LARGE), LARGE)
        .when(code_hit & small & (words > 20) & (req_count >= 3), LARGE)
        .when(code_hit & medium & (words > 20) & (req_count >= 5), LARGE)
        .when(code_hit & small & (words > 15) & (req_count >= 2), MEDIUM)
    )


def academic_rule(predicted: Column, words: Column, academic_hit: Column) -> Column:
    return F.when(academic_hit & (words > 20) & (predicted == SMALL), MEDIUM)


def last_fired(outcomes: list[Column], predicted: Column) -> Column:
    return F.coalesce(*reversed(outcomes), predicted)


def fired_rules(outcomes: list[Column]) -> Column:
    """Numbers (from 1) of the rules that fired, in order."""
    marks = [F.when(r.isNotNull(), i).otherwise(0) for i, r in enumerate(outcomes, 1)]
    return F.array_remove(F.array(*marks), 0)


def capped_confidence(confidence: Column, override: Column) -> Column:
    """Confidence after the rules: an overridden label is never more than 85 % sure."""
    return F.when(override, F.least(confidence, F.lit(OVERRIDE_CONFIDENCE_CAP))).otherwise(
        confidence
    )
