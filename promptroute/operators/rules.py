"""The rule layer over a table of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.functions import rules as rl
from promptroute.functions.text import present, word_count
from promptroute.operators.once import with_computed_once
from promptroute.settings import LARGE, LONG_FOR_ANY

RULES = ("proof", "length", "depth", "steps", "code", "academic")


def apply_rules(
    df: DataFrame, every_rule: bool = True, keep_outcomes: bool = False
) -> DataFrame:
    """``(prompt, predicted, confidence, all_probs)`` plus the label after the rules.

    Adds ``complexity``, ``rule_override``, ``fired_rules`` and the capped ``confidence``;
    with ``keep_outcomes`` also the outcome of each rule.  Without ``every_rule`` the label is the
    same, but rules that could not change it are not looked at, which saves most lookups in long
    prompts; which rules fired is then not known, and not given.  Narrow: a few projections in one
    stage.  They are separate so that each feature is computed once per row.
    """
    predicted, probs = F.col("predicted"), F.col("all_probs")
    words = F.col("_words")
    columns = [c for c in df.columns if c != "confidence"]
    # A prompt predicted large is left as it is: its text is not even looked at.
    final, text = predicted.eqNullSafe(LARGE), F.col("_text")
    staged = df.select("*", present(F.col("prompt")).alias("_text"))
    staged = staged.select(
        "*",
        F.when(final, "").otherwise(F.lower(text)).alias("_lowered"),
        F.when(final, 0).otherwise(word_count("_text", exact_to=LONG_FOR_ANY)).alias("_words"),
    )
    first = rl.needed_features("_lowered", words, predicted, probs, every_rule)
    staged = staged.withColumns({f"_{n}": c for n, c in first.items()})
    second = rl.needed_code_features("_lowered", words, F.col("_code_hit"))
    staged = staged.withColumns({f"_{n}": c for n, c in second.items()})
    outcomes = {
        "proof": rl.proof_rule(predicted, words, F.col("_proof_hit")),
        "length": rl.length_rule(predicted, words),
        "depth": rl.depth_rule(predicted, F.col("_depth_count")),
        "steps": rl.steps_rule(predicted, words, probs, F.col("_step_count")),
        "code": rl.code_rule(
            predicted, words, F.col("_code_hit"), F.col("_tech_count"), F.col("_req_count")
        ),
        "academic": rl.academic_rule(predicted, words, F.col("_academic_hit")),
    }
    staged = with_computed_once(staged, {f"rule_{n}": outcomes[n] for n in RULES})
    fired = [F.col(f"rule_{n}") for n in RULES]
    override = F.coalesce(*fired).isNotNull()
    return staged.select(
        *columns,
        rl.capped_confidence(F.col("confidence"), override).alias("confidence"),
        rl.last_fired(fired, predicted).alias("complexity"),
        override.alias("rule_override"),
        *([rl.fired_rules(fired).alias("fired_rules")] if every_rule else []),
        *([f"rule_{n}" for n in RULES] if keep_outcomes else []),
    )


def transition_counts(ruled: DataFrame) -> DataFrame:
    """How many prompts went from each predicted label to each final label."""
    return ruled.groupBy("predicted", "complexity").agg(F.count("*").alias("n"))


def fire_counts(ruled: DataFrame) -> DataFrame:
    """How often each rule fired.

    Grouped before unfolding: the explode sees one row per combination of rules.
    """
    return (
        ruled.groupBy("fired_rules")
        .agg(F.count("*").alias("_n"))
        .select(F.explode("fired_rules").alias("rule"), "_n")
        .groupBy("rule")
        .agg(F.sum("_n").alias("n"))
    )


def override_audit(ruled: DataFrame) -> DataFrame:
    """Transitions and fire counts in one pass, as ``(kind, item, n)``."""
    change = F.concat_ws(" > ", "predicted", "complexity")
    items = F.concat(
        F.array(F.struct(F.lit("transition").alias("kind"), change.alias("item"))),
        *[
            F.when(
                F.array_contains("fired_rules", i),
                F.array(F.struct(F.lit("rule").alias("kind"), F.lit(name).alias("item"))),
            ).otherwise(F.array().cast("array<struct<kind:string,item:string>>"))
            for i, name in enumerate(RULES, 1)
        ],
    )
    # Grouped before unfolding: the explode sees one row per distinct case.
    cases = ruled.groupBy("predicted", "complexity", "fired_rules").agg(F.count("*").alias("_n"))
    return (
        cases.select(F.explode(items).alias("_e"), "_n")
        .groupBy("_e.kind", "_e.item")
        .agg(F.sum("_n").alias("n"))
    )
