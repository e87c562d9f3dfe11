"""From a labelled corpus and logged responses to the validation report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.operators.passes import LinearModel, score
from promptroute.operators.responses import compare_pair
from promptroute.operators.rules import apply_rules
from promptroute.operators.sampling import sample_per_class
from promptroute.operators.validation import validation_report, validation_table
from promptroute.session import materialise
from promptroute.settings import BASELINE_MODEL, SMALL, SMALLEST_MODEL
from promptroute.sources.sinks import write_csv, write_json

SAMPLE_PER_CLASS = 20


def validate_routing(
    predictions: DataFrame,
    responses: DataFrame,
    small: str = SMALLEST_MODEL,
    large: str = BASELINE_MODEL,
    use_rules: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Validation table of ``(prompt_id, prompt, complexity_label, predicted, confidence, ...)``.

    The model's label is judged as it is; with ``use_rules`` the label after the rules.
    ``responses`` are normalised; only those to prompts predicted small are compared.  Without ``texts`` the replies
    are left out, as for ``validation_report``, which shows none.
    """
    rows = predictions
    if use_rules:
        rows = apply_rules(rows, every_rule=False).withColumn("predicted", F.col("complexity"))
    labelled = rows.select(
        "prompt_id", F.col("complexity_label").alias("true_label"), "predicted", "confidence"
    )
    wanted = materialise(labelled.where(F.col("predicted") == SMALL).select("prompt_id"), "wanted")
    return validation_table(labelled, compare_pair(responses, small, large, wanted, texts))


def validate_sample(
    corpus: DataFrame,
    model: LinearModel,
    responses: DataFrame,
    k: int = SAMPLE_PER_CLASS,
    small: str = SMALLEST_MODEL,
    large: str = BASELINE_MODEL,
) -> DataFrame:
    """Validation table of ``k`` labelled prompts of each class, scored by the classifier.

    ``corpus`` is a labelled corpus with a ``prompt_id``.
    """
    scored = score(sample_per_class(corpus, "prompt_id", k), model)
    return validate_routing(scored, responses, small, large)


def publish(table: DataFrame, folder: str) -> DataFrame:
    """Write the validation table as CSV and its report as JSON; returns the report."""
    table = materialise(table, "validation")
    report = validation_report(table)
    write_csv(table, f"{folder}/results", columns=None)
    write_json(report, f"{folder}/report")
    return report
