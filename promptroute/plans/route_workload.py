"""From predictions to routed records and the energy of the workload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from promptroute.operators.energy import workload_rollup
from promptroute.operators.routing import model_registry, route_and_account, tier_table


def route_workload(
    predictions: DataFrame,
    overrides: Mapping[str, str] | None = None,
    every_rule: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Routed record of every prompt, with the default tiers and models.  Narrow."""
    spark = predictions.sparkSession
    return route_and_account(
        predictions,
        tier_table(spark),
        model_registry(spark),
        overrides,
        every_rule=every_rule,
        keep=keep,
    )


def workload_energy(predictions: DataFrame) -> DataFrame:
    """Class mix, energy and savings per class, source and in all.  One small shuffle."""
    routed = route_workload(predictions, every_rule=False, keep=["source_dataset"])
    return workload_rollup(routed)
