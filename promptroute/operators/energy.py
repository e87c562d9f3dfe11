"""Energy roll-ups of routed prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptroute.functions import energy as en
from promptroute.settings import BASELINE_KWH, BASELINE_MODEL

DAYS_PER_YEAR = 365
# Sums are rounded to this many digits: their last bits depend on the summing order.
DIGITS = 12


def with_bands(routed: DataFrame) -> DataFrame:
    return routed.select(
        "*",
        en.confidence_band(F.col("confidence")).alias("confidence_band"),
        en.green_band(F.col("green_score")).alias("green_band"),
    )


def baseline_comparison(routed: DataFrame) -> DataFrame:
    """Two rows per prompt: the routed model and the always-largest baseline."""
    saved = F.lit(BASELINE_KWH) - F.col("energy_kwh")

    def side(strategy: str, model, energy, co2_saved):
        return F.struct(
            F.lit(strategy).alias("strategy"),
            model.alias("model"),
            energy.alias("energy_kwh"),
            en.co2_kg(energy).alias("co2_kg"),
            co2_saved.alias("co2_saved_kg"),
        )

    sides = F.array(
        side("smart", F.col("routed_model"), F.col("energy_kwh"), en.co2_kg(saved)),
        side("baseline", F.lit(BASELINE_MODEL), F.lit(BASELINE_KWH), F.lit(0.0)),
    )
    return routed.select("prompt_id", F.inline(sides))


def _figures() -> list:
    """Aggregates over pre-grouped rows (``_n`` prompts, ``_served`` of them with energy)."""
    energy, served = F.sum("_energy"), F.sum("_served")
    base = served * F.lit(BASELINE_KWH)
    return [
        F.sum("_n").alias("prompts"),
        served.alias("served"),
        F.round(energy, DIGITS).alias("energy_kwh"),
        F.round(energy / F.nullif(served, F.lit(0)), DIGITS).alias("mean_kwh"),
        F.round(en.co2_kg(energy), DIGITS).alias("co2_kg"),
        # + 0.0 turns a rounded -0.0 into 0.0
        (F.round(base - energy, DIGITS) + F.lit(0.0)).alias("saved_kwh"),
        (F.round((base - energy) / F.nullif(base, F.lit(0.0)) * 100, 6) + F.lit(0.0)).alias(
            "saved_pct"
        ),
    ]


def _grouped(routed: DataFrame, *keys) -> DataFrame:
    return routed.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.count("energy_kwh").alias("_served"),
        F.coalesce(F.sum("energy_kwh"), F.lit(0.0)).alias("_energy"),
    )


def workload_rollup(routed: DataFrame) -> DataFrame:
    """Class mix and energy per class, per source and in all.

    ``level`` is class, source or total.  Prompts are counted per class and source first;
    the grouping sets run over those few rows, of which the total is the largest.
    """
    counts = _grouped(routed, "complexity", "source_dataset")
    sets = [[F.col("complexity")], [F.col("source_dataset")], []]
    return (
        counts.groupingSets(sets, F.col("complexity"), F.col("source_dataset"))
        .agg(
            F.grouping("complexity").alias("_all_classes"),
            F.grouping("source_dataset").alias("_all_sources"),
            *_figures(),
        )
        .select(
            F.when(F.col("_all_classes") == 0, "class")
            .when(F.col("_all_sources") == 0, "source")
            .otherwise("total")
            .alias("level"),
            F.coalesce("complexity", "source_dataset").alias("item"),
            F.round(F.col("prompts") * 100 / F.max("prompts").over(Window.partitionBy()), 6).alias(
                "mix_pct"
            ),
            "prompts",
            "served",
            "energy_kwh",
            "mean_kwh",
            "co2_kg",
            "saved_kwh",
            "saved_pct",
        )
    )


def daily_rollup(routed: DataFrame, ts: str = "ts") -> DataFrame:
    """Energy per day, and what a year of such days would come to."""
    figures = _grouped(routed, F.date_trunc("day", F.col(ts)).alias("day")).groupBy("day").agg(
        *_figures()
    )
    return figures.select(
        "*",
        F.round(F.col("energy_kwh") * DAYS_PER_YEAR, DIGITS).alias("kwh_per_year"),
        F.round(F.col("saved_kwh") * DAYS_PER_YEAR, DIGITS).alias("saved_kwh_per_year"),
        F.round(F.col("co2_kg") * DAYS_PER_YEAR, DIGITS).alias("co2_kg_per_year"),
    )
