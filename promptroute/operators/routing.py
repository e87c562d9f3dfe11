"""From labelled prompts to models, and from models to energy figures."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute import schemas
from promptroute.functions import energy as en
from promptroute.functions.wording import explain_choice, explain_route
from promptroute.operators.responses import settle_attempts
from promptroute.operators.rules import apply_rules
from promptroute.settings import (
    BASELINE_KWH,
    BASELINE_MODEL,
    BASELINE_SIZE_GB,
    DEFAULT_TIER,
    ENERGY_PER_GB_KWH,
    LABELS,
    MODELS,
    STRATEGIES,
    TIERS,
)


def _local_table(spark: SparkSession, schema, rows: Iterable[tuple]) -> DataFrame:
    """A table held in the plan itself.  Its size is known to the optimizer, which therefore
    broadcasts it without a hint; a larger registry would be joined in another way."""
    columns = list(zip(*rows))
    arrays = {f.name: list(c) for f, c in zip(schema.fields, columns)}
    return spark.createDataFrame(pa.table(arrays), schema)


def model_registry(spark: SparkSession, rows: Iterable[tuple] = MODELS) -> DataFrame:
    return _local_table(spark, schemas.MODELS, rows)


def tier_table(spark: SparkSession, rows: Iterable[tuple] = TIERS) -> DataFrame:
    rows = [(label, list(first), list(then)) for label, first, then in rows]
    return _local_table(spark, schemas.TIERS, rows)


def registry_usage(routed: DataFrame, models: DataFrame) -> DataFrame:
    """Every registered model with the number of prompts routed to it."""
    used = routed.groupBy("routed_model").agg(F.count("*").alias("n"))
    return models.join(used, F.col("model_id") == F.col("routed_model"), "left").select(
        *models.columns, F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def with_tiers(df: DataFrame, tiers: DataFrame, label: str = "complexity") -> DataFrame:
    """``df`` with the ``recommended`` and ``fallback`` models of its class.

    An unknown class gets those of the medium class.  A left join: an inner join would test the
    class for NULL first, and the optimizer would move that test, with all the rules spelled
    out in it, down to the scan.
    """
    known = F.when(F.col(label).isin(*LABELS), F.col(label)).otherwise(DEFAULT_TIER)
    lookup = tiers.withColumnRenamed("complexity", "_tier")
    return df.withColumn("_tier", known).join(lookup, "_tier", "left").drop("_tier")


def with_size(df: DataFrame, models: DataFrame, model: str = "routed_model") -> DataFrame:
    """``df`` with name, size and timeout of a model; NULL size if it is not registered."""
    info = models.select(
        F.col("model_id").alias(model),
        F.col("name").alias("model_name"),
        F.col("size_gb").alias("size_gb"),
        F.col("timeout_s").alias("timeout_s"),
    )
    return df.join(info, model, "left").withColumn(
        "model_name", F.coalesce("model_name", model)
    )


def explain_routes(df: DataFrame) -> Column:
    return explain_route(
        F.col("complexity"), F.col("confidence"), F.col("prompt"), F.col("rule_override")
    )


def route(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """Predictions to routing decisions: rules, then the models of the resulting class."""
    return with_tiers(apply_rules(df), tiers).withColumn("reasoning", explain_routes(df))


def overrides_map(overrides: Mapping[str, str] | None) -> Column | None:
    if not overrides:
        return None
    return F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])


def with_choice(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with ``routed_model``: the override for the class, else the first recommended."""
    first = F.try_element_at("recommended", F.lit(1))
    chosen = overrides_map(overrides)
    if chosen is not None:
        first = F.coalesce(F.try_element_at(chosen, F.col("complexity")), first)
    return df.withColumn("routed_model", first)


def account(df: DataFrame, energy: Column) -> DataFrame:
    """``df`` with energy, carbon, savings against the baseline and green score."""
    e = F.col("energy_kwh")
    return df.withColumn("energy_kwh", energy).select(
        "*",
        en.co2_kg(e).alias("co2_kg"),
        en.saved_kwh(e).alias("energy_saved_kwh"),
        en.saved_pct(e).alias("energy_saved_pct"),
        en.green_score(e).alias("green_score"),
    )


def route_and_account(
    df: DataFrame,
    tiers: DataFrame,
    models: DataFrame,
    overrides: Mapping[str, str] | None = None,
    responses: DataFrame | None = None,
    recommend_only: bool = False,
    strict_reference: bool = False,
    every_rule: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The whole pass from predictions to routed records.

    Without ``responses`` every prompt is taken as answered by its model, and the pass is
    narrow: one stage with lookups in two small tables.  With ``responses`` (normalised) the answer of
    the chosen model is attached, of several attempts that of ``settle_attempts``.  A failed or
    missing answer has no savings; ``strict_reference`` counts its energy as 0 instead.
    Without ``every_rule`` the record does not say which rules fired, and routing is faster.
    ``keep`` names further columns of ``df`` to pass on.
    """
    ruled = apply_rules(df, every_rule=every_rule and not recommend_only)
    chosen = with_size(with_choice(with_tiers(ruled, tiers), overrides), models)
    chosen = chosen.withColumn(
        "reasoning",
        explain_choice(
            F.col("complexity"), F.col("confidence"), F.col("model_name"), F.col("size_gb")
        ),
    )
    if recommend_only:
        return chosen.select(
            "prompt_id",
            "complexity",
            "confidence",
            "routed_model",
            "reasoning",
            F.lit(False).alias("auto_route"),
            *keep,
        )
    none = F.lit(None)
    if responses is None:
        answered = chosen.select(
            "*",
            none.cast("string").alias("response"),
            none.cast("string").alias("error"),
            none.cast("double").alias("inference_latency_ms"),
        )
        energy = en.energy_kwh(F.col("size_gb"))
    else:
        # A class has one model, so the replies of most are not asked for: they are left out before they travel.
        possible = tiers.select(F.try_element_at("recommended", F.lit(1)).alias("model"))
        if overrides:
            named = F.array(*[F.lit(model) for model in overrides.values()])
            possible = possible.union(df.sparkSession.range(1).select(F.explode(named)))
        asked = responses.join(possible.distinct(), "model", "left_semi")
        answers = settle_attempts(asked).select(
            "prompt_id",
            F.col("model").alias("routed_model"),
            F.coalesce("raw_response", F.lit("")).alias("response"),
            "error",
            F.col("latency_ms").alias("inference_latency_ms"),
            F.col("energy_kwh").alias("_energy"),
        )
        answered = chosen.join(answers, ["prompt_id", "routed_model"], "left")
        served = F.when(F.col("error").isNull(), F.col("_energy"))
        energy = F.coalesce(served, F.lit(0.0)) if strict_reference else served
    classified = (
        F.col("classification_latency_ms")
        if "classification_latency_ms" in df.columns
        else none.cast("double")
    )
    return account(answered, energy).select(
        "prompt_id",
        "complexity",
        "confidence",
        "routed_model",
        "model_name",
        "response",
        "error",
        classified.alias("classification_latency_ms"),
        "inference_latency_ms",
        (F.coalesce(classified, F.lit(0.0)) + F.col("inference_latency_ms")).alias(
            "total_latency_ms"
        ),
        "energy_kwh",
        "co2_kg",
        "energy_saved_kwh",
        "energy_saved_pct",
        "green_score",
        F.lit(BASELINE_MODEL).alias("baseline_model"),
        F.lit(BASELINE_KWH).alias("baseline_energy"),
        "reasoning",
        "all_probs",
        "rule_override",
        *(["fired_rules"] if every_rule else []),
        *keep,
    )


def _strategy_models(names: Iterable[str]) -> Column:
    """Array of (strategy, forced model or NULL), to be unfolded per row."""
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("strategy"), F.lit(STRATEGIES[n]).cast("string").alias("forced")
            )
            for n in names
        ]
    )


def compare_strategies(
    ruled: DataFrame,
    tiers: DataFrame,
    models: DataFrame,
    names: Iterable[str] = tuple(STRATEGIES),
) -> DataFrame:
    """Each prompt under each strategy: one row per prompt and strategy."""
    unfolded = with_choice(with_tiers(ruled, tiers)).select(
        "prompt_id",
        "complexity",
        "routed_model",
        F.inline(_strategy_models(names)),
    )
    forced = unfolded.withColumn("routed_model", F.coalesce("forced", "routed_model"))
    sized = with_size(forced, models)
    return account(sized, en.energy_kwh(F.col("size_gb"))).select(
        "prompt_id",
        "strategy",
        "complexity",
        "routed_model",
        "energy_kwh",
        "co2_kg",
        "energy_saved_kwh",
        "energy_saved_pct",
        "green_score",
    )


def strategy_totals(
    ruled: DataFrame,
    tiers: DataFrame,
    models: DataFrame,
    names: Iterable[str] = tuple(STRATEGIES),
) -> DataFrame:
    """Energy of the whole workload under each strategy.

    Energy depends on the class alone, so prompts are counted per class first and the
    strategies unfolded over the few counts, not over the prompts.
    """
    counts = ruled.groupBy("complexity").agg(F.count("*").alias("_n"))
    unfolded = with_choice(with_tiers(counts, tiers)).select(
        "_n", "routed_model", F.inline(_strategy_models(names))
    )
    sized = with_size(
        unfolded.withColumn("routed_model", F.coalesce("forced", "routed_model")), models
    )
    per_prompt = account(sized, en.energy_kwh(F.col("size_gb")))
    energy = F.sum(F.col("energy_kwh") * F.col("_n"))
    base = F.sum(F.lit(BASELINE_SIZE_GB * ENERGY_PER_GB_KWH) * F.col("_n"))
    return per_prompt.groupBy("strategy").agg(
        F.sum("_n").alias("prompts"),
        energy.alias("energy_kwh"),
        en.co2_kg(energy).alias("co2_kg"),
        F.sum(F.col("energy_saved_kwh") * F.col("_n")).alias("energy_saved_kwh"),
        en.saved_pct(energy, base).alias("energy_saved_pct"),
    )


def _candidates(k: int | None) -> Column:
    """The listed models in order of preference, as (kind, position, model)."""

    def listed(col: str, kind: str) -> Column:
        models = F.col(col) if k is None else F.slice(col, 1, k)
        return F.transform(
            models,
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"), (i + 1).alias("position"), m.alias("model")
            ),
        )

    return F.concat(listed("recommended", "primary"), listed("fallback", "fallback"))


def pick_available(tiers: DataFrame, available: DataFrame, model: str = "model_id") -> DataFrame:
    """The tier table with ``available_model``: the first recommended, else fallback, that is up.

    Availability is settled here, on the few tiers; prompts then get it through ``with_tiers``.
    """
    up = (
        tiers.select(
            "complexity", F.posexplode(F.concat("recommended", "fallback")).alias("_pos", "_model")
        )
        .join(available.select(F.col(model).alias("_model")), "_model", "left_semi")
        .groupBy("complexity")
        .agg(F.min_by("_model", "_pos").alias("available_model"))
    )
    return tiers.join(up, "complexity", "left")


def candidates(routed: DataFrame, models: DataFrame, k: int = 3) -> DataFrame:
    """One row per prompt and listed model (the first ``k`` of each list) with name and size."""
    unfolded = routed.select("prompt_id", F.inline(_candidates(k)))
    return with_size(unfolded, models, "model").select(
        "prompt_id", "kind", "position", "model", "model_name", "size_gb"
    )
