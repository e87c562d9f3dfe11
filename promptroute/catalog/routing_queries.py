"""Evaluation, rules, routing and energy."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.catalog import derived as dv
from promptroute.catalog import sql as q
from promptroute.catalog.corpus_queries import _keys as corpus_keys
from promptroute.catalog.corpus_queries import _rounded
from promptroute.catalog.response_queries import _PAIR as PAIRS
from promptroute.catalog.training_sql import cut_into_pieces, trained
from promptroute.operators import energy, evaluation, passes, routing, rules, subwords
from promptroute.operators.corpus import label_corpus
from promptroute.operators.sampling import stratified_split
from promptroute.functions.energy import energy_report
from promptroute.plans.corpus_build import KEY
from promptroute.plans.route_workload import route_workload, workload_energy
from promptroute.plans.train_model import train_and_evaluate
from promptroute.plans.validate_routing import validate_sample
from promptroute.session import materialise, new_path
from promptroute.settings import LABELS
from promptroute.sources.sinks import write_json

OVERRIDES = {"small": "qwen2:1.5b", "large": "zephyr:latest"}
AVAILABLE = ("phi3:latest", "gemma3:4b", "zephyr:latest", "deepseek-r1:1.5b")


# ------------------------------------------------------------------ evaluation
def _cells(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.confusion(dv.labelled_predictions(spark, d))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.metrics(_cells(spark, d)))


def per_class_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.per_class(_cells(spark, d)))


def quality_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.verdict(_cells(spark, d)))


def evaluation_file(spark: SparkSession, d: str) -> DataFrame:
    """The report written as JSON and read back, one row per class."""
    path = new_path(spark, "evaluation")
    report = evaluation.evaluation_report(materialise(_cells(spark, d), "cells"))
    write_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    return _rounded(back.select("n", "accuracy", F.inline("classification_report")))


def split_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.split_report(stratified_split(corpus_keys(spark, d), KEY))


def labelled_workload(spark: SparkSession, d: str) -> DataFrame:
    """The whole workload under the main labeller, written once."""
    return materialise(label_corpus(dv.workload(spark, d)).drop("n"), "labeled")


def _trained(spark: SparkSession, d: str) -> tuple[DataFrame, passes.LinearModel]:
    """The labelled workload, and the classifier trained on it."""
    rows = labelled_workload(spark, d)
    return rows, passes.train(rows, "prompt_id")


def training_passes(spark: SparkSession, d: str) -> DataFrame:
    """What every pass of the training reached, and which is kept."""
    figures = passes.pass_figures(spark, _trained(spark, d)[1])
    return figures.select("pass", *(F.round(c, 6).alias(c) for c in figures.columns[1:-1]), "best")


def _trained_and_scored(spark: SparkSession, d: str, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """Every prompt scored by the classifier trained on the labelled workload; its numbers are made and written once for both."""
    made = passes.with_columns(labelled_workload(spark, d), vocabulary).drop("prompt")
    rows = materialise(made, "numbered")
    model = passes.train(rows, "prompt_id", vocabulary=vocabulary, numbered=True)
    return passes.score(rows.select("prompt_id", "columns", "n_tokens"), model, numbered=True)


def classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Label, confidence and the share of every class, of every prompt."""
    return _shown(_trained_and_scored(spark, d))


def _shown(scored: DataFrame) -> DataFrame:
    shares = [F.round(F.col("all_probs")[name], 6).alias(f"share_{name}") for name in LABELS]
    return scored.select("prompt_id", "predicted", F.round("confidence", 6).alias("confidence"), *shares)


def vocabulary_path() -> str:
    """The file of a public tokenizer whose pieces prompts are cut into."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def subword_slices(spark: SparkSession, d: str) -> DataFrame:
    """The sub-words of every prompt that a model of so many tokens sees."""
    vocabulary = subwords.read_vocabulary(vocabulary_path())
    cut = subwords.with_pieces(dv.workload(spark, d), vocabulary, passes.MAX_TOKENS)
    digest = F.md5(F.array_join("pieces", " ")).alias("pieces_md5")
    return cut.select("prompt_id", F.size("pieces").alias("n_pieces"), digest)


def subword_classifier_scores(spark: SparkSession, d: str) -> DataFrame:
    """Label, confidence and shares of every prompt, by a classifier of sub-words."""
    return _shown(_trained_and_scored(spark, d, subwords.read_vocabulary(vocabulary_path())))


def classifier_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the kept weights on the validation prompts, a row for every class."""
    report = train_and_evaluate(labelled_workload(spark, d), "prompt_id")[1]
    return _rounded(report.select("n", "accuracy", "f1_macro", "f1_weighted", F.inline("classification_report")))


def sampled_validation(spark: SparkSession, d: str) -> DataFrame:
    """Twenty prompts of each class, classified, and the two models compared on those predicted small."""
    corpus, model = _trained(spark, d)
    compared = validate_sample(corpus, model, dv.normalised(spark, d))
    return compared.select(
        "prompt_id", "true_label", "predicted", F.round("confidence", 6).alias("confidence"),
        F.col("equivalent_quality").isNotNull().alias("compared"), "equivalent_quality",
    )


# ------------------------------------------------------------------ rules
def _ruled(spark: SparkSession, d: str) -> DataFrame:
    """Labels after the rules, without the record of the rules that fired."""
    return rules.apply_rules(dv.predictions(spark, d), every_rule=False)


def _audited(spark: SparkSession, d: str) -> DataFrame:
    return rules.apply_rules(dv.predictions(spark, d), keep_outcomes=True)


def rule_layer(spark: SparkSession, d: str) -> DataFrame:
    return _audited(spark, d).select(
        "prompt_id",
        "predicted",
        *[f"rule_{n}" for n in rules.RULES],
        "complexity",
        "rule_override",
        F.array_join("fired_rules", ",").alias("fired_rules"),
        "confidence",
    )


def override_audit(spark: SparkSession, d: str) -> DataFrame:
    return rules.override_audit(_audited(spark, d))


def label_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rules.transition_counts(_ruled(spark, d))


def rule_fire_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules.fire_counts(_audited(spark, d))


# ------------------------------------------------------------------ routing
def _routed(spark: SparkSession, d: str) -> DataFrame:
    return route_workload(dv.predictions(spark, d), every_rule=False)


def registry_usage(spark: SparkSession, d: str) -> DataFrame:
    return routing.registry_usage(_routed(spark, d), routing.model_registry(spark))


def routed_prompts(spark: SparkSession, d: str) -> DataFrame:
    decisions = routing.route(dv.predictions(spark, d), routing.tier_table(spark))
    return decisions.select(
        "prompt_id",
        "complexity",
        "confidence",
        F.array_join("recommended", ",").alias("recommended"),
        F.array_join("fallback", ",").alias("fallback"),
        "rule_override",
        "reasoning",
    )


def tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of a class column that also holds classes the tier table lacks."""
    kinds = dv.table(spark, d, "events").select(
        "event_id",
        F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in dv.EVENT_LABELS.items() if k != "signup"], "event_type").alias("complexity"),
    )
    return routing.with_tiers(kinds, routing.tier_table(spark)).select(
        "event_id",
        "complexity",
        F.array_join("recommended", ",").alias("recommended"),
        F.array_join("fallback", ",").alias("fallback"),
    )


def chosen_models(spark: SparkSession, d: str) -> DataFrame:
    return route_workload(dv.predictions(spark, d), OVERRIDES, every_rule=False).select(
        "prompt_id", "complexity", "routed_model", "model_name", "energy_kwh", "green_score"
    )


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return routing.route_and_account(
        dv.predictions(spark, d),
        routing.tier_table(spark),
        routing.model_registry(spark),
        recommend_only=True,
    )


def _record(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    routed = routing.route_and_account(
        dv.predictions(spark, d),
        routing.tier_table(spark),
        routing.model_registry(spark),
        responses=dv.normalised(spark, d),
        strict_reference=strict,
    )
    return routed.drop("all_probs", "fired_rules", "classification_latency_ms")


def routed_records(spark: SparkSession, d: str) -> DataFrame:
    return _record(spark, d, False)


def routed_records_failures_as_zero(spark: SparkSession, d: str) -> DataFrame:
    return _record(spark, d, True)


def strategy_comparison(spark: SparkSession, d: str) -> DataFrame:
    return routing.compare_strategies(
        _ruled(spark, d), routing.tier_table(spark), routing.model_registry(spark)
    )


def strategy_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = routing.strategy_totals(
        _ruled(spark, d), routing.tier_table(spark), routing.model_registry(spark)
    )
    pct = F.round("energy_saved_pct", 6).alias("energy_saved_pct")
    return _rounded(totals.select(*[c for c in totals.columns if c != "energy_saved_pct"], pct), energy.DIGITS)


def available_models(spark: SparkSession, d: str) -> DataFrame:
    up = routing.model_registry(spark).filter(F.col("model_id").isin(*AVAILABLE))
    tiers = routing.pick_available(routing.tier_table(spark), up)
    return routing.with_tiers(_ruled(spark, d), tiers).select(
        "prompt_id", "complexity", "available_model"
    )


def candidate_models(spark: SparkSession, d: str) -> DataFrame:
    tiered = routing.with_tiers(_ruled(spark, d), routing.tier_table(spark))
    return routing.candidates(tiered, routing.model_registry(spark))


# ------------------------------------------------------------------ energy
def energy_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d).select(
        "prompt_id",
        "routed_model",
        "energy_kwh",
        "co2_kg",
        "energy_saved_kwh",
        "energy_saved_pct",
        "green_score",
    )


def energy_against_any_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each prompt's model against the biggest model that answered it without error."""
    answered = dv.normalised(spark, d).filter("error is null")
    sizes = routing.with_size(
        answered.select("prompt_id", "model"), routing.model_registry(spark), "model"
    )
    biggest = sizes.groupBy("prompt_id").agg(F.max("size_gb").alias("base_gb"))
    chosen = routing.with_size(
        _routed(spark, d).select("prompt_id", "routed_model"), routing.model_registry(spark)
    )
    report = energy_report(F.col("size_gb"), F.col("base_gb"))
    return chosen.join(biggest, "prompt_id").select("prompt_id", report.alias("r")).select("prompt_id", "r.*")


def energy_bands(spark: SparkSession, d: str) -> DataFrame:
    banded = energy.with_bands(_routed(spark, d))
    return banded.groupBy("confidence_band", "green_band").agg(F.count("*").alias("n"))


def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    return energy.baseline_comparison(_routed(spark, d))


def workload_energy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return workload_energy(dv.predictions(spark, d))


def daily_energy_rollup(spark: SparkSession, d: str) -> DataFrame:
    events = dv.event_predictions(dv.table(spark, d, "events"))
    return energy.daily_rollup(route_workload(events, every_rule=False, keep=["ts"])).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ------------------------------------------------------------------ SQL
_PERCENT = "round_even(confidence * 100, 0)::int || '%'"
_ROUTE_REASON = f"""concat_ws(' • ', case when rule_override then 'Raised by rules' end,
 case complexity when 'small' then 'Simple task, a small model (1-2B) is enough'
  when 'medium' then 'Moderate task, a medium model (3-4B) is needed'
  when 'large' then 'Complex task, a large model (7B+) is needed' end,
 case when complexity = 'small' and confidence > 0.9::double then 'Clearly a simple prompt' end,
 case when complexity = 'small' and length(prompt) // 4 < 50 then 'Short prompt' end,
 case when complexity = 'medium' and length(prompt) // 4 > 100 then 'Some context to read' end,
 case when complexity = 'medium' then 'A few steps or some code' end,
 case when complexity = 'large' and length(prompt) // 4 > 200 then 'Long and detailed prompt' end,
 case when complexity = 'large' and confidence > 0.85::double then 'Clearly a complex prompt' end,
 case when complexity = 'large' then 'Many steps, mathematics or demanding code' end,
 case when confidence < 0.7::double then 'Only ' || {_PERCENT} || ' sure, consider a fallback' end)"""
_CHOICE_REASON = f"""concat_ws(' | ', case complexity when 'small' then 'Simple task: small model for efficiency'
  when 'medium' then 'Moderate task: medium model for balance'
  when 'large' then 'Complex task: large model for quality' else 'Unknown complexity' end,
 case when confidence > 0.9::double then 'Confidence high (' || {_PERCENT} || ')'
  when confidence < 0.7::double then 'Confidence low (' || {_PERCENT} || '), watch quality' end,
 'Selected: ' || model_name || printf(' (%.1fGB)', size_gb))"""
_BASE = "(4.7::double * 5e-5)"


def _recorded(energy_sql: str) -> str:
    return f"""select prompt_id, complexity, confidence, routed_model, model_name, response, error,
 inference_latency_ms, inference_latency_ms as total_latency_ms, e as energy_kwh, e * 0.475::double as co2_kg,
 case when e is not null then greatest(0::double, {_BASE} - e) end as energy_saved_kwh,
 case when e is not null then greatest(0::double, ({_BASE} - e) / {_BASE} * 100) end as energy_saved_pct,
 case when e is not null then greatest(0, least(100, round_even(100 * (1 - e / {_BASE}), 0)))::int end as green_score,
 'qwen2.5:7b' as baseline_model, {_BASE} as baseline_energy, {_CHOICE_REASON} as reasoning, rule_override
 from (select r.prompt_id, r.complexity, r.confidence, r.routed_model, r.model_name, r.size_gb, r.rule_override,
  coalesce(a.raw_response, '') as response, a.error, a.latency_ms as inference_latency_ms, {energy_sql} as e
  from routed r left join settled a on a.prompt_id = r.prompt_id and a.model = r.routed_model)"""


_ENERGY = """size_gb * 5e-5 as energy_kwh, size_gb * 5e-5 * 0.475::double as co2_kg,
 greatest(0::double, 4.7::double * 5e-5 - size_gb * 5e-5) as energy_saved_kwh,
 greatest(0::double, (4.7::double * 5e-5 - size_gb * 5e-5) / (4.7::double * 5e-5) * 100) as energy_saved_pct,
 greatest(0, least(100, round_even(100 * (1 - size_gb * 5e-5 / (4.7::double * 5e-5)), 0)))::int as green_score"""
_FIGURES = f"""count(*) as prompts, count(energy_kwh) as served, round(sum(energy_kwh), 12) as energy_kwh,
 round(avg(energy_kwh), 12) as mean_kwh, round(sum(energy_kwh) * 0.475::double, 12) as co2_kg,
 round(count(energy_kwh) * {_BASE} - sum(energy_kwh), 12) + 0.0::double as saved_kwh,
 round((count(energy_kwh) * {_BASE} - sum(energy_kwh)) / (count(energy_kwh) * {_BASE}) * 100, 6) + 0.0::double as saved_pct"""
_RULE_EVENTS = "(select unnest(string_split(nullif(fired_rules, ''), ','))::int as rule from ruled)"
_CLASS_FIGURES = """(select label, coalesce(hits / nullif(claimed, 0), 0) as precision,
 coalesce(hits / nullif(support, 0), 0) as recall, support from
 (select label, (select count(*) from truths where true_label = label and predicted = label) as hits,
   (select count(*) from truths where true_label = label) as support,
   (select count(*) from truths where predicted = label) as claimed
  from (values ('small'), ('medium'), ('large')) v(label)))"""
_PER_CLASS = f"""(select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from {_CLASS_FIGURES})"""
_SHARES = """select prompt_id, predicted, round(confidence, 6) as confidence, round(p0, 6) as share_small,
 round(p1, 6) as share_medium, round(p2, 6) as share_large from scored"""
_SCORED_CLASSES = """(select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from
 (select class as label, coalesce(hits / nullif(claimed, 0), 0) as precision, coalesce(hits / nullif(support, 0), 0) as recall, support from
  (select class, (select count(*) from scored where not train and complexity_label = class and predicted = class) as hits,
   (select count(*) from scored where not train and predicted = class) as claimed,
   (select count(*) from scored where not train and complexity_label = class) as support
   from (values ('small'), ('medium'), ('large')) v(class))))"""
_ACCURACY = "(select avg((true_label = predicted)::int) as accuracy, count(*) as n from truths)"
_RULE_NAMES = ", ".join(f"({i}, {q.text(n)})" for i, n in enumerate(rules.RULES, 1))

QUERIES = {
    "confusion_matrix": (
        confusion_matrix,
        """select t as true_label, p as predicted_label, (select count(*) from truths where true_label = t and predicted = p) as n
 from (values ('small'), ('medium'), ('large')) a(t), (values ('small'), ('medium'), ('large')) b(p)""",
    ),
    "classification_metrics": (
        classification_metrics,
        f"""select n, round(accuracy, 6) as accuracy, round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted
 from {_ACCURACY}, (select avg(f1) as f1_macro, sum(f1 * support) / sum(support) as f1_weighted from {_PER_CLASS})""",
    ),
    "per_class_report": (
        per_class_report,
        f"""select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support
 from {_PER_CLASS}""",
    ),
    "quality_verdict": (
        quality_verdict,
        f"""select round(accuracy, 6) as accuracy, case when accuracy < 0.7 then 'warning' when accuracy >= 0.85 then 'excellent'
 when accuracy >= 0.75 then 'good' else 'moderate' end as grade, round(s, 6) as f1_std, s > 0.1 as imbalanced
 from {_ACCURACY}, (select stddev_pop(f1) as s from {_PER_CLASS})""",
    ),
    "evaluation_file": (
        evaluation_file,
        f"""select n, round(accuracy, 6) as accuracy, label, round(precision, 6) as precision, round(recall, 6) as recall,
 round(f1, 6) as f1, support from {_ACCURACY}, {_PER_CLASS}""",
    ),
    "split_report": (
        split_report,
        "select split, complexity_label, count(*) as n from split group by split, complexity_label",
    ),
    "training_passes": (
        training_passes,
        trained("""select pass, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss, round(accuracy, 6) as accuracy,
 round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted, best from passes"""),
    ),
    "classifier_scores": (
        classifier_scores,
        trained(_SHARES),
    ),
    "classifier_evaluation": (
        classifier_evaluation,
        trained(f"""select n, round(accuracy, 6) as accuracy, round(f1_macro, 6) as f1_macro, round(f1_weighted, 6) as f1_weighted, label,
 round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from
 (select count(*) as n, avg((complexity_label = predicted)::int) as accuracy from scored where not train),
 (select avg(f1) as f1_macro, sum(f1 * support) / sum(support) as f1_weighted from {_SCORED_CLASSES}), {_SCORED_CLASSES}"""),
    ),
    "sampled_validation": (
        sampled_validation,
        trained(f"""select prompt_id, complexity_label as true_label, predicted, round(confidence, 6) as confidence,
 predicted = 'small' and equivalent_quality is not null as compared,
 case when predicted = 'small' then equivalent_quality end as equivalent_quality from
 (select *, row_number() over (partition by complexity_label order by md5('42|' || prompt_id), prompt_id) as place from scored)
 left join {PAIRS} using (prompt_id) where place <= 20"""),
    ),
    "rule_layer": (
        rule_layer,
        """select prompt_id, predicted, r1 as rule_proof, r2 as rule_length, r3 as rule_depth, r4 as rule_steps, r5 as rule_code,
 r6 as rule_academic, complexity, rule_override, fired_rules, confidence from ruled""",
    ),
    "override_audit": (
        override_audit,
        f"""select 'transition' as kind, predicted || ' > ' || complexity as item, count(*) as n from ruled group by all
 union all select 'rule', name, count(*) from {_RULE_EVENTS} join (values {_RULE_NAMES}) v(number, name) on number = rule group by name""",
    ),
    "label_transitions": (
        label_transitions,
        "select predicted, complexity, count(*) as n from ruled group by all",
    ),
    "rule_fire_counts": (
        rule_fire_counts,
        f"select rule, count(*) as n from {_RULE_EVENTS} group by rule",
    ),
    "registry_usage": (
        registry_usage,
        """select model_id, name, size_gb, timeout_s, (select count(*) from routed where routed_model = model_id) as n from models""",
    ),
    "routed_prompts": (
        routed_prompts,
        f"""select prompt_id, r.complexity, confidence, array_to_string(recommended, ',') as recommended,
 array_to_string(fallback, ',') as fallback, rule_override, {_ROUTE_REASON.replace('complexity', 'r.complexity')} as reasoning
 from ruled r join tiers t on t.complexity = r.complexity""",
    ),
    "tier_lookup": (
        tier_lookup,
        """select event_id, e.complexity, array_to_string(recommended, ',') as recommended, array_to_string(fallback, ',') as fallback
 from (select event_id, case event_type when 'click' then 'small' when 'view' then 'medium' when 'error' then 'medium'
  when 'purchase' then 'large' else event_type end as complexity from events) e
 join tiers t on t.complexity = case when e.complexity in ('small', 'medium', 'large') then e.complexity else 'medium' end""",
    ),
    "chosen_models": (
        chosen_models,
        f"""select prompt_id, complexity, routed_model, name as model_name, energy_kwh, green_score from
 (select prompt_id, complexity, model_id as routed_model, name, {_ENERGY} from ruled join models on model_id =
  case complexity when 'small' then 'qwen2:1.5b' when 'medium' then 'qwen2.5:3b' else 'zephyr:latest' end)""",
    ),
    "recommendations": (
        recommendations,
        f"""select prompt_id, complexity, confidence, routed_model, {_CHOICE_REASON} as reasoning, false as auto_route from routed""",
    ),
    "routed_records": (
        routed_records,
        _recorded("case when a.error is null then a.energy_kwh end"),
    ),
    "routed_records_failures_as_zero": (
        routed_records_failures_as_zero,
        _recorded("coalesce(case when a.error is null then a.energy_kwh end, 0::double)"),
    ),
    "strategy_comparison": (
        strategy_comparison,
        f"""select prompt_id, strategy, complexity, model_id as routed_model, {_ENERGY} from
 (select prompt_id, complexity, routed_model, unnest(['smart', 'always_small', 'always_large']) as strategy from routed) r
 join models on model_id = case strategy when 'smart' then routed_model when 'always_small' then 'tinyllama:latest' else 'qwen2.5:7b' end""",
    ),
    "strategy_totals": (
        strategy_totals,
        f"""select strategy, count(*) as prompts, round(sum(energy_kwh), 12) as energy_kwh, round(sum(energy_kwh) * 0.475::double, 12) as co2_kg,
 round(sum(energy_saved_kwh), 12) as energy_saved_kwh,
 round(greatest(0, (count(*) * {_BASE} - sum(energy_kwh)) / (count(*) * {_BASE}) * 100), 6) as energy_saved_pct from
 (select strategy, {_ENERGY} from
  (select routed_model, unnest(['smart', 'always_small', 'always_large']) as strategy from routed) r
  join models on model_id = case strategy when 'smart' then routed_model when 'always_small' then 'tinyllama:latest' else 'qwen2.5:7b' end)
 group by strategy""",
    ),
    "available_models": (
        available_models,
        """select prompt_id, complexity, case complexity when 'small' then 'deepseek-r1:1.5b' when 'medium' then 'phi3:latest'
 else 'gemma3:4b' end as available_model from ruled""",
    ),
    "candidate_models": (
        candidate_models,
        """select prompt_id, kind, position::int as position, model_id as model, name as model_name, size_gb from
 (select prompt_id, 'primary' as kind, unnest(recommended) as model, unnest(range(1, len(recommended) + 1)) as position
  from ruled r join tiers t on t.complexity = r.complexity
  union all select prompt_id, 'fallback', unnest(fallback), unnest(range(1, len(fallback) + 1))
  from ruled r join tiers t on t.complexity = r.complexity) join models on model_id = model""",
    ),
    "energy_by_prompt": (
        energy_by_prompt,
        """select prompt_id, routed_model, energy_kwh, co2_kg, energy_saved_kwh, energy_saved_pct, green_score from routed""",
    ),
    "energy_against_any_baseline": (
        energy_against_any_baseline,
        """select prompt_id, e as energy_kwh, e * 0.475::double as co2_kg,
 greatest(0, least(100, round_even(100 * (1 - e / b), 0)))::int as green_score,
 round_even(greatest(0::double, b - e) / b * 100, 1) as energy_saved_pct, greatest(0::double, b - e) as energy_saved_kwh from
 (select r.prompt_id, r.size_gb * 5e-5 as e, base_gb * 5e-5 as b from routed r join
  (select prompt_id, max(size_gb) as base_gb from normalised join models on model_id = model where error is null group by prompt_id) s
  on s.prompt_id = r.prompt_id)""",
    ),
    "energy_bands": (
        energy_bands,
        """select case when confidence > 0.9::double then 'High' when confidence > 0.7::double then 'Medium' else 'Low' end as confidence_band,
 case when green_score > 75 then 'Excellent' when green_score > 50 then 'Good' else 'Fair' end as green_band, count(*) as n
 from routed group by all""",
    ),
    "baseline_comparison": (
        baseline_comparison,
        f"""select prompt_id, 'smart' as strategy, routed_model as model, energy_kwh, co2_kg, ({_BASE} - energy_kwh) * 0.475::double as co2_saved_kg from routed
 union all select prompt_id, 'baseline', 'qwen2.5:7b', {_BASE}, {_BASE} * 0.475::double, 0::double from routed""",
    ),
    "workload_energy_rollup": (
        workload_energy_rollup,
        f"""select case when grouping(complexity) = 0 then 'class' when grouping(source_dataset) = 0 then 'source' else 'total' end as level,
 coalesce(complexity, source_dataset) as item, round(count(*) * 100 / (select count(*) from routed), 6) as mix_pct, {_FIGURES}
 from routed group by grouping sets ((complexity), (source_dataset), ())""",
    ),
    "daily_energy_rollup": (
        daily_energy_rollup,
        f"""select *, round(energy_kwh * 365, 12) as kwh_per_year, round(saved_kwh * 365, 12) as saved_kwh_per_year,
 round(co2_kg * 365, 12) as co2_kg_per_year from
 (select strftime(ts, '%Y-%m-%d') as day, {_FIGURES} from event_routed group by 1)""",
    ),
}

# Where there are files of public tokenizers.
if find_spec("public_tokenizers") is not None:
    QUERIES |= {
        "subword_slices": (subword_slices, cut_into_pieces(vocabulary_path())),
        "subword_classifier_scores": (subword_classifier_scores, trained(_SHARES, vocabulary=vocabulary_path())),
    }
