"""Logged responses, validation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.catalog import derived as dv
from promptroute.catalog import sql as q
from promptroute.catalog.corpus_queries import _rounded
from promptroute.functions.wording import SENTIMENT_TEMPLATE
from promptroute.operators import responses as rs
from promptroute.operators import routing, sketches
from promptroute.operators.validation import validation_report as report_of
from promptroute.plans.validate_routing import validate_routing
from promptroute.session import materialise, new_path
from promptroute.settings import BASELINE_MODEL, SMALLEST_MODEL
from promptroute.streaming import online

FLEET = ("tinyllama:latest", "unlisted:1b", "qwen2.5:7b", "phi3:latest")
PANELS = ("tinyllama:latest", "qwen2.5:3b", "qwen2.5:7b")


def inference_requests(spark: SparkSession, d: str) -> DataFrame:
    requests = rs.fan_out(dv.workload(spark, d), FLEET, routing.model_registry(spark))
    return requests.select("prompt_id", "slot", "model", "timeout_s")


def request_texts(spark: SparkSession, d: str) -> DataFrame:
    return rs.with_request_text(dv.workload(spark, d)).select("prompt_id", "request")


def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    replies = dv.responses(spark, d).filter("error is null")
    return rs.parse_replies(replies).select("prompt_id", "model", "attempt", "label", "confidence", "ok")


def normalised_responses(spark: SparkSession, d: str) -> DataFrame:
    return dv.normalised(spark, d)


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return rs.side_by_side(dv.normalised(spark, d), PANELS)


def pair_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rs.compare_pair(dv.normalised(spark, d), SMALLEST_MODEL, BASELINE_MODEL)


def _table(spark: SparkSession, d: str, use_rules: bool = False, texts: bool = True) -> DataFrame:
    return validate_routing(
        dv.labelled_predictions(spark, d), dv.normalised(spark, d), use_rules=use_rules, texts=texts
    )


def validation_table(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d)


def validation_table_after_rules(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, use_rules=True)


def validation_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(report_of(_table(spark, d, texts=False)))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rs.leaderboard(dv.normalised(spark, d))


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(rs.model_summary(dv.normalised(spark, d)), 12)


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of latency per model, from stored sketches of every tenth part of the prompts."""
    log = dv.normalised(spark, d).withColumn("part", F.col("prompt_id") % 10)
    stored = materialise(sketches.latency_sketches(log, ["part", "model"]), "sketches")
    shares = {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    found = sketches.merged(stored, ["model"])
    return found.select("model", "n", *(F.round(sketches.quantile(q), 6).alias(c) for c, q in shares.items()), F.round("most", 6).alias("most"))


# ------------------------------------------------------------------ streams
def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    folder, pattern = dv.stream_folder(d, "events")
    schema = dv.table(spark, d, "events").schema
    return dv.event_predictions(online.read_stream(spark, folder, schema, pattern))


def _routed_stream(spark: SparkSession, d: str, every_rule: bool = False, keep=()) -> DataFrame:
    tiers, models = routing.tier_table(spark), routing.model_registry(spark)
    return online.score_stream(
        _event_stream(spark, d), tiers, models, every_rule=every_rule, keep=keep
    )


def _run(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    return online.run_to_table(stream, new_path(spark, "stream"), new_path(spark, "progress"))


def stream_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = _run(_routed_stream(spark, d, every_rule=True).drop("all_probs"))
    return scored.select(
        "prompt_id",
        "complexity",
        "confidence",
        "routed_model",
        "energy_kwh",
        "co2_kg",
        "energy_saved_pct",
        "green_score",
        F.array_join("fired_rules", ",").alias("fired_rules"),
    )


def stream_registry_join(spark: SparkSession, d: str) -> DataFrame:
    routed = _routed_stream(spark, d).select("prompt_id", "routed_model")
    sized = online.join_registry(routed, routing.model_registry(spark))
    return _run(sized)


def stream_window_energy(spark: SparkSession, d: str) -> DataFrame:
    windows = online.window_energy(_routed_stream(spark, d, keep=["ts"]))
    totals = online.run_totals_to_table(windows, new_path(spark, "windows"), new_path(spark, "progress"))
    return _rounded(totals.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm")), 12)


def _asked(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("prompt_id"),
        F.lit(SMALLEST_MODEL).alias("model"),
        (F.col("event_id") % 4 * 10 + 10).cast("int").alias("timeout_s"),
        F.col("ts").cast("timestamp").alias("request_ts"),
    )


def _answered(events: DataFrame) -> DataFrame:
    """Answers 5 to 45 seconds later, of which every seventh is an error, with the event's content."""
    n = F.col("event_id")
    failed = n % 7 == 0
    delay = F.make_dt_interval(secs=(n % 5 * 10 + 5).cast("decimal(18,6)"))
    return events.select(
        n.alias("prompt_id"),
        F.lit(SMALLEST_MODEL).alias("model"),
        (F.col("ts").cast("timestamp") + delay).alias("response_ts"),
        F.when(~failed, F.concat_ws(" ", "event_type", "props")).alias("raw_response"),
        F.when(failed, "Connection refused").alias("error"),
    )


def stream_response_match(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to the small model, whose answers come in time, late, or as errors."""
    folder, pattern = dv.stream_folder(d, "events")
    given = dv.table(spark, d, "events")
    longest = online.longest_timeout(routing.model_registry(spark))
    asked, answered = (online.read_stream(spark, folder, given.schema, pattern) for _ in range(2))
    matched = _run(online.match_responses(_asked(asked), _answered(answered), longest))
    settled = online.settle_matches(matched, _asked(given), _answered(given), longest)
    return settled.drop("request_ts", "response_ts")


# ------------------------------------------------------------------ SQL
_before, _after = SENTIMENT_TEMPLATE.split("{text}")
_SIDE = """(select prompt_id, model, coalesce(raw_response, '') as response, error, latency_ms, energy_kwh,
 error is null and length(coalesce(raw_response, '')) > 10 as success from settled where model = {})"""
_PAIR = f"""(select s.prompt_id, s.model as small_model, s.response as small_response, s.error as small_error,
 s.latency_ms as small_latency, s.energy_kwh as small_energy, s.success as small_success,
 l.model as large_model, l.response as large_response, l.error as large_error,
 l.latency_ms as large_latency, l.energy_kwh as large_energy, l.success as large_success,
 s.success and l.success as equivalent_quality,
 case when s.success then l.energy_kwh - s.energy_kwh end as energy_saved_kwh,
 case when s.success then case when l.energy_kwh > 0 then (l.energy_kwh - s.energy_kwh) * 100 / l.energy_kwh else 0 end end as energy_saved_pct
 from {_SIDE.format(q.text(SMALLEST_MODEL))} s join {_SIDE.format(q.text(BASELINE_MODEL))} l on l.prompt_id = s.prompt_id)"""
_VALIDATION = f"""(select t.prompt_id, true_label, predicted, raw_confidence as confidence, p.* exclude (prompt_id)
 from truths t left join {_PAIR} p on p.prompt_id = t.prompt_id and predicted = 'small')"""


def _panel(i: int, model: str) -> str:
    return f"""{q.text(model)} as model_{i}, max(case when error is null then 'success' else 'error' end) filter (where model = {q.text(model)}) as status_{i},
 max(coalesce(error, raw_response)) filter (where model = {q.text(model)}) as text_{i}, max(latency_ms) filter (where model = {q.text(model)}) as latency_ms_{i}"""


QUERIES = {
    "inference_requests": (
        inference_requests,
        f"""select prompt_id, slot::int as slot, model, coalesce(timeout_s, 120) as timeout_s from
 (select prompt_id, unnest({q.listing(FLEET[:3])}) as model, unnest([0, 1, 2]) as slot from workload) left join models on model_id = model""",
    ),
    "request_texts": (
        request_texts,
        f"select prompt_id, {q.text(_before)} || prompt || {q.text(_after)} as request from workload",
    ),
    "parsed_replies": (
        parsed_replies,
        "select prompt_id, model, attempt, out_label as label, out_conf as confidence, ok from parsed where error is null",
    ),
    "normalised_responses": (normalised_responses, "select * from normalised"),
    "side_by_side": (
        side_by_side,
        f"""select prompt_id, {", ".join(_panel(i, m) for i, m in enumerate(PANELS, 1))} from settled group by prompt_id""",
    ),
    "pair_comparison": (pair_comparison, f"select * from {_PAIR}"),
    "validation_table": (validation_table, f"select * from {_VALIDATION}"),
    "validation_table_after_rules": (
        validation_table_after_rules,
        f"""select t.prompt_id, true_label, r.complexity as predicted, r.confidence, p.* exclude (prompt_id)
 from truths t join ruled r on r.prompt_id = t.prompt_id left join {_PAIR} p on p.prompt_id = t.prompt_id and r.complexity = 'small'""",
    ),
    "validation_report": (
        validation_report,
        f"""select metric, item, round(value, 6) as value from (
 select 'total_prompts' as metric, null::varchar as item, count(*)::double as value from {_VALIDATION}
 union all select 'classifier_accuracy', null, avg((true_label = predicted)::int) from {_VALIDATION}
 union all select 'count', predicted, count(*) from {_VALIDATION} group by predicted
 union all select 'avg_confidence', predicted, avg(confidence) from {_VALIDATION} group by predicted
 union all select 'total_routed', null, count(*) from {_VALIDATION} where predicted = 'small'
 union all select 'total_tested', null, count(equivalent_quality) from {_VALIDATION} where predicted = 'small'
 union all select 'equivalent_quality_rate', null, avg(equivalent_quality::int) from {_VALIDATION} where predicted = 'small'
 union all select 'avg_energy_saved_pct', null, avg(energy_saved_pct) from {_VALIDATION} where predicted = 'small')
 where value is not null""",
    ),
    "leaderboard": (
        leaderboard,
        """select prompt_id, model, label, confidence, score from
 (select *, row_number() over (partition by prompt_id order by score desc, model) as rn from
  (select *, round((confidence * 0.4::double + coalesce(1 - energy_kwh / nullif(max(energy_kwh) over w, 0), 1) * 0.3::double
   + coalesce(1 - latency_ms / nullif(max(latency_ms) over w, 0), 1) * 0.2::double
   + coalesce(1 - co2_kg / nullif(max(co2_kg) over w, 0), 1) * 0.1::double) * 100, 6) as score
   from settled where error is null window w as (partition by prompt_id))) where rn = 1""",
    ),
    "model_summary": (
        model_summary,
        """select model, count(*) as requests, round(avg((error is null)::int), 12) as success_rate,
 round(avg(coalesce(error = 'Model did not provide confidence score in expected format', false)::int), 12) as parse_failure_rate,
 round(avg(latency_ms), 12) as mean_latency_ms,
 round(quantile_disc(latency_ms, 0.95), 12) as p95_latency_ms, round(sum(energy_kwh), 12) as energy_kwh, round(sum(co2_kg), 12) as co2_kg
 from normalised group by model""",
    ),
    "latency_quantiles": (
        latency_quantiles,
        # Up to as many values as a sketch holds, its quantiles are exact.
        """select model, count(latency_ms) as n, round(quantile_disc(latency_ms, 0.25), 6) as p25, round(quantile_disc(latency_ms, 0.5), 6) as p50,
 round(quantile_disc(latency_ms, 0.95), 6) as p95, round(max(latency_ms), 6) as most from normalised group by model""",
    ),
    "stream_scores": (
        stream_scores,
        """select prompt_id, complexity, confidence, routed_model, energy_kwh, co2_kg, energy_saved_pct, green_score, fired_rules
 from event_routed""",
    ),
    "stream_registry_join": (
        stream_registry_join,
        """select prompt_id, routed_model, m.name as model_name, m.size_gb, m.timeout_s from event_routed r
 join models m on m.model_id = r.routed_model""",
    ),
    "stream_window_energy": (
        stream_window_energy,
        """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, complexity, count(*) as prompts,
 round(sum(energy_kwh), 12) as energy_kwh, round(sum(co2_kg), 12) as co2_kg from event_routed group by 1, 2""",
    ),
    "stream_response_match": (
        stream_response_match,
        """select event_id as prompt_id, 'tinyllama:latest' as model,
 case when answered and event_id % 7 <> 0 then concat_ws(' ', event_type, props) end as raw_response,
 case when not answered then 'Request timeout' when event_id % 7 = 0 then 'Connection refused' end as error,
 case when answered then (event_id % 5 * 10 + 5) * 1000::double end as latency_ms
 from (select *, event_id % 5 * 10 + 5 <= event_id % 4 * 10 + 10 as answered from events)""",
    ),
}
