"""Texts do not travel where only the verdict on them is asked for, nor those that nobody asked for."""

from pyspark.sql import functions as F

from promptroute.catalog import derived as dv
from promptroute.operators import responses as rs
from promptroute.operators import routing
from promptroute.operators.validation import validation_report
from promptroute.plans.validate_routing import validate_routing
from promptroute.session import materialise
from promptroute.settings import BASELINE_MODEL, SMALLEST_MODEL


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()



def logged(spark, sf_dir):
    # Written, so that the plan begins at the table of normalised replies.
    return materialise(dv.normalised(spark, sf_dir), "normalised")


def test_the_report_gathers_no_text(spark, sf_dir):
    replies = logged(spark, sf_dir)
    predictions = dv.labelled_predictions(spark, sf_dir)
    table = validate_routing(predictions, replies, texts=False)
    assert not [c for c in table.columns if c.endswith("response")]
    gathered = [line for line in plan(table).split("\n") if "Aggregate" in line and "_tie" in line]
    assert gathered and not any("response, " in line and "coalesce(raw_response" in line for line in gathered)
    with_texts = validate_routing(predictions, replies)
    gathered = [line for line in plan(with_texts).split("\n") if "Aggregate" in line and "_tie" in line]
    assert any("response" in line for line in gathered)
    report = lambda t: sorted(map(str, validation_report(t).collect()))
    assert report(table) == report(with_texts)


def test_only_prompts_predicted_small_are_compared(spark, sf_dir):
    replies = logged(spark, sf_dir)
    wanted = replies.select("prompt_id").distinct().where("prompt_id % 5 = 0")
    some = rs.compare_pair(replies, SMALLEST_MODEL, BASELINE_MODEL, wanted)
    every = rs.compare_pair(replies, SMALLEST_MODEL, BASELINE_MODEL).where("prompt_id % 5 = 0")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.collect()))
    # Small enough to be broadcast, the ids meet the replies before these are shuffled.
    lines = plan(some).split("\n")
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-")) for x in lines if word in x)
    assert depth("LeftSemi") > depth("Aggregate")


def test_replies_of_models_that_no_class_is_routed_to_do_not_travel(spark, sf_dir):
    replies = logged(spark, sf_dir)
    predictions = dv.predictions(spark, sf_dir)
    tiers, registry = routing.tier_table(spark), routing.model_registry(spark)
    for overrides in (None, {"large": "zephyr:latest", "odd": "phi3:latest"}):
        routed = routing.route_and_account(predictions, tiers, registry, overrides, responses=replies)
        models = {r.routed_model for r in routed.select("routed_model").distinct().collect()}
        assert "LeftSemi" in plan(routed)
        want = rs.settle_attempts(replies).select("prompt_id", F.col("model").alias("routed_model"), F.coalesce("raw_response", F.lit("")).alias("r"), F.col("error").alias("e"))
        both = routed.join(want, ["prompt_id", "routed_model"], "left")
        assert len(models) == 3 and both.where("not (response <=> r) or not (error <=> e)").count() == 0
    odd = predictions.limit(5).withColumn("predicted", F.lit("odd"))
    rows = routing.route_and_account(odd, tiers, registry, {"odd": "phi3:latest"}, responses=replies).collect()
    assert all(r.response is not None for r in rows if r.routed_model == "phi3:latest")
