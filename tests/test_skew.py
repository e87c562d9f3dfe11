"""One key may hold most of the rows; an input may hold none."""

from pyspark.sql import functions as F

from promptroute.operators import sampling as sp
from promptroute.operators.evaluation import confusion
from promptroute.operators.judge import agreement, attach_verdicts
from promptroute.operators.profile import describe_numeric, distribution
from promptroute.operators.responses import leaderboard
from promptroute.sources import corpora, sinks


def test_hot_conversation(spark):
    turns = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("conv_id"),
        (20000 - F.col("id")).alias("turn"),
        F.lit("user").alias("role"),
        F.concat(F.lit("a prompt with number "), "id").alias("text"),
    )
    out = corpora.chat_prompts_from_turns(turns.repartition(6))
    hot = out.filter("conv_id = 7").collect()
    assert [r.prompt for r in hot] == ["a prompt with number 19998"]
    assert out.count() == turns.select("conv_id").distinct().count()


def test_hot_prompt_on_the_leaderboard(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") < 6000, -1).otherwise(F.col("id")).alias("prompt_id"),
        F.concat(F.lit("m"), F.lpad("id", 5, "0")).alias("model"),
        F.lit("POSITIVE").alias("label"),
        F.lit(0.5).alias("confidence"),
        (F.col("id") + 1).cast("double").alias("latency_ms"),
        F.lit(1e-4).alias("energy_kwh"),
        F.lit(5e-5).alias("co2_kg"),
        F.lit(None).cast("string").alias("error"),
    )
    best = {r.prompt_id: r for r in leaderboard(rows).collect()}
    assert len(best) == 3001
    assert best[-1].model == "m00000" and best[-1].score == round(100 * (0.2 + 0.2 * (1 - 1 / 6000)), 6)


def test_compact_write_splits_a_hot_partition(spark, tmp_path):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("source_dataset")
    ).repartition(20)
    sinks.write_parquet(df, str(tmp_path / "c"), ["source_dataset"], compact=True)
    sinks.write_parquet(df, str(tmp_path / "p"), ["source_dataset"])
    files = {k: len(list((tmp_path / k).rglob("*.parquet"))) for k in "cp"}
    assert files["c"] < files["p"] == 40
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5000


def test_empty_inputs(spark):
    schema = "row_key string, prompt string, source_dataset string, complexity_label string"
    none = spark.createDataFrame([], schema)
    for sample in (
        sp.balance(none, "row_key"),
        sp.judge_sample(none, "row_key"),
        sp.stratified_split(none, "row_key"),
        sp.sample_per_class(none, "row_key", 3),
        sp.first_by_hash(none, "row_key", 3),
        distribution(none, "complexity_label"),
    ):
        assert sample.count() == 0
    assert describe_numeric(none, F.length("prompt")).count() <= 1
    assert confusion(none.withColumn("predicted", F.col("complexity_label"))).count() == 9
    assert agreement(attach_verdicts(none, "row_key")).filter("judged > 0").count() == 0
