"""Training finds a learnable rule, scores are probabilities, and a saved model scores alike, in passes and by Spark ML."""

import pytest

from pyspark.sql import functions as F

from promptroute.operators import classifier, passes, routing
from promptroute.operators.evaluation import confusion, metrics
from promptroute.operators.responses import normalise_responses
from promptroute.plans.train_model import train_and_evaluate
from promptroute.plans.validate_routing import publish, validate_sample

WORDS = {"small": "capital colour name", "medium": "summary email outline", "large": "theorem kernel compiler"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (f"k{i}", f"{WORDS[label].split()[i % 3]} about topic {i % 11}", "wildchat", label)
        for i in range(120)
        for label in [("small", "medium", "large")[i % 3 if i % 2 else (i // 3) % 3]]
    ]
    return spark.createDataFrame(
        rows, "row_key string, prompt string, source_dataset string, complexity_label string"
    )


def test_train_score_save(spark, corpus, tmp_path):
    model, report = train_and_evaluate(corpus, folder=str(tmp_path))
    row = report.first()
    assert row.accuracy > 0.9 and row.n == 24 and len(row.confusion_matrix) == 9
    scored = passes.score(corpus, model)
    for r in scored.collect():
        assert set(r.all_probs) == {"small", "medium", "large"}
        assert abs(sum(r.all_probs.values()) - 1) < 1e-9
        assert r.confidence == max(r.all_probs.values()) == r.all_probs[r.predicted]
    assert spark.read.json(f"{tmp_path}/training").where("best").count() == 1
    again = passes.score(corpus, passes.load_model(spark, f"{tmp_path}/model"))
    columns = ["row_key", "predicted", "confidence"]
    assert again.select(*columns).exceptAll(scored.select(*columns)).count() == 0
    assert metrics(confusion(again)).first() == metrics(confusion(scored)).first()

    numbered = corpus.withColumn("prompt_id", F.substring("row_key", 2, 9).cast("long"))
    asked = numbered.select(
        "prompt_id", F.explode(F.array(F.lit("tinyllama:latest"), F.lit("qwen2.5:7b"))).alias("model")
    )
    logged = asked.select(
        "*",
        F.lit("positive, confidence 80").alias("raw_response"),
        F.lit(9.0).alias("latency_ms"),
        F.when(F.col("prompt_id") % 2 == 0, "Request timeout").alias("error"),
    )
    responses = normalise_responses(logged, routing.model_registry(spark))
    table = validate_sample(numbered, model, responses, k=5)
    assert table.count() == 15
    compared = table.filter("equivalent_quality is not null")
    assert compared.count() == table.filter("predicted = 'small'").count() > 0
    lines = {(r.metric, r.item): r.value for r in publish(table, str(tmp_path / "v")).collect()}
    assert lines[("total_prompts", None)] == 15
    assert spark.read.json(str(tmp_path / "v" / "report")).count() == len(lines)
    assert spark.read.option("header", True).csv(str(tmp_path / "v" / "results")).count() == 15


def test_spark_ml_finds_the_rule_as_well(spark, corpus, tmp_path):
    model = classifier.train(corpus, candidates=(0.003,), max_iter=15)
    scored = classifier.score(corpus, model)
    for r in scored.collect():
        assert abs(sum(r.all_probs.values()) - 1) < 1e-9 and r.confidence == r.all_probs[r.predicted]
    assert metrics(confusion(scored)).first().accuracy > 0.9
    classifier.save_model(model, f"{tmp_path}/model")
    again = classifier.score(corpus, classifier.load_model(f"{tmp_path}/model"))
    assert metrics(confusion(again)).first() == metrics(confusion(scored)).first()


def test_only_the_first_tokens_count(spark, corpus):
    fitted = classifier.feature_pipeline(max_tokens=2).fit(classifier.with_text_features(corpus))
    df = spark.createDataFrame([("a b c d", "a b x y")], "x string, y string")
    rows = df.selectExpr("explode(array(x, y)) as prompt")
    out = fitted.transform(classifier.with_text_features(rows)).select("_tokens").collect()
    assert out[0][0] == out[1][0] == ["a", "b"]
