"""Sources, sinks and the end-to-end jobs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from promptroute import schemas
from promptroute.catalog import derived as dv
from promptroute.operators import routing
from promptroute.operators.validation import validation_report
from promptroute.plans import corpus_build
from promptroute.plans.corpus_build import build_corpus, latest_release, releases
from promptroute.plans.route_workload import route_workload
from promptroute.plans.validate_routing import validate_routing
from promptroute.session import materialise, run_folder, work_dir
from promptroute.sources import corpora, sinks


def chat(spark, rows):
    return spark.createDataFrame(
        rows, "row_key long, language string, conversation array<struct<role:string,content:string>>"
    )


def test_chat_prompts_bounds(spark):
    ok = "x" * 10
    rows = [
        (1, "English", [("user", f"  {ok}\n"), ("assistant", "no")]),
        (2, "English", [("user", "x" * 9)]),
        (3, "English", [("user", "x" * 2000)]),
        (4, "English", [("user", "x" * 2001)]),
        (5, "French", [("user", ok)]),
        (6, "English", [("system", ok), ("user", ok)]),
        (7, "English", []),
        (8, "English", None),
        (9, "English", [("user", None)]),
        (10, None, [("user", ok)]),
    ]
    df = chat(spark, rows)
    out = {r.row_key: r.prompt for r in corpora.chat_prompts(df).collect()}
    assert out == {1: ok, 3: "x" * 2000}
    assert corpora.chat_prompts(df, lang=None).count() == 4
    assert corpora.chat_prompts(df, limit=1).count() == 1


def test_chat_prompts_from_turns(spark):
    rows = [
        (1, 1, "assistant", "later answer here"), (1, 0, "user", " a first question "),
        (2, 3, "user", "second user turn"), (2, 2, "system", "be helpful now"),
        (3, 5, "user", "short"), (3, 6, "user", "long enough but not the first"),
        (4, 7, "user", "conversation that starts late"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.prompt for r in corpora.chat_prompts_from_turns(df).collect()}
    assert out == {1: "a first question", 4: "conversation that starts late"}


def test_qa_and_gold(spark):
    asked = spark.createDataFrame([(" why? ", "42"), (" \n", "x"), (None, "y"), ("q", None)], "question string, answer string")
    assert [(r.prompt, r.answer, r.source_dataset) for r in corpora.qa_prompts(asked).collect()] == [
        ("why?", "42", "gsm8k"), ("q", "", "gsm8k"),
    ]
    gold = corpora.gold_prompts(spark.createDataFrame([("t", 1)], "text string, label int"))
    assert gold.columns == ["prompt", "label", "source_dataset", "original_label"]
    plain = corpora.gold_prompts(spark.createDataFrame([("t",)], "prompt string"))
    assert plain.columns == ["prompt", "source_dataset"]


def test_csv_keeps_awkward_text(spark, tmp_path):
    texts = ['line\nbreak, comma "quote"', "back\\slash", "", "  spaces  "]
    df = spark.createDataFrame([(t, "a", "small") for t in texts], "prompt string, source_dataset string, complexity_label string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / "csv"))
    assert sorted(r.prompt or "" for r in back.collect()) == sorted(texts)
    assert back.columns == ["prompt", "source_dataset", "complexity_label"]


def test_parquet_scan_prunes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "corpus")
    sinks.write_parquet(dv.corpus(spark, sf_dir), path, ("source_dataset", "complexity_label"))
    read = corpora.read_corpus(spark, path, schemas.LABELED)
    plan = read.filter("complexity_label = 'small'").select("row_key")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_key:string>" in text and "PartitionFilters: [isnotnull(complexity_label" in text


def test_corpus_build(spark, sf_dir, tmp_path):
    built = build_corpus(
        dv.gold_corpus(spark, sf_dir), dv.chat_corpus(spark, sf_dir), dv.math_corpus(spark, sf_dir),
        sample_size=30,
    )
    built.publish(str(tmp_path))
    lines = spark.read.text(str(tmp_path / "metadata")).collect()
    meta = json.loads(lines[0][0])
    assert meta["original_size"] == built.full.count()
    assert meta["total_samples"] == sum(meta["class_distribution"].values())
    assert meta["eval_set_size"] == 30 and meta["llm_judge_used"] is False
    labelled = spark.read.parquet(str(tmp_path / "labeled"))
    assert labelled.count() == meta["total_samples"]
    assert spark.read.parquet(str(tmp_path / "evaluation")).filter("llm_judge_label is not null").count() == 0


def test_a_release_is_seen_whole_or_not_at_all(spark, sf_dir, tmp_path, monkeypatch):
    corpora_of = (dv.gold_corpus(spark, sf_dir), dv.chat_corpus(spark, sf_dir), dv.math_corpus(spark, sf_dir))
    built, folder = build_corpus(*corpora_of, sample_size=30), str(tmp_path / "corpus")
    assert latest_release(spark, folder) is None
    assert built.release(folder) == 1
    first = latest_release(spark, folder)
    whole = spark.read.parquet(f"{first}/labeled").count()

    def fails(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(corpus_build, "write_json", fails)
        with pytest.raises(RuntimeError):
            built.release(folder)
    # Half of version 2 is there, and nobody is sent to it.
    assert os.path.isdir(f"{folder}/version-2/labeled") and latest_release(spark, folder) == first
    assert [built.release(folder) for _ in range(2)] == [2, 3]
    assert releases(spark, folder) == [2, 3]
    listed = {r.output: r.n for r in spark.read.json(f"{latest_release(spark, folder)}/manifest").collect()}
    assert listed == {"labeled": whole, "evaluation": 30}


def test_a_run_leaves_no_intermediate_tables(spark, sf_dir, tmp_path):
    def run(out):
        with run_folder(spark, "run") as folder:
            balanced = build_corpus(
                dv.gold_corpus(spark, sf_dir), dv.chat_corpus(spark, sf_dir), dv.math_corpus(spark, sf_dir), sample_size=5
            ).balanced
            assert os.listdir(folder)
            balanced.write.parquet(out)

    before = sorted(os.listdir(work_dir(spark)))
    for i in range(2):
        run(f"{tmp_path}/{i}")
        assert sorted(os.listdir(work_dir(spark))) == before
    assert spark.read.parquet(f"{tmp_path}/1").count() > 0
    with pytest.raises(ZeroDivisionError), run_folder(spark, "run") as folder:
        materialise(spark.range(1), "kept")
        1 / 0
    assert os.listdir(folder)


def test_routing_pass_is_narrow(spark, sf_dir):
    routed = route_workload(dv.predictions(spark, sf_dir).coalesce(1))
    events = route_workload(dv.event_predictions(dv.table(spark, sf_dir, "events")))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastExchange") == 2
    assert routed.count() == dv.workload(spark, sf_dir).count()


def test_overrides_and_unknown_class(spark):
    df = spark.createDataFrame([("small",), ("odd",), (None,)], "complexity string")
    chosen = routing.with_choice(routing.with_tiers(df, routing.tier_table(spark)), {"odd": "phi3:latest"})
    assert [r.routed_model for r in chosen.collect()] == ["tinyllama:latest", "phi3:latest", "qwen2.5:3b"]


def test_available_model(spark):
    up = routing.model_registry(spark).filter("model_id in ('phi3:latest', 'zephyr:latest')")
    tiers = routing.pick_available(routing.tier_table(spark), up)
    got = {r.complexity: r.available_model for r in tiers.collect()}
    assert got == {"small": None, "medium": "phi3:latest", "large": "zephyr:latest"}


def test_validation_report_leaves_out_absent_classes(spark, sf_dir):
    table = validate_routing(
        dv.labelled_predictions(spark, sf_dir).filter("predicted <> 'small'"), dv.normalised(spark, sf_dir)
    )
    lines = {(r.metric, r.item) for r in validation_report(table).collect()}
    assert not any(m in ("total_routed", "equivalent_quality_rate") for m, _ in lines)
    assert ("count", "small") not in lines and ("classifier_accuracy", None) in lines


def test_energy_adds_up(spark, sf_dir):
    from promptroute.plans.route_workload import workload_energy

    rows = workload_energy(dv.predictions(spark, sf_dir)).collect()
    by_level = lambda level: [r for r in rows if r.level == level]
    total = by_level("total")[0]
    for level in ("class", "source"):
        assert sum(r.prompts for r in by_level(level)) == total.prompts
        assert abs(sum(r.energy_kwh for r in by_level(level)) - total.energy_kwh) < 1e-9
        assert abs(sum(r.mix_pct for r in by_level(level)) - 100) < 1e-4


def test_work_dir_setting_is_used(tmp_path):
    from promptroute.session import work_dir

    class Conf(dict):
        pass

    class Fake:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master})

    assert work_dir(Fake("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert work_dir(Fake("local[2]"))
    with pytest.raises(RuntimeError):
        work_dir(Fake("yarn"))


def test_materialise_keeps_rows_and_size(spark):
    from promptroute.session import materialise

    df = materialise(spark.range(5).withColumn("x", F.col("id") * 2), "five")
    assert df.count() == 5 and df.inputFiles()
