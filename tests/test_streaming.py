"""The stream gives what the batch gives; unanswered requests time out."""

import datetime as dt
import os
import shutil

from promptroute.catalog import derived as dv
from promptroute.operators import routing
from promptroute.plans.route_workload import route_workload
from promptroute.streaming import online

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def files(spark, df, path, n=3):
    df.repartition(n).write.parquet(path)
    return online.read_stream(spark, path, df.schema, files_per_batch=1)


def run(stream, tmp_path, name="out"):
    return online.run_to_table(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-progress")


def test_stream_equals_batch_over_several_batches(spark, sf_dir, tmp_path):
    events = dv.table(spark, sf_dir, "events")
    stream = files(spark, events, str(tmp_path / "events"))
    scored = online.score_stream(
        dv.event_predictions(stream), routing.tier_table(spark), routing.model_registry(spark)
    )
    columns = ["prompt_id", "complexity", "routed_model", "energy_kwh", "green_score"]
    got = run(scored.select(*columns), tmp_path)
    want = route_workload(dv.event_predictions(events)).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_window_totals_over_several_batches(spark, tmp_path):
    rows = [(T0 + dt.timedelta(minutes=m), "small", 1.0, 0.5) for m in (0, 30, 59, 61, 119, 125)]
    df = spark.createDataFrame(rows, "ts timestamp, complexity string, energy_kwh double, co2_kg double")
    stream = files(spark, df.coalesce(1), str(tmp_path / "m"), n=1)
    out = online.run_totals_to_table(online.window_energy(stream), f"{tmp_path}/t", f"{tmp_path}/p")
    assert sorted((r.prompts, r.energy_kwh) for r in out.collect()) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


ASKED = "prompt_id long, model string, timeout_s int, request_ts timestamp"
ANSWERED = "prompt_id long, model string, response_ts timestamp, raw_response string, error string"


def test_requests_time_out_and_every_one_is_settled(spark, tmp_path):
    requests = [
        (1, "a", 30, at(0)), (2, "a", 30, at(1)), (3, "a", 60, at(2)), (4, "a", 600, at(3)),
        (5, "a", 900, at(4)), (6, "a", 900, at(5)), (7, "a", 900, at(6)), (9, "a", 30, at(9000)), (10, "a", 30, at(9001)),
        (11, "a", 30, at(9002)),
    ]
    responses = [
        (1, "a", at(25), "again", None), (1, "a", at(20), "fine", None), (1, "a", at(29), None, "third"), (2, "a", at(40), "late", None),
        (3, "a", at(50), None, "boom"), (4, "a", at(303), "slow", None), (5, "a", at(10), "quick", None),
        (6, "a", at(700), "beyond the bound", None), (11, "a", at(9003), "one", None), (11, "a", at(9003), "two", None),
        (9, "a", at(9001), "ok", None),
    ]
    asked, answered = spark.createDataFrame(requests, ASKED), spark.createDataFrame(responses, ANSWERED)
    matched = run(
        online.match_responses(
            files(spark, asked, str(tmp_path / "q"), 1), files(spark, answered, str(tmp_path / "a"), 1), 600
        ),
        tmp_path,
    )
    # The stream itself gives every request that its watermark has passed, and each once.
    assert sorted(r.prompt_id for r in matched.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert {r.prompt_id: r.raw_response for r in matched.collect()}[1] == "fine"
    rows = online.settle_matches(matched, asked, answered, 600).collect()
    out = {r.prompt_id: r for r in rows}
    assert len(rows) == len(requests)
    assert out[1].raw_response == "fine" and out[1].latency_ms == 20000.0
    assert out[2].error == "Request timeout" and out[2].raw_response is None
    assert out[3].error == "boom" and out[3].response_ts is not None
    assert out[4].raw_response == "slow" and out[4].error is None
    assert out[5].raw_response == "quick" and out[5].error is None and out[5].latency_ms == 6000.0
    for unbounded in (6, 7):
        assert out[unbounded].error == "Timeout above the longest of the registry" and out[unbounded].raw_response is None
    assert out[11].raw_response == "one"
    assert out[9].raw_response == "ok" and out[10].error == "Request timeout"
    batch = online.match_responses(asked, answered, 600)
    assert sorted(map(str, batch.collect())) == sorted(map(str, rows))


def test_a_restarted_stream_goes_on_in_the_same_table(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, complexity string, energy_kwh double, co2_kg double"
    got = []
    for start in (0, 10):
        rows = [(at(60 * k), "small", 1.0, 0.5) for k in range(start, start + 10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = online.read_stream(spark, folder, spark.read.parquet(folder).schema)
        got.append(run(stream, tmp_path).count())
        totals = online.run_totals_to_table(
            online.window_energy(online.read_stream(spark, folder, spark.read.parquet(folder).schema)),
            f"{tmp_path}/totals", f"{tmp_path}/totals-progress",
        )
        got.append([r.prompts for r in totals.collect()])
    assert got == [10, [10], 20, [20]]


def test_totals_are_compacted_and_a_failure_on_the_way_changes_nothing(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "in"), "ts timestamp, complexity string, energy_kwh double, co2_kg double"
    path, progress = f"{tmp_path}/totals", f"{tmp_path}/totals-progress"
    monkeypatch.setattr(online, "COMPACTED", 3)

    def more(hours):
        for h in hours:
            spark.createDataFrame([(at(3600 * h + 60 * k), "small", 1.0, 0.5) for k in range(3)], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = online.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
        totals = online.run_totals_to_table(online.window_energy(stream), path, progress)
        return sorted((r.window_start.hour, r.prompts, r.energy_kwh) for r in totals.collect())

    want = [(h, 3, 3.0) for h in range(8)]
    assert more(range(8)) == want
    kept = [f for f in os.listdir(path) if f.startswith("batch=")]
    bases = os.listdir(f"{path}/_base")
    assert 0 < len(kept) < 8 and 0 < len(bases) <= 2
    # A base without its mark is not looked at, and neither is a batch run again that the base has.
    shutil.copytree(f"{path}/_base/{max(bases)}", f"{path}/_base/upto-999")
    os.remove(f"{path}/_base/upto-999/_SUCCESS")
    spark.createDataFrame([], "window_start timestamp, complexity string, prompts long, energy_kwh double, co2_kg double").write.parquet(f"{path}/batch=0")
    schema_of = online.window_energy(online.read_stream(spark, folder, spark.read.parquet(folder).schema)).schema
    again = online.latest_totals(spark, path, schema_of)
    assert sorted((r.window_start.hour, r.prompts, r.energy_kwh) for r in again.collect()) == want
    # A restarted query goes on from the base.
    assert more([9, 10]) == [*want, (9, 3, 3.0), (10, 3, 3.0)]
    online.compact_totals(spark, path, schema_of)
    online.compact_totals(spark, path, schema_of)
    assert sorted(r.prompts for r in online.latest_totals(spark, path, schema_of).collect()) == [3] * 10


def test_a_late_row_does_not_reopen_its_window(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "ts timestamp, complexity string, energy_kwh double, co2_kg double"
    for minutes in ((0, 30), (200,), (1,), (210,)):
        rows = [(at(60 * m), "small", 1.0, 0.5) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = online.read_stream(spark, folder, spark.read.parquet(folder).schema)
        totals = online.run_totals_to_table(
            online.window_energy(stream), f"{tmp_path}/totals", f"{tmp_path}/totals-progress"
        )
    assert sorted(r.prompts for r in totals.collect()) == [2, 2]
