"""Reply parsers, explanations and energy figures."""

import re

import pytest
from pyspark.sql import functions as F

from promptroute import settings as st
from promptroute.functions import energy as en
from promptroute.functions.replies import bare_number, parse_reply, parse_verdict, percentage, stated_number
from promptroute.functions.text import strip, truncated, word_count
from promptroute.functions.wording import judge_text, percent
from promptroute.operators import routing
from promptroute.operators.energy import with_bands
from promptroute.operators.responses import compare_pair, normalise_responses, parse_replies, settle_attempts, side_by_side

REPLIES = [
    ("Sentiment: POSITIVE\nConfidence: 85", "POSITIVE", 0.85, True),
    ("Confidence: 0.85, negative", "NEGATIVE", 0.85, True),
    ("neutral 60%", "NEUTRAL", 0.60, True),
    ("NEGATIVE 75", "NEGATIVE", 0.75, True),
    ("not positive, 1", "POSITIVE", 1.0, True),
    ("positive 250", "NEUTRAL", 0.0, False),
    ("positive", "NEUTRAL", 0.0, False),
    ("confidence: 250 positive", "POSITIVE", 1.0, True),
    ("confidence: 85. negative", "NEGATIVE", 0.85, True),
    ("42", "NEUTRAL", 0.0, False),
    ("", "NEUTRAL", 0.0, False),
]
GREEN = {
    "tinyllama:latest": 86, "deepseek-coder:1.3b": 83, "qwen2:1.5b": 80, "deepseek-r1:1.5b": 77,
    "qwen2.5:3b": 60, "phi3:latest": 53, "gemma3:4b": 30, "zephyr:latest": 13, "qwen2:latest": 6,
    "qwen2.5:7b": 0, "qwen2.5-coder:latest": 0,
}


def test_replies(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "id long, t string")
    out = df.select("id", parse_reply(F.col("t")).alias("r")).orderBy("id").select("r.*").collect()
    assert [tuple(r) for r in out] == [r[1:] for r in REPLIES]
    staged = parse_replies(df.withColumn("label", F.lit("old")), "t").orderBy("id")
    assert staged.columns == ["id", "t", "label", "confidence", "ok"]
    assert [tuple(r)[2:] for r in staged.collect()] == [r[1:] for r in REPLIES]


def test_numbers_are_found_as_python_finds_them(spark):
    patterns = [r"confidence[:\s]+(\d+\.?\d*)", r"(\d+\.?\d*)%", r"\b(\d+\.?\d*)\b"]
    said = [
        "confidence:\u00a0150 then 20", "negative \u0668\u0665%", "\u00e985 40", "a1 2_ _3 4", "85.x", "1.5a", "1.5.2", "x.5",
        "confidence\u2003\uff19\uff15", "confidence \x1c7", "confidence\u200b7", "12\u0e51 3", "5\u00bd 6", "(7)", "8%9%", "",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "id long, t string").orderBy("id")
    found = df.select(*[f(F.col("t")) for f in (stated_number, percentage, bare_number)]).collect()
    for text, row in zip(said, found):
        want = [re.search(p, text) for p in patterns]
        assert list(row) == [float(m[1]) if m else None for m in want], text


def test_verdicts(spark):
    said = ["small", " Medium\n", "LARGE.", "large or small", "medium, not large", "?", None]
    df = spark.createDataFrame(list(enumerate(said)), "id long, t string").orderBy("id")
    assert [r[0] for r in df.select(parse_verdict(F.col("t"))).collect()] == [
        "small", "medium", "large", "small", "medium", None, None,
    ]


def test_strip_and_truncate(spark):
    texts = ["  a b ", " x \n", "\t\x1f", "", "plain", "\x0b\x85q　"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").orderBy("id")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]
    long = spark.createDataFrame([("x" * 150,), ("y" * 151,)], "t string")
    assert [r[0] for r in long.select(truncated(F.col("t"), 150)).collect()] == [
        "x" * 150, "y" * 150 + "...",
    ]


def test_judge_text_cuts_and_keeps_braces(spark):
    df = spark.createDataFrame([("$1 {prompt} \\ " + "z" * 2000,)], "p string")
    text = df.select(judge_text(F.col("p"))).first()[0]
    assert ("$1 {prompt} \\ " + "z" * 2000)[:1000] in text and "z" * 990 not in text


def test_percent_rounds_like_python(spark):
    shares = [0.645, 0.655, 0.005, 0.015, 0.905, 0.6449, 1.0, 0.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shares)], "id long, s double")
    out = [r[0] for r in df.orderBy("id").select(percent(F.col("s"))).collect()]
    assert out == [f"{s:.0%}" for s in shares]


def test_energy_of_every_model(spark):
    models = routing.model_registry(spark).withColumn("e", en.energy_kwh(F.col("size_gb")))
    rows = models.select(
        "model_id", "size_gb", "e", en.co2_kg(F.col("e")).alias("co2"),
        en.saved_pct(F.col("e")).alias("pct"), en.green_score(F.col("e")).alias("green"),
    ).collect()
    assert {r.model_id: r.green for r in rows} == GREEN
    base = 4.7 * 5e-5
    for r in rows:
        assert r.e == r.size_gb * 5e-5 and r.co2 == r.e * 0.475
        assert r.pct == max(0, (base - r.e) / base * 100)


@pytest.mark.parametrize("size,base", [(0.637, 4.7), (4.7, 4.7), (9.0, 4.7), (1.0, 0.0), (2.35, 4.7)])
def test_energy_report(spark, size, base):
    row = spark.range(1).select(
        en.energy_report(F.lit(size).cast("double"), F.lit(base).cast("double")).alias("r")
    ).select("r.*").first()
    e, b = size * 5e-5, base * 5e-5
    saved = max(0.0, b - e)
    assert row.energy_saved_kwh == saved
    assert row.energy_saved_pct == (round(saved / b * 100, 1) if b else 0.0)
    assert row.green_score == (max(0, min(100, round(100 * (1 - e / b)))) if b else 0)


def test_unknown_energy_has_no_savings(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(en.saved_kwh(none), en.saved_pct(none), en.green_score(none)).first()
    assert tuple(row) == (None, None, None)


def test_bands(spark):
    df = spark.createDataFrame([(0.91, 76), (0.9, 75), (0.71, 51), (0.7, 50)], "confidence double, green_score int")
    assert [(r.confidence_band, r.green_band) for r in with_bands(df).collect()] == [
        ("High", "Excellent"), ("Medium", "Good"), ("Medium", "Good"), ("Low", "Fair"),
    ]


def test_failed_responses(spark):
    rows = [
        (1, "tinyllama:latest", "positive 80", 5.0, None),
        (2, "tinyllama:latest", "positive", 5.0, None),
        (3, "tinyllama:latest", None, 5.0, "Request timeout"),
        (4, "nobody:1b", "positive 80", 5.0, None),
    ]
    df = spark.createDataFrame(rows, "prompt_id long, model string, raw_response string, latency_ms double, error string")
    out = normalise_responses(df, routing.model_registry(spark)).orderBy("prompt_id").collect()
    assert [r.label for r in out] == ["POSITIVE", "ERROR", "ERROR", "ERROR"]
    assert [r.error for r in out] == [None, st.ERROR_FORMAT, "Request timeout", "Model nobody:1b not found"]
    assert [r.energy_kwh > 0 for r in out] == [True, False, False, False]
    assert out[1].raw_response == "positive" and out[3].latency_ms == 0


def test_word_count_is_exact_up_to_the_bound(spark):
    texts = [
        edge + " ".join(["w"] * n) + tail
        for n in list(range(0, 12)) + [119, 120, 121, 122, 123, 124, 125, 130, 500]
        for edge in ("", " ", "\n\n")
        for tail in ("", " ", "\t ")
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").orderBy("id")
    for bound in (3, 120):
        got = [r[0] for r in df.select(word_count("t", exact_to=bound)).collect()]
        for count, text in zip(got, texts):
            words = len(text.split())
            assert count == words if words <= bound else count > bound


def test_of_several_attempts_the_latest_good_one_counts(spark):
    rows = [
        (1, "tinyllama:latest", "positive 80%", None, 1), (1, "tinyllama:latest", None, "Connection refused", 2),
        (1, "qwen2.5:7b", "no number", None, 1), (1, "qwen2.5:7b", "negative, 70%", None, 2),
        (1, "qwen2.5:7b", "neutral, 60% of it", None, 3), (2, "qwen2.5:7b", None, "Request timeout", 1),
        (2, "qwen2.5:7b", None, "Connection refused", 2), (2, "tinyllama:latest", "positive 90%", None, 1),
    ]
    log = spark.createDataFrame(
        [(p, m, r, 5.0, e, a) for p, m, r, e, a in rows],
        "prompt_id long, model string, raw_response string, latency_ms double, error string, attempt int",
    )
    done = normalise_responses(log, routing.model_registry(spark))
    one = {(r.prompt_id, r.model): (r.label, r.error) for r in settle_attempts(done).collect()}
    assert one == {
        (1, "tinyllama:latest"): ("POSITIVE", None), (1, "qwen2.5:7b"): ("NEUTRAL", None),
        (2, "qwen2.5:7b"): ("ERROR", "Connection refused"), (2, "tinyllama:latest"): ("POSITIVE", None),
    }
    pairs = compare_pair(done, "tinyllama:latest", "qwen2.5:7b").orderBy("prompt_id").collect()
    assert [(r.small_success, r.large_success, r.large_error) for r in pairs] == [
        (True, True, None), (True, False, "Connection refused"),
    ]
    plan = compare_pair(log.withColumns({"energy_kwh": F.lit(1.0)}), "a", "b")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange") == 1 and "Join" not in plan.toString()
    shown = side_by_side(done, ["qwen2.5:7b"]).orderBy("prompt_id").collect()
    assert [r.text_1 for r in shown] == ["neutral, 60% of it", "Connection refused"]
