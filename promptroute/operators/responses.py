"""Request tables for a fleet of models, and logs of their responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.functions import energy as en
from promptroute.functions import replies as rp
from promptroute.functions.text import strip
from promptroute.functions.wording import SENTIMENT_TEMPLATE, sentiment_text
from promptroute.operators.once import with_computed_once
from promptroute.session import materialise
from promptroute.settings import (
    DEFAULT_TIMEOUT_S,
    ERROR_FORMAT,
    MAX_FAN_OUT,
    MIN_RESPONSE_CHARS,
)


def fan_out(
    prompts: DataFrame, model_ids: Sequence[str], models: DataFrame, limit: int = MAX_FAN_OUT
) -> DataFrame:
    """One request per prompt and model (the first ``limit`` models), with the timeout."""
    wanted = F.array(*[F.lit(m) for m in model_ids[:limit]])
    requests = prompts.select("*", F.posexplode(wanted).alias("slot", "model"))
    timeouts = models.select(F.col("model_id").alias("model"), "timeout_s")
    return requests.join(timeouts, "model", "left").withColumn(
        "timeout_s", F.coalesce("timeout_s", F.lit(DEFAULT_TIMEOUT_S))
    )


def with_request_text(
    requests: DataFrame, prompt: str = "prompt", template: str = SENTIMENT_TEMPLATE
) -> DataFrame:
    return requests.withColumn("request", sentiment_text(F.col(prompt), template))


def parse_replies(replies: DataFrame, reply: str = "raw_response") -> DataFrame:
    """``replies`` with ``label``, ``confidence`` and ``ok``.

    Gives what ``parse_reply`` gives, in steps: each pattern is searched once, a later pattern
    only if the earlier ones are not found, and nothing again by later filters.
    """
    text, stated, percent, bare = (F.col(c) for c in (reply, "_stated", "_percent", "_bare"))
    found = (
        replies.withColumn("_stated", rp.stated_number(text))
        .withColumn("_percent", F.when(stated.isNull(), rp.percentage(text)))
        .withColumn("_bare", F.when(F.coalesce(stated, percent).isNull(), rp.bare_number(text)))
    )
    parts = {
        "_label": rp.reply_sentiment(text),
        "_confidence": rp.confidence_of(stated, percent, bare),
    }
    once = with_computed_once(found, parts)
    kept = [c for c in replies.columns if c not in ("label", "confidence", "ok")]
    verdict = rp.verdict_of(F.col("_label"), F.col("_confidence"))
    return once.select(*kept, *[c.alias(name) for name, c in verdict.items()])


def _rank(responses: DataFrame) -> list:
    """What makes a response count before others of its prompt and model: success, then being later.

    A hash settles the rest, so that texts need not travel where only the verdict on them is asked for.
    Responses may come without their text.
    """
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(0)
    tie = F.xxhash64(*[c for c in ("raw_response", "error", "latency_ms") if c in responses.columns])
    return [F.col("error").isNull().alias("_good"), attempt.alias("_attempt"), tie.alias("_tie")]


def settle_attempts(responses: DataFrame) -> DataFrame:
    """One response per prompt and model: the latest (by ``attempt``) without an error, else the latest.

    Retries are usual in a log.  Of responses that are alike in this, that with the largest hash counts.  Combined
    before the shuffle, so a prompt tried many times is not hot.
    """
    keys = ("prompt_id", "model")
    rest = [c for c in responses.columns if c not in keys]
    best = F.max(F.struct(*_rank(responses), *rest)).alias("_best")
    settled = responses.groupBy(*keys).agg(best)
    return settled.select(*[c if c in keys else F.col(f"_best.{c}").alias(c) for c in responses.columns])


def normalise_responses(responses: DataFrame, models: DataFrame) -> DataFrame:
    """Logged replies to one uniform row each.

    A reply counts only if the model is registered, the transport gave no error and the reply
    holds both a label and a confidence.  Any other row has label ERROR, no energy and the
    error text.  An ``attempt`` number is passed on.
    """
    info = models.select(F.col("model_id").alias("model"), "name", "size_gb")
    text = strip(F.coalesce(F.col("raw_response"), F.lit("")))
    readable = responses.withColumn("raw_response", F.when(F.col("error").isNull(), text))
    parsed = parse_replies(readable).join(info, "model", "left")
    registered, failure = F.col("name").isNotNull(), F.col("error")
    unknown = F.concat(F.lit("Model "), F.col("model"), F.lit(" not found"))
    error = F.when(~registered, unknown).otherwise(
        F.coalesce(failure, F.when(~F.col("ok"), ERROR_FORMAT))
    )
    served = registered & failure.isNull() & F.col("ok")
    energy = F.when(served, en.energy_kwh(F.col("size_gb"))).otherwise(0.0)
    return parsed.select(
        "prompt_id",
        "model",
        F.when(registered, F.col("name")).otherwise("Unknown").alias("model_name"),
        F.when(served, F.col("label")).otherwise("ERROR").alias("label"),
        F.when(served, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(registered, F.coalesce("latency_ms", F.lit(0.0))).otherwise(0.0).alias("latency_ms"),
        energy.alias("energy_kwh"),
        en.co2_kg(energy).alias("co2_kg"),
        F.when(registered, F.col("raw_response")).alias("raw_response"),
        error.alias("error"),
        *(["attempt"] if "attempt" in responses.columns else []),
    )


def side_by_side(responses: DataFrame, panels: Sequence[str]) -> DataFrame:
    """One row per prompt, with response and latency of each panel's model in columns.

    One shuffle, on the prompt, of the panels' models alone.  Of several attempts that of ``settle_attempts``
    is shown.
    """
    shown = F.struct(
        *_rank(responses),
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        F.coalesce("error", "raw_response").alias("text"),
        "latency_ms",
    )
    wide = (
        responses.filter(F.col("model").isin(*panels))
        .groupBy("prompt_id")
        .agg(
            *[
                F.max(F.when(F.col("model") == model, shown)).alias(f"_{i}")
                for i, model in enumerate(panels, 1)
            ]
        )
    )
    columns = [
        column
        for i, model in enumerate(panels, 1)
        for column in (
            F.lit(model).alias(f"model_{i}"),
            *[F.col(f"_{i}.{c}").alias(f"{c}_{i}") for c in ("status", "text", "latency_ms")],
        )
    ]
    return wide.select("prompt_id", *columns)


def compare_pair(
    responses: DataFrame, small: str, large: str, wanted: DataFrame | None = None, texts: bool = True
) -> DataFrame:
    """A small and a large model on the same prompts, from normalised responses.

    One scan and one shuffle: both models' responses to a prompt are brought together by an
    aggregate, which takes the attempt that ``settle_attempts`` would.  ``wanted`` holds the ``prompt_id`` of the prompts to
    compare, if not all: written, so that others are left out before the shuffle where it is small enough to be
    broadcast, and in the one shuffle that the aggregate needs anyway where it is not.  Without ``texts`` the two
    responses are left out, and do not travel.
    """
    if wanted is not None:
        responses = responses.join(wanted.select("prompt_id"), "prompt_id", "left_semi")
    shown_text = [F.coalesce("raw_response", F.lit("")).alias("response")] if texts else []
    columns = [*(["response"] if texts else []), "error", "latency", "energy", "success"]
    good = F.col("error").isNull() & (
        F.length(F.coalesce("raw_response", F.lit(""))) > MIN_RESPONSE_CHARS
    )
    shown = F.struct(
        *_rank(responses),
        *shown_text,
        "error",
        F.col("latency_ms").alias("latency"),
        F.col("energy_kwh").alias("energy"),
        good.alias("success"),
    )
    sides = {"small": small, "large": large}
    both = (
        responses.filter(F.col("model").isin(small, large))
        .groupBy("prompt_id")
        .agg(*[F.max(F.when(F.col("model") == m, shown)).alias(f"_{s}") for s, m in sides.items()])
        .filter("_small is not null and _large is not null")
    )
    wide = both.select(
        "prompt_id",
        *[
            column
            for side, model in sides.items()
            for column in (
                F.lit(model).alias(f"{side}_model"),
                *[
                    F.col(f"_{side}.{c}").alias(f"{side}_{c}")
                    for c in columns
                ],
            )
        ],
    )
    saved = F.col("large_energy") - F.col("small_energy")
    pct = F.when(
        F.col("large_energy") > 0, saved * 100 / F.nullif(F.col("large_energy"), F.lit(0.0))
    ).otherwise(0.0)
    return wide.select(
        "*",
        (F.col("small_success") & F.col("large_success")).alias("equivalent_quality"),
        F.when(F.col("small_success"), saved).alias("energy_saved_kwh"),
        F.when(F.col("small_success"), pct).alias("energy_saved_pct"),
    )


LEADERBOARD_WEIGHTS = {"confidence": 0.4, "energy_kwh": 0.3, "latency_ms": 0.2, "co2_kg": 0.1}


def leaderboard(responses: DataFrame) -> DataFrame:
    """The best model of each prompt by weighted confidence, energy, speed and carbon.

    Cost figures count by their distance from the worst model of the same prompt.  A window over
    the prompt would put all its rows into one task, however many there are.  So the few columns
    needed are written, the worst figures found by a combined aggregate, and joined back: a join
    of two written tables, in which a hot prompt is split at run time.
    """
    costs = ("energy_kwh", "latency_ms", "co2_kg")
    good = materialise(
        settle_attempts(responses).filter(F.col("error").isNull()).select(
            "prompt_id", "model", "label", "confidence", *costs
        ),
        "good",
    )
    worst = materialise(
        good.groupBy("prompt_id").agg(*[F.max(c).alias(f"_{c}") for c in costs]), "worst"
    )
    score = F.col("confidence") * LEADERBOARD_WEIGHTS["confidence"]
    for cost in costs:
        most = F.col(f"_{cost}")
        share = F.col(cost) / F.nullif(most, F.lit(0.0))
        score = score + F.when(most > 0, 1 - share).otherwise(1.0) * LEADERBOARD_WEIGHTS[cost]
    ranked = F.struct((-F.round(score * 100, 6)).alias("loss"), "model", "label", "confidence")
    best = good.join(worst, "prompt_id").groupBy("prompt_id").agg(F.min(ranked).alias("best"))
    return best.select(
        "prompt_id", "best.model", "best.label", "best.confidence", (-F.col("best.loss")).alias("score")
    )


# The rank of the 95th percentile is off by one ten-thousandth of the requests at most.
P95_ACCURACY = 10_000


def model_summary(responses: DataFrame) -> DataFrame:
    """Success and failure rates, latency and energy per model, over all attempts."""
    unparsed = F.col("error") == ERROR_FORMAT
    return responses.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.avg(F.col("error").isNull().cast("int")).alias("success_rate"),
        F.avg(F.coalesce(unparsed, F.lit(False)).cast("int")).alias("parse_failure_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.percentile_approx("latency_ms", 0.95, P95_ACCURACY).alias("p95_latency_ms"),
        F.sum("energy_kwh").alias("energy_kwh"),
        F.sum("co2_kg").alias("co2_kg"),
    )
