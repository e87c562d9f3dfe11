"""Requests to a judge model, its verdicts, and how far they agree with the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.functions.replies import parse_verdict
from promptroute.functions.wording import JUDGE_TEMPLATE, judge_text
from promptroute.operators.sampling import LABEL

VERDICT = "llm_judge_label"


def judge_requests(df: DataFrame, key: str, template: str = JUDGE_TEMPLATE) -> DataFrame:
    """Request table ``(key, request)``; a judge reads at most 1000 characters of a prompt."""
    return df.select(key, judge_text(F.col("prompt"), template).alias("request"))


def parse_verdicts(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    return replies.select(key, parse_verdict(F.col(reply)).alias(VERDICT))


def attach_verdicts(sample: DataFrame, key: str, verdicts: DataFrame | None = None) -> DataFrame:
    """The sample with the judge's label, NULL where no judge ran or it said nothing usable."""
    if verdicts is None:
        return sample.withColumn(VERDICT, F.lit(None).cast("string"))
    return sample.join(verdicts.select(key, VERDICT), key, "left")


def agreement(df: DataFrame) -> DataFrame:
    """Share of judged rows whose label the judge shares: per class, and in all (NULL class)."""
    judged = df.filter(F.col(VERDICT).isNotNull())
    agrees = (F.col(LABEL) == F.col(VERDICT)).cast("int")
    by_class = judged.groupBy(LABEL).agg(F.count("*").alias("_n"), F.sum(agrees).alias("_agreed"))
    return by_class.rollup(LABEL).agg(
        F.sum("_n").alias("judged"), (F.sum("_agreed") / F.sum("_n")).alias("agreement")
    )
