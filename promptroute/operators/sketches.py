"""Latency quantiles that can be put together: a small sketch for each day and model, merged for any choice of them.

A sketch keeps some hundred to thousand values, however many there were; the rank of a quantile read from it is off by
about 2.3 / ``K`` of the rows at most (99 times in 100), and a merged sketch is no worse than one of all rows.  Up to ``K``
values it is exact.  Stored sketches are read instead of the log when a day is added or another span is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch.
K = 2048


def latency_sketches(responses: DataFrame, by: Sequence[str], latency: str = "latency_ms") -> DataFrame:
    """Per group: ``n``, the largest latency, and a ``sketch`` of it.  Combined before the shuffle."""
    return responses.where(F.col(latency).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.max(latency).alias("most"), F.kll_sketch_agg_double(F.col(latency).cast("double"), K).alias("sketch")
    )


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sketches of finer groups as those of coarser ones."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", K).alias("sketch")
    )


def quantile(share: float, sketch: str = "sketch") -> Column:
    """The smallest kept value up to which ``share`` of the rows lie."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
