"""Distributions, length statistics and previews of a corpus.

Every aggregate is combined before its shuffle, and totals are taken over the already
grouped counts, never over the rows a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptroute.functions.text import truncated
from promptroute.operators.sampling import LABEL, SOURCE, first_of_each, hash_order, rows_of
from promptroute.settings import SEED

QUARTILES = (0.25, 0.5, 0.75)
VALUE_RANGES = 256


def distribution(df: DataFrame, col: str) -> DataFrame:
    """``(value, n, pct)``, most frequent first; missing values are not counted."""
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("value"))
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "value")


def describe_numeric(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles (interpolated) and maximum.

    Exact at any size in one pass over ``df``.  Rows are first reduced to counted distinct
    values, so a value held by a third of all rows is one row per task.  The distinct values
    are then cut into 256 ranges by approximate quantiles and ranked range by range.
    """
    by = list(by)
    counted = (
        df.select(*by, value.cast("double").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy(*by, "v")
        .agg(F.count("*").alias("n"))
    )
    edges = [i / VALUE_RANGES for i in range(1, VALUE_RANGES)]
    # Per group: the range edges and the totals all later steps need.
    frame = F.struct(
        F.percentile_approx("v", edges).alias("edges"),
        F.sum("n").alias("count"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
    ).alias("_frame")
    if by:
        placed = counted.join(counted.groupBy(*by).agg(frame), by)
    else:
        placed = counted.withColumn("_frame", counted.agg(frame).scalar())
    # Never NULL, or the join on it below would put a NULL test on every row of ``df``.
    below = F.coalesce(F.size(F.filter("_frame.edges", lambda edge: edge < F.col("v"))), F.lit(0))
    placed = placed.select(
        *by,
        "v",
        "n",
        below.alias("_range"),
        F.col("_frame.count").alias("_count"),
        F.col("_frame.mean").alias("_mean"),
    )
    sums = placed.groupBy(*by, "_range").agg(F.sum("n").alias("_in_range"))
    earlier = Window.partitionBy(*by).orderBy("_range")
    offsets = sums.select(
        *by, "_range", (F.sum("_in_range").over(earlier) - F.col("_in_range")).alias("_before")
    )
    inside = Window.partitionBy(*by, "_range").orderBy("v")
    ranked = (
        placed.join(offsets, [*by, "_range"])
        .withColumn("_last", F.col("_before") + F.sum("n").over(inside) - 1)
        .withColumn("_first", F.col("_last") - F.col("n") + 1)
    )

    def value_at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("_first"), F.col("_last")), F.col("v")))

    quartiles, named = [], []
    for q in QUARTILES:
        at = F.lit(q) * (F.col("_count") - 1)
        name = f"p{int(q * 100)}"
        low, high, part = f"_low_{name}", f"_high_{name}", f"_part_{name}"
        quartiles += [
            value_at(F.floor(at)).alias(low),
            value_at(F.ceil(at)).alias(high),
            F.max(at - F.floor(at)).alias(part),
        ]
        named.append((F.col(low) + (F.col(high) - F.col(low)) * F.col(part)).alias(name))
    spread = F.sum(F.col("n") * (F.col("v") - F.col("_mean")) * (F.col("v") - F.col("_mean")))
    return (
        ranked.groupBy(*by)
        .agg(
            F.max("_count").alias("count"),
            F.max("_mean").alias("mean"),
            spread.alias("_spread"),
            F.min("v").alias("min"),
            *quartiles,
            F.max("v").alias("max"),
        )
        .select(
            *by,
            "count",
            "mean",
            F.when(F.col("count") > 1, F.sqrt(F.col("_spread") / (F.col("count") - 1))).alias("std"),
            "min",
            *named,
            "max",
        )
    )


def length_profile(df: DataFrame, by: Sequence[str] = (), prompt: str = "prompt") -> DataFrame:
    return describe_numeric(df, F.length(prompt), by)


def token_profile(df: DataFrame, by: Sequence[str] = (), prompt: str = "prompt") -> DataFrame:
    """Statistics of characters / 4, here not rounded down."""
    return describe_numeric(df, F.length(prompt) / 4, by)


def crosstab(df: DataFrame, a: str = SOURCE, b: str = LABEL) -> DataFrame:
    """Counts of every pair with row, column and grand totals, one row per cell.

    ``level`` tells cells (0) from totals: 1 over ``b``, 2 over ``a``, 3 over both.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count("*").alias("_n")
    )
    return cells.cube(a, b).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("_n").alias("n")
    )


def crosstab_wide(
    df: DataFrame, values: Sequence[str], a: str = SOURCE, b: str = LABEL
) -> DataFrame:
    """The cross table with a column per value of ``b`` and an ``all`` row and column."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count("*").alias("_n")
    )
    columns = [
        F.coalesce(F.sum(F.when(F.col(b) == v, F.col("_n"))), F.lit(0)).alias(v) for v in values
    ]
    return (
        cells.rollup(a)
        .agg(*columns, F.sum("_n").alias("all"), F.grouping(a).alias("_total"))
        .withColumn(a, F.when(F.col("_total") == 1, "all").otherwise(F.col(a)))
        .drop("_total")
    )


def source_totals(df: DataFrame, source: str = SOURCE) -> DataFrame:
    """Rows per source, and in the row with a NULL source the grand total."""
    counts = df.groupBy(source).agg(F.count("*").alias("_n")).filter(F.col(source).isNotNull())
    return counts.rollup(source).agg(F.sum("_n").alias("n"))


def imbalance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: largest and smallest class and their ratio."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(
        F.max("n").alias("max_count"),
        F.min("n").alias("min_count"),
        (F.max("n") / F.min("n")).alias("ratio"),
    )


def preview(
    df: DataFrame,
    key: str,
    by: str | None = None,
    k: int = 3,
    width: int = 150,
    prompt: str = "prompt",
    seed: int = SEED,
    keys: DataFrame | None = None,
) -> DataFrame:
    """``k`` rows, or ``k`` of each value of ``by``, with the prompt cut to ``width``.

    ``keys`` may hold ``key`` and ``by`` of the rows in a table of its own: the choice is then made there, and
    only the chosen rows are looked up in ``df``.
    """
    shown = truncated(F.col(prompt), width)
    if by is None:
        # Cut first: the rows that travel to the final sort are short.
        return df.withColumn(prompt, shown).orderBy(key).limit(k)
    picks = rows_of(df, key, first_of_each(df if keys is None else keys, key, [by], k, seed))
    order = Window.partitionBy(by).orderBy(hash_order(F.col(key), seed), key)
    return picks.select(
        F.row_number().over(order).alias("position"),
        *[c for c in df.columns if c != prompt],
        shown.alias(prompt),
    )
