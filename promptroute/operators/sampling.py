"""Deterministic sampling, balancing and splitting.

"Random" means the order of ``md5(seed | key)``: the same rows are picked on any cluster,
in any partitioning and after any retry.

The scale problem: there are three classes, so ranking the rows of a class would put a third
of the table into one task.  ``cutoffs`` avoids it.  It counts rows per stratum and hash
prefix (combined before the shuffle), finds the prefix the quota falls into, and ranks only
the rows with that prefix, one of 4096.  The rows to keep are then those up to the cut, a
plain filter against a table with one row per stratum.  Quotas are met exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptroute.functions.labels import stratum
from promptroute.functions.text import present
from promptroute.session import materialise
from promptroute.settings import (
    BALANCE_FACTOR,
    IMBALANCE_RATIO,
    JUDGE_SAMPLE_SIZE,
    LABELS,
    SEED,
    VALIDATION_FRACTION,
)

PREFIX_DIGITS = 3  # hexadecimal: 16 ** 3 = 4096 prefixes
# Rows of a stratum up to which a rank is cheaper than a cut: the planner lets every task pass on so many at most.
FEW = 1000
LABEL, SOURCE = "complexity_label", "source_dataset"

Quotas = Callable[[DataFrame], DataFrame]


def hash_order(key: Column, seed: int = SEED) -> Column:
    """Position of a row in the fixed random order, as 32 hexadecimal digits (never NULL)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), present(key.cast("string"))))


def cutoffs(
    df: DataFrame, key: str, strata: Sequence[str], quotas: Quotas, seed: int = SEED
) -> DataFrame:
    """Per stratum: ``total``, ``quota`` and the last row within the quota.

    ``quotas`` maps ``(strata..., total)`` to ``(strata..., total, quota)``.  ``cut_hash`` and
    ``cut_key`` are NULL where the quota takes all rows or none.  The table is written: the planner
    then knows that it is small and sends it to the rows, which would otherwise be dealt out by
    stratum, all rows of one to one task.
    """
    narrow = df.select(
        *strata, F.col(key).alias("_key"), hash_order(F.col(key), seed).alias("_hash")
    ).withColumn("_prefix", F.substring("_hash", 1, PREFIX_DIGITS))
    # Written: at most 4096 rows per stratum, read three times below.
    histogram = materialise(
        narrow.groupBy(*strata, "_prefix").agg(F.count("*").alias("_n")), "histogram"
    )
    bounds = quota_bounds(histogram, strata, quotas)
    within = Window.partitionBy(*strata).orderBy("_hash", "_key")
    last = (
        narrow.join(bounds.filter("quota < total").select(*strata, "_prefix", "_rest"), [*strata, "_prefix"])
        .withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") == F.col("_rest"))
        .select(*strata, F.col("_hash").alias("cut_hash"), F.col("_key").alias("cut_key"))
    )
    return materialise(bounds.select(*strata, "total", "quota").join(last, list(strata), "left"), "cuts")


def quota_bounds(histogram: DataFrame, strata: Sequence[str], quotas: Quotas) -> DataFrame:
    """Per stratum: ``total``, ``quota``, the prefix the quota falls into and how many rows of it count."""
    totals = quotas(histogram.groupBy(*strata).agg(F.sum("_n").alias("total")))
    running = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_prefix"))
    hit = (
        histogram.withColumn("_upto", running)
        .join(totals.select(*strata, "quota"), list(strata))
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*strata, "_prefix", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rest"))
    )
    return totals.join(hit, list(strata), "left")


def mark_within(
    df: DataFrame, key: str, strata: Sequence[str], cuts: DataFrame, seed: int = SEED
) -> DataFrame:
    """``df`` with a boolean ``within``: is the row inside its stratum's quota?

    Rows whose stratum is NULL are a stratum as well; they are within a quota that takes all of them.
    """
    position = F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    cut = F.struct(F.col("cut_hash").alias("h"), F.col("cut_key").alias("k"))
    inside = (F.col("quota") >= F.col("total")) | (
        F.col("cut_hash").isNotNull() & (position <= cut)
    )
    own = cuts.select(*[F.col(c).alias(f"_{c}_of_cut") for c in strata], "total", "quota", "cut_hash", "cut_key")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}_of_cut")) for c in strata])
    return (
        df.join(own, same, "left")
        .withColumn("within", F.coalesce(inside, F.lit(False)))
        .drop("total", "quota", "cut_hash", "cut_key", *[f"_{c}_of_cut" for c in strata])
    )


def keep_within(
    df: DataFrame, key: str, strata: Sequence[str], quotas: Quotas, seed: int = SEED
) -> DataFrame:
    """The rows of each stratum that fall within its quota."""
    cuts = cutoffs(df, key, strata, quotas, seed)
    return mark_within(df, key, strata, cuts, seed).filter("within").drop("within")


def first_by_hash(df: DataFrame, key: str, limit: int, seed: int = SEED) -> DataFrame:
    """Exactly ``limit`` rows (or all, if fewer) without passing them through one task."""
    # One stratum for all rows: an empty string, but not a literal, which the optimizer would
    # fold out of the join keys.
    whole = df.withColumn("_whole", F.substring(F.col(key).cast("string"), 1, 0))
    return keep_within(
        whole, key, ["_whole"], lambda t: t.withColumn("quota", F.lit(limit).cast("long")), seed
    ).select(*df.columns)


def first_of_each(df: DataFrame, key: str, strata: Sequence[str], most: int, seed: int = SEED) -> DataFrame:
    """``(strata..., _key, _hash, _rank)`` of the first ``most`` rows of each stratum, for few of them.

    One scan of keys: every task ranks its own rows and passes on no more than ``most`` of a stratum.
    """
    narrow = df.select(*strata, F.col(key).alias("_key"), hash_order(F.col(key), seed).alias("_hash"))
    order = Window.partitionBy(*strata).orderBy("_hash", "_key")
    return narrow.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)


def rows_of(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``df`` with the keys ``_key`` of the few rows of ``chosen``, which are written, so their size is known."""
    keys = materialise(chosen.select("_key"), "chosen")
    return df.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def balance(
    df: DataFrame,
    key: str,
    seed: int = SEED,
    ratio: float = IMBALANCE_RATIO,
    factor: float = BALANCE_FACTOR,
    method: str = "undersample",
) -> DataFrame:
    """Cut large classes to ``factor`` times the smallest, if the classes are far apart.

    Left as it is if the largest class is less than ``ratio`` times the smallest.  Rows without a
    label are no class: they count for nothing, and stay only where nothing is cut.
    """
    if method != "undersample":
        return df
    everything = Window.partitionBy()

    def quotas(totals: DataFrame) -> DataFrame:
        size = F.when(F.col(LABEL).isNotNull(), F.col("total"))
        most, least = F.max(size).over(everything), F.min(size).over(everything)
        target = F.least(F.floor(least * F.lit(factor)), most)
        even = F.coalesce(most / least < F.lit(ratio), F.lit(True))
        cut = F.when(F.col(LABEL).isNull(), 0).otherwise(F.least(F.col("total"), target))
        return totals.withColumn("quota", F.when(even, F.col("total")).otherwise(cut))

    return keep_within(df, key, [LABEL], quotas, seed).select(*df.columns)


def judge_sample(
    df: DataFrame, key: str, size: int = JUDGE_SAMPLE_SIZE, seed: int = SEED
) -> DataFrame:
    """About ``size`` rows for a judge, spread over sources and classes.

    Each source gives ``size`` rows, divided among its classes by their share (at least one
    row each); ``size`` rows of all those are kept.
    """
    by_source = Window.partitionBy(SOURCE)

    def quotas(totals: DataFrame) -> DataFrame:
        share = F.floor(F.lit(size) * F.col("total") / F.sum("total").over(by_source))
        return totals.withColumn(
            "quota", F.least(F.col("total"), F.greatest(F.lit(1).cast("long"), share))
        )

    known = df.filter(F.col(LABEL).isin(*LABELS) & F.col(SOURCE).isNotNull())
    if size > FEW:
        picked = keep_within(known, key, [SOURCE, LABEL], quotas, seed)
        return first_by_hash(picked, key, size, seed).select(*df.columns)
    totals = quotas(known.groupBy(SOURCE, LABEL).agg(F.count("*").alias("total")))
    ranked = first_of_each(known, key, [SOURCE, LABEL], size, seed).join(totals, [SOURCE, LABEL])
    chosen = ranked.filter(F.col("_rank") <= F.col("quota")).orderBy("_hash", "_key").limit(size)
    return rows_of(known, key, chosen).select(*df.columns)


def stratified_split(
    df: DataFrame,
    key: str,
    frac: float = VALIDATION_FRACTION,
    seed: int = SEED,
    exact: bool = True,
) -> DataFrame:
    """``df`` with ``split`` = train or val, stratified by class and source.

    ``exact``: the validation set holds ``ceil(frac * n)`` rows; each stratum gives its share
    rounded down, and the strata that lost most by rounding give one more.
    Otherwise a row is in the validation set if its hash is below ``frac`` of the range: no
    shuffle and no extra pass, with shares that are right on average.
    """
    if not exact:
        bound = f"{min(int(frac * 2**32), 2**32 - 1):08x}"
        low = F.substring(hash_order(F.col(key), seed), 1, 8) < bound
        return df.withColumn("split", F.when(low, "val").otherwise("train"))

    everything = Window.partitionBy()
    rounding = Window.orderBy(F.col("_lost").desc(), "_stratum")

    def quotas(totals: DataFrame) -> DataFrame:
        # Integer arithmetic: shares are compared exactly.
        n = F.sum("total").over(everything)
        wanted = F.ceil(n * F.lit(frac))
        product = F.col("total").cast("decimal(19,0)") * wanted.cast("decimal(18,0)")
        return (
            totals.withColumn("_all", n)
            .withColumn("_wanted", wanted)
            .withColumn("_lost", product % F.col("_all").cast("decimal(19,0)"))
            .withColumn(
                "_floor",
                ((product - F.col("_lost")) / F.col("_all").cast("decimal(19,0)")).cast("long"),
            )
            .withColumn("_more", F.col("_wanted") - F.sum("_floor").over(everything))
            .withColumn(
                "quota",
                F.col("_floor") + (F.row_number().over(rounding) <= F.col("_more")).cast("long"),
            )
            .select("_stratum", "total", "quota")
        )

    keyed = df.withColumn("_stratum", stratum(F.col(LABEL), F.col(SOURCE)))
    # Rows without a label or source belong to no stratum: they are training rows, and no share is taken of them.
    cuts = cutoffs(keyed.where(F.col("_stratum").isNotNull()), key, ["_stratum"], quotas, seed)
    return (
        mark_within(keyed, key, ["_stratum"], cuts, seed)
        .withColumn("split", F.when(F.col("within"), "val").otherwise("train"))
        .drop("_stratum", "within")
    )


def sample_per_class(df: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """``k`` rows of each class, or all rows of a smaller class."""
    known = df.filter(F.col(LABEL).isin(*LABELS))
    if k <= FEW:
        return rows_of(known, key, first_of_each(known, key, [LABEL], k, seed)).select(*df.columns)
    return keep_within(
        known,
        key,
        [LABEL],
        lambda t: t.withColumn("quota", F.least(F.col("total"), F.lit(k).cast("long"))),
        seed,
    ).select(*df.columns)
