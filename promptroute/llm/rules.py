"""Quality rules in built-in expressions alone: countable faults and an n-gram likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: of trusted documents and of
the whole corpus.  A document's mean log ratio per n-gram is held against a fixed threshold, so
equal texts always get the same verdict.

Words are runs of characters other than ASCII white space.  A null text has no words and counts as
empty; empty texts fail the base rules; a document whose words have no n-gram has the ratio 0.
Repeated rows are judged alike, other columns are kept, and those named like a result are replaced.
An empty corpus gives the ratio 0 for every n-gram.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import free
from promptroute.operators.once import with_computed_once

#: Buckets of hashed n-grams.
BUCKETS = 8192
#: Trusted documents, the first in hash order, from which the target multinomial is counted.
TRUSTED_ROWS = 10_000
#: Least mean log ratio of a document that is kept.
THRESHOLD = -0.02
#: N-grams spread as in the corpus that are added to the target's, as a share of these: a bucket without any says little.
PRIOR = 2.0
#: Consecutive words of a repeat, and the base rules' limits.
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

_BLANKS = r"[ \x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANKS), "")


def buckets(words: Column) -> Column:
    """Buckets of the words and of the pairs of adjacent words."""
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    pairs = F.transform(
        words,
        lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(single, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def with_counts(df: DataFrame, text: str = "text", split: str = "_words") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    The words are in the column ``split``, for ``with_verdict``.
    """
    hashed, windowed, ranked, placed, lined = free(df, "_hashes", "_windows", "_sorted", "_places", "_lines")
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    words, hashes, windows = F.col(split), F.col(hashed), F.col(windowed)

    def window_hash(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(REPEAT_WORDS)])

    starts = F.sequence(F.lit(0), F.size(words) - REPEAT_WORDS)
    long_enough = F.size(words) >= REPEAT_WORDS
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    sorted_windows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = F.col(ranked)

    def has_twin(x: Column, i: Column) -> Column:
        before, after = F.get(pairs, i - 1)["h"], F.get(pairs, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    places = F.array_sort(F.transform(F.filter(pairs, has_twin), lambda x: x["i"]))
    starts_of = F.col(placed)
    covered = F.aggregate(
        F.transform(
            starts_of,
            lambda at, i: F.least(F.coalesce(F.get(starts_of, i + 1) - at, F.lit(REPEAT_WORDS)), F.lit(REPEAT_WORDS)),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    made = (
        df.withColumn(split, split_words(F.col(text)))
        .withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn(windowed, F.when(long_enough, F.transform(starts, window_hash)))
        .withColumn(ranked, F.when(repeated, sorted_windows))
        .withColumn(placed, F.when(pairs.isNotNull(), places))
        .withColumn(lined, lines)
    )
    none = F.lit(0).cast("long")
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, none, lambda n, w: n + F.length(w)),
        "n_symbols": F.regexp_count(value, F.lit(_SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lined) - F.size(F.array_distinct(lined))).cast("long"),
        "n_repeat_words": F.when(starts_of.isNotNull(), covered).otherwise(none),
    }
    # A later filter on a count is not to spell the whole derivation out again.
    counted = with_computed_once(made, counts)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed).drop(hashed, windowed, ranked, placed, lined)


def fit_ratio(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> list[float]:
    """Log ratio of trusted to corpus probability per bucket.

    Corpus counts are raised by one; n-grams of the corpus' distribution are added to the target's, ``PRIOR`` times
    as many as these are.  Without any the ratio is 0.  ``trusted`` holds ``key`` of the trusted rows; the first ``TRUSTED_ROWS`` in hash order are used, and
    sent to all tasks.  The corpus counts cover every row.  ``BUCKETS`` rows reach the driver.
    """
    chosen = (
        trusted.select(F.col(key).alias("_trusted"))
        .where(F.col("_trusted").isNotNull())
        .distinct()
        .orderBy(F.xxhash64("_trusted"), "_trusted")
        .limit(TRUSTED_ROWS)
    )
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), F.col("_key") == F.col("_trusted"), "left"
    )
    grams = marked.select(
        F.col("_trusted").isNotNull().cast("long").alias("trusted"),
        split_words(F.col("_text")).alias("words"),
    ).select("trusted", F.explode(buckets(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t"))
    target, corpus = np.zeros(BUCKETS), np.ones(BUCKETS)
    for row in counts.collect():
        target[row["bucket"]] += row["t"]
        corpus[row["bucket"]] += row["n"]
    corpus /= corpus.sum()
    prior = PRIOR * target.sum() or 1.0
    target = (target + prior * corpus) / (target.sum() + prior)
    return np.log(target / corpus).tolist()


def with_verdict(counted: DataFrame, ratio: list[float], split: str = "_words") -> DataFrame:
    """``counted`` (of ``with_counts``) with ``log_ratio`` and ``kept``, without the words."""
    table = F.lit(np.array(ratio))
    (hashed,) = free(counted, "_buckets")
    grams = F.col(hashed)
    total = F.aggregate(grams, F.lit(0.0), lambda s, b: s + F.get(table, b))
    bucketed = counted.withColumn(hashed, buckets(F.col(split)))
    judged = with_computed_once(bucketed, {"log_ratio": total / F.greatest(F.size(grams), F.lit(1))})
    kept = ~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD)
    return judged.withColumn("kept", kept).drop(hashed, split)
