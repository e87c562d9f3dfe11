"""Quality classifier: a ridge fit on random Fourier features, calibrated by isotonic regression.

Every text becomes a short vector of document statistics (``STATISTICS``).  Random Fourier features of the
standardised vector approximate a Gaussian kernel.  Each task sums the normal equations
of its labelled rows, per fold, and the sums are added on the cluster; only the finished
matrices reach the driver.  Scores of every fold under the fit of the others are calibrated by isotonic
regression over score bins, and the final fit uses all folds.

A null text is an empty text, which has all-zero statistics and gets a score as any other.  Labels
other than 0 and 1 and labels of unknown rows are not used; a row labelled twice counts twice.
Without labels of both classes every score is the share of label 1, or 0.5.  Equal texts get equal scores,
other columns are kept, and those named like a result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import arrow_schema, field, free, map_columns, share, texts

STATISTICS = (
    "log_bytes", "log_words", "word_length", "blank_share", "upper_share", "digit_share",
    "period_share", "comma_share", "symbol_share", "bar_share", "exclamation_share", "other_share",
    "wide_share", "distinct_words", "distinct_pairs", "same_neighbour", "same_line", "line_words",
    "packed_size",
)
#: Random features, their bandwidth, the ridge and the seed of the fit.
FEATURES, BANDWIDTH, RIDGE, SEED = 256, 2.5, 1e-3, 20240501
#: Folds for the calibration, and the bins of scores it works on.
FOLDS, BINS = 4, 512
#: Bytes of a text that are packed at a time.
CHUNK = 1 << 16

_SYMBOLS = b"#*$%&<>{}[]\\^_~=+@/"
_UPPER = bytes(range(0x41, 0x5B))
_KINDS = (_UPPER, b"0123456789", b".", b",", _SYMBOLS, b"|", b"!")


def statistics(text: str) -> list[float]:
    """``STATISTICS`` of a whole text; words are split at white space."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n_words = max(1, len(words))
    shares = [counts[list(kind)].sum() / n for kind in _KINDS]
    blanks = counts[[9, 10, 11, 12, 13, 32]].sum() / n
    known = sum(shares) + blanks + counts[0x61:0x7B].sum() / n
    pairs = list(zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), sum(map(len, words)) / n_words, blanks,
        *shares[:6], shares[6], max(0.0, 1 - known - counts[128:].sum() / n), counts[128:].sum() / n,
        len(set(words)) / n_words, len(set(pairs)) / max(1, len(pairs)),
        sum(a == b for a, b in pairs) / max(1, len(pairs)),
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n_words / max(1, len(lines)))),
        packed_bytes(raw) / n,
    ]


def packed_bytes(raw: bytes) -> int:
    """Bytes that all of ``raw`` packs to; what is packed is counted and not held."""
    packer = zlib.compressobj(1)
    parts = memoryview(raw)
    packed = sum(len(packer.compress(parts[i : i + CHUNK])) for i in range(0, len(raw), CHUNK))
    return packed + len(packer.flush())


def with_statistics(df: DataFrame, text: str = "text", to: str = "statistics") -> DataFrame:
    def make():
        return lambda batch: [[statistics(x) for x in texts(batch, text)]]

    return map_columns(df, [field(to, "array<double>")], make)


@dataclass(frozen=True)
class Projection:
    """Standardisation and random directions: statistics to features."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z / 8, np.ones((len(z), 1))])


@dataclass(frozen=True)
class Classifier:
    projection: Projection | None
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return np.full(len(x), self.levels[0])
        return np.interp(self.projection(x) @ self.weights, self.knots, self.levels)


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(labelled: DataFrame, label: str = "label", statistics: str = "statistics") -> Classifier:
    """A classifier of ``label`` (0 or 1) from every row of ``labelled``, given its statistics."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        F.col(statistics).alias("x"),
        F.col(label).cast("double").alias("y"),
        F.pmod(F.xxhash64(statistics), F.lit(FOLDS)).cast("int").alias("fold"),
    )
    size = len(STATISTICS)
    first = rows.select(
        F.count("*").alias("n"),
        F.sum("y").alias("ones"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size)],
    ).first()
    n, ones = first["n"], first["ones"] or 0.0
    if not 0 < ones < n:
        return Classifier(None, np.zeros(0), np.zeros(1), np.array([ones / n if n else 0.5]))
    rng = np.random.default_rng(SEED)
    spread = np.array([first[f"s{i}"] for i in range(size)])
    projection = Projection(
        np.array([first[f"m{i}"] for i in range(size)]),
        np.where(spread > 1e-9, spread, 1.0),
        rng.standard_normal((size, FEATURES)) / BANDWIDTH,
        rng.uniform(0, 2 * np.pi, FEATURES),
    )
    gram, moment = _normal_equations(rows, projection)
    whole, target = gram.sum(axis=0), moment.sum(axis=0)
    penalty = RIDGE * n * np.eye(len(target)) / FEATURES
    weights = np.linalg.solve(whole + penalty, target)
    others = [np.linalg.solve(whole - gram[k] + penalty, target - moment[k]) for k in range(FOLDS)]
    knots, levels = _calibrate(rows, projection, others)
    return Classifier(projection, weights, knots, levels)


def _normal_equations(rows: DataFrame, projection: Projection) -> tuple[np.ndarray, np.ndarray]:
    """Per fold, the sums of products of features and of features with labels.

    A task sums its rows; the sums, row by row of the matrix, are added by the row's number.
    """
    width = FEATURES + len(STATISTICS) + 1
    schema = "fold int, row int, sums array<double>"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, width, width + 1))
        for batch in batches:
            x, y = _rows(batch, "x"), batch.column("y").to_numpy(zero_copy_only=False)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for low in range(0, len(y), 4096):
                part = slice(low, low + 4096)
                features = projection(x[part])
                both = np.hstack([features, y[part, None]])
                for k in range(FOLDS):
                    own = folds[part] == k
                    sums[k] += features[own].T @ both[own]
        for k in range(FOLDS):
            if sums[k].any():
                columns = [[k] * width, list(range(width)), sums[k].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)

    def add(group: pa.Table) -> pa.Table:
        values = _rows(group.combine_chunks().to_batches()[0], "sums").sum(axis=0)
        keys = [group.column("fold")[0].as_py()], [group.column("row")[0].as_py()]
        return pa.table([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array([values.tolist()], kinds.field("sums").type)], schema=kinds)

    gram, moment = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
    summed = rows.mapInArrow(run, schema).groupBy("fold", "row").applyInArrow(add, schema)
    for row in summed.toLocalIterator():
        gram[row["fold"], row["row"]] = row["sums"][:-1]
        moment[row["fold"], row["row"]] = row["sums"][-1]
    return gram, moment


def _calibrate(rows: DataFrame, projection: Projection, weights: list[np.ndarray]):
    """Knots and levels of the isotonic fit of labels on the scores of fits without the own fold."""

    def make():
        table = np.array(weights)

        def score(batch):
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.einsum("ij,ij->i", projection(_rows(batch, "x")), table[folds])
            return [pa.array(np.clip(((raw + 0.5) * BINS / 2), 0, BINS - 1).astype(np.int32))]

        return score

    bins = map_columns(rows, [field("bin", "int")], make)
    counted = bins.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
    counted = sorted(counted, key=lambda r: r["bin"])
    centres = (np.array([r["bin"] for r in counted]) + 0.5) * 2 / BINS - 0.5
    return isotonic(centres, np.array([r["n"] for r in counted], float), np.array([r["ones"] for r in counted]))


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression of ``ones / n`` on ascending ``x`` by pooling adjacent violators.

    A knot stands at each pool's mean ``x``; between knots the level rises, so scores keep their order.  One row of
    either label is spread over every pool, which keeps the levels within 0 and 1.
    """
    pools: list[list[float]] = []  # x times weight, weight, ones
    for at, weight, hits in zip(x, n, ones):
        pools.append([at * weight, weight, hits])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    knots = np.array([p[0] / p[1] for p in pools])
    levels = np.array([(p[2] + 0.5) / (p[1] + 1) for p in pools])
    levels = np.maximum.accumulate(levels)
    ends = np.array([knots[0] - 1, *knots, knots[-1] + 1])
    return ends, np.array([levels[0] * 0.5, *levels, (1 + levels[-1]) / 2])


def score(
    df: DataFrame, classifier: Classifier, statistics: str = "statistics", prefix: str = ""
) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on), named after ``prefix``."""
    shared = share(df.sparkSession, classifier)

    def make():
        model = shared()
        return lambda batch: [pa.array(model(_rows(batch, statistics)))]

    scored = map_columns(df, [field(prefix + "score", "double")], make)
    return scored.withColumn(prefix + "predicted", (F.col(prefix + "score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, as they are."""
    (statistics,) = free(docs, "_statistics")
    prefix = "_"
    while free(docs, prefix + "score", prefix + "predicted") != [prefix + "score", prefix + "predicted"]:
        prefix += "_"
    described = with_statistics(docs, text, statistics)
    return score(described, classifier, statistics, prefix).where(F.col(prefix + "predicted") == 1).select(*docs.columns)


def labelled_statistics(described: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Statistics and label of the rows of ``described`` that ``labels`` has."""
    rows = described.select(F.col(key).alias("key"), "statistics")
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label"))
    return rows.join(known, "key").select("statistics", "label")
