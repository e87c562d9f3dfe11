"""The three-class classifier trained in passes: gradients that tasks sum, a score after every pass, the best kept.

A prompt is a sparse row of numbers: its first ``MAX_TOKENS`` words, or sub-words if a vocabulary is given, hashed into
``BUCKETS`` columns and weighted by one over the root of their number; a constant; its length band; its yes/no features; and each of these within its band.  The rows
are written once.  In a pass every task goes over its rows in Arrow batches, adds up the gradient of the training rows and counts
the validation rows by true and predicted class; the sums, cut into blocks of columns, meet by block.  Three weights a
column go to the tasks and back to the driver, however many rows there are.  The driver then steps the weights (Adam
with decoupled decay, a rate that falls to zero).

The weights after every pass can be written to a folder; training goes on from the last pass found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptroute.functions.labels import id_label
from promptroute.functions.text import present
from promptroute.operators.corpus import encode_labels, heuristic_features
from promptroute.operators.once import with_computed_once
from promptroute.operators.sampling import stratified_split
from promptroute.operators.subwords import with_pieces
from promptroute.session import delete, folders, materialise
from promptroute.settings import LABELS

MAX_TOKENS = 256
BUCKETS = 1 << 14
#: Edges of the length bands, in estimated tokens: a linear model cannot bend at a length otherwise.
BANDS = (5, 10, 20, 30, 40, 50, 75, 100, 150, 200, 300, 500, 1000)
FLAGS = ("has_code_blocks", "has_multi_step", "has_math", "has_code", "is_simple", "asks_often")
#: What stands behind the buckets: the constant, the bands, the flags, and the flags of each band.
CONSTANT = BUCKETS
FIRST_BAND = CONSTANT + 1
FIRST_FLAG = FIRST_BAND + len(BANDS) + 1
FIRST_BANDED = FIRST_FLAG + len(FLAGS)
COLUMNS = FIRST_BANDED + (len(BANDS) + 1) * len(FLAGS)
#: Passes, the first step's rate, decay of the weights, and the constants of Adam.
PASSES, RATE, DECAY = 24, 0.15, 0.01
#: What the mean gradient must exceed before a bucket has a weight: most words say nothing about the class.
LEAST = 0.0005
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-8
#: Columns of a block of sums.
BLOCK = 1024
CLASSES = len(LABELS)
#: Rows a task works on at a time: their numbers fit into a core's cache.
SLICE = 1024
#: Words are runs of letters and digits.
GAPS = r"[^\p{L}\p{N}]+"


def words(prompt: Column, most: int = MAX_TOKENS) -> Column:
    """The first words of a prompt in lower case; what follows them is left in one piece and not looked at."""
    parts = F.slice(F.split(F.lower(present(prompt)), GAPS, most + 2), 1, most + 1)
    return F.slice(F.filter(parts, lambda w: w != ""), 1, most)


def bucket(word: Column) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def with_columns(df: DataFrame, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` and ``columns``: the buckets of so many tokens, then the columns that count one.

    Tokens are words, or pieces of the ``vocabulary``.
    Columns of ``df`` with these names, or with that of a feature, are left out.
    """
    df = df.drop("n_tokens", "columns")
    named = [f for f in FLAGS if f != "asks_often"]
    df = df.drop("token_count", "char_count", "question_count", *named)
    made = heuristic_features(df)
    flags = [F.col("question_count") >= 3 if f == "asks_often" else F.col(f) for f in FLAGS]
    band = reduce(add, [(F.col("token_count") >= edge).cast("int") for edge in BANDS])
    held = [F.when(flag, F.lit(FIRST_FLAG + i)) for i, flag in enumerate(flags)]
    banded = [F.when(flag, FIRST_BANDED + F.col("_band") * len(FLAGS) + i) for i, flag in enumerate(flags)]
    tokens = words(F.col("prompt"))
    if vocabulary is not None:
        made, tokens = with_pieces(made, vocabulary, MAX_TOKENS, to="_pieces"), F.col("_pieces")
    made = with_computed_once(made, {"_tokens": F.transform(tokens, bucket), "_band": band})
    ones = F.array(F.lit(CONSTANT), FIRST_BAND + F.col("_band"), *held, *banded)
    return made.select(
        *df.columns, F.size("_tokens").alias("n_tokens"),
        F.concat("_tokens", F.array_compact(ones).cast("array<int>")).alias("columns"),
    )


@dataclass
class LinearModel:
    """Weights by column and class, figures of the passes that led to them, and the vocabulary of sub-words, if any."""

    weights: np.ndarray
    figures: list[dict]
    vocabulary: frozenset[str] | None = None

    @property
    def best_pass(self) -> int:
        return next(f["pass"] for f in self.figures if f["best"])


@dataclass
class _State:
    weights: np.ndarray
    mean: np.ndarray
    square: np.ndarray

    @classmethod
    def start(cls) -> _State:
        return cls(*(np.zeros((COLUMNS, CLASSES)) for _ in range(3)))

    def step(self, gradient: np.ndarray, number: int, passes: int) -> _State:
        rate = RATE * (1 - (number - 1) / passes)
        bound = np.where(np.arange(COLUMNS) < BUCKETS, LEAST, 0.0)[:, None]
        still = np.sign(gradient) * np.maximum(np.abs(gradient) - bound, 0)
        gradient = np.where(self.weights == 0, still, gradient + bound * np.sign(self.weights))
        mean = BETA_1 * self.mean + (1 - BETA_1) * gradient
        square = BETA_2 * self.square + (1 - BETA_2) * gradient**2
        move = mean / (1 - BETA_1**number) / (np.sqrt(square / (1 - BETA_2**number)) + EPSILON)
        return _State(self.weights * (1 - rate * DECAY) - rate * move, mean, square)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many numbers every row of a batch has, and column and value of each.  No row is without the constant."""
    sizes = batch.column("columns").value_lengths().to_numpy()
    tokens = batch.column("n_tokens").to_numpy()
    kinds = np.stack([1 / np.sqrt(np.maximum(tokens, 1)), np.ones(len(tokens))], axis=1)
    value = np.repeat(kinds.ravel(), np.stack([tokens, sizes - tokens], axis=1).ravel())
    return sizes, batch.column("columns").flatten().to_numpy().astype(np.intp), value


def probabilities(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The share of every class in every row of a batch; ``weights`` by class and column."""
    sizes, column, value = numbers = _rows(batch)
    first = np.cumsum(sizes, dtype=np.intp) - sizes
    scores = np.stack([np.add.reduceat(value * weights[c].take(column), first) for c in range(CLASSES)], axis=1)
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True), numbers


SUMS = "block int, sums array<double>"


def one_pass(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, dict]:
    """The mean gradient over the training rows, and losses and counts of validation rows by true and predicted class."""
    sent = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T))
    kinds = pa.schema([("block", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient = np.zeros((CLASSES, -(-COLUMNS // BLOCK) * BLOCK))
        told = np.zeros(4 + CLASSES**2)  # training rows and their loss, validation rows and theirs, and their cells
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                share, (sizes, column, value) = probabilities(batch, sent.value)
                label = batch.column("label").to_numpy()
                train = batch.column("train").to_numpy(zero_copy_only=False)
                loss = -np.log(np.maximum(share[np.arange(len(label)), label], 1e-300))
                told[:4] += train.sum(), loss[train].sum(), (~train).sum(), loss[~train].sum()
                told[4:] += np.bincount(label[~train] * CLASSES + share[~train].argmax(axis=1), minlength=CLASSES**2)
                share[np.arange(len(label)), label] -= 1
                share[~train] = 0
                for c in range(CLASSES):
                    gradient[c] += np.bincount(column, value * np.repeat(share[:, c], sizes), gradient.shape[1])
        blocks = gradient.reshape(CLASSES, -1, BLOCK).transpose(1, 0, 2).reshape(-1, CLASSES * BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        columns = [pa.array([-1, *some.tolist()], pa.int32()), pa.array([told.tolist(), *blocks[some].tolist()], kinds.field("sums").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def total(group: pa.Table) -> pa.Table:
        sums = group.column("sums").combine_chunks()
        added = sums.flatten().to_numpy().reshape(len(sums), -1).sum(axis=0)
        return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([added.tolist()])], schema=kinds)

    gradient = np.zeros((-(-COLUMNS // BLOCK), CLASSES, BLOCK))
    told = np.zeros(4 + CLASSES**2)
    for r in rows.mapInArrow(run, SUMS).groupBy("block").applyInArrow(total, SUMS).collect():
        if r["block"] < 0:
            told += r["sums"]
        else:
            gradient[r["block"]] = np.reshape(r["sums"], (CLASSES, BLOCK))
    n = max(told[0], 1)
    flat = gradient.transpose(0, 2, 1).reshape(-1, CLASSES)[:COLUMNS] / n
    return flat, _figures(told)


def _figures(told: np.ndarray) -> dict:
    cells = told[4:].reshape(CLASSES, CLASSES)
    hits, known, claimed = np.diag(cells), cells.sum(axis=1), cells.sum(axis=0)
    f1 = 2 * hits / np.maximum(known + claimed, 1)
    n = max(cells.sum(), 1)
    return {
        "train_loss": float(told[1] / max(told[0], 1)), "val_loss": float(told[3] / max(told[2], 1)),
        "accuracy": float(hits.sum() / n), "f1_macro": float(f1.mean()), "f1_weighted": float((f1 * known).sum() / n),
    }


FIGURES = "pass int, train_loss double, val_loss double, accuracy double, f1_macro double, f1_weighted double, best boolean"


def prepare(df: DataFrame, key: str, vocabulary: frozenset[str] | None = None, numbered: bool = False) -> DataFrame:
    """The written rows of the labelled prompts of ``df``: ``columns``, ``n_tokens``, ``label``, ``train``.

    ``df`` needs ``prompt``, ``source_dataset`` and ``complexity_label``; it is split here unless it has a ``split`` column.
    If it is ``numbered``, it has what ``with_columns`` makes, and the prompt is not looked at.
    """
    if "split" not in df.columns:
        df = stratified_split(df, key)
    rows = encode_labels(df if numbered else with_columns(df, vocabulary)).where("label is not null")
    return materialise(rows.select("columns", "n_tokens", F.col("label").cast("int").alias("label"), (F.col("split") == "train").alias("train")), "rows")


def fit(rows: DataFrame, passes: int = PASSES, folder: str | None = None) -> LinearModel:
    """The weights of the pass with the best macro F1 on the validation rows, the first of equal ones."""
    spark, state, figures, best = rows.sparkSession, _State.start(), [], None
    gradient: np.ndarray | None = None
    for number in range(1, passes + 1):
        known = None if folder is None else _read_pass(spark, folder, number, passes)
        if known is None:
            if gradient is None:
                gradient, _ = one_pass(rows, state.weights)
            state = state.step(gradient, number, passes)
            gradient, found = one_pass(rows, state.weights)
            if folder is not None:
                _write_pass(spark, folder, number, passes, state, found)
        else:
            (state, found), gradient = known, None
        if best is None or found["f1_macro"] > best[0]:
            best = found["f1_macro"], number, state.weights
        figures.append({"pass": number} | found)
    return LinearModel(best[2], [f | {"best": f["pass"] == best[1]} for f in figures])


def train(
    df: DataFrame, key: str = "row_key", passes: int = PASSES, folder: str | None = None, vocabulary: frozenset[str] | None = None,
    numbered: bool = False,
) -> LinearModel:
    return replace(fit(prepare(df, key, vocabulary, numbered), passes, folder), vocabulary=vocabulary)


def pass_figures(spark: SparkSession, model: LinearModel) -> DataFrame:
    """A row for every pass: losses, accuracy, macro and weighted F1 on the validation rows, and whether it is the one kept."""
    names = [name.strip().split(" ")[0] for name in FIGURES.split(",")]
    return spark.createDataFrame([tuple(f[n] for n in names) for f in model.figures], FIGURES)


WEIGHTS = "column int, class int, weight double, mean double, square double"


def _path(folder: str, number: int, passes: int) -> str:
    return f"{folder}/pass-{number}-of-{passes}"


def _write_pass(spark: SparkSession, folder: str, number: int, passes: int, state: _State, found: dict) -> None:
    place = np.arange(COLUMNS * CLASSES)
    kinds = pa.schema([("column", pa.int32()), ("class", pa.int32()), *((n, pa.float64()) for n in ("weight", "mean", "square"))])
    columns = [place // CLASSES, place % CLASSES, *(x.ravel() for x in (state.weights, state.mean, state.square))]
    table = spark.createDataFrame(pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds))
    told = F.lit(",".join(f"{name}={value!r}" for name, value in found.items())).alias("figures")
    table.select("*", told).coalesce(1).write.mode("overwrite").parquet(_path(folder, number, passes))


def _read_pass(spark: SparkSession, folder: str, number: int, passes: int) -> tuple[_State, dict] | None:
    """Weights and figures of a pass, or none if it has not been written to the end."""
    try:
        table = spark.read.schema(f"{WEIGHTS}, figures string").parquet(_path(folder, number, passes)).toPandas()
    except AnalysisException:
        return None
    if len(table) != COLUMNS * CLASSES:
        return None
    table = table.sort_values(["column", "class"])
    told = dict(x.split("=") for x in table["figures"].iloc[0].split(","))
    state = _State(*(table[n].to_numpy(float).reshape(COLUMNS, CLASSES) for n in ("weight", "mean", "square")))
    return state, {name: float(value) for name, value in told.items()}


def score(df: DataFrame, model: LinearModel, numbered: bool = False) -> DataFrame:
    """``df`` with the model's label, its probability, and the probability of each class.

    If it is ``numbered``, it has what ``with_columns`` makes of the model's vocabulary; that is left out.
    """
    made = df.drop("predicted", "confidence", "all_probs")
    if not numbered:
        made = with_columns(made, model.vocabulary)
    kept = [c for c in made.columns if c not in ("columns", "n_tokens")]
    schema = T.StructType([*made.select(*kept).schema.fields, T.StructField("_shares", T.ArrayType(T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                batch = whole.slice(low, SLICE)
                share, _ = probabilities(batch, sent.value)
                ends = pa.array(np.arange(0, share.size + 1, CLASSES), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "_shares"])

    shares = F.col("_shares")
    most = F.array_max(shares)
    return made.mapInArrow(run, schema).select(
        *kept, id_label((F.array_position(shares, most) - 1).cast("int")).alias("predicted"), most.alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(name) for name in LABELS]), shares).alias("all_probs"),
    )


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    """The weights as a table of (column, class, weight), and the figures of the passes beside it."""
    place = np.arange(COLUMNS * CLASSES)
    kinds = pa.schema([("column", pa.int32()), ("class", pa.int32()), ("weight", pa.float64())])
    columns = [place // CLASSES, place % CLASSES, model.weights.ravel()]
    table = pa.table([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    pass_figures(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/passes")
    delete(spark, f"{path}/vocabulary")
    if model.vocabulary is not None:
        pieces = spark.createDataFrame(pa.table({"piece": sorted(model.vocabulary)}))
        pieces.coalesce(1).write.parquet(f"{path}/vocabulary")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    table = spark.read.parquet(f"{path}/weights").toPandas().sort_values(["column", "class"])
    figures = [r.asDict() for r in spark.read.parquet(f"{path}/passes").orderBy("pass").collect()]
    vocabulary = None
    if "vocabulary" in folders(spark, path):
        vocabulary = frozenset(r["piece"] for r in spark.read.parquet(f"{path}/vocabulary").collect())
    return LinearModel(table["weight"].to_numpy(float).reshape(COLUMNS, CLASSES), figures, vocabulary)
