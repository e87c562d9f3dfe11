"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

The probability of a word is that of its class after the class before, times that of the word in its
class.  Every word that stands ``LEAST`` times or more in training texts is put into one of ``CLASSES`` classes by
exchange: a word moves to the class where the likelihood of the class bigrams is highest.  The ``FREQUENT`` most
frequent words do so round by round, until the likelihood no longer rises; these rounds read a table of their
neighbours only, whose size has a bound.  Then all others go to their best class, in passes over the texts of which there are
``PLACINGS``, and more while the likelihood still rises a good deal.
Rarer words are in classes by their shape, and the end of a text is a class of its own.
Both factors are smoothed, and a small share of the add-one word frequencies is mixed in.

Counts cover all training texts and grow with them; they stay in tables, and so do the neighbours of the words that are
placed.  A text is turned into numbers next to the words of its block of
neighbouring rows, which are looked up in the count table together, so no task needs the words of the whole
vocabulary.  Of a clustered word tasks hold its class with a mark or its count, 3 or 9 bytes, and the driver some
dozens of bytes (symbol, count, class), but no words: that much still grows with the vocabulary.

A-Z count as lower case; words are runs of characters other than ASCII white space.  A null text is an empty
text, which has the end as its only token.  Repeated rows count and are scored each.  Without
training texts every word is unknown.  A key may be of any type and null.  An empty table gives an empty one; extra
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from promptroute.llm.frames import ROWS, arrow_schema, share, texts
from promptroute.session import materialise

#: Occurrences from which a word is clustered, the classes, and the least rise of the log likelihood a token in two rounds.
LEAST, CLASSES, RISE = 10, 48, 1e-4
#: Words that exchange round by round; passes in which the others go to their best class, and the rise of the log likelihood
#: a token for which there are more.
FREQUENT, PLACINGS, PLACED = 4096, 2, 0.02
#: Rows of a block, and the entries a task counts before it passes them on.
BLOCK_ROWS, HELD = 8192, 1_000_000
#: Links of clustered words in a row of their table.
LINKS = 1 << 18
#: Smoothing: prior weight of class frequencies, of every word in its class, and the share of word frequencies.
TRANSITION, EMISSION, MIXED = 20.0, 0.5, 0.05
SHAPES = 8
END = b"\n"

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_DIGITS = frozenset(b"0123456789")
_MARKS = frozenset(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shape(word: bytes) -> int:
    letters = frozenset(word)
    if letters & _DIGITS:
        return 0
    if letters & _MARKS:
        return 1
    if word[-1] in b".,":
        return 2
    if max(word) > 127:
        return 3
    return 4 + (len(word) > 4) + (len(word) > 8) + (len(word) > 12)


def blocks(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """``id``, ``text``, ``held_out`` and ``block``, which is the same at every reading.

    A block is a run of neighbouring rows of a file; rows that come from no file are written first.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held_out.alias("held_out"))
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / BLOCK_ROWS))
    try:
        return docs.select(
            F.col(key).alias("id"), F.col(text).alias("text"), held_out.alias("held_out"), place.alias("block")
        )
    except AnalysisException:
        return materialise(rows, "texts").select("id", "text", "held_out", place.alias("block"))


def _block_words(rows: DataFrame) -> DataFrame:
    """Every block's words, ends included, and how often each stands in training texts."""
    schema = "block long, word binary, n long"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for block, counts in seen.items():
                columns = [[block] * len(counts), list(counts), list(counts.values())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)
            seen.clear()

        for batch in batches:
            out, of = batch.column("held_out").to_pylist(), batch.column("block").to_pylist()
            for value, skipped, block in zip(texts(batch, "text"), out, of):
                counts = seen.setdefault(block, Counter())
                if skipped:
                    counts.update(dict.fromkeys([*tokens(value), END], 0))
                else:
                    counts.update([*tokens(value), END])
            if len(seen) > 1 or sum(map(len, seen.values())) > HELD:
                # A block's rows come one after the other: all but the last are complete.
                last = next(reversed(seen))
                open_counts = seen.pop(last)
                yield from flush()
                seen[last] = open_counts
                if len(open_counts) > HELD:
                    yield from flush()
        yield from flush()

    return rows.select("block", "text", "held_out").mapInArrow(run, schema)


def numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """``word``, ``n``, ``symbol`` and ``shape`` of all words, and how many are clustered: theirs are 0, 1, ..., others have -1."""
    schema = "word binary, n long, part int, place int, shape int"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), 0
        for batch in batches:
            words = batch.column("word").to_pylist()
            often = batch.column("n").to_numpy() >= LEAST
            often &= np.array([w != END for w in words], bool)
            place = np.where(often, found + np.cumsum(often) - 1, -1).astype(np.int32)
            found += int(often.sum())
            columns = [batch.column("word"), batch.column("n"), pa.array(np.full(len(place), part, np.int32)), pa.array(place)]
            columns.append(pa.array([SHAPES if w == END else shape(w) for w in words], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    placed = materialise(counts.select("word", "n").mapInArrow(run, schema), "counts")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum((F.col("place") >= 0).cast("int")).alias("n")).collect())
    firsts = [(part, sum(n for _, n in sizes[:i])) for i, (part, _) in enumerate(sizes)]
    first = counts.sparkSession.createDataFrame(firsts, "part int, first int")
    symbol = F.when(F.col("place") < 0, -1).otherwise(F.col("first") + F.col("place")).alias("symbol")
    return placed.join(first, "part").select("word", "n", symbol, "shape"), sum(n for _, n in sizes)


ENCODED = "held_out boolean, codes array<int>"


def _keyed(rows: DataFrame, rest: str) -> tuple[T.StructType, pa.Schema]:
    """The columns ``rest`` after an ``id`` like that of ``rows``."""
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string(rest).fields])
    return schema, to_arrow_schema(schema)


def encode(rows: DataFrame, of_blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Every text as codes of its words: the symbol, or -1, -2, ... by shape and count of a word that has none."""
    rare = -1 - LEAST * F.col("shape") - F.col("n").cast("int")
    coded = words.where(F.col("word") != F.lit(END)).select("word", F.when(F.col("symbol") < 0, rare).otherwise(F.col("symbol")).alias("code"))
    lookups = of_blocks.select("block", "word").distinct().join(coded, "word")
    nothing = {"word": F.lit(None).cast("binary"), "code": F.lit(None).cast("int")}
    schema, kinds = _keyed(rows, ENCODED)
    line = lookups.select("block", F.lit(None).cast(schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("text"),
                          F.lit(None).cast("boolean").alias("held_out"), "word", "code", F.lit(0).alias("kind"))
    line = line.unionByName(rows.withColumns(nothing).withColumn("kind", F.lit(1)))
    line = line.repartition("block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, block, made, held = {}, None, [], 0

        def flush() -> pa.RecordBatch:
            ids, out, lines = zip(*made)
            ends = np.cumsum([0, *map(len, lines)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lines)), type=kinds.field("codes").type)
            return pa.RecordBatch.from_arrays([pa.array(ids, kinds.field("id").type), pa.array(out, pa.bool_()), flat], schema=kinds)

        for batch in batches:
            of, words = batch.column("block").to_pylist(), batch.column("kind").to_numpy() == 0
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(batch.column("block").to_numpy()) != 0) | (np.diff(words.astype(int)) != 0)]))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                part = batch.slice(low, high - low)
                if block is None or of[low] != block:
                    codes, block = {}, of[low]
                if words[low]:
                    codes.update(zip(part.column("word").to_pylist(), part.column("code").to_pylist()))
                    continue
                for i, out, value in zip(part.column("id").to_pylist(), part.column("held_out").to_pylist(), texts(part, "text")):
                    made.append((i, out, np.array([*map(codes.__getitem__, tokens(value))], np.int32)))
                    held += len(made[-1][2])
                    if len(made) >= ROWS or held >= HELD:
                        yield flush()
                        made, held = [], 0
        if made:
            yield flush()

    found = line.select("block", "kind", "word", "code", "id", "text", "held_out").mapInArrow(run, schema)
    return materialise(found, "encoded")


def _lines(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts of a batch, and where each text ends."""
    column = batch.column("codes")
    return column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())


def _neighbouring(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that follow each other in the texts of a batch: those of words, then of shapes, then the end."""
    codes, ends = _lines(batch)
    symbols = np.where(codes >= 0, codes, size + (-1 - codes.astype(np.int64)) // LEAST)
    line = np.concatenate([[size + SHAPES], np.insert(symbols, ends, size + SHAPES)])
    return line[:-1], line[1:]


def _links(encoded: DataFrame, top: np.ndarray, size: int) -> DataFrame:
    """Rows of about ``LINKS`` links in order: a word, twice a neighbour (one more where it stands before), how often.

    Words are known by their place in ``top``; the shapes, the end and the rest of the words follow them.  Only the first and the
    last of a row may have links in other rows, however many links a word has.
    """
    schema, packed = "pair long, n long", "own array<int>, link array<long>, n array<long>"
    pair_kinds, kinds, n_symbols = arrow_schema(schema), arrow_schema(packed), len(top) + SHAPES + 2
    most, sent = LINKS, share(encoded.sparkSession, top)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        places = np.full(size + SHAPES + 1, n_symbols - 1, np.int64)
        places[sent()] = np.arange(n_symbols - SHAPES - 2)
        places[size:] = np.arange(n_symbols - SHAPES - 2, n_symbols - 1)

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], schema=pair_kinds)

        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                a, b = _neighbouring(whole.slice(low, ROWS), size)
                held.append(places[a] * n_symbols + places[b])
                if sum(map(len, held)) >= 2 * HELD:
                    yield from flush()
                    held.clear()
        if held:
            yield from flush()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            own, link, n = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("own", "link", "n"))
            new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(link) != 0)]))
            columns = own[new], link[new], np.add.reduceat(n, new)
            return pa.RecordBatch.from_arrays([pa.array([c], k.type) for c, k in zip(columns, kinds)], schema=kinds)

        for whole in batches:
            for low in range(0, whole.num_rows, most):
                held.append(whole.slice(low, most))
                if sum(x.num_rows for x in held) >= most:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    found = encoded.where(~F.col("held_out")).select("codes").mapInArrow(pairs, schema)
    summed = found.groupBy("pair").agg(F.sum("n").alias("n"))
    a, b = F.floor(F.col("pair") / n_symbols), F.col("pair") % n_symbols
    ends = F.array(F.struct(a.cast("int").alias("own"), (2 * b).alias("link")), F.struct(b.cast("int").alias("own"), (2 * a + 1).alias("link")))
    # Written: ranging it reads it twice.
    linked = materialise(summed.select(F.inline(ends), "n"), "pairs")
    ranged = linked.repartitionByRange("own", "link").sortWithinPartitions("own", "link")
    return materialise(ranged.mapInArrow(pack, packed), "links")


@dataclass(frozen=True)
class Model:
    """``classes`` by symbol: of clustered words, then of the shapes and the end.  Tasks do without ``words``."""

    words: DataFrame | None
    classes: np.ndarray
    counts: np.ndarray
    log_transition: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    train_tokens: int
    train_words: int

    def classes_of(self, words: list[bytes]) -> list[int]:
        """Classes of ``words``, from the table of all words."""
        told = self.words.where((F.col("symbol") >= 0) & F.col("word").isin([bytearray(w) for w in words]))
        known = {bytes(r["word"]): r["symbol"] for r in told.collect()}
        return [int(self.classes[known.get(w, len(self.counts) + shape(w))]) for w in words]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what does not depend on the classes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=1)).sum() - _xlogx(matrix.sum(axis=0)).sum())


def best_classes(own: np.ndarray, r: np.ndarray, c: np.ndarray, matrix: np.ndarray, n_classes: int) -> np.ndarray:
    """For words of the classes ``own``, followed by ``r`` and preceded by ``c``, where the likelihood gains most."""
    rows, columns = matrix.sum(axis=1), matrix.sum(axis=0)
    found = own.copy()
    for low in range(0, len(own), 256):
        part = slice(low, low + 256)
        found[part] = _best_classes(own[part], r[part], c[part], matrix, rows, columns, n_classes)
    return found


def _best_classes(own, r, c, matrix, rows, columns, n_classes):
    rt, ct = r.sum(axis=1), c.sum(axis=1)
    leave = (_xlogx(np.maximum(matrix[own] - r, 0)) - _xlogx(matrix[own])).sum(axis=1)
    leave += (_xlogx(np.maximum(matrix.T[own] - c, 0)) - _xlogx(matrix.T[own])).sum(axis=1)
    leave -= _xlogx(rows[own] - rt) - _xlogx(rows[own]) + _xlogx(columns[own] - ct) - _xlogx(columns[own])
    target = matrix[:n_classes][None]
    enter = (_xlogx(target + r[:, None]) - _xlogx(target)).sum(axis=2)
    target = matrix.T[:n_classes][None]
    enter += (_xlogx(target + c[:, None]) - _xlogx(target)).sum(axis=2)
    enter -= _xlogx(rows[:n_classes] + rt[:, None]) - _xlogx(rows[:n_classes])
    enter -= _xlogx(columns[:n_classes] + ct[:, None]) - _xlogx(columns[:n_classes])
    enter[np.arange(len(own)), own] = -leave
    best = enter.argmax(axis=1)
    return np.where(enter[np.arange(len(own)), best] + leave > 1e-9, best, own)


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].values.to_numpy() for c in ("own", "link", "n"))


def _class_pairs(links: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs: every task adds up its own."""
    k, schema = int(classes.max()) + 1, "pair int, n long"
    sent, kinds = share(links.sparkSession, classes), arrow_schema("pair int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = sent().astype(np.int64), np.zeros(k * k, np.int64)
        for batch in batches:
            for own, link, n in _arrays(batch):
                after = link % 2 == 0
                pair = of[own[after]] * k + of[link[after] // 2]
                sums += np.bincount(pair, n[after], k * k).astype(np.int64)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(sums[seen])], schema=kinds)

    matrix = np.zeros(k * k)
    for r in links.mapInArrow(run, schema).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        matrix[r["pair"]] = r["n"]
    return matrix.reshape(k, k)


def _moved(links: DataFrame, classes: np.ndarray, turns: np.ndarray, n_classes: int, matrix: np.ndarray, turn: int) -> np.ndarray:
    """The classes after a round in which the words whose turn it is go to their best class, the others staying.

    A task decides on the words it has all links of; the neighbours' classes of those at either end of a row of
    links, two a row, are added up here.
    """
    k, movable = len(matrix), len(turns)
    sent = share(links.sparkSession, (classes, turns, matrix))
    schema = "own int, to int, counts array<long>"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, turns, matrix = sent()
        mine = np.concatenate([turns == turn % 2, np.zeros(len(classes) - len(turns), bool)])
        for batch in batches:
            for own, link, n in _arrays(batch):
                edges = own[0], own[-1]
                kept = mine[own]
                words, at = np.unique(own[kept], return_inverse=True)
                for low in range(0, len(words), 4096):
                    some = words[low : low + 4096]
                    first, last = np.searchsorted(at, [low, low + len(some)])
                    place = (at[first:last] - low) * 2 * k + (link[kept][first:last] % 2) * k + classes[link[kept][first:last] // 2]
                    counts = np.bincount(place, n[kept][first:last], len(some) * 2 * k).reshape(len(some), 2, k)
                    best = best_classes(classes[some].astype(np.int64), counts[:, 0], counts[:, 1], matrix, n_classes)
                    edge = np.isin(some, edges)
                    out = np.flatnonzero(edge | (best != classes[some]))
                    lists = [counts[i].astype(np.int64).ravel().tolist() if edge[i] else None for i in out]
                    columns = [some[out], best[out].astype(np.int32), lists]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, kinds)], schema=kinds)

    moved, shared = classes.copy(), {}
    for r in links.mapInArrow(run, schema).toLocalIterator():
        if r["counts"] is None:
            moved[r["own"]] = r["to"]
        else:
            shared[r["own"]] = shared.get(r["own"], 0) + np.array(r["counts"], float).reshape(2, k)
    if shared:
        words, counts = np.array(list(shared)), np.array(list(shared.values()))
        moved[words] = best_classes(classes[words].astype(np.int64), counts[:, 0], counts[:, 1], matrix, n_classes)
    return moved


def cluster(links: DataFrame, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every symbol of ``links``, and the counts of class pairs.  ``ranks`` of the words, the most frequent being 0."""
    n_classes = min(CLASSES, max(1, len(ranks)))
    classes = np.concatenate([ranks % n_classes, np.arange(SHAPES + 2) + n_classes]).astype(np.uint8)
    turns = (ranks % 2).astype(np.uint8)
    matrix = _class_pairs(links, classes)
    best, value, turn, still = (classes, matrix), likelihood(matrix), 0, 0
    # Both halves of the words have had a turn without a rise when it ends.
    while still < 2 and len(ranks) > 1:
        classes = _moved(links, classes, turns, n_classes, matrix, turn)
        matrix = _class_pairs(links, classes)
        now = likelihood(matrix)
        still = 0 if now > value + RISE * matrix.sum() else still + 1
        if now > value:
            best, value = (classes, matrix), now
        turn += 1
    return best


def _class_neighbours(encoded: DataFrame, classes: np.ndarray, fixed: np.ndarray | None, size: int, k: int) -> DataFrame:
    """How often a class stands next to a word: ``own`` word, ``place`` (the class, ``k`` more where it stands before), ``n``.

    Of all words but the ``fixed`` ones, or of none without these.  Rows of the word -1 count pairs of classes, ``k`` times the first.
    """
    schema = "own int, place int, n long"
    kinds, sent = arrow_schema(schema), share(encoded.sparkSession, (classes, fixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, still = sent()
        moves = np.zeros(len(of), bool)
        if still is not None:
            moves[:size] = True
            moves[still] = False
        pairs, held = np.zeros(k * k, np.int64), []

        def rows(own: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((own, place, n), kinds)], schema=kinds)

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return rows((found // (2 * k)).astype(np.int32), (found % (2 * k)).astype(np.int32), n)

        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                a, b = _neighbouring(whole.slice(low, ROWS), size)
                before, after = of[a].astype(np.int64), of[b].astype(np.int64)
                pairs += np.bincount(before * k + after, minlength=k * k)
                held += [a[moves[a]] * 2 * k + after[moves[a]], b[moves[b]] * 2 * k + k + before[moves[b]]]
                if sum(map(len, held)) >= 2 * HELD:
                    yield flush()
        if sum(map(len, held)):
            yield flush()
        seen = np.flatnonzero(pairs)
        yield rows(np.full(len(seen), -1, np.int32), seen.astype(np.int32), pairs[seen])

    return encoded.where(~F.col("held_out")).select("codes").mapInArrow(run, schema)


def sparse_best_classes(
    own: np.ndarray, starts: np.ndarray, place: np.ndarray, n: np.ndarray, matrix: np.ndarray, n_classes: int
) -> np.ndarray:
    """``best_classes`` from the neighbours that there are: ``n`` of each ``place``, a word's from its start on.

    A word whose class is none of the first ``n_classes`` goes to the best of these in any case.
    """
    k, rows, columns = len(matrix), matrix.sum(axis=1), matrix.sum(axis=0)
    both = np.hstack([matrix, matrix.T])
    follows = place < k
    r = np.add.reduceat(np.where(follows, n, 0), starts).astype(float)
    c = np.add.reduceat(np.where(follows, 0, n), starts).astype(float)
    target = both[:n_classes, place].T
    enter = np.add.reduceat(_xlogx(target + n[:, None]) - _xlogx(target), starts, axis=0)
    enter -= _xlogx(rows[:n_classes] + r[:, None]) - _xlogx(rows[:n_classes])
    enter -= _xlogx(columns[:n_classes] + c[:, None]) - _xlogx(columns[:n_classes])
    here = both[np.repeat(own, np.diff([*starts, len(n)])), place]
    leave = np.add.reduceat(_xlogx(np.maximum(here - n, 0)) - _xlogx(here), starts)
    leave -= _xlogx(rows[own] - r) - _xlogx(rows[own]) + _xlogx(columns[own] - c) - _xlogx(columns[own])
    settled = np.flatnonzero(own < n_classes)
    enter[settled, own[settled]] = -leave[settled]
    best = enter.argmax(axis=1)
    return np.where((own >= n_classes) | (enter[np.arange(len(own)), best] + leave > 1e-9), best, own)


def _placed(neighbours: DataFrame, classes: np.ndarray, matrix: np.ndarray, n_classes: int, turn: int) -> np.ndarray:
    """The classes after the words of ``neighbours`` have gone to their best class, the others staying.

    Words without a class all go, of the others every second one, since words that move at once miss one another.
    """
    schema = "own int, to int"
    kinds, k, sent = arrow_schema(schema), len(matrix), share(neighbours.sparkSession, (classes, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, matrix = sent()

        def decide(own: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            # What several tasks counted of a word and place is added up.
            key, at = np.unique(own.astype(np.int64) * 2 * k + place, return_inverse=True)
            n, own, place = np.bincount(at, n), key // (2 * k), key % (2 * k)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
            words = own[starts]
            best = sparse_best_classes(classes[words].astype(np.int64), starts, place, n, matrix, n_classes)
            columns = [words.astype(np.int32), best.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=kinds)

        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for whole in batches:
            for low in range(0, whole.num_rows, 1 << 15):
                part = whole.slice(low, 1 << 15)
                held = [np.concatenate([x, part.column(c).to_numpy()]) for x, c in zip(held, ("own", "place", "n"))]
                # The last word's rows may go on in the next batch.
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield decide(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if len(held[0]):
            yield decide(*held)

    moved = classes.copy()
    chosen = neighbours.where("own >= 0" if turn == 0 else f"own >= 0 and own % 2 = {turn % 2}")
    found = chosen.repartition("own").sortWithinPartitions("own").mapInArrow(run, schema).toPandas()
    moved[found["own"].to_numpy(np.int64)] = found["to"].to_numpy()
    return moved


def _place_all(encoded: DataFrame, classes: np.ndarray, top: np.ndarray, size: int, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all symbols, and the counts of class pairs, once words in none of the first classes have one."""
    k = n_classes + SHAPES + 2

    def counted(found: DataFrame) -> tuple[np.ndarray, float]:
        matrix = np.zeros(k * k)
        for r in found.where("own = -1").groupBy("place").agg(F.sum("n").alias("n")).collect():
            matrix[r["place"]] = r["n"]
        return matrix.reshape(k, k), likelihood(matrix.reshape(k, k))

    best, turn = None, 0
    while True:
        # The counts of the last pass are all that it is for, so its neighbours are only looked at if it was not the last.
        if turn >= PLACINGS:
            matrix, value = counted(_class_neighbours(encoded, classes, None, size, k))
            risen = value - best[0]
            if risen > 0:
                best = value, classes, matrix
            if risen < PLACED * matrix.sum():
                return best[1:]
        neighbours = materialise(_class_neighbours(encoded, classes, top, size, k), "neighbours")
        matrix, value = counted(neighbours)
        if turn and (best is None or value > best[0]):
            best = value, classes, matrix
        classes = _placed(neighbours, classes, matrix, n_classes, turn)
        turn += 1


def fit(rows: DataFrame, counts: DataFrame) -> Model:
    """The model of the training texts in ``rows``, given all words with their training counts."""
    words, size = numbered(counts)
    return learn(encode(rows, _block_words(rows), words), words, size)


def learn(encoded: DataFrame, words: DataFrame, size: int) -> Model:
    """The model of the encoded training texts, given all words with their counts and symbols."""
    sizes = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    n, v = sizes["n"] or 0, sizes["v"] or 0
    often = words.where("symbol >= 0").select("symbol", "n").toPandas().sort_values("symbol")["n"].to_numpy(np.int64)
    ranked = words.where("symbol >= 0").orderBy(F.desc("n"), F.xxhash64("word"), "word").limit(FREQUENT)
    top = np.array([r["symbol"] for r in ranked.select("symbol").collect()], np.int64)
    found, matrix = cluster(_links(encoded, top, size), np.arange(len(top)))
    # Until they are placed, the rest of the words are in the last class.
    n_classes = len(matrix) - SHAPES - 2
    classes = np.full(size + SHAPES + 1, len(matrix) - 1, np.uint8)
    classes[top], classes[size:] = found[: len(top)], np.arange(n_classes, len(matrix) - 1)
    if size > len(top):
        classes, matrix = _place_all(encoded, classes, top, size, n_classes)
    matrix = matrix[:-1, :-1]
    rare = words.where((F.col("n") > 0) & (F.col("symbol") < 0) & (F.col("word") != F.lit(END)))
    class_tokens, class_words = np.zeros(len(matrix)), np.zeros(len(matrix))
    for r in rare.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        at = classes[size + r["shape"]]
        class_tokens[at], class_words[at] = r["n"], r["v"]
    np.add.at(class_tokens, classes[:size], often)
    np.add.at(class_words, classes[:size], 1)
    into = matrix.sum(axis=0) + 1
    transition = (matrix + TRANSITION * into / into.sum()) / (matrix.sum(axis=1, keepdims=True) + TRANSITION)
    return Model(words, classes, often, np.log(transition), class_tokens, class_words, n, v)


SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every text under the model of the texts that are not ``held_out``.

    Columns: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability), perplexity.
    """
    rows = blocks(docs, key, text, held_out)
    of_blocks = materialise(_block_words(rows), "words")
    words, size = numbered(of_blocks.groupBy("word").agg(F.sum("n").alias("n")))
    encoded = encode(rows, of_blocks, words)
    model = learn(encoded, words, size)
    sent = share(docs.sparkSession, replace(model, words=None))
    schema, kinds = _keyed(encoded, SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent()
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                flat, ends = _lines(batch)
                codes, at = np.unique(flat, return_inverse=True)
                rare = -1 - codes[codes < 0]
                often = codes[codes >= 0]
                scorer = Scorer(known)
                scorer.learn([], [*(rare % LEAST), *known.counts[often]], [*known.classes[size + rare // LEAST], *known.classes[often]])
                scores = map(scorer.score, np.split(at, ends[:-1]))
                ids = zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist())
                yield _batch([(*key, *found) for key, found in zip(ids, scores)], kinds)

    found = encoded.mapInArrow(run, schema)
    return found.select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


class Scorer:
    """Scores texts whose words it has been told."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.counts: list[int] = []
        self.told: list[int] = []
        self.known = -1

    def learn(self, words: list[bytes], counts: list[int], classes: list[int] | None = None) -> None:
        """Words' counts and classes; without ``classes``, on the driver, they are looked up by the ``words``."""
        self.told += self.model.classes_of(words) if classes is None else classes
        self.counts += counts

    def _prepare(self) -> None:
        m = self.model
        self.known = len(self.counts)
        self.n = n = np.array([*self.counts, m.train_tokens - m.class_tokens.sum()], float)
        self.classes = np.array([*self.told, m.classes[-1]], np.int64)
        top = m.class_tokens[self.classes] + EMISSION * (m.class_words[self.classes] + 1)
        self.emission = np.log((n + EMISSION) / np.maximum(top, n + EMISSION))
        self.emission[-1] = 0.0
        self.base = np.log10((n + 1) / (m.train_tokens + m.train_words + 1))

    def score(self, places: np.ndarray) -> tuple[int, int, float, float]:
        """Tokens, known tokens, base score and score of a text, given the places of its words among those told."""
        if self.known != len(self.counts):
            self._prepare()
        at = np.append(places, self.known)
        classes = self.classes[at]
        before = np.concatenate([classes[-1:], classes[:-1]])
        model = self.model.log_transition[before, classes] + self.emission[at]
        base = self.base[at]
        mixed = np.logaddexp(model + np.log1p(-MIXED), base * np.log(10) + np.log(MIXED))
        known = int((self.n[at] > 0).sum())
        return len(at), known, float(base.sum()), float(mixed.sum() / np.log(10))
