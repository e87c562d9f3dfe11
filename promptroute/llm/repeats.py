"""Repeated byte strings across documents by suffix arrays.

A byte is repeated if a string of ``length`` bytes covers it that also starts anywhere else, in the
same document or another.  Texts count as UTF-8, and strings never span documents.

1. Every string of that length holds one anchor: of its runs of ``anchor`` bytes the one with the lowest hash.
   Equal strings have equal anchors, so anchors that occur once rule out all their strings.  The
   strings of an anchor are next to each other and make up a piece of its document.
2. Equal pieces of an anchor are taken together, with their number, before anything is gathered.
3. Pieces that share an anchor but differ go to shards, by anchor; an anchor with very many is dealt over several.  A
   shard leaves out strings whose hash it holds once and takes equal remains together.  The bytes of those that differ
   get a suffix array, and common prefixes of neighbours tell which strings repeat.
4. Shards that hold parts of one anchor are merged: the sorted digests of their strings are looked
   up in each other by binary search.

Strings of a second, ``longer`` length are found on the way.  Longer strings that are equal begin with equal shorter
ones, so they share an anchor; a piece only has to reach as far behind its last string as the longer one does.

A null text is an empty text, and texts shorter than ``length`` have no repeats.  Repeated rows are
repeats of each other.  An empty table gives an empty one.  Extra columns are kept by ``cut``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import arrow_schema, field, free, map_columns, texts
from promptroute.llm.shingles import _BYTES, _INVERSE, _ODD, mix, powers
from promptroute.llm.suffixes import NO_SUFFIX, common_prefixes, packed, suffix_ranks
from promptroute.session import materialise

#: Bytes of a string and of an anchor, unless given.
LENGTH, ANCHOR = 400, 100
#: Bytes of a passage, fewer than those of 50 short words, and of its anchor.
PASSAGE, PASSAGE_ANCHOR = 250, 64
#: Pieces that a shard holds, about.
SHARD = 1_500
#: Strings whose digests a merging task holds, at most.
MERGED = 500_000
#: Bytes of texts that are hashed together, about.
TOGETHER = 1 << 17
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_SECOND_INVERSE = np.uint64(pow(int(_SECOND), -1, 1 << 64))


def _sums(line: np.ndarray, base: np.uint64) -> np.ndarray:
    out = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_BYTES[line] * powers(base, len(line)), out=out[1:])
    return out


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring keys, from running minima of blocks to both sides."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces(raws: list[bytes], lengths: list[int], anchor: int) -> tuple[np.ndarray, ...]:
    """Number of the text, anchor hash, content hash, first byte, end and reach of every piece of some texts."""
    numbers = [i for i, raw in enumerate(raws) if len(raw) >= lengths[0]]
    if not numbers:
        return (np.zeros(0, np.int64),) * 6
    length = lengths[0]
    line = np.frombuffer(b"".join(raws[i] for i in numbers), np.uint8)
    sizes = np.array([len(raws[i]) for i in numbers])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    sums, inverse = _sums(line, _ODD), powers(_INVERSE, len(line))
    n = len(line) - anchor + 1
    hashes = mix((sums[anchor:] - sums[:n]) * inverse[:n])
    places = np.arange(n, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    # Of equal hashes the rightmost counts: the later place has the lower key.
    keys = (hashes & ~low) | (low - places)
    at = (low - (_window_minima(keys, length - anchor + 1) & low)).astype(np.int64)
    # Strings do not span texts; anchors of neighbouring texts stand in different places.
    inside = np.ones(len(line), bool)
    for end in ends.tolist():
        inside[end - length + 1 : end] = False
    starts = np.flatnonzero(inside)
    at = at[starts]
    new = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    first, last = starts[new], starts[np.concatenate([new[1:], [len(at)]]) - 1]
    owner = np.searchsorted(ends, first, "right")
    anchors, stops, reach = at[new], last + length, np.minimum(last + lengths[-1], ends[owner])
    other = _sums(line, _SECOND)
    content = mix(
        (other[reach] - other[first]) * powers(_SECOND_INVERSE, len(line))[first]
        + mix(
            (anchors - first).astype(np.uint64)
            + (stops - first).astype(np.uint64) * np.uint64(1 << 20)
            + (reach - first).astype(np.uint64) * np.uint64(1 << 40)
        )
    )
    begin = begins[owner]
    found = hashes[anchors].view(np.int64), content.view(np.int64), first - begin, stops - begin, reach - begin
    return np.array(numbers)[owner], *found


PIECES = "row long, anchor long, content long, start int, stop int, reach int"


def row_key(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def _occurrences(docs: DataFrame, key: str, text: str, lengths: list[int], anchor: int) -> DataFrame:
    kinds = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy()
            raws = [value.encode("utf-8", "surrogatepass") for value in texts(batch, "text")]
            sizes = np.cumsum([len(raw) for raw in raws])
            cuts = [0, *(np.flatnonzero(np.diff(sizes // TOGETHER)) + 1).tolist(), len(raws)]
            held = [(low, pieces(raws[low:high], lengths, anchor)) for low, high in zip(cuts[:-1], cuts[1:])]
            columns = [np.concatenate(x) for x in zip(*((rows[low + found[0]], *found[1:]) for low, found in held))]
            if len(columns[0]):
                arrays = [pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return docs.select(row_key(key, text).alias("row"), F.col(text).alias("text")).mapInArrow(run, PIECES)


#: Columns of spans: of the strings, and of the longer ones.
SPANS = ["spans", "longer"]


def repeated_spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    longer: int | None = None,
) -> DataFrame:
    """``row`` (``row_key`` of a row of ``docs``) and ``spans``, the maximal runs of repeated bytes, for rows with any.

    With ``longer`` a column of that name has the runs that repeated strings of that many bytes cover.
    """
    lengths = [length] if longer is None else [length, longer]
    every = _occurrences(docs, key, text, lengths, anchor)
    # Written, so that the join reads two plain shuffles: a hot anchor's share of one can then be split.
    several = materialise(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors").select("anchor")
    seen = materialise(every.join(several, "anchor", "left_semi"), "occurrences")
    kinds = materialise(
        seen.groupBy("anchor", "content").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "start", "stop", "reach")).alias("one")
        ),
        "pieces",
    )
    # Whole pieces that occur several times, and what the suffix arrays find in pieces that differ.
    ends = [F.col("one.stop") - F.col("one.start"), F.col("one.reach") - F.col("one.start")]
    whole = kinds.where("n > 1").select(
        "anchor", "content",
        *(F.when(end >= size, F.struct(F.lit(0).alias("start"), end.alias("stop"))).alias(name)
          for name, end, size in zip(SPANS, ends, lengths)),
    )
    parts = _shared_parts(docs, key, text, kinds, lengths).select(
        "anchor", "content",
        *(F.when(F.col("level") == i, F.struct("start", "stop")).alias(SPANS[i]) for i in range(len(lengths))),
    )
    found = whole.unionByName(parts).join(seen.select("anchor", "content", "row", "start"), ["anchor", "content"])
    moved = [
        F.when(
            F.col(name).isNotNull(),
            F.struct(*((F.col("start") + F.col(f"{name}.{x}")).alias(x) for x in ("start", "stop"))),
        ).alias(name)
        for name in SPANS[: len(lengths)]
    ]
    return _merged(found.select("row", *moved))


def _merged(found: DataFrame) -> DataFrame:
    names = found.columns[1:]
    spans = found.groupBy("row").agg(*(F.collect_set(name).alias(name) for name in names))
    kind = "array<struct<start:int, stop:int>>"

    def make():
        return lambda batch: [merged_runs(batch.column(name)) for name in names]

    return map_columns(spans, [field(name, kind) for name in names], make)


def merged_runs(spans: pa.ListArray) -> pa.ListArray:
    """The maximal runs of each row's spans."""
    counts = spans.value_lengths().to_numpy()
    start, stop = (spans.flatten().field(i).to_numpy().astype(np.int64) for i in (0, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((start, row))
    # Rows are set apart, so that one running end serves all.
    apart = row[order] << 32
    start, stop = start[order] + apart, np.maximum.accumulate(stop[order] + apart)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > stop[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start))[: len(at)] - 1
    row = row[order][at]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))])
    runs = pa.StructArray.from_arrays(
        [pa.array((x & 0xFFFFFFFF).astype(np.int32)) for x in (start[at], stop[last])], names=["start", "stop"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)


def _shared_parts(docs: DataFrame, key: str, text: str, kinds: DataFrame, lengths: list[int]) -> DataFrame:
    """Repeated stretches of the pieces whose anchor has several contents; ``level`` is the number of the length."""
    # Written as well: with the aggregate in its stage the join could not split the pieces of an anchor.
    contents = materialise(kinds.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"), "contents")
    open_pieces = materialise(kinds.join(contents, "anchor"), "open")
    size = open_pieces.agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("contents") > SHARD, F.col("one.reach") - F.col("one.start"))).alias("dealt"),
    ).first()
    shards, tasks = max(1, size["n"] // SHARD), max(1, (size["dealt"] or 0) // MERGED)
    dealt = F.when(
        F.col("contents") > SHARD,
        F.xxhash64("anchor", F.pmod(F.xxhash64("content"), F.ceil(F.col("contents") / SHARD))),
    ).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    wanted = open_pieces.select(
        F.col("one.row").alias("row"),
        F.struct(
            "anchor", "content", "one.start", "one.stop", "one.reach", "n",
            dealt.alias("shard"), (F.col("contents") > SHARD).alias("dealt"),
        ).alias("piece"),
    ).groupBy("row").agg(F.collect_list("piece").alias("pieces"))
    source = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text"))
    held = source.join(wanted, "row").dropDuplicates(["row"])
    cut = "shard long, dealt boolean, anchor long, content long, n long, own int, raw binary"
    cut_kinds = arrow_schema(cut)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, wanted in zip(texts(batch, "text"), batch.column("pieces").to_pylist()):
                raw = value.encode("utf-8", "surrogatepass")
                rows += [
                    {k: p[k] for k in ("shard", "dealt", "anchor", "content", "n")}
                    | {"own": p["stop"] - p["start"], "raw": raw[p["start"] : p["reach"]]}
                    for p in wanted
                ]
            yield pa.RecordBatch.from_pylist(rows, schema=cut_kinds)

    parts = "level int, anchor long, content long, start int, stop int, task int, digests binary, places binary"
    part_kinds = arrow_schema(parts)

    def search(shard: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(search_shard(shard.to_pylist(), tasks, lengths), schema=part_kinds)

    found = materialise(held.mapInArrow(slices, cut).groupBy("shard").applyInArrow(search, parts), "parts")
    return found.where("task is null").select("level", "anchor", "content", "start", "stop").unionByName(
        _across(found.where("task is not null"), lengths)
    )


#: Where a string stands: its piece, its first byte there, and whether its shard holds it twice already.
PLACE = np.dtype([("anchor", "<i8"), ("content", "<i8"), ("start", "<i4"), ("closed", "?")])


def search_shard(rows: list[dict], tasks: int, lengths: list[int]) -> list[dict]:
    """Repeated stretches of a shard's pieces, and the sorted digests of all distinct strings of dealt ones.

    Strings whose hash the shard holds once are left out first, unless other shards may hold them.  What stays of the
    pieces is taken together where it is equal; a suffix array tells what repeats in stretches that still differ.
    """
    sizes = np.array([len(r["raw"]) for r in rows])
    line = np.frombuffer(b"".join(r["raw"] for r in rows), np.uint8)
    begins = np.cumsum(sizes) - sizes
    sums, inverse = _sums(line, _ODD), powers(_INVERSE, len(line))
    copies, dealt = np.array([r["n"] for r in rows]), np.array([r["dealt"] for r in rows])
    # Strings of a piece: those that hold its anchor, and the longer ones that begin with one of them.
    own = [np.array([r["own"] for r in rows]), sizes]
    out: list[dict] = []
    for level, length in enumerate(lengths):
        owner, offset = _strings(np.maximum(own[level] - length + 1, 0))
        at = begins[owner] + offset
        _, string = np.unique((sums[at + length] - sums[at]) * inverse[at], return_inverse=True)
        likely = (np.bincount(string, copies[owner])[string] > 1) | dealt[owner]
        kinds: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for p, a, b in _stretches(owner, offset, likely, length, 1):
            kinds.setdefault((rows[p]["anchor"], rows[p]["raw"][a:b]), []).append((p, a))
        several = Counter(anchor for anchor, _ in kinds)
        differ = []
        for (anchor, raw), places in kinds.items():
            one = rows[places[0][0]]
            held = {
                "anchor": anchor, "raw": raw, "dealt": one["dealt"], "n": sum(rows[p]["n"] for p, _ in places),
                "places": [(rows[p]["content"], a) for p, a in places],
            }
            if held["n"] > 1 and several[anchor] == 1 and not one["dealt"]:
                out += _everywhere(held, level, 0, len(raw))
            else:
                differ.append(held)
        if differ:
            out += _search_differing(differ, tasks, level, length)
    return out


def _strings(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of every string, of as many as ``counts`` says for each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _everywhere(held: dict, level: int, start: int, stop: int) -> list[dict]:
    """A stretch of what several pieces hold, in each of them."""
    return [
        {"level": level, "anchor": held["anchor"], "content": content, "start": at + start, "stop": at + stop}
        for content, at in held["places"]
    ]


def _search_differing(rows: list[dict], tasks: int, level: int, length: int) -> list[dict]:
    """What ``search_shard`` says of strings of ``length`` bytes, from a suffix array of all these stretches.

    The digests are cut into ``tasks`` ranges; a range is one row, with the places of its strings beside it.
    """
    sizes = np.array([len(r["raw"]) for r in rows])
    line = np.frombuffer(b"".join(r["raw"] for r in rows), np.uint8)
    begins = np.cumsum(sizes) - sizes
    words = packed(line)
    owner, offset = _strings(sizes - length + 1)
    # Only suffixes that begin a string within a stretch count.
    at = begins[owner] + offset
    order = np.argsort(suffix_ranks(words)[at])
    before = np.full(len(line), NO_SUFFIX, np.int64)
    before[at[order]] = np.concatenate([[-1], at[order[:-1]]])
    new = common_prefixes(words, before, begins, sizes - length + 1, length)[at[order]] < length
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(new) - 1
    copies = np.array([r["n"] for r in rows])[owner]
    repeated = np.bincount(string, copies)[string] > 1
    out: list[dict] = []
    for p, a, b in _stretches(owner, offset, repeated, length, length):
        out += _everywhere(rows[p], level, a, b)
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    shown = np.flatnonzero(first & np.array([r["dealt"] for r in rows])[owner])
    if not len(shown):
        return out
    digests = np.array(
        [
            hashlib.blake2b(rows[p]["raw"][a : a + length], digest_size=16).digest()
            for p, a in zip(owner[shown].tolist(), offset[shown].tolist())
        ],
        "S16",
    )
    held = np.zeros(len(shown), PLACE)
    # A string that stands in several places repeats in this shard, so the first place will do.
    content, start = (np.array([r["places"][0][i] for r in rows])[owner[shown]] for i in (0, 1))
    held["anchor"], held["content"] = np.array([r["anchor"] for r in rows])[owner[shown]], content
    held["start"], held["closed"] = start + offset[shown], repeated[shown]
    by_digest = np.argsort(digests)
    digests, held = digests[by_digest], held[by_digest]
    high = np.frombuffer(digests.tobytes(), ">u4")[::4].astype(np.int64)
    task = high * tasks >> 32
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1, [len(task)]])
    return out + [
        {"level": level, "task": int(task[a]), "digests": digests[a:b].tobytes(), "places": held[a:b].tobytes()}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())
    ]


def _stretches(
    owner: np.ndarray, offset: np.ndarray, wanted: np.ndarray, length: int, gap: int
) -> Iterator[tuple[int, int, int]]:
    """Per piece, the bytes of runs of wanted strings, which start ``gap`` bytes apart at most."""
    at = np.flatnonzero(wanted)
    if not len(at):
        return
    apart = np.ones(len(at), bool)
    apart[1:] = (np.diff(owner[at]) != 0) | (np.diff(offset[at]) > gap)
    starts = np.flatnonzero(apart)
    stops = np.concatenate([starts[1:], [len(at)]]) - 1
    for a, b in zip(at[starts].tolist(), at[stops].tolist()):
        yield int(owner[a]), int(offset[a]), int(offset[b]) + length


def _across(runs: DataFrame, lengths: list[int]) -> DataFrame:
    """Strings that other shards hold as well: the shards' sorted runs of a range, searched in each other."""
    kinds = "level int, anchor long, content long, start int, stop int"
    found_kinds = arrow_schema(kinds)

    def merge(group: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x, "S16") for x in group.column("digests").to_pylist()]
        everything = np.sort(np.concatenate(runs))
        met = []
        for run, held in zip(runs, group.column("places").to_pylist()):
            # A run holds a digest once, so a second one is of another shard.
            copies = np.searchsorted(everything, run, "right") - np.searchsorted(everything, run, "left")
            held = np.frombuffer(held, PLACE)
            met.append(held[(copies > 1) & ~held["closed"]])
        met, level = np.concatenate(met), group.column("level")[0].as_py()
        columns = [np.full(len(met), level), met["anchor"], met["content"], met["start"], met["start"] + lengths[level]]
        return pa.table([pa.array(c, k.type) for c, k in zip(columns, found_kinds)], schema=found_kinds)

    return runs.select("level", "task", "digests", "places").groupBy("level", "task").applyInArrow(merge, kinds)


def cut(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text", to: str = "kept") -> DataFrame:
    """``docs`` with the bytes outside the spans in the binary column ``to``, ``n_bytes``, ``n_removed`` and ``n_spans``.

    Spans of two lengths: these are of the longer one; of the shorter, ``n_passage_bytes``, ``n_passages`` and the text
    without their characters in ``passages_cut``.
    """
    both, found = _with_spans(docs, spans, key, text)
    fields = [field(to, "binary"), field("n_bytes", "long"), field("n_removed", "long"), field("n_spans", "long")]
    if len(found) > 1:
        fields += [field("n_passage_bytes", "long"), field("n_passages", "long"), field("passages_cut", "string")]

    def make():
        def keep(batch):
            columns: list[list] = [[] for _ in fields]
            runs = [batch.column(name).to_pylist() for name in found]
            for value, *spans in zip(texts(batch, text), *runs):
                raw = value.encode("utf-8", "surrogatepass")
                *shorter, last = ([(x["start"], x["stop"]) for x in some or ()] for some in spans)
                kept = _without(raw, last)
                made = [kept, len(raw), len(raw) - len(kept), len(last)]
                for some in shorter:
                    left = _without(raw, whole_characters(raw, some)).decode("utf-8", "surrogatepass") if some else value
                    made += [sum(b - a for a, b in some), len(some), left]
                for column, x in zip(columns, made):
                    column.append(x)
            return columns

        return keep

    return map_columns(both, fields, make).drop(*found)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    left, at = [], 0
    for start, stop in spans:
        left.append(raw[at:start])
        at = stop
    return b"".join([*left, raw[at:]])


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the spans of each row, and the names of their columns."""
    names = [c for c in SPANS if c in spans.columns]
    row, *found = free(docs, "_row", *(f"_{c}" for c in names))
    known = spans.select(F.col("row").alias(row), *(F.col(c).alias(to) for c, to in zip(names, found)))
    return docs.withColumn(row, row_key(key, text)).join(known, row, "left").drop(row), found


def remove(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """``docs`` without the characters of repeated strings; a character of which a part is repeated stays."""
    both, (found,) = _with_spans(docs, repeated_spans(docs, key, text, length, anchor), key, text)

    def make():
        def shorten(batch):
            out = []
            for value, spans in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist()):
                if spans:
                    raw = value.encode("utf-8", "surrogatepass")
                    whole = whole_characters(raw, [(s["start"], s["stop"]) for s in spans])
                    value = _without(raw, whole).decode("utf-8", "surrogatepass")
                out.append(value)
            return [out]

        return shorten

    return map_columns(both, [field(text, "string")], make).select(*docs.columns)


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters that they hold only a part of."""
    out = []
    for start, stop in spans:
        while start < stop and raw[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop -= 1
        if stop > start:
            out.append((start, stop))
    return out
