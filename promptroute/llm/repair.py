"""Least repairs of the turns of conversations, by a Viterbi search whose chunks run side by side.

The role initials of a repaired conversation are none, or pairs of user and assistant behind one system turn at most.
Every turn is kept, given another role or deleted, and empty turns are inserted, at the least total cost.  What is left to
pay from a turn on depends on the role last given: a vector of four costs, found from the end backwards.

1. Turns are written in order, ranged over files, with a running number; a chunk is what stands of a conversation in
   ``1 << CHUNK_BITS`` neighbouring numbers.  Most conversations are one chunk.
2. Chunks run backwards at once, all from the vector that holds at the end of a conversation: for the last chunk it is
   right, for others speculation.
3. In fix-up passes a chunk whose following chunk came out with another vector than it started from runs again.
   Vectors that differ only by a constant lead to the same choices, so passes end when all chunks have started from
   vectors equal but for constants; chunks of deletions only hand on what they are given.  The constants add up to the cost.
4. A pass forward over each conversation in order takes, of the edits that keep to the least cost, the one with the
   lowest letter, and so the lowest of the cheapest audits.

Step 4 streams a conversation through one task, since a digest of all its turns in order has no other way; that task
holds a chunk and the audit.  No other step gathers a conversation: turns that are common in one are found by counting.

Null roles and texts count as one space.  A null key is a conversation of its own, and null turns come first.  Rows of
one turn go by role and then by a hash of the text; repeated rows stay next to each other and are duplicates.  A
conversation without turns has zeros, an empty audit and no repaired turns.  An empty table gives an empty one.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptroute.llm.frames import ROWS, arrow_schema
from promptroute.session import materialise

#: Neighbouring rows of which a chunk is a part, as a power of two.
CHUNK_BITS = 12
#: Costs of another role, a deletion, an insertion, and of a turn that is cut short and stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What was given last: nothing yet, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Vector at the end of a conversation: it may end with nothing or an assistant's turn.
FINAL = (0, 2 * INSERT, INSERT, 0)
#: Code of a turn that must go; of others it is 0 to 3 by initial, and 4 more if they are cut short.
GONE = 8
SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def following(state: int) -> int:
    """What an inserted turn, or one given another role, becomes."""
    return ASSISTANT if state == USER else USER


NAMES = {USER: "user", ASSISTANT: "assistant"}


class Search:
    """Steps of the search; each is worked out once, since turns are of few kinds and vectors take few values."""

    def __init__(self) -> None:
        self.steps: dict[tuple, tuple[Vector, int]] = {}
        self.choices: dict[tuple, tuple] = {}

    @staticmethod
    def moves(code: int, state: int) -> list[tuple[str, int, int]]:
        """Letter, cost and next state of what can be done with a turn itself."""
        found = [("D", DELETE, state)]
        if code == GONE:
            return found
        extra = TRUNCATED if code & 4 else 0
        kept = {0: SYSTEM if state == NOTHING else None, 1: USER if state != USER else None,
                2: ASSISTANT if state == USER else None, 3: None}[code & 3]
        if kept is not None:
            found.append(("K", extra, kept))
        return [*found, ("R", REROLE + extra, following(state))]

    def before(self, code: int, after: Vector) -> tuple[Vector, int]:
        """The vector before a turn less its least cost, and that cost."""
        known = self.steps.get((code, after))
        if known is None:
            plain = [min(cost + after[to] for _, cost, to in self.moves(code, q)) for q in range(4)]
            once = [min(plain[q], INSERT + plain[following(q)]) for q in range(4)]
            costs = [min(plain[q], INSERT + once[following(q)]) for q in range(4)]
            least = min(costs)
            known = self.steps[code, after] = tuple(c - least for c in costs), least
        return known

    def start(self, codes: bytes, after: Vector) -> tuple[Vector, int]:
        """The vector before a chunk less its least cost, and that cost."""
        total = 0
        for code in reversed(codes):
            after, least = self.before(code, after)
            total += least
        return after, total

    def choice(self, code: int, after: Vector, state: int) -> tuple[str, int]:
        """Letters up to and with that of a turn, and the state after it: the lowest of the cheapest."""
        known = self.choices.get((code, after, state))
        if known is None:
            (here, least), letters, q = self.before(code, after), "", state
            while True:
                options = [(letter, to, cost + after[to]) for letter, cost, to in self.moves(code, q)]
                options.append(("I", following(q), INSERT + here[following(q)] + least))
                letter, to = min((letter, to) for letter, to, cost in options if cost == here[q] + least)
                letters, q = letters + letter, to
                if letter != "I":
                    break
            known = self.choices[code, after, state] = letters, q
        return known

    def trace(self, codes: bytes, after: Vector, state: int) -> tuple[list[str], int]:
        """Letters of every turn of a chunk that begins in ``state``, and the state it ends in."""
        vectors = [after]
        for code in reversed(codes[1:]):
            vectors.append(self.before(code, vectors[-1])[0])
        out = []
        for code, vector in zip(codes, reversed(vectors)):
            letters, state = self.choice(code, vector, state)
            out.append(letters)
        return out, state


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with faults of five kinds put in by a checksum of key and turn, in the same four columns."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(key), F.lit(":"), blank(turn))) % 20
    rows = turns.select(key, turn, blank(role).alias(role), blank(text).alias(text), kind.alias("_kind")).where("_kind <> 0")
    of = F.col("_kind")
    rows = rows.select(
        key, turn, F.when(of == 4, "user").otherwise(F.col(role)).alias(role),
        F.when(of == 1, "").when(of == 2, F.translate(text, ".!?", "")).otherwise(F.col(text)).alias(text),
        F.explode(F.when(of == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


def _ordered(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Written turns in order: ``key``, ``turn``, ``role``, ``text``, ``hash`` of it, and ``g``, which numbers them with gaps."""
    spaced = lambda name: F.coalesce(F.col(name), F.lit(" "))
    rows = turns.select(
        F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"),
        # So that many equal rows need not be of one range.
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("hash", F.md5("text"))
    order = ["key", "turn", "role", "hash", "place"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    return materialise(ranged.withColumn("g", F.monotonically_increasing_id()), "turns")


def _code() -> Column:
    """Code of a turn by role and text alone."""
    ended = F.rtrim(F.col("text"), F.lit(SPACE))
    kind = F.coalesce(*(F.when(F.col("initial") == c, F.lit(i)) for i, c in enumerate("sua")), F.lit(3))
    return F.when(ended == "", GONE).otherwise(kind + F.when(F.right(ended, F.lit(1)).isin(*".!?"), 0).otherwise(4))


_LEGAL = frozenset(("su", "ua", "au"))


def _chunks(turns: DataFrame, bits: int) -> DataFrame:
    """A row for every chunk, run backwards from the vector at the end of a conversation."""
    block = F.shiftright("g", bits).alias("block")
    narrow = turns.withColumn("initial", F.substring("role", 1, 1)).select(block, "g", "key", "turn", "initial", _code().alias("code"))
    firsts = turns.groupBy("key", "role", "hash").agg(F.min("g").alias("g")).select(block, "g")
    schema = T.StructType([T.StructField("key", turns.schema["key"].dataType)] + [
        T.StructField(name, T._parse_datatype_string(kind)) for name, kind in (
            ("g", "long"), ("edge", "boolean"), ("live", "boolean"), ("codes", "binary"), ("after", "array<int>"), ("start", "array<int>"), ("least", "long"),
            ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("first_initial", "string"),
            ("last_initial", "string"), ("first_turn", "long"), ("last_turn", "long"), ("turns", "long"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(rows: pa.Table, new: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], schema=kinds)
        rows, search = rows.sort_by("g"), Search()
        g, code = rows.column("g").to_numpy(), rows.column("code").to_numpy().astype(np.uint8)
        keys, turn, initial = (rows.column(c).to_pylist() for c in ("key", "turn", "initial"))
        seen = ~np.isin(g, new.column("g").to_numpy())
        blank, again = code == GONE, seen & (code != GONE)
        code[again] = GONE
        cut = (code & 4) > 0
        bounds = [0, *(i for i in range(1, len(g)) if keys[i] != keys[i - 1]), len(g)]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            codes, met = code[a:b].tobytes(), [t for t in turn[a:b] if t is not None]
            start, least = search.start(codes, FINAL)
            out.append({
                "key": keys[a], "g": int(g[a]), "edge": a == 0 or b == len(g), "live": bool((code[a:b] != GONE).any()),
                "codes": codes, "after": FINAL, "start": start,
                "least": least, "blank": int(blank[a:b].sum()), "duplicate": int(again[a:b].sum()), "truncated": int(cut[a:b].sum()),
                "illegal": sum(x + y not in _LEGAL for x, y in zip(initial[a : b - 1], initial[a + 1 : b])),
                "first_initial": initial[a], "last_initial": initial[b - 1], "first_turn": met[0] if met else None,
                "last_turn": met[-1] if met else None, "turns": len(set(met))})
        return pa.Table.from_pylist(out, schema=kinds)

    return materialise(narrow.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(run, schema), "chunks")


def _fixed_up(chunks: DataFrame) -> DataFrame:
    """The chunks, each started from the vector that the conversation's later chunks give."""
    later = Window.partitionBy("key").orderBy(F.desc("g"))
    # Chunks of deletions only hand on the vector of the next one that is more.
    ahead = F.last(F.when(F.col("live"), F.col("g")), ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, -1))
    ends = chunks.where("edge").select("key", "g", "live").withColumn("next", ahead)
    # Only these can start from another vector; most tables of short conversations have few.
    linked = materialise(ends.where("next is not null").select("g", "next"), "linked")
    if linked.isEmpty():
        return chunks
    schema = "g long, next long, codes binary, after array<int>, start array<int>, least long, moved boolean"
    kinds = arrow_schema(schema)

    def rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                moved = row["told"] is not None and row["told"] != row["after"]
                if moved:
                    row["after"] = row["told"]
                    row["start"], row["least"] = search.start(row["codes"], tuple(row["told"]))
                out.append({name: row.get(name) for name in kinds.names} | {"moved": moved})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    plain = ["g", "codes", "after", "start", "least"]
    asked = linked.select(F.col("next").alias("g")).distinct().join(linked, "g", "left_anti")
    state = chunks.select(*plain).join(linked.unionByName(asked, allowMissingColumns=True), "g")
    while True:
        told = state.select(F.col("g").alias("next"), F.col("start").alias("told"))
        state = materialise(state.drop("moved").join(told, "next", "left").mapInArrow(rerun, schema), "vectors")
        if state.where("moved").isEmpty():
            break
    new = state.select("g", *(F.col(c).alias(f"new_{c}") for c in ("after", "start", "least")))
    given = {c: F.coalesce(f"new_{c}", c) for c in ("after", "start", "least")}
    return chunks.join(new, "g", "left").withColumns(given).select(*chunks.columns)


class _Conversation:
    """What is known of a conversation while its chunks and turns go by in order."""

    def __init__(self, search: Search) -> None:
        self.search, self.state, self.cost = search, NOTHING, 0
        self.audit: list[str] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.initial = None
        self.letters: Iterator[str] = iter(())
        self.begun = False

    def chunk(self, row: dict[str, Any]) -> None:
        for name in self.counts:
            self.counts[name] += row[name]
        if self.begun:
            self.counts["illegal"] += self.initial + row["first_initial"] not in _LEGAL
        else:
            self.cost += row["start"][NOTHING]
        if row["first_turn"] is not None:
            self.counts["turns"] -= row["first_turn"] == self.last_turn
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        self.begun, self.initial, self.cost = True, row["last_initial"], self.cost + row["least"]
        self.before = self.state
        letters, self.state = self.search.trace(row["codes"], tuple(row["after"]), self.state)
        self.letters = iter(letters)
        self.audit += letters

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired turns that a turn stands for."""
        for letter in next(self.letters):
            if letter == "D":
                continue
            to = following(self.before)
            if letter == "K":
                to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
                yield role, text
            else:
                yield NAMES[to], "" if letter == "I" else text
            self.before = to

    def end(self) -> Iterator[tuple[str, str]]:
        while self.state in (SYSTEM, USER):
            self.state = following(self.state)
            self.audit.append("I")
            yield NAMES[self.state], ""

    def gaps(self) -> int:
        if self.first_turn is None:
            return 0
        return min(self.last_turn - self.first_turn + 1 - self.counts["turns"], (1 << 63) - 1)


_CHUNK = ("codes", "after", "start", "least", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial",
          "first_turn", "last_turn", "turns")


def _line(turns: DataFrame, conversations: DataFrame | None, key: str, turn: str, role: str, text: str, bits: int) -> DataFrame:
    """All that step 4 needs, by conversation in order: its key, then its chunks, each before its turns."""
    ordered = _ordered(turns, key, turn, role, text)
    chunks = _fixed_up(_chunks(ordered, bits))
    named = ordered.select("key")
    if conversations is not None:
        named = named.union(conversations.select(F.col(key).alias("key")))
    line = named.distinct().select("key", F.lit(-1).cast("long").alias("g"), F.lit(0).alias("kind")).unionByName(
        chunks.select("key", "g", F.lit(1).alias("kind"), F.struct(*_CHUNK).alias("chunk")), allowMissingColumns=True
    ).unionByName(ordered.select("key", "g", F.lit(2).alias("kind"), "role", "text"), allowMissingColumns=True)
    return line.repartition("key").sortWithinPartitions("key", "g", "kind").select("key", "kind", "chunk", "role", "text")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Key, conversation, and a repaired turn (role, text), or None at the conversation's end."""
    search, now, key = Search(), None, None
    for whole in batches:
        for low in range(0, whole.num_rows, ROWS):
            batch = whole.slice(low, ROWS)
            for own, kind, chunk, role, text in zip(*(batch.column(c) for c in ("key", "kind", "chunk", "role", "text"))):
                if (kind := kind.as_py()) == 0:
                    if now is not None:
                        yield from ((key, now, x) for x in now.end())
                        yield key, now, None
                    now, key = _Conversation(search), own.as_py()
                if kind == 1:
                    now.chunk(chunk.as_py())
                elif kind == 2:
                    yield from ((key, now, x) for x in now.turn(role.as_py(), text.as_py()))
    if now is not None:
        yield from ((key, now, x) for x in now.end())
        yield key, now, None


def _schemas(key_type: T.DataType, key: str, rest: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(key, key_type), *T._parse_datatype_string(rest).fields])
    return schema, to_arrow_schema(schema)


def _table(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)


def repaired(
    turns: DataFrame, conversations: DataFrame | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """The turns of the repaired conversations: ``key``, ``place`` (0, 1, ...), ``role``, ``text``."""
    schema, kinds = _schemas(turns.schema[key].dataType, key, "place long, role string, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, place = [], 0, 0
        for name, _, made in _walked(batches):
            if made is None:
                place = 0
                continue
            held.append((name, place, *made))
            place, size = place + 1, size + len(made[1])
            if len(held) >= ROWS or size >= 4 << 20:
                yield _table(held, kinds)
                held, size = [], 0
        if held:
            yield _table(held, kinds)

    return _line(turns, conversations, key, turn, role, text, bits).mapInArrow(run, schema)


def report(
    turns: DataFrame, conversations: DataFrame | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Of every conversation: ``key``, gaps, blank, duplicate, truncated, illegal, cost, audit, and the hash of its repaired turns.

    The keys in ``conversations`` come out as well, whether or not they have turns.
    """
    rest = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema, kinds = _schemas(turns.schema[key].dataType, key, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, lines = [], hashlib.sha256(), 0
        for name, known, made in _walked(batches):
            if made is not None:
                digest.update(f"{chr(10) if lines else ''}{made[0]}:{made[1]}".encode("utf-8", "surrogatepass"))
                lines += 1
                continue
            counts = [known.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")]
            held.append((name, known.gaps(), *counts, known.cost, "".join(known.audit), digest.hexdigest()))
            digest, lines = hashlib.sha256(), 0
            if len(held) >= ROWS:
                yield _table(held, kinds)
                held = []
        if held:
            yield _table(held, kinds)

    return _line(turns, conversations, key, turn, role, text, bits).mapInArrow(run, schema)
