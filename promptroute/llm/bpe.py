"""Byte-level BPE encoding and decoding with a given vocabulary.

Texts are cut into words by the vocabulary's pattern.  A short word is merged on contiguous
arrays: the parts between its boundaries, as ids, and the ranks of adjacent parts.  The lowest rank is
searched, the boundary there deleted, and the two neighbouring ranks refreshed, until no pair can merge.  Words
beyond ``SHORT`` bytes, for which repeated search is quadratic, are merged with a heap over the
same pairs and ranks, with the same result.

Null and empty texts have no ids; special tokens written in a text become their id.  Ids are held
as packed little-endian unsigned 32-bit integers.  Repeated rows are encoded alike, and other
columns are kept; a column named like a result is replaced.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import field, map_columns, texts

#: Longest word in bytes that is merged by repeated search.
SHORT = 96
#: Words whose ids a task remembers.
REMEMBERED = 400_000
#: How the vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: letter to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, ranks and special tokens of a byte-level BPE vocabulary file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        ids = spec["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: raw(t) for t, i in ids.items()}
        self.byte_ids = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: Rank of a pair of ids, which are packed into one number, and the id made at each rank.
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(ids[a] << 32 | ids[b], rank)
            self.made.append(ids[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens |= {i: t.encode() for t, i in self.special.items()}

    def merge_short(self, word: bytes) -> list[int]:
        rank_of, none = self.pairs.get, len(self.made)
        parts = [self.byte_ids[b] for b in word]
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            parts[at] = made = self.made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(made << 32 | parts[at + 1], none)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | made, none)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        pairs, n = self.pairs, len(word)
        parts: list[int | None] = [self.byte_ids[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := pairs.get(parts[i] << 32 | parts[j])) is not None:
                heap.append((rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # one of the two has merged with another since
            parts[i], parts[j] = self.made[rank], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    size = len(heap)
                    offer(k)
                    if len(heap) > size:
                        heapq.heappush(heap, heap.pop())
        return [p for p in parts if p is not None]

    def encode_word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw)
        return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Packed ids of the words seen so far, forgotten when there are too many."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        ids = self.vocabulary.encode_word(word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def encoder(vocabulary: Vocabulary) -> Callable[[str], bytes]:
    find = regex.compile(PATTERN).findall
    words = Words(vocabulary)
    special = {t: struct.pack("<I", i) for t, i in vocabulary.special.items()}
    longest_first = sorted(special, key=len, reverse=True)
    cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if special else None

    def encode(text: str) -> bytes:
        if cut is None or not any(t in text for t in longest_first):
            return b"".join(map(words.__getitem__, find(text)))
        pieces = []
        for i, piece in enumerate(cut.split(text)):
            pieces += [special[piece]] if i % 2 else map(words.__getitem__, find(piece))
        return b"".join(pieces)

    return encode


def decoder(vocabulary: Vocabulary) -> Callable[[bytes], str]:
    tokens = vocabulary.tokens

    def decode(ids: bytes) -> str:
        packed = struct.unpack(f"<{len(ids) // 4}I", ids)
        return b"".join(map(tokens.__getitem__, packed)).decode("utf-8", "replace")

    return decode


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``df`` with the packed ids of ``text`` in the binary column ``to``.

    The vocabulary file is read once, on the driver, and sent to the tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        run = encoder(Vocabulary(source.value))
        return lambda batch: [[run(x) for x in texts(batch, text)]]

    return map_columns(df, [field(to, "binary")], make)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of packed ids in the column ``to``; bytes that are no UTF-8 become U+FFFD.

    Null ids give the empty text.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        run = decoder(Vocabulary(source.value))
        return lambda batch: [[run(x or b"") for x in batch.column(ids).to_pylist()]]

    return map_columns(df, [field(to, "string")], make)


def token_count(ids: str = "ids"):
    return F.floor(F.octet_length(F.col(ids)) / 4).cast("long")
