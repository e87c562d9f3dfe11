"""Prompts as sub-words: the longest pieces of a given vocabulary, from the left of every word, until there are enough.

The vocabulary is a file of a public tokenizer: a JSON with ``model.vocab``, whose pieces are written in letters that stand
for bytes, with a mark on those that end a word.  It holds every letter, with and without the mark, so any word can be
written.  The driver reads it and sends it to the tasks; its size is that of the file and not of the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

END = "</w>"
_WORD = re.compile(r"[^\W_]+")
#: Words whose pieces a task remembers.
REMEMBERED = 100_000


def letters() -> list[str]:
    """The letter of every byte: itself where Latin-1 prints it, else one from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def read_vocabulary(path: str) -> frozenset[str]:
    with open(path, encoding="utf-8") as file:
        return frozenset(json.load(file)["model"]["vocab"])


class Cutter:
    """Cuts texts into pieces of a vocabulary."""

    def __init__(self, vocabulary: frozenset[str]) -> None:
        self.letters = letters()
        # A step of a trie is a letter; None marks a node at which a piece ends.
        self.inner = self._trie(p for p in vocabulary if not p.endswith(END))
        self.final = self._trie(p.removesuffix(END) for p in vocabulary if p.endswith(END))
        self.known: dict[str, list[str]] = {}

    @staticmethod
    def _trie(pieces: Iterator[str]) -> dict:
        root: dict = {}
        for piece in pieces:
            node = root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[None] = True
        return root

    @staticmethod
    def _longest(trie: dict, line: str, at: int) -> int:
        """Where the longest piece from ``at`` on ends."""
        found, node = at, trie
        for i in range(at, len(line)):
            node = node.get(line[i])
            if node is None:
                break
            if None in node:
                found = i + 1
        return found

    def _whole(self, line: str, at: int) -> bool:
        """Whether what is left of a word is a piece that ends one."""
        node = self.final
        for letter in line[at:]:
            node = node.get(letter)
            if node is None:
                return False
        return None in node

    def word(self, word: str) -> list[str]:
        found = self.known.get(word)
        if found is None:
            line, at, found = "".join([self.letters[b] for b in word.encode("utf-8", "surrogatepass")]), 0, []
            while at < len(line):
                if self._whole(line, at):
                    found.append(line[at:] + END)
                    break
                # The last letter belongs to a piece that ends the word.
                stop = self._longest(self.inner, line[:-1], at)
                found.append(line[at:stop])
                at = stop
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def text(self, text: str, most: int) -> list[str]:
        """The first pieces of a text; words behind them are not looked at."""
        found: list[str] = []
        for match in _WORD.finditer(text):
            found += self.word(match.group().lower())
            if len(found) >= most:
                break
        return found[:most]


def with_pieces(df: DataFrame, vocabulary: frozenset[str], most: int, prompt: str = "prompt", to: str = "pieces") -> DataFrame:
    """``df`` with the first ``most`` sub-words of every prompt in ``to``; of a null prompt none."""
    kept = [f for f in df.schema.fields if f.name.lower() != to.lower()]
    schema = T.StructType([*kept, T.StructField(to, T.ArrayType(T.StringType()))])
    names = [f.name for f in kept]
    sent = df.sparkSession.sparkContext.broadcast(sorted(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(frozenset(sent.value))
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                found = [cutter.text(x.as_py() or "", most) for x in batch.column(prompt)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], names=[*names, to])

    return df.select(*names, *([prompt] if prompt not in names else [])).mapInArrow(run, schema)
