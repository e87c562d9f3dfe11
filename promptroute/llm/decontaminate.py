"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items, as sequences of words, make one automaton of all their substrings.  A
document's words are streamed through it, holding the longest match that ends at each word.  Where
that match covers a whole window (``WINDOW`` consecutive item words, or a whole shorter item), the window's words are hit.

Words: A-Z in lower case, then runs of characters other than ASCII control, blank and punctuation.
Null and empty texts have no words; an item without words matches nothing; repeated rows are
treated alike; items of the same text are all reported.  Other columns are kept, and replaced if
they are named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import field, map_columns, share, texts
from promptroute.session import materialise

WINDOW = 10
#: Words of the items that one automaton holds; more items are gone through in several passes.
AUTOMATON_WORDS = 200_000

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UNKNOWN = "\n"
_FIRST_LETTER = 0x100

SPANS = "array<struct<start:int, stop:int>>"


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of items; every known word is written as one letter."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.letters: dict[bytes, str] = {}
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str, int]] = []
        for item, words in items:
            state = 0
            for word in words:
                letter = self.letters.setdefault(word, chr(_FIRST_LETTER + len(self.letters)))
                state = self._extend(state, letter)
                ends.append((state, item, len(words)))
        self._windows(ends, items)

    def _extend(self, last: int, letter: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if letter in nxt[last]:
            q = nxt[last][letter]
            return q if length[q] == length[last] + 1 else self._clone(last, q, letter)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and letter not in nxt[p]:
            nxt[p][letter] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][letter]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, letter)
        return new

    def _clone(self, p: int, q: int, letter: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(letter) == q:
            nxt[p][letter] = copy
            p = link[p]
        return copy

    def _windows(self, ends: list, items: list) -> None:
        """Which states stand for a window, of which items, and per state the window states above."""
        size = len(self.next)
        found: dict[int, set[str]] = {}
        link, length, window = self.link, self.length, self.window
        for state, item, n in ends:
            if n < window:
                continue
            while length[state] >= window:
                if length[link[state]] < window:
                    found.setdefault(state, set()).add(item)
                state = link[state]
        shorter: dict[int, tuple[int, set[str]]] = {}
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][self.letters[word]]
                shorter.setdefault(state, (len(words), set()))[1].add(item)
        self.shortest = min([window, *(n for n, _ in shorter.values())])
        #: Per state: (words that must have matched, items) of the windows it ends.
        self.ended: list[tuple] = [()] * size
        for state in sorted(range(1, size), key=length.__getitem__):
            own = [(window, found[state])] if state in found else []
            if state in shorter:
                own.append(shorter[state])
            self.ended[state] = self.ended[link[state]] + tuple(own)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words, and the items with a window in ``words``."""
        line = "".join([self.letters.get(w, _UNKNOWN) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        at = 0
        for run in line.split(_UNKNOWN):
            if len(run) >= self.shortest:
                self._scan(run, at, spans, items)
            at += len(run) + 1
        return spans, items

    def _scan(self, run: str, at: int, spans: list, items: set[str]) -> None:
        nxt, link, length, ended = self.next, self.link, self.length, self.ended
        state = matched = 0
        for i, letter in enumerate(run, at + 1):
            while state and letter not in nxt[state]:
                state = link[state]
                matched = length[state]
            if letter in nxt[state]:
                state = nxt[state][letter]
                matched += 1
            for needed, of in ended[state]:
                if matched >= needed:
                    items |= of
                    start = i - needed
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))


def automata(items: DataFrame, item: str, text: str, window: int) -> Iterator[Automaton]:
    """Automata over the items, each of about ``AUTOMATON_WORDS`` words at most."""
    rows = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")
    )
    held: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in rows.toLocalIterator():
        words = split_words(row["text"] or "")
        if held and size + len(words) > AUTOMATON_WORDS:
            yield Automaton(held, window)
            held, size = [], 0
        if words:
            held.append((row["item"], words))
            size += len(words)
    if held:
        yield Automaton(held, window)


def find_contamination(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    prefix: str = "",
) -> DataFrame:
    """``df`` with ``n_words``, ``hit_words`` (runs of hit words), ``items`` and ``hit_chars``.

    The new names follow ``prefix``.  ``items`` holds the ids of the items found, as sorted strings; ``hit_chars`` the runs as
    spans of code points in the text.  One automaton goes to the tasks at a time.
    """
    kinds = {"n_words": "long", "hit_words": SPANS, "items": "array<string>", "hit_chars": SPANS}
    fields = [field(prefix + name, kind) for name, kind in kinds.items()]
    out, first = None, True
    for automaton in automata(items, item, item_text, window):
        out = _pass(df if first else materialise(out, "contamination"), automaton, text, fields, first)
        first = False
    return out if out is not None else _pass(df, Automaton([], window), text, fields, True)


def _pass(df: DataFrame, automaton: Automaton, text: str, fields: list, first: bool) -> DataFrame:
    shared = share(df.sparkSession, automaton)

    def make() -> Callable:
        scan = shared().hits

        def judge(batch):
            columns: list[list] = [[], [], [], []]
            before = [None] * batch.num_rows
            if not first:
                before = [
                    ([(s["start"], s["stop"]) for s in spans], set(names))
                    for spans, names in zip(
                        batch.column(fields[1].name).to_pylist(),
                        batch.column(fields[2].name).to_pylist(),
                    )
                ]
            for value, earlier in zip(texts(batch, text), before):
                words = split_words(value)
                spans, names = scan(words)
                if earlier:
                    spans, names = merge_spans(spans + earlier[0]), names | earlier[1]
                row = (len(words), _structs(spans), sorted(names), _structs(_in_chars(value, spans)))
                for column, x in zip(columns, row):
                    column.append(x)
            return columns

        return judge

    return map_columns(df, fields, make)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if merged and merged[-1][1] >= start:
            merged[-1] = (merged[-1][0], max(stop, merged[-1][1]))
        else:
            merged.append((start, stop))
    return merged


def _structs(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "stop": b} for a, b in spans]


def _in_chars(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def hit_count(spans: str = "hit_words") -> Column:
    return F.expr(f"aggregate({spans}, 0L, (a, x) -> a + x.stop - x.start)")


def remove_contamination(
    df: DataFrame, items: DataFrame, most_covered: float = 0.5, text: str = "text"
) -> DataFrame:
    """``df`` without its hit spans; rows of which more than ``most_covered`` of the words are hit go.

    All columns of ``df`` are kept as they are but the text of rows that had a hit.
    """
    made, prefix = ("n_words", "hit_words", "items", "hit_chars"), "_cut_"
    while any((prefix + name).lower() in map(str.lower, df.columns) for name in made):
        prefix += "_"
    found = find_contamination(df, items, text, prefix=prefix)
    few = hit_count(prefix + "hit_words") <= F.lit(most_covered) * F.col(prefix + "n_words")
    hits = prefix + "hit_chars"
    cut = F.expr(
        f"""array_join(transform(sequence(0, size({hits})), i -> substring(`{text}`,
            if(i = 0, 1, {hits}[greatest(i - 1, 0)].stop + 1),
            if(i = size({hits}), length(`{text}`), {hits}[least(i, size({hits}) - 1)].start)
             - if(i = 0, 0, {hits}[greatest(i - 1, 0)].stop))), '')"""
    )
    changed = F.when(F.size(hits) > 0, cut).otherwise(F.col(text))
    return found.where(few).withColumn(text, changed).select(*df.columns)
