"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a line of words and tags.  Words score by the element that holds them, tags cost something, and one
linear scan finds the contiguous region of the highest sum: the content.  The scores come from
labelled pages, which are those that mark their article themselves: how often words of a holder,
and tags of a kind, stand inside against outside of the mark.  Elements that are never content
(menus, adverts, forms, scripts, reader comments and so on) score nothing, and are left out of the region's text.

A null or empty page, or one without content, has the empty text.  Repeated rows give equal texts;
other columns are kept, and replaced if they are named like the result.  Pages are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import arrow_schema, field, map_columns, texts

#: Labelled pages, the first in hash order, from which the scores are learned.
LABELLED_PAGES = 2_000
#: Score of a word and of a tag of a kind that no labelled page has.
WORD, TAG = 1.0, -0.5
#: What every tag costs at least, and the largest score either way.
LEAST_COST, LARGEST = 0.1, 4.0
ARTICLE = "article"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_RAW = frozenset("script style textarea title noscript template iframe xmp".split())
_NEVER = frozenset(
    "nav menu footer aside form button select dialog head header svg object audio video canvas map".split()
) | _RAW
_NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer footer header login menu modal nav navbar navigation newsletter notice "
    "notices pagination popup promo promoted recommended related replies respond share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: First parts of names that say something of the page and not of the element: has-sidebar, no-comments.
_STATES = frozenset("has have no not with without hide hidden show shows is are can".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))

_PIECE = re.compile(
    # A quote that nothing closes is a character of its tag, which ends at the next bracket all the same.
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Piece(NamedTuple):
    """A run of text (``text``, held by ``kind``) or a tag of ``kind``."""

    kind: str
    text: str | None
    skipped: bool
    breaks: bool  # ends a block
    inside: bool  # within the page's own article mark


def _never(name: str, attributes: str, in_article: bool) -> bool:
    if name in _NEVER:
        return not (name == "header" and in_article)
    if not attributes or name in ("body", "html", "main", ARTICLE):
        return False
    return any(_named(n) for m in _NAMES.findall(attributes) for n in "".join(m).split())


def _named(name: str) -> bool:
    """Whether a class, id or role is of what is never content: by the last part of the name, that says what it is."""
    parts = [p.lower() for p in _PARTS.split(name) if p]
    return bool(parts) and parts[-1] in _NEVER_NAMED and (len(parts) == 1 or parts[0] not in _STATES)


def _whole_page(page: str, name: str, at: int) -> bool:
    """Whether the element ``name`` that begins at ``at`` holds a main heading and most of the page."""
    heading = page.find("<h1", at)
    if heading < 0 or 2 * at > len(page):
        return False
    depth = 1
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])", re.IGNORECASE).finditer(page, at):
        depth += -1 if tag[1] else 1
        if not depth:
            return heading < tag.start() and 2 * (tag.start() - at) > len(page)
    return False


def pieces(page: str) -> Iterator[Piece]:
    """The page's tags and runs of text, in order."""
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is left out
    closes = Counter(re.findall(r"</([a-z][^\s/>]*)", page.lower()))  # close tags still to come
    skipped = inside = 0
    at, end = 0, len(page)

    def holder() -> str:
        return next((n for n, _ in reversed(stack) if n not in _INLINE), "")

    while at < end:
        tag = _PIECE.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            yield Piece(holder(), page[at:stop], skipped > 0, False, inside > 0)
        if not tag:
            return
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        breaks = name not in _INLINE and name != "br"
        if tag[1]:
            closes[name] -= 1
            within = skipped > 0
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                for gone, out in stack[depth:]:
                    skipped -= out
                    inside -= gone == ARTICLE
                del stack[depth:]
            yield Piece("/" + name, None, within, breaks, inside > 0)
            continue
        if name == "br":
            yield Piece(name, "\n", skipped > 0, False, inside > 0)
            continue
        if breaks and stack and stack[-1][0] in _INLINE | _CLOSED_BY_BLOCK:
            # An open paragraph and what is open in it end where a block begins.
            depth = len(stack)
            while depth and stack[depth - 1][0] in _INLINE:
                depth -= 1
            if depth and stack[depth - 1][0] == name and name in _CLOSED_BY_BLOCK or (
                depth and stack[depth - 1][0] == "p"
            ):
                for _, out in stack[depth - 1 :]:
                    skipped -= out
                del stack[depth - 1 :]
        if name in _VOID or tag[3].endswith("/"):
            yield Piece(name, None, skipped > 0, breaks, inside > 0)
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>?", re.IGNORECASE).search(page, at)
            closes[name] -= 1
            yield Piece(name, None, True, breaks, inside > 0)
            at = close.end() if close else end
            continue
        # An element that is never closed is not taken to hold the rest of the page.
        out = closes[name] > 0 and _never(name, tag[3], inside > 0)
        out = out and (name in _NEVER or skipped > 0 or not _whole_page(page, name, at))
        stack.append((name, out))
        skipped += out
        inside += name == ARTICLE
        yield Piece(name, None, skipped > 0, breaks, inside > 0)


def count_kinds(page: str) -> Counter:
    """Words by holder and tags by kind, inside and outside of the page's article mark."""
    counts: Counter = Counter()
    for p in pieces(page):
        if not p.skipped:
            counts[("w:" if p.text is not None else "t:") + p.kind, p.inside] += (
                len(p.text.split()) if p.text is not None else 1
            )
    return counts


def fit_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Scores of words by holder (``w:``) and of tags by kind (``t:``), from labelled pages.

    Labelled are the pages that mark an article; the first ``LABELLED_PAGES`` in hash order count, with
    all their copies.
    """
    marked = pages.where(F.col(column).rlike("(?i)<article[ >]")).select(
        F.col(column).alias("page"), F.xxhash64(column).alias("h")
    )
    # Only hashes are sorted; the pages stay where they are.
    last = marked.select("h").distinct().orderBy("h").limit(LABELLED_PAGES).agg(F.max("h")).first()[0]
    labelled = marked.where(F.col("h") <= last).select("page") if last is not None else marked.select("page").limit(0)
    kinds = arrow_schema("kind string, inside boolean, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in texts(batch, "page"):
                counts.update(count_kinds(page))
        rows = [{"kind": k, "inside": i, "n": n} for (k, i), n in counts.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    found = labelled.mapInArrow(run, "kind string, inside boolean, n long")
    summed = found.groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum("n").alias("n")
    )
    weights = {}
    for row in summed.collect():
        odds = math.log((row["inside"] + 0.5) / (row["n"] - row["inside"] + 0.5))
        odds = max(-LARGEST, min(LARGEST, odds))
        weights[row["kind"]] = min(-LEAST_COST, odds) if row["kind"].startswith("t:") else odds
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part of the highest positive sum, the first and shortest of equal ones."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    line = list(pieces(page))
    scores = []
    for p in line:
        if p.skipped:
            scores.append(0.0)
        elif p.text is None:
            scores.append(weights.get("t:" + p.kind, TAG))
        else:
            scores.append(len(p.text.split()) * weights.get("w:" + p.kind, WORD))
    start, stop = best_region(scores)
    blocks, parts = [], []
    for p in line[start:stop]:
        if p.text is not None and not p.skipped:
            parts.append(p.text)
        elif p.breaks and parts:
            blocks.append("".join(parts))
            parts = []
    blocks.append("".join(parts))
    plain = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in plain if b)


def extract(pages: DataFrame, weights: dict[str, float], column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in the column ``to``."""

    def make():
        return lambda batch: [[main_text(x, weights) for x in texts(batch, column)]]

    return map_columns(pages, [field(to, "string")], make)
