"""URL filters: all glob rules at once, by a bit-parallel automaton.

Every rule is a glob over the canonical URL ``host?path``: ``*`` stands for any characters, every
other character for itself.  The question mark, which neither part can hold, keeps a host's ``*``
from reaching into the path.  The rules' characters are laid one after the other into the bits of
several 64-bit words.  A set bit says that its rule has matched up to there; per character of the
URL, all rules advance by one shift and one mask (Shift-And), for all URLs of a batch together.

A null URL or one without ``://`` has an empty host and path.  Empty tables give empty results,
repeated rows equal results, and long URLs are matched whole: some thousand characters of a batch's URLs are laid out
at a time, URLs that have ended drop out, and what is left of a few very long ones is matched one by one, the masks
being whole numbers of any size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptroute.llm.frames import field, map_columns, texts

ALLOW, BLOCK = "allow", "block"
#: Characters of URLs that are laid out together, and the number of URLs from which that is worth it.
CHARS, FEW = 2048, 8


@dataclass(frozen=True)
class SiteRule:
    """A verdict for a host with all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        rest = f"{self.host}?{self.path}*"
        return rest, f"*.{rest}"


class GlobAutomaton:
    """Which of ``globs`` match a whole text: multiword Shift-And with self-loops for ``*``.

    A glob has one bit per state: state k is reached when its first k literals have matched.
    State 0 is set at the start; a state before which a ``*`` stands keeps itself set.
    """

    def __init__(self, globs: list[str]) -> None:
        start, ends, loops = [], [], []
        edges: dict[int, list[int]] = {}
        bit = 0
        for glob in globs:
            start.append(bit)
            for char in glob.encode():
                if char == ord("*"):
                    loops.append(bit)
                else:
                    bit += 1
                    edges.setdefault(char, []).append(bit)
            ends.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.loops = self._mask(start), self._mask(loops)
        self.advance = np.zeros((256, self.words), np.uint64)
        for char, bits in edges.items():
            self.advance[char] = self._mask(bits)
        self.ends = np.array(ends, np.int64)

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return mask

    def _finish(self, state: np.ndarray, text: memoryview) -> np.ndarray:
        """The state after the rest of one text."""
        advance = [int.from_bytes(row.astype("<u8").tobytes(), "little") for row in self.advance]
        loops = int.from_bytes(self.loops.astype("<u8").tobytes(), "little")
        now = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for char in text:
            now = (now << 1) & advance[char] | now & loops
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), "<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per glob."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        one, top = np.uint64(1), np.uint64(63)
        state = np.tile(self.start, (len(texts), 1))  # in order: those that go on are the first ones
        ending = -lengths[order]
        low, going = 0, int(np.searchsorted(ending, 0))
        while going >= FEW:
            parts = [np.frombuffer(texts[i], np.uint8)[low : low + CHARS] for i in order[:going]]
            grid = np.zeros((len(parts[0]), going), np.uint8)
            for i, part in enumerate(parts):
                grid[: len(part), i] = part
            for k in range(len(grid)):
                n = int(np.searchsorted(ending, -(low + k)))
                shifted = state[:n] << one
                shifted[:, 1:] |= state[:n, :-1] >> top
                state[:n] = (shifted & self.advance[grid[k, :n]]) | (state[:n] & self.loops)
            low += CHARS
            going = int(np.searchsorted(ending, -low))
        for i in range(going):
            state[i] = self._finish(state[i], memoryview(texts[order[i]])[low:])
        found = np.zeros((len(texts), len(self.ends)), bool)
        found[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one == one
        return found


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z in lower case."""
    return F.translate(
        F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def filter_urls(
    df: DataFrame, sites: list[SiteRule], blocked_globs: list[str], url: str = "url"
) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` and ``verdict``.

    The longest site rule that fits decides, its host and path taken together (of equally long ones the first);
    without one, a URL that any of ``blocked_globs`` matches is blocked and the rest allowed.
    """
    globs = [g for s in sites for g in s.globs()] + list(blocked_globs)
    ranks = np.argsort([-len(s.name) for s in sites], kind="stable")

    def make():
        automaton = GlobAutomaton(globs)

        def judge(batch):
            urls = [
                f"{h}?{p}".encode() for h, p in zip(texts(batch, "host"), texts(batch, "path"))
            ]
            found = automaton.match(urls)
            fits = found[:, : 2 * len(sites)].reshape(len(urls), len(sites), 2).any(axis=2)
            blocked = found[:, 2 * len(sites) :].any(axis=1)
            rules, verdicts = [], []
            for fit, block in zip(fits, blocked):
                best = next((sites[i] for i in ranks if fit[i]), None)
                rules.append(best and best.name)
                verdicts.append(best.verdict if best else BLOCK if block else ALLOW)
            return [rules, verdicts]

        return judge

    parts = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    return map_columns(parts, [field("rule", "string"), field("verdict", "string")], make)
