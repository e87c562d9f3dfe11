import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from promptroute.llm import repeats, suffixes
from promptroute.llm.queries import op2_repeats
from tests.llm.helpers import by_id, documents, frame


def _brute(texts):
    raws = [(t or "").encode() for t in texts]
    size = repeats.LENGTH
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for raw in raws:
        hit = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                hit[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((len(raw), int(hit.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _texts(seed=1):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdeé \n漢") for _ in range(n))
    shared = [say(n) for n in (330, 400, 420, 700, 1500)]
    texts = [say(rng.randint(0, 900)) for _ in range(15)]
    for s in shared:
        texts += [say(rng.randint(0, 300)) + s + say(rng.randint(0, 300)) for _ in range(6)]
        texts += [say(50) + s[: rng.randint(300, len(s))] + say(50) for _ in range(4)]
    texts += [texts[3], texts[3], "a" * 3000, "ab" * 600, "a" * 399, "a" * 400, None, "", "x" + shared[4][3:900] * 2]
    return texts


def test_suffix_ranks_and_common_prefixes_equal_brute_force():
    rng = random.Random(1)
    for t in range(12):
        raw = bytes(rng.choice(b"ab") for _ in range(300)) if t % 3 else b"abc\0\0ab\0" * 30
        line = np.frombuffer(raw, np.uint8)
        words = suffixes.packed(line)
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert np.argsort(suffixes.suffix_ranks(words)).tolist() == order
        before = np.full(len(raw), -1)
        before[order[1:]] = order[:-1]
        halves = np.array([0, 100]), np.array([100, len(raw) - 100])
        got = suffixes.common_prefixes(words, before, *halves, 50)
        for i, p in enumerate(before):
            n = 0
            while p >= 0 and n < 50 and max(i, p) + n < len(raw) and raw[i + n] == raw[p + n]:
                n += 1
            assert got[i] == n


@pytest.mark.parametrize("shard, merged", [(3000, 200_000), (3, 40)])
def test_removed_bytes_equal_brute_force(spark, tmp_path, monkeypatch, shard, merged):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "MERGED", merged)
    texts = _texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = by_id(op2_repeats(spark, str(tmp_path)))
    for i, want in enumerate(_brute(texts)):
        r = out[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, i


def test_null_ids_repeated_rows_and_no_rows(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(500))
    rows = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (5, text[:399], "y"), (None, None, None)]
    df = frame(spark, rows, "doc_id long, text string, spans string")
    out = repeats.cut(df, repeats.repeated_spans(df)).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 500, 500, 500]
    assert out[0].asDict().keys() == {"doc_id", "text", "spans", "kept", "n_bytes", "n_removed", "n_spans"}
    none = df.limit(0)
    assert repeats.cut(none, repeats.repeated_spans(none)).count() == 0


def test_joins_by_anchor_read_written_tables(spark, monkeypatch):
    """Only joins of plain shuffles are split at run time; an aggregate in their stage leaves a hot anchor to one task."""
    plans, real = {}, repeats.materialise

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(repeats, "materialise", spied)
    repeats.repeated_spans(documents(spark, _texts())).count()
    for name in ("occurrences", "open"):
        assert "Join" in plans[name] and "Aggregate" not in plans[name], name


def test_spans_without_parts_of_characters():
    raw = "aéé漢b".encode()
    for start in range(len(raw)):
        for stop in range(start + 1, len(raw) + 1):
            for a, b in repeats.whole_characters(raw, [(start, stop)]):
                assert start <= a < b <= stop
                (raw[:a] + raw[b:]).decode()


def _repeated(raws, size):
    seen = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    for raw in raws:
        hit = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            if seen[raw[i : i + size]] > 1:
                hit[i : i + size] = True
        yield hit


@pytest.mark.parametrize("shard, merged", [(3000, 200_000), (3, 40)])
def test_spans_of_two_lengths_equal_brute_force(spark, monkeypatch, shard, merged):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "MERGED", merged)
    texts = _texts(2)
    raws = [(t or "").encode() for t in texts]
    docs = documents(spark, texts).select("doc_id", "text")
    keys = {r.row: r.doc_id for r in docs.select("doc_id", repeats.row_key("doc_id", "text").alias("row")).collect()}
    found = {keys[r.row]: r for r in repeats.repeated_spans(docs, length=250, anchor=64, longer=400).collect()}
    for name, size in (("spans", 250), ("longer", 400)):
        for i, want in enumerate(_repeated(raws, size)):
            got = np.zeros(len(want), bool)
            for a, b in found[i][name] if i in found else ():
                assert not got[max(a - 1, 0) : b + 1].any()
                got[a:b] = True
            assert (got == want).all(), (name, i)


def test_passages_of_over_fifty_words_that_the_contract_leaves(spark, tmp_path):
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6))) for _ in range(n))
    passages = [say(n) for n in (51, 55, 60, 64)]
    assert all(250 < len(p) < 400 for p in passages)
    texts = [say(80) for _ in range(6)] + [f"{say(40)} {p} {say(40)}" for p in passages for _ in range(2)] + [None]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = by_id(op2_repeats(spark, str(tmp_path)))
    for i, text in enumerate(texts):
        r, raw = out[i], text or ""
        assert (r.n_bytes, r.n_removed, r.n_spans, r.text) == (len(raw), 0, 0, raw)
        if i < 6 or text is None:
            assert (r.n_passage_bytes, r.n_passages, r.passages_cut) == (0, 0, raw)
        else:
            passage = passages[(i - 6) // 2]
            assert len(passage) <= r.n_passage_bytes <= len(passage) + 6 and r.n_passages == 1
            assert len(r.passages_cut) == len(raw) - r.n_passage_bytes and passage[3:-3] not in r.passages_cut
