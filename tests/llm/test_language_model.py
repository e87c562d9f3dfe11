import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptroute.llm import language_model as lm
from promptroute.llm.queries import op7_language_model
from tests.llm.helpers import by_id, documents, frame


def _words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def _texts(n=120, seed=2):
    """Two kinds of texts, whose words follow each other in a fixed order of classes."""
    rng = random.Random(seed)
    kinds = [["the", "a", "this"], ["cat", "dog", "Bird"], ["runs", "sleeps", "eats"]]
    other = [["le", "la"], ["chat", "été"], ["dort", "mange"]]
    texts = []
    for i in range(n):
        parts = kinds if i % 2 else other
        texts.append(" ".join(rng.choice(parts[k % 3]) for k in range(rng.randint(0, 60))))
    return [*texts, None, "", " \n", "x1 y# new. " * 40, texts[1], "zzz" * 5000]


def _brute_base(texts, held):
    counts = Counter(w for t, h in zip(texts, held) if not h for w in _words(t))
    n, v = sum(counts.values()), len(counts)
    rows = []
    for text in texts:
        words = _words(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        rows.append((len(words), sum(counts[w] > 0 for w in words), n, base))
    return rows


def test_query_counts_equal_brute_force_and_model_beats_them(spark, tmp_path):
    texts = _texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    out = by_id(op7_language_model(spark, str(tmp_path)))
    assert len(out) == len(texts)
    gain = 0.0
    for i, (n, known, train, base) in enumerate(_brute_base(texts, held)):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], n, known, train)
        assert math.isclose(r.base_score, base, abs_tol=1e-9)
        assert r.score < 0 and r.perplexity > 1
        gain += (r.score - r.base_score) * (held[i] and n < 100)
    assert gain > 0


def _fitted(spark, texts):
    rows = lm.blocks(documents(spark, texts), "doc_id", "text", F.lit(False))
    counts = lm._block_words(rows).groupBy("word").agg(F.sum("n").alias("n"))
    return lm.fit(rows, counts), counts


def test_probabilities_of_all_words_sum_to_one_at_most(spark):
    model, counts = _fitted(spark, _texts())
    assert np.allclose(np.exp(model.log_transition).sum(axis=1), 1)
    scorer = lm.Scorer(model)
    known = [(bytes(r.word), r.n) for r in counts.collect() if bytes(r.word) != lm.END]
    scorer.learn([w for w, _ in known] + [b"unseen"], [n for _, n in known] + [0])
    scorer._prepare()
    for c in range(len(model.class_tokens)):
        own = np.exp(scorer.emission[:-2][scorer.classes[:-2] == c]).sum()
        assert own <= 1 + 1e-9


@pytest.mark.parametrize("frequent", [30_000, 4096])
def test_every_word_of_ten_or_more_is_clustered_however_many_words_there_are(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    # 25,000 words of ten each: none makes up a 20,000th of all tokens.  Those of each half follow one another.
    monkeypatch.setattr(lm, "LINKS", 5_000)
    rng = np.random.default_rng(4)
    lists = []
    for _ in range(10):
        halves = [rng.permutation(12_500), rng.permutation(12_500) + 12_500]
        lists.append([f"{'xy'[k % 2]}{halves[k % 2][k // 2]}" for k in range(25_000)])
    model, counts = _fitted(spark, [*(" ".join(x) for x in lists), "rare " * 9])
    assert len(model.counts) == counts.where("n >= 10 and word != X'0A'").count() == 25_000
    matrix = np.exp(model.log_transition)
    assert model.class_words[:-lm.SHAPES - 1].sum() == 25_000 and len(matrix) == lm.CLASSES + lm.SHAPES + 1
    names = [f"x{i}".encode() for i in range(0, 12_500, 500)] + [f"y{i}".encode() for i in range(12_500, 25_000, 500)]
    found = model.classes_of(names)
    assert max(found) < lm.CLASSES
    # Where all exchange round by round the halves part; a sixth of words none of which is frequent says too little for that.
    assert frequent < 25_000 or not set(found[:25]) & set(found[25:])


def _plain(texts, classes, k):
    """Counts of class pairs, and of the classes next to every word, as they are in the texts."""
    matrix, after, before = np.zeros((k, k)), {}, {}
    for line in (["\n", *_words(t)] for t in texts):
        for x, y in zip(line, line[1:]):
            matrix[classes[x], classes[y]] += 1
            after.setdefault(x, Counter())[classes[y]] += 1
            before.setdefault(y, Counter())[classes[x]] += 1
    return matrix, after, before


def _plain_gains(word, classes, matrix, after, before, n_classes):
    """What the likelihood gains if a word goes to each class, its own first taken out: rows, columns and sums."""
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    gains = []
    for to in range(n_classes):
        gain = 0.0
        if to != classes[word]:
            for of, sign in ((to, 1), (classes[word], -1)):
                for counts, line in ((after[word], matrix[of]), (before[word], matrix[:, of])):
                    gain += sum(f(line[j] + sign * n) - f(line[j]) for j, n in counts.items())
                    gain -= f(line.sum() + sign * sum(counts.values())) - f(line.sum())
        gains.append(gain)
    return gains


def _clustered_texts(seed):
    rng = random.Random(seed)
    return [" ".join(f"{'ab'[k % 2]}{rng.randint(0, 11)}" for k in range(rng.randint(5, 90))) for _ in range(90)] + ["odd 1 #x " * 3]


def test_a_round_of_moves_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "LINKS", 40)
    texts, n = _clustered_texts(1), 5
    rows = lm.blocks(documents(spark, texts), "doc_id", "text", F.lit(False))
    of_blocks = lm._block_words(rows)
    words, size = lm.numbered(of_blocks.groupBy("word").agg(F.sum("n").alias("n")))
    encoded = lm.encode(rows, of_blocks, words)
    symbols = {bytes(r.word).decode(): r.symbol for r in words.collect() if r.symbol >= 0}
    assert size == len(symbols) == 24
    top = np.arange(size)
    fixed = np.arange(lm.SHAPES + 2) + n
    classes = np.concatenate([top % n, fixed]).astype(np.uint8)
    of = lambda w: symbols.get(w, size + (lm.SHAPES if w == "\n" else lm.shape(w.encode())))
    named = {w: int(classes[of(w)]) for t in texts for w in ["\n", *_words(t)]}
    k = n + lm.SHAPES + 2
    matrix, after, before = _plain(texts, named, k)
    links = lm._links(encoded, top, size)
    assert links.count() > 3 and np.array_equal(lm._class_pairs(links, classes), matrix)
    moved = lm._moved(links, classes, (top % 2).astype(np.uint8), n, matrix, 0)
    changed = 0
    for word, s in symbols.items():
        if s % 2:
            assert moved[s] == classes[s]
            continue
        gains = _plain_gains(word, named, matrix, after, before, n)
        assert gains[moved[s]] >= max(gains) - 1e-6 and (moved[s] == classes[s] or gains[moved[s]] > 0)
        changed += moved[s] != classes[s]
    assert changed
    # The others of a table of which some words are frequent: all at once, from no class and from one.
    for start in (np.where(top < 8, top % n, k - 1), top % n):
        classes = np.concatenate([start, fixed]).astype(np.uint8)
        named = {w: int(classes[of(w)]) for t in texts for w in ["\n", *_words(t)]}
        matrix, after, before = _plain(texts, named, k)
        found = lm._class_neighbours(encoded, classes, top[:8], size, k)
        pairs = {r.place: r.n for r in found.where("own = -1").groupBy("place").agg(F.sum("n").alias("n")).collect()}
        assert all(pairs.get(i, 0) == x for i, x in enumerate(matrix.ravel()))
        placed = lm._placed(found, classes, matrix, n, 0)
        for word, s in symbols.items():
            gains = _plain_gains(word, named, matrix, after, before, n)
            if s < 8:
                assert placed[s] == classes[s]
            elif classes[s] == k - 1:
                assert placed[s] < n and gains[placed[s]] >= max(gains) - 1e-6
            else:
                assert gains[placed[s]] >= max(gains) - 1e-6


def test_sparse_choice_equals_the_dense_one():
    rng = np.random.default_rng(3)
    k, n_classes, n = 12, 7, 400
    counts = rng.poisson(0.4, (n, 2, k))
    counts[:, 0, 0] += 1
    own = rng.integers(0, n_classes, n)
    matrix = rng.poisson(3, (k, k)).astype(float)
    np.add.at(matrix, own, counts[:, 0])
    np.add.at(matrix.T, own, counts[:, 1])
    word, place = np.nonzero(counts.reshape(n, 2 * k))
    starts = np.searchsorted(word, np.arange(n))
    sparse = lm.sparse_best_classes(own, starts, place, counts.reshape(n, 2 * k)[word, place].astype(float), matrix, n_classes)
    dense = lm.best_classes(own, counts[:, 0].astype(float), counts[:, 1].astype(float), matrix, n_classes)
    assert np.array_equal(sparse, dense) and (sparse != own).any()


@pytest.mark.parametrize("frequent", [5, 1000])
def test_scores_equal_brute_force_and_classes_raise_the_likelihood(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    texts = _clustered_texts(2)
    held = [i % 6 == 5 for i in range(len(texts))]
    fits = []
    monkeypatch.setattr(lm, "learn", lambda *a, learn=lm.learn: fits.append(learn(*a)) or fits[-1])
    out = by_id(lm.score(documents(spark, texts), F.col("doc_id") % 6 == 5))
    (model,) = fits
    counts = Counter(w for t, h in zip(texts, held) if not h for w in _words(t))
    names = sorted({w for t in texts for w in _words(t)} - {"\n"})
    classes = dict(zip(names, model.classes_of([w.encode() for w in names]))) | {"\n": int(model.classes[-1])}
    k = len(model.log_transition)
    assert model.counts.sum() == sum(n for w, n in counts.items() if n >= 10 and w != "\n")
    matrix = _plain([t for t, h in zip(texts, held) if not h], classes, k)[0]
    plain = {w: i % (k - lm.SHAPES - 1) if counts[w] >= 10 and w != "\n" else classes[w] for i, w in enumerate(names)}
    first = _plain([t for t, h in zip(texts, held) if not h], plain | {"\n": classes["\n"]}, k)[0]
    # With as many classes as words there is nothing to gain.
    assert k - lm.SHAPES - 1 == len(model.counts) or lm.likelihood(matrix) > lm.likelihood(first)
    into = matrix.sum(axis=0) + 1
    n, v = sum(counts.values()), len(counts)
    tokens, kinds = Counter(), Counter()
    for w, c in counts.items():
        tokens[classes[w]] += c
        kinds[classes[w]] += 1
    for i, text in enumerate(texts):
        total, before = 0.0, classes["\n"]
        for w in _words(text):
            c = classes[w]
            p = (matrix[before, c] + lm.TRANSITION * into[c] / into.sum()) / (matrix[before].sum() + lm.TRANSITION)
            if w != "\n":
                top = tokens[c] + lm.EMISSION * (kinds[c] + 1)
                p *= (counts[w] + lm.EMISSION) / max(top, counts[w] + lm.EMISSION)
            total += math.log10((1 - lm.MIXED) * p + lm.MIXED * (counts[w] + 1) / (n + v + 1))
            before = c
        assert math.isclose(out[i].score, total, rel_tol=1e-9)


def test_text_keys(spark):
    df = frame(spark, [("a", "x y", 1), (None, None, 2)], "doc_id string, text string, id int")
    out = lm.score(df, F.lit(False))
    assert out.schema["doc_id"].dataType.simpleString() == "string"
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {"a": 3, None: 1}


def test_no_training_texts_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, "y")]
    df = frame(spark, rows, "doc_id long, text string, block string")
    out = lm.score(df, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0)] * 3
    assert sorted(r.n_tokens for r in out) == [1, 3, 3] and all(math.isfinite(r.score) for r in out)
    trained = lm.score(df, F.lit(False)).collect()
    assert {r.train_tokens for r in trained} == {7} and all(r.n_known == r.n_tokens for r in trained)
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
