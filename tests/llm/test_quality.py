import random
import zlib

import numpy as np

from promptroute.llm import quality
from promptroute.llm.queries import op1_quality
from tests.llm.helpers import by_id, documents, frame


def _corpus(n, seed=3):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else words[:3] * 20
        texts.append(" ".join(words))
        labels.append((i, int(good)))
    return texts, labels


def _fit(spark, texts, labels):
    described = quality.with_statistics(documents(spark, texts))
    known = frame(spark, labels, "doc_id long, quality int")
    return described, quality.fit(quality.labelled_statistics(described, known, "doc_id", "quality"))


def test_normal_equations_equal_those_of_all_rows_together(spark):
    texts, labels = _corpus(150)
    _, model = _fit(spark, texts, labels)
    x = model.projection(np.array([quality.statistics(t) for t in texts]))
    y = np.array([q for _, q in labels], float)
    penalty = quality.RIDGE * len(y) * np.eye(x.shape[1]) / quality.FEATURES
    assert np.allclose(x @ np.linalg.solve(x.T @ x + penalty, x.T @ y), x @ model.weights, atol=1e-6)


def test_isotonic_levels_rise_and_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = rng.integers(1, 6, 12).astype(float)
        ones = np.array([rng.integers(0, k + 1) for k in n.astype(int)], float)
        knots, levels = quality.isotonic(np.arange(12.0), n, ones)
        assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()
        assert 0 < levels[0] and levels[-1] < 1
        # The pools' means by the min-max formula of isotonic regression.
        mean = lambda a, b: ones[a:b].sum() / n[a:b].sum()
        exact = [max(min(mean(a, b) for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
        assert len(set(np.round(exact, 9))) == len(knots) - 2


def test_held_out_documents_and_strange_rows(spark):
    texts, labels = _corpus(400)
    described, model = _fit(spark, texts, labels[:250])
    out = by_id(quality.score(described, model))
    right = [out[i].predicted == q for i, q in labels[250:]]
    assert sum(right) >= 0.95 * len(right)
    rows = [(1, None, 5.0), (1, None, 5.0), (2, "", 1.0), (None, "x " * 200_000, 1.0), (3, "\x00é", None)]
    odd = quality.with_statistics(frame(spark, rows, "doc_id long, text string, score double"))
    scores = [r.score for r in quality.score(odd, model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores)
    assert scores[1] == scores[2] == scores[3]
    assert quality.score(odd.limit(0), model).count() == 0


def test_packed_size_is_of_the_whole_text_at_every_length():
    rng = random.Random(5)
    junk = "".join(chr(rng.randint(33, 126)) for _ in range(16_384))
    for n in (100, 8_192, 8_193, 65_537, 131_072):
        # Junk at the eight places a sample would look at, one word over and over between them, and the reverse.
        step = n // 8
        mixed = "".join(junk[i : i + 1024] + "same " * max(0, (step - 1024) // 5) for i in range(0, 8_192, 1_024))
        for text in (mixed[:n], ("same " * n)[:n], (junk * 9)[:n], ("same " * 1_000 + junk) * 4):
            packed = quality.statistics(text)[quality.STATISTICS.index("packed_size")]
            raw = text.encode()
            assert packed == len(zlib.compress(raw, 1)) / len(raw)


def test_without_two_classes_every_score_is_the_share(spark):
    texts, labels = _corpus(20)
    for known, share in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, None), (99, 0)], 0.5)):
        described, model = _fit(spark, texts, known) if known else _fit(spark, texts, [(-1, 0)])
        assert {r.score for r in quality.score(described, model).collect()} == {share}


def test_query(spark, sf_dir):
    out = by_id(op1_quality(spark, sf_dir))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(out[r.doc_id], r.quality) for r in labels if out[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in held) >= 0.85 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
