"""The training in passes equals a plain numpy fit, goes on where it stopped, and its scores are shares."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptroute.operators import passes as ps
from promptroute.operators.corpus import heuristic_features

WORDS = {"small": "capital colour name", "medium": "summary email outline", "large": "theorem kernel compiler"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(150):
        label = ("small", "medium", "large")[i * 7 % 3]
        own = WORDS[label].split()[i % 3] if i % 9 else "about"
        rows.append((f"k{i}", f"{own} of Topic-{i % 13}, {'x ' * (i % 40)}?", "wildchat", label, "val" if i % 5 == 0 else "train"))
    schema = "row_key string, prompt string, source_dataset string, complexity_label string, split string"
    return spark.createDataFrame(rows, schema)


def plain_words(text, most=256):
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w][:most]


def dense(corpus):
    """The prompts as a plain matrix, made of rows of Python."""
    rows = heuristic_features(corpus).collect()
    x = np.zeros((len(rows), ps.COLUMNS))
    for i, r in enumerate(rows):
        tokens = plain_words(r.prompt)
        for w in tokens:
            x[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % ps.BUCKETS] += 1 / len(tokens) ** 0.5
        band = sum(r.token_count >= edge for edge in ps.BANDS)
        flags = [r.question_count >= 3 if f == "asks_often" else r[f] for f in ps.FLAGS]
        ones = [ps.CONSTANT, ps.FIRST_BAND + band]
        for k, flag in enumerate(flags):
            if flag:
                ones += [ps.FIRST_FLAG + k, ps.FIRST_BANDED + band * len(flags) + k]
        x[i, ones] = 1
    label = np.array([("small", "medium", "large").index(r.complexity_label) for r in rows])
    return x, label, np.array([r.split == "train" for r in rows])


def numpy_fit(x, y, train, passes):
    """Weights and macro F1 after every pass."""
    w = m = s = np.zeros((x.shape[1], 3))
    bound = np.where(np.arange(x.shape[1]) < ps.BUCKETS, ps.LEAST, 0)[:, None]
    share = lambda w: (lambda e: e / e.sum(axis=1, keepdims=True))(np.exp(x @ w))
    out = []
    for t in range(1, passes + 1):
        g = x[train].T @ (share(w) - np.eye(3)[y])[train] / train.sum()
        g = np.where(w == 0, np.sign(g) * np.maximum(abs(g) - bound, 0), g + bound * np.sign(w))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        rate = ps.RATE * (1 - (t - 1) / passes)
        w = w * (1 - rate * ps.DECAY) - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        said, known = share(w)[~train].argmax(axis=1), y[~train]
        f1 = [2 * ((said == c) & (known == c)).sum() / max(1, (said == c).sum() + (known == c).sum()) for c in range(3)]
        out.append((w, np.mean(f1)))
    return out


def test_training_equals_a_numpy_fit(corpus):
    model = ps.train(corpus, passes=6)
    expected = numpy_fit(*dense(corpus), 6)
    assert [f["pass"] for f in model.figures] == [1, 2, 3, 4, 5, 6]
    assert np.allclose([f["f1_macro"] for f in model.figures], [f for _, f in expected])
    best = max(range(6), key=lambda i: (round(expected[i][1], 9), -i))
    assert model.best_pass == best + 1 and [f["best"] for f in model.figures].count(True) == 1
    assert np.allclose(model.weights, expected[best][0], atol=1e-7)
    assert (model.weights[: ps.BUCKETS] == 0).mean() > 0.9


def test_training_goes_on_where_it_stopped(spark, corpus, tmp_path, monkeypatch):
    rows, folder = ps.prepare(corpus, "row_key"), str(tmp_path / "passes")
    whole = ps.fit(rows, 5)
    step, runs = ps.one_pass, []

    def failing(rows, weights):
        runs.append(1)
        if len(runs) == 4:
            raise RuntimeError("lost")
        return step(rows, weights)

    monkeypatch.setattr(ps, "one_pass", failing)
    with pytest.raises(RuntimeError):
        ps.fit(rows, 5, folder)
    assert len(os.listdir(folder)) == 2
    done = len(runs)
    again = ps.fit(rows, 5, folder)
    # The two written passes are read: one gradient to go on from, and three passes.
    assert len(runs) - done == 4
    assert np.allclose(again.weights, whole.weights, atol=1e-9) and again.best_pass == whole.best_pass
    assert ps.fit(rows, 5, folder).figures == again.figures and len(runs) - done == 4


def test_scores_are_shares_and_a_saved_model_scores_alike(spark, corpus, tmp_path):
    model = ps.train(corpus, passes=8)
    odd = corpus.limit(0).unionByName(
        spark.createDataFrame([("n", None, "wildchat", None, None), ("e", "", None, None, None), ("l", "word " * 50_000, "s", None, None)], corpus.schema)
    )
    every = corpus.unionByName(odd).withColumn("columns", F.lit("mine")).withColumn("label", F.lit(7))
    scored = ps.score(every, model)
    assert scored.columns == [*(c for c in every.columns if c != "columns"), "predicted", "confidence", "all_probs"]
    rows = scored.collect()
    assert len(rows) == 153
    for r in rows:
        assert set(r.all_probs) == {"small", "medium", "large"} and abs(sum(r.all_probs.values()) - 1) < 1e-9
        assert r.confidence == max(r.all_probs.values()) == r.all_probs[r.predicted]
    x, y, train = dense(corpus)
    e = np.exp(x @ model.weights)
    share = {r.row_key: s for r, s in zip(corpus.collect(), e / e.sum(axis=1, keepdims=True))}
    assert all(np.allclose([r.all_probs[c] for c in ("small", "medium", "large")], share[r.row_key]) for r in rows if r.row_key in share)
    ps.save_model(spark, model, str(tmp_path / "model"))
    loaded = ps.load_model(spark, str(tmp_path / "model"))
    assert np.array_equal(loaded.weights, model.weights) and loaded.figures == model.figures
    assert ps.score(corpus.limit(0), model).count() == 0


def test_numbers_are_made_once_for_training_and_scoring(spark, corpus, monkeypatch):
    """Numbered rows train and score like prompts, without a look at the prompt."""
    expected = ps.train(corpus, passes=4)
    shares = {r.row_key: r for r in ps.score(corpus, expected).collect()}
    numbered = ps.with_columns(corpus).drop("prompt")
    monkeypatch.setattr(ps, "with_columns", None)
    model = ps.train(numbered, passes=4, numbered=True)
    assert np.allclose(model.weights, expected.weights, atol=1e-9) and model.best_pass == expected.best_pass
    scored = ps.score(numbered.withColumn("predicted", F.lit("mine")), model, numbered=True)
    assert scored.columns == [*(c for c in corpus.columns if c != "prompt"), "predicted", "confidence", "all_probs"]
    rows = scored.collect()
    assert len(rows) == len(shares) == 150
    for r in rows:
        assert r.predicted == shares[r.row_key].predicted
        assert all(abs(p - shares[r.row_key].all_probs[c]) < 1e-9 for c, p in r.all_probs.items())


def test_the_query_of_scores_numbers_prompts_once(spark, sf_dir, monkeypatch):
    from promptroute.catalog import routing_queries as rq

    real, calls = ps.with_columns, []
    monkeypatch.setattr(ps, "with_columns", lambda *args: calls.append(1) or real(*args))
    assert rq.classifier_scores(spark, sf_dir).count() == rq.labelled_workload(spark, sf_dir).count()
    assert len(calls) == 1


def test_words_are_cut_before_they_are_split(spark):
    rows = ["a b c d", " a,b -x y", "", None, "...", "A_b", "a" + " " * 50 + "b c"]
    df = spark.createDataFrame([(r,) for r in rows], "prompt string").select(ps.words(F.col("prompt"), 2).alias("w"))
    assert [r.w for r in df.collect()] == [["a", "b"], ["a", "b"], [], [], [], ["a", "b"], ["a", "b"]]


def test_no_rows_and_one_class(spark, corpus):
    model = ps.train(corpus.limit(0), passes=2)
    assert not model.weights.any() and [f["accuracy"] for f in model.figures] == [0, 0]
    one = ps.train(corpus.where("complexity_label = 'small'"), passes=3)
    assert {r.predicted for r in ps.score(corpus, one).collect()} == {"small"}
