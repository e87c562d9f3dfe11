import random

import pytest

import corpus_pipeline
from promptroute.llm import minhash
from promptroute.llm.shingles import shingles
from tests.llm.helpers import by_id, documents, frame


def _prose(rng, n):
    words = ["".join(rng.choice("aeinorstlh") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = [_prose(rng, rng.randint(30, 200)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in _prose(rng, 60).split()) for _ in range(40)]
    item = _prose(rng, 25)
    passage = _prose(rng, 90)
    short = _prose(rng, 52)
    near = clean[5].split()
    near[3] = "changed"
    texts = {
        "clean": clean,
        "copies": [clean[7], clean[7], clean[5] if len(near) < 60 else " ".join(near)],
        "bad": bad,
        "leak": [f"{_prose(rng, 80)} {item} {_prose(rng, 60)}", item],
        "repeat": [f"{_prose(rng, 70)} {passage} {_prose(rng, 50)}" for _ in range(2)],
        "short": [f"{_prose(rng, 70)} {short} {_prose(rng, 50)}" for _ in range(2)],
        "empty": [None],
    }
    rows = [(kind, t) for kind, own in texts.items() for t in own]
    docs = documents(spark, [t for _, t in rows])
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(kind != "bad"), 0) for i, (kind, _) in enumerate(rows) if kind in ("clean", "bad")]
    frame(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, item, passage, short


def test_every_stage_takes_effect(spark, corpus):
    folder, rows, item, passage, short = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kinds = dict(enumerate(k for k, _ in rows))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        out = by_id(docs)
        seen.append(out)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, unique, whole, free, coded = seen
    assert not any(kinds[i] == "bad" for i in good)
    assert {i for i, k in kinds.items() if k in ("clean", "leak", "repeat", "short")} <= {*good}
    assert {i for i, k in kinds.items() if k == "clean"} <= {*unique}
    sets = [shingles(r.text or "") for r in unique.values()]
    assert all(minhash.similarity(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
    for i, r in whole.items():
        if kinds[i] == "repeat":
            assert passage not in r.text and r.n_chars == len(r.text) > 300
        elif kinds[i] == "short":
            assert short not in r.text and r.n_chars == len(r.text) > 300
        else:
            assert r.text == unique[i].text
    leaks = [i for i, k in kinds.items() if k == "leak"]
    assert leaks[0] in free and leaks[1] not in free
    assert item.lower()[20:80] not in free[leaks[0]].text.lower()
    for i, r in coded.items():
        assert r.round_trip and r.text == free[i].text and len(r.ids) == 4 * r.n_tokens


def test_run_gives_the_rows_of_the_last_stage(spark, corpus):
    folder, rows, *_ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "ids", "n_tokens", "round_trip"} <= set(out.columns)
    assert 60 <= out.count() < len(rows)


def test_empty_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay_through_the_stages(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["score", "row", "spans", "node", "statistics", "_row", "_hash", "_key", "_spans", "_statistics", "_score", "_predicted"]
    names += ["_words", "_hashes", "_windows", "_cut_items", "_cut_n_words", "_text", "_id", "kept", "n_bytes"]
    for name in names:
        docs = docs.withColumn(name, docs.doc_id)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert out.count() and out.where(" or ".join(f"{name} <> doc_id" for name in names)).count() == 0
