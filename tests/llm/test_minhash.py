import random
from collections import defaultdict

import numpy as np
import pytest

from promptroute.llm import minhash
from promptroute.llm.components import components
from promptroute.llm.queries import op8_near_duplicates
from promptroute.llm.shingles import mix, shingles, word_hashes
from tests.llm.helpers import by_id, documents, frame


def _brute(texts):
    sets = [shingles(t or "") for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if minhash.similarity(sets[i], sets[j]) >= minhash.SIMILARITY:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def _texts(seed=1):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = [" ".join(say(rng.randint(1, 150))) for _ in range(60)]

    def near(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        return " ".join(words)

    for size, edits in ((120, 3), (40, 1), (25, 2)):
        original = say(size)
        texts.append(" ".join(original))
        texts += [near(original, edits) for _ in range(25)] + [" ".join(original)] * 3
    chain = say(100)
    for _ in range(12):
        chain = near(chain, 1).split()
        texts.append(" ".join(chain))
    texts += ["One two  three", "one, two three", "a b c d e", None, "", " \n", "a " * 3000, "a " * 2900, "a " * 2000]
    return texts


def test_hashes_follow_the_words():
    a, b = word_hashes("One two, THREE one"), word_hashes("three;one two")
    assert a[0] == a[3] == b[1] and a[1] == b[2] and a[2] == b[0] and len(set(a)) == 3
    assert len(word_hashes(" ,")) == 0
    hashes, counts = shingles("a b a b a b a")
    assert sorted(counts.tolist()) == [1, 2] and len(hashes) == 2


def test_signatures_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        hashes = np.unique(mix(rng.integers(0, 2**62, 200).astype(np.uint64)))
        a = rng.integers(1, 40, len(hashes))
        b = np.where(rng.random(len(hashes)) < 0.6, a, rng.integers(0, 40, len(hashes)))
        x, y = (hashes, a), (hashes[b > 0], b[b > 0])
        s = minhash.signatures([x, y])
        off.append((s[0] == s[1]).mean() - minhash.similarity(x, y))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_a_signature_does_not_depend_on_its_neighbours():
    sets = [shingles(t or "") for t in _texts()]
    together = minhash.signatures(sets)
    assert all((minhash.signatures([s])[0] == row).all() for s, row in zip(sets[::7], together[::7]))


@pytest.mark.parametrize("hubs, block", [(True, 512), (False, 7)])
def test_classes_equal_brute_force(spark, monkeypatch, hubs, block):
    if not hubs:
        real = minhash._hub_pairs
        monkeypatch.setattr(minhash, "_hub_pairs", lambda *args: real(*args).limit(0))
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = _texts()
    want = _brute(texts)
    docs = documents(spark, texts).withColumnRenamed("lang", "class_id").withColumnRenamed("source", "bucket")
    out = by_id(minhash.near_duplicates(docs))
    sizes = defaultdict(int)
    for root in want:
        sizes[root] += 1
    assert len(out) == len(texts)
    for i, root in enumerate(want):
        assert (out[i].class_id, out[i].class_size) == (root, sizes[root]), texts[i]


def test_null_ids_repeated_rows_and_no_rows(spark, tmp_path):
    rows = [(None, "a b"), (7, "a b"), (7, "a b"), (None, "x y"), (3, None)]
    frame(spark, rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op8_near_duplicates(spark, str(tmp_path)).collect()
    plain = lambda x: -1 if x is None else x
    found = sorted((plain(r.doc_id), plain(r.class_id), r.class_size) for r in out)
    assert found == [(-1, -1, 1), (-1, 7, 3), (3, 3, 1), (7, 7, 3), (7, 7, 3)]
    assert minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, 199)]
    out = components(frame(spark, links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in out} == {
        *((i, 0) for i in range(41)), *((i, 100) for i in range(100, 130)), (199, 199), (200, 199)
    }
