"""Sub-words equal a plain longest-match cut, and nothing behind the cut is looked at."""

import json
import random
import re

import pytest

from promptroute.operators import passes, subwords


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    letters = subwords.letters()
    assert len(set(letters)) == 256 and letters[ord("a")] == "a" and letters[0] == "Ā"
    pieces = [*letters, *(x + "</w>" for x in letters), "th", "the", "the</w>", "ther", "er", "er</w>", "in", "ing</w>", "ingt", "Ã©t", "oo</w>"]
    path = tmp_path_factory.mktemp("vocabulary") / "pieces.json"
    path.write_text(json.dumps({"model": {"vocab": {p: i for i, p in enumerate(pieces)}}}))
    read = subwords.read_vocabulary(str(path))
    assert read == frozenset(pieces)
    return read


def plain(text, vocabulary, most):
    """Every cut by trying all lengths, longest first."""
    letters, out = subwords.letters(), []
    for word in re.findall(r"[^\W_]+", text):
        line = "".join(letters[b] for b in word.lower().encode())
        at = 0
        while at < len(line):
            for stop in range(len(line), at, -1):
                piece = line[at:stop] + ("</w>" if stop == len(line) else "")
                if piece in vocabulary:
                    break
            out.append(piece)
            at = stop
    return out[:most]


def test_pieces_equal_a_plain_cut(spark, vocabulary):
    rng = random.Random(2)
    texts = ["The other thing, therE_in the étéing foo!", "", None, " \n", "漢字 été x" * 30, "a" * 5000]
    texts += ["".join(rng.choice("theringo é-_9") for _ in range(rng.randint(0, 200))) for _ in range(100)]
    for most in (3, 256):
        df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "id long, prompt string, pieces string")
        out = subwords.with_pieces(df, vocabulary, most)
        assert out.columns == ["id", "prompt", "pieces"]
        for r in out.collect():
            assert r.pieces == plain(texts[r.id] or "", vocabulary, most) and r.prompt == texts[r.id]


def test_words_behind_the_cut_are_not_looked_at(vocabulary, monkeypatch):
    cutter, seen = subwords.Cutter(vocabulary), []
    monkeypatch.setattr(cutter, "word", lambda w: seen.append(w) or ["x", "y"])
    assert cutter.text("a b c d e f " * 10_000, 5) == ["x", "y", "x", "y", "x"] and seen == ["a", "b", "c"]


def test_a_classifier_of_sub_words_is_saved_with_its_vocabulary(spark, vocabulary, tmp_path):
    words = {"small": "therein", "medium": "nothing", "large": "foothing"}
    rows = [(f"k{i}", f"{words[c]} {i % 5}", "s", c, "val" if i % 4 == 0 else "train") for i in range(60) for c in [("small", "medium", "large")[i % 3]]]
    df = spark.createDataFrame(rows, "row_key string, prompt string, source_dataset string, complexity_label string, split string")
    model = passes.train(df, passes=6, vocabulary=vocabulary)
    assert max(f["accuracy"] for f in model.figures) == 1
    passes.save_model(spark, model, str(tmp_path / "m"))
    loaded = passes.load_model(spark, str(tmp_path / "m"))
    assert loaded.vocabulary == vocabulary
    a, b = (sorted(map(str, passes.score(df, m).collect())) for m in (model, loaded))
    assert a == b
    other = spark.createDataFrame([("therein",), ("foothing",)], "prompt string")
    assert passes.score(other, model).select("predicted").collect() == [("small",), ("large",)]
