import hashlib
import random
import struct

import pytest

from promptroute.llm import bpe
from promptroute.llm.queries import op3_bpe, vocabulary_path
from tests.llm.helpers import by_id, documents, frame

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    with open(vocabulary_path(), encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def _packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_ids_and_text_equal_the_library(vocabulary, library):
    rng = random.Random(7)
    letters = "ab c'sre<|endoftext|>\n\t  1234é漢😀.,- 　\u0085"
    cases = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(500)]
    cases += ["", "a" * 5000, "ab" * 3000, " " * 900, "  <|endoftext|> <|endoftext|>x", "the" * 2000]
    encode, decode = bpe.encoder(vocabulary), bpe.decoder(vocabulary)
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == _packed(ids)
        assert decode(_packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_long_and_short_words_merge_alike(vocabulary):
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("thereingonxéß9") for _ in range(rng.randint(1, 90))).encode()
        assert vocabulary.merge_short(word) == vocabulary.merge_long(word)


def test_undecodable_ids_become_replacement_characters(vocabulary):
    half = _packed([vocabulary.byte_ids["é".encode()[0]]])
    assert bpe.decoder(vocabulary)(half) == "�"


def test_words_are_forgotten_without_changing_ids(vocabulary, monkeypatch):
    encode = bpe.encoder(vocabulary)
    text = "one two three one two three four five " * 3
    whole = encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert bpe.encoder(vocabulary)(text) == whole


def test_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "a b", "y"), (2, "a b", "y"), (3, "", None)]
    df = frame(spark, rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, vocabulary_path()), vocabulary_path())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(r.decoded for r in out.collect()) == ["", "", "a b", "a b", "a b"]
    assert bpe.encode(df.limit(0), vocabulary_path()).count() == 0


def test_query(spark, tmp_path, library):
    texts = ["Hello there, you.", None, "", "<|endoftext|>", "x" * 20000, "Été 漢字\n\n  end "]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    for i, row in by_id(op3_bpe(spark, str(tmp_path))).items():
        ids = library.encode(texts[i] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(_packed(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
