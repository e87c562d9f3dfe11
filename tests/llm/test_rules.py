import math
import random
import re

from promptroute.llm import rules
from promptroute.llm.queries import op10_quality_rules
from tests.llm.helpers import by_id, documents, frame


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {i for i, w in enumerate(windows) if windows.count(w) > 1}
    repeated = {i + k for i in twice for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    dup = len(lines) - len(set(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return n, sum(map(len, words)), symbols, dup, r, n < 20 or 100 * r > 30 * n


def _texts(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(["a", "bé", "c#", "<d>", "😀", " "]) + rng.choice(" \n\t\x0b ") for _ in range(n))
    texts = [None, "", " ", "\n\n", "a " * 8, "a " * 9, "x y z\nx y z\n \nx y z"]
    for n in (5, 19, 20, 40, 100):
        texts += [say(n) for _ in range(10)]
        once = "w1 w2 w3 w4 w5 w6 w7 w8 w9 "
        texts.append(once + say(n) + once + " ".join(f"u{i}" for i in range(60)))
    return texts


def test_counts_equal_brute_force(spark):
    texts = _texts(1)
    df = documents(spark, [*texts, texts[8]]).withColumnRenamed("lang", "n_words")
    out = by_id(rules.with_counts(df))
    for i, text in enumerate(texts):
        r = out[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute(text), text
    assert rules.with_counts(df.limit(0)).count() == 0


def test_ratio_is_that_of_the_two_multinomials(spark):
    texts = ["a b a", None, "c", "a  b", ""]
    docs = documents(spark, texts)
    trusted = frame(spark, [(0,), (0,), (3,), (None,), (77,)], "doc_id long")
    grams = [[("a",), ("b",), ("a",), ("a", "b"), ("b", "a")], [], [("c",)], [("a",), ("b",), ("a", "b")], []]
    corpus = [g for x in grams for g in x]
    target = grams[0] + grams[3]
    ratio = rules.fit_ratio(docs, trusted)
    out = by_id(rules.with_verdict(rules.with_counts(docs), ratio))
    for i, own in enumerate(grams):
        each = []
        for g in own:
            p = (corpus.count(g) + 1) / (len(corpus) + rules.BUCKETS)
            t = (target.count(g) + rules.PRIOR * len(target) * p) / (len(target) * (1 + rules.PRIOR))
            each.append(math.log(t / p))
        assert math.isclose(out[i].log_ratio, sum(each) / max(1, len(each)), abs_tol=1e-9)
    assert max(map(abs, rules.fit_ratio(docs.limit(0), trusted.limit(0)))) < 1e-9


def test_query_keeps_good_and_drops_bad_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = op10_quality_rules(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = out.join(labels, "doc_id").where("n_words >= 20 and not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good)
    assert sum(bad) <= 0.2 * len(bad)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
