import hashlib
import random
import re

from promptroute.llm import decontaminate
from promptroute.llm.queries import op6_decontaminate
from tests.llm.helpers import by_id, documents, frame

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words, hit, found = WORDS.findall(fold(text)), set(), set()
    for name, item in items:
        parts = WORDS.findall(fold(item))
        size = min(10, len(parts))
        windows = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if size else ()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                found.add(str(name))
                hit |= set(range(i, i + size))
    return len(words), len(hit), sorted(found)


def _cases(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "C", "dé", "x1", "Éa"]

    def say(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))

    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 12, 30]))) for i in range(25)]
    items = [x for x in items if len(WORDS.findall(x[1])) not in (1, 2)]
    items += [(90, items[3][1]), (91, None), (91, ""), (3, items[4][1])]
    texts = [say(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + say(4) for _ in range(120)]
    return items, [None, "", " \n", *texts, texts[0]]


def _tables(spark, items, texts):
    return documents(spark, texts), frame(spark, items, "item_id long, text string")


def test_hits_equal_brute_force(spark, tmp_path):
    items, texts = _cases(1)
    docs, benchmark = _tables(spark, items, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for i, row in by_id(op6_decontaminate(spark, str(tmp_path))).items():
        n, hit, found = brute(texts[i], items)
        assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(found)), texts[i]
        assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
        assert row.contaminated == (hit > 0)


def test_several_automata_find_the_same(spark, monkeypatch):
    items, texts = _cases(2)
    docs, benchmark = _tables(spark, items, texts)
    whole = by_id(decontaminate.find_contamination(docs, benchmark))
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 60)
    assert len(list(decontaminate.automata(benchmark, "item_id", "text", 10))) > 3
    assert by_id(decontaminate.find_contamination(docs, benchmark)) == whole


def test_no_items_and_no_rows(spark):
    docs, benchmark = _tables(spark, [(1, "one two")], ["one two", None])
    out = by_id(decontaminate.find_contamination(docs, benchmark.limit(0)))
    assert [out[0].n_words, out[0].hit_words, out[1].n_words] == [2, [], 0]
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0


def test_spans_are_cut_out_and_covered_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Alpha beta, gamma. " * 20
    texts = [clean, f"{clean}é ONE, two three four five six seven eight nine ten eleven. {clean}", item, None]
    docs, benchmark = _tables(spark, [(1, item)], texts)
    out = by_id(decontaminate.remove_contamination(docs.withColumn("items", docs.lang), benchmark))
    assert set(out) == {0, 1, 3}
    assert out[0].text == clean and out[0]["items"] == "en"
    assert out[1].text == f"{clean}é . {clean}"
