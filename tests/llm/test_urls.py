import fnmatch
import random

from promptroute.llm import urls
from promptroute.llm.queries import BLOCKED_GLOBS, SITE_RULES
from tests.llm.helpers import by_id, frame


def test_long_urls_take_little_memory_and_end_where_they_end():
    import tracemalloc

    rng = random.Random(3)
    globs = ["a*b?c*", "*x", "ab*", "*?*zz*", "*" + "q" * 70 + "*"]
    automaton = urls.GlobAutomaton(globs)
    texts = ["".join(rng.choice("abcxz?q") for _ in range(rng.choice([0, 1, 30, 2047, 2048, 2049, 5000]))) for _ in range(60)]
    texts += ["ab" + "z" * 300_000 + "x", "a" + "q" * 100_000 + "b?c"]

    def plain(glob, text):
        at, parts = 0, glob.split("*")
        if not text.startswith(parts[0]) or (len(parts) == 1 and text != glob):
            return False
        at = len(parts[0])
        for part in parts[1:-1]:
            at = text.find(part, at)
            if at < 0:
                return False
            at += len(part)
        return len(text) - at >= len(parts[-1]) and text.endswith(parts[-1])

    found = automaton.match([t.encode() for t in texts])
    assert found.tolist() == [[plain(g, t) for g in globs] for t in texts]
    few = [b"ab"] * 1023 + [b"a" * 2_000_000]
    tracemalloc.start()
    assert automaton.match(few)[:, 2].tolist() == [True] * 1023 + [False]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000


def test_automaton_matches_as_globs_do():
    rng = random.Random(5)
    globs = ["".join(rng.choice("ab/*") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    globs += ["*", "a" * 130, "*" + "ab" * 40 + "*", "**a**"]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["a" * 130, "x" + "ab" * 45, "", "é", "b" * 5000]
    found = urls.GlobAutomaton(globs).match([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert found[i].tolist() == [fnmatch.fnmatchcase(text, g) for g in globs]


def test_verdicts(spark):
    cases = {
        "http://example.net/": ("net/", "block"),
        "http://example.net": (None, "allow"),
        "https://www.EXAMPLE.net/en/1?q=/de/": ("example.net/en/", "allow"),
        "https://example.net/EN/1": ("net/", "block"),
        "http://notexample.com/de/1": (None, "allow"),
        "http://a.example.com/de/1#x": ("example.com/de/", "block"),
        "http://casino.example.org/fr/": ("org/fr/", "allow"),
        "http://casino.example.org/en/": (None, "block"),
        "http://a.org/b.net/c": (None, "allow"),
        "http://a.org/x/ads/y": (None, "block"),
        "http://" + "a" * 9000 + ".net/": ("net/", "block"),
        "no scheme.net/": (None, "allow"),
        "http://net/": ("net/", "block"),
        "": (None, "allow"),
        None: (None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)]
    df = frame(spark, rows + rows[:1], "page_id long, url string, rule string")
    out = urls.filter_urls(df, SITE_RULES, BLOCKED_GLOBS)
    assert out.count() == len(rows) + 1
    for (url, expected), row in zip(cases.items(), sorted(by_id(out, "page_id").items())):
        assert (row[1].rule, row[1].verdict) == expected, url
    assert by_id(out, "page_id")[2].host == "www.example.net"
    assert by_id(out, "page_id")[2].path == "/en/1"
    assert urls.filter_urls(df.limit(0), SITE_RULES, BLOCKED_GLOBS).count() == 0
