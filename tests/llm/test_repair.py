import hashlib
import itertools
import random
import zlib

import pytest

from promptroute.llm import repair
from tests.llm.helpers import frame

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def faults(turns):
    """First fault of every turn (0 none, 1 blank, 2 duplicate, 3 truncated) of a conversation in order."""
    seen, out = set(), []
    for _, role, text in turns:
        ended = text.rstrip(SPACES)
        out.append(1 if not ended else 2 if (role, text) in seen else 0 if ended[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def cheapest(turns):
    """Least cost, least audit and lines, by looking at every way from the end on, audits and all."""
    known = faults(turns)
    to, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    end = {0: (0, "", ()), 3: (0, "", ()), 1: None, 2: None}

    def with_inserts(plain):
        out = {}
        for q in range(4):
            ways, state, cost, letters, lines = [plain[q]], q, 0, "", ()
            for _ in range(3):
                state = to[state]
                cost, letters, lines = cost + 3, letters + "I", (*lines, f"{names[state]}:")
                if plain[state]:
                    c, a, t = plain[state]
                    ways.append((cost + c, letters + a, lines + t))
            out[q] = min((w for w in ways if w), default=None)
        return out

    after = with_inserts(end)
    for (_, role, text), fault in zip(reversed(turns), reversed(known)):
        plain = {}
        for q in range(4):
            ways = [(4 + after[q][0], "D" + after[q][1], after[q][2])]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                state = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if state:
                    c, a, t = after[state]
                    ways.append((more + c, "K" + a, (f"{role}:{text}", *t)))
                c, a, t = after[to[q]]
                ways.append((3 + more + c, "R" + a, (f"{names[to[q]]}:{text}", *t)))
            plain[q] = min(ways)
        after = with_inserts(plain)
    return after[0]


def told(rows, names):
    """The contract in plain Python: a row for every conversation."""
    out = []
    for conv in names:
        turns = [(t, r, x) for c, t, r, x in rows if c == conv]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        known, met = faults(turns), [t for t, _, _ in turns if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = cheapest(turns)
        gaps = max(met) - min(met) + 1 - len(set(met)) if met else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(known.count(f) for f in (1, 2, 3)), illegal, cost, audit, digest))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversation(rng, conv, n, roles=("system", "user", "assistant", "user", "assistant", "tool", None, "usher")):
    texts = ["Yes.", "No!  ", "Cut", "", " \n", "Why?", "And so on", None, "Yes."]
    row = lambda t: (conv, rng.choice([t, t, t, t - 1, None, t + 2]), rng.choice(roles), rng.choice(texts) )
    return [row(t) if rng.random() < 0.5 else (conv, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(n)]


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    rows = [r for conv in [None, *range(120)] for r in conversation(rng, conv, rng.randint(1, 12))]
    return rows + [rows[5]] * 3 + conversation(rng, 500, 150) + conversation(rng, 501, 90, ("tool", "user"))


def test_brute_force_agrees_with_all_edit_sequences():
    """The suffix search against every sequence of edits, on conversations of up to three turns."""
    rng = random.Random(1)
    to, names = (2, 2, 3, 2), {2: "user", 3: "assistant"}
    for _ in range(60):
        turns = [(i, r or " ", x or " ") for i, (_, _, r, x) in enumerate(conversation(rng, 0, rng.randint(0, 3)))]
        known, best = faults(turns), []

        def go(i, q, cost, audit, lines, inserted):
            if i == len(turns) and q in (0, 3):
                best.append((cost, audit, lines))
            if inserted < 3:
                go(i, to[q], cost + 3, audit + "I", (*lines, names[to[q]] + ":"), inserted + 1)
            if i == len(turns):
                return
            _, role, text = turns[i]
            go(i + 1, q, cost + 4, audit + "D", lines, 0)
            if known[i] not in (1, 2):
                more = 3 * (known[i] == 3)
                state = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                if state:
                    go(i + 1, state, cost + more, audit + "K", (*lines, f"{role}:{text}"), 0)
                go(i + 1, to[q], cost + 3 + more, audit + "R", (*lines, f"{names[to[q]]}:{text}"), 0)

        go(0, 0, 0, "", (), 0)
        assert min(best) == cheapest(turns)


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_equals_brute_force_whatever_the_chunks(spark, table, bits):
    df = frame(spark, table, SCHEMA).repartition(3)
    out = repair.report(repair.damage(df), df, bits=bits)
    assert found(out) == told(damaged(table), {r[0] for r in table})


def test_long_runs_of_deletions_and_of_odd_roles(spark):
    good = lambda a, n: [(1, a + i, ("user", "assistant")[i % 2], f"T{a + i}.") for i in range(n)]
    rows = good(0, 41) + [(1, 100 + i, "user", " ") for i in range(90)] + good(300, 40)
    rows += [(2, i, "tool", f"x{i}") for i in range(75)] + [(3, None, "user", "Same.")] * 60 + [(4, 2**62, "user", "A."), (4, -(2**62), "system", "B.")]
    out = found(repair.report(frame(spark, rows, SCHEMA).repartition(4), bits=3))
    assert out == told(rows, {1, 2, 3, 4})


def test_repaired_turns_have_the_digest_of_the_report(spark, table):
    df = frame(spark, table, SCHEMA)
    hurt = repair.damage(df)
    lines = {}
    for r in repair.repaired(hurt, bits=4).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for row in repair.report(hurt, df, bits=4).collect():
        own = lines.get(row.conv_id, [])
        assert hashlib.sha256("\n".join(own).encode()).hexdigest() == row.repaired_sha256
        initials = "".join(x[0] for x in own)
        assert initials in ("", *("s" * s + "ua" * n for s in (0, 1) for n in range(1, 200)))


def test_dropped_conversations_text_keys_and_clashing_columns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    df = frame(spark, rows, SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(repair.report(repair.damage(df), df)) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    rows = [("a", 0, "user", "Hi."), ("b", 0, "assistant", "x" * 2_000_000 + "."), ("b", 1, "user", "é" * 9)]
    df = frame(spark, rows, "block string, g long, kind string, chunk string").selectExpr("*", "1 as key", "2 as role", "3 as hash")
    out = repair.report(df, None, "block", "g", "kind", "chunk")
    assert out.columns[0] == "block" and found(out) == told(rows, {"a", "b"})


def test_empty_table(spark):
    df = frame(spark, [], SCHEMA)
    assert repair.report(repair.damage(df), df).collect() == [] and repair.repaired(df).collect() == []


def test_query(spark, sf_dir):
    from promptroute.llm.queries import op12_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(op12_repair(spark, sf_dir)) == told(damaged(rows), {r[0] for r in rows})
