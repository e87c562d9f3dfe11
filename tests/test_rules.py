"""Rule layer and labeller against golden rows and a plain-Python model."""

import random

import pytest
from pyspark.sql import functions as F

from promptroute import settings as st
from promptroute.operators.corpus import heuristic_features, label_corpus, label_gold, rule_features
from promptroute.operators.rules import apply_rules, fire_counts, override_audit, transition_counts
from tests import model

SCHEMA = "id long, prompt string, predicted string, confidence double, all_probs map<string,double>"
GOEDEL = "Explain in detail the implications of Gödel's incompleteness theorems"
PROOF = "Prove that the square root of 2 is irrational using proof by contradiction"
GOLDEN = [
    (PROOF, "small", 0.907, "large", 0.85),
    (PROOF, "medium", 0.907, "medium", 0.907),
    (GOEDEL, "medium", 0.70, "medium", 0.70),
    (GOEDEL + " on computational theory with step by step analysis", "medium", 0.70, "large", 0.70),
    (
        "Create a complete web application with authentication, database, API, React frontend, error "
        "handling, logging, rate limiting, validation, tests, and deployment",
        "medium", 0.938, "large", 0.85,
    ),
    ("What is the capital of France?", "small", 0.981, "small", 0.981),
    (
        "Write a Python function to implement binary search with detailed comments",
        "medium", 0.904, "medium", 0.904,
    ),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, p, lab, c, probs) for i, (p, lab, c, probs) in enumerate(rows)], SCHEMA
    )


def test_golden_rows(spark):
    rows = [(p, lab, c, {"medium": 0.2}) for p, lab, c, _, _ in GOLDEN]
    out = apply_rules(frame(spark, rows)).orderBy("id").collect()
    assert [(r.complexity, r.confidence) for r in out] == [(g[3], g[4]) for g in GOLDEN]
    assert [r.rule_override for r in out] == [g[1] != g[3] for g in GOLDEN]


@pytest.fixture(scope="module")
def random_prompts():
    rnd = random.Random(7)
    lists = (
        st.PROOF_WORDS, st.DEPTH_WORDS, st.STEP_WORDS, st.CODE_WORDS, st.REQUIREMENT_WORDS,
        st.TECHNICAL_WORDS, st.ACADEMIC_WORDS, st.MAIN.reasoning, st.MAIN.symbols,
        st.MAIN.math_words, st.MAIN.code, st.MAIN.simple,
    )
    spaces = [" ", "  ", "\n", "\t", " ", " ", "\r\n", "\n     ", " \x1c"]
    prompts = ["", " ", "\n", "a", "```"]
    for _ in range(1500):
        chosen = [w for ws in lists if rnd.random() < 0.25 for w in rnd.sample(ws, rnd.randint(1, min(6, len(ws))))]
        filler = ["blah"] * rnd.choice([0, 0, 2, 10, 18, 25, 70, 85, 110, 130, 320])
        words = chosen + filler
        rnd.shuffle(words)
        text = "".join(w + rnd.choice(spaces if rnd.random() < 0.3 else [" "]) for w in words)
        if rnd.random() < 0.3:
            text = text.upper()
        if rnd.random() < 0.2:
            text += "?" * rnd.randint(1, 4)
        prompts.append(text)
    return prompts


def test_rules_match_plain_python(spark, random_prompts):
    rnd = random.Random(3)
    rows = [
        (p, rnd.choice(st.LABELS), 0.9, {"medium": rnd.choice([0.05, 0.1, 0.2])} if rnd.random() < 0.9 else {})
        for p in random_prompts
    ]
    out = apply_rules(frame(spark, rows)).orderBy("id").collect()
    expected = [model.rules(p, lab, probs) for p, lab, _, probs in rows]
    assert [(r.complexity, list(r.fired_rules)) for r in out] == expected
    assert {i for _, fired in expected for i in fired} == {1, 2, 3, 4, 5, 6}
    quick = apply_rules(frame(spark, rows), every_rule=False).orderBy("id").collect()
    same = ("complexity", "confidence", "rule_override")
    assert [[r[c] for c in same] for r in quick] == [[r[c] for c in same] for r in out]
    assert "fired_rules" not in quick[0]
    for row in out:
        assert st.LABELS.index(row.complexity) >= st.LABELS.index(row.predicted)
        assert row.rule_override == (row.complexity != row.predicted) == bool(row.fired_rules)
        assert row.confidence == (0.85 if row.rule_override else 0.9)


def test_audit_adds_up(spark, random_prompts):
    rows = [(p, st.LABELS[i % 3], 0.9, {"medium": 0.2}) for i, p in enumerate(random_prompts)]
    ruled = apply_rules(frame(spark, rows)).cache()
    assert transition_counts(ruled).agg(F.sum("n")).first()[0] == len(rows)
    counts = {r["rule"]: r["n"] for r in fire_counts(ruled).collect()}
    audit = {(r["kind"], r["item"]): r["n"] for r in override_audit(ruled).collect()}
    assert counts[1] == audit[("rule", "proof")]
    assert sum(n for (kind, _), n in audit.items() if kind == "transition") == len(rows)


def test_unknown_prediction_and_null_prompt(spark):
    rows = [(None, "small", 0.9, None), ("prove it", None, 0.9, None), ("prove it", "huge", 0.9, None)]
    out = apply_rules(frame(spark, rows)).orderBy("id").collect()
    assert [r.complexity for r in out] == ["small", None, "huge"]


@pytest.mark.parametrize("lex", [st.MAIN, st.VARIANT_A, st.VARIANT_B], ids=lambda x: x.name)
def test_labels_match_plain_python(spark, random_prompts, lex):
    rows = [(i, p, s) for i, p in enumerate(random_prompts) for s in ("wildchat", "gsm8k")]
    df = spark.createDataFrame(rows, "id long, prompt string, source_dataset string")
    out = label_corpus(df, lex).orderBy("id", F.col("source_dataset").desc()).collect()
    assert [r.complexity_label for r in out] == [model.label(p, s, lex) for _, p, s in rows]
    assert {r.complexity_label for r in out} == set(st.LABELS)


def test_word_and_feature_counts(spark, random_prompts):
    df = spark.createDataFrame(list(enumerate(random_prompts)), "id long, prompt string")
    out = rule_features(heuristic_features(df)).orderBy("id").collect()
    for row, prompt in zip(out, random_prompts):
        assert row.word_count == len(prompt.split())
        assert row.char_count == len(prompt)
        assert row.token_count == len(prompt) // 4
        assert row.question_count == prompt.count("?")
        assert row.tech_count == sum(w in prompt.lower() for w in st.TECHNICAL_WORDS)
        assert row.simple_start == prompt.lower().startswith(st.SIMPLE_STARTS)


def test_gold_labels(spark):
    rows = [
        ("small model", 5.0), ("big model", 2.0), ("big model", 2.5), ("big model", 3.0),
        ("big model", None), ("other", 5.0), (None, 1.0),
    ]
    df = spark.createDataFrame(rows, "routing_choice string, complexity_score double")
    labels = [r.complexity_label for r in label_gold(df).collect()]
    assert labels == ["small", "medium", "large", "large", "large", "medium", "medium"]


def test_a_filter_on_the_label_does_not_recompute_it(spark):
    rows = [("prove it step by step", "small", 0.9, {"medium": 0.2})]
    ruled = apply_rules(frame(spark, rows)).filter("complexity = 'large'")
    plan = ruled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("theorem") == 1
    labelled = label_corpus(ruled.withColumn("source_dataset", F.lit("wildchat")))
    plan = labelled.filter("complexity_label = 'large'")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("logarithm") == 1
