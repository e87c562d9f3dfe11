"""Statistics against pandas, and the metrics of a known confusion matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from promptroute.operators import evaluation, profile

MATRIX = {
    "small": (1441, 83, 21),
    "medium": (23, 1287, 124),
    "large": (35, 101, 2578),
}
LABELS = ("small", "medium", "large")


@pytest.fixture(scope="module")
def predictions(spark):
    cells = [(t, p, n) for t, row in MATRIX.items() for p, n in zip(LABELS, row)]
    df = spark.createDataFrame(cells, "complexity_label string, predicted string, n int")
    return df.select("complexity_label", "predicted", F.explode(F.sequence(F.lit(1), "n")))


def test_golden_matrix(predictions):
    cells = evaluation.confusion(predictions)
    got = {(r.true_label, r.predicted_label): r.n for r in cells.collect()}
    assert got == {(t, p): n for t, row in MATRIX.items() for p, n in zip(LABELS, row)}
    row = evaluation.metrics(cells).first()
    assert row.n == 5693
    assert row.accuracy == pytest.approx(0.932022, abs=1e-6)
    assert row.f1_macro == pytest.approx(0.927052, abs=1e-6)
    per_class = {r.label: r for r in evaluation.per_class(cells).collect()}
    for label, precision, recall, f1 in (
        ("small", 0.961308, 0.932686, 0.946781),
        ("medium", 0.874915, 0.897490, 0.886058),
        ("large", 0.946750, 0.949889, 0.948317),
    ):
        assert per_class[label].precision == pytest.approx(precision, abs=1e-6)
        assert per_class[label].recall == pytest.approx(recall, abs=1e-6)
        assert per_class[label].f1 == pytest.approx(f1, abs=1e-6)
    verdict = evaluation.verdict(cells).first()
    assert (verdict.grade, verdict.imbalanced) == ("excellent", False)


def test_empty_cells_and_absent_classes(spark):
    df = spark.createDataFrame([("small", "large")] * 3, "complexity_label string, predicted string")
    cells = evaluation.confusion(df)
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 3
    row = evaluation.metrics(cells).first()
    assert (row.accuracy, row.f1_macro, row.f1_weighted) == (0.0, 0.0, 0.0)
    verdict = evaluation.verdict(cells).first()
    assert verdict.grade == "warning" and not verdict.imbalanced


def _series(kind):
    rnd = np.random.default_rng(5)
    return {
        "skewed": np.concatenate([np.full(3000, 7.0), rnd.integers(1, 5000, 2000)]).astype(float),
        "continuous": rnd.lognormal(3, 2, 4000),
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "equal": np.full(50, 2.25),
    }[kind]


@pytest.mark.parametrize("kind", ["skewed", "continuous", "one", "two", "equal"])
def test_describe_matches_pandas(spark, kind):
    values = _series(kind)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    row = profile.describe_numeric(df, F.col("x")).first()
    want = pd.Series(values).describe()
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    for name, expected in zip(names, want):
        if np.isnan(expected):
            assert row[name] is None
        else:
            assert row[name] == pytest.approx(expected, rel=1e-9, abs=1e-9)


def test_describe_by_group(spark):
    frame = pd.DataFrame({"g": ["a"] * 500 + ["b"] * 3, "x": list(_series("continuous")[:500]) + [1.0, 2.0, 9.0]})
    rows = profile.describe_numeric(spark.createDataFrame(frame), F.col("x"), ["g"]).collect()
    want = frame.groupby("g")["x"].describe()
    for r in rows:
        assert r["p25"] == pytest.approx(want.loc[r["g"], "25%"])
        assert r["std"] == pytest.approx(want.loc[r["g"], "std"])


def test_crosstab_margins(spark):
    rows = [("a", "small")] * 3 + [("a", "large")] * 2 + [("b", "small")]
    df = spark.createDataFrame(rows, "source_dataset string, complexity_label string")
    wide = {r["source_dataset"]: r for r in profile.crosstab_wide(df, LABELS).collect()}
    assert (wide["a"]["small"], wide["a"]["medium"], wide["a"]["all"], wide["all"]["all"]) == (3, 0, 5, 6)
    total = profile.crosstab(df).filter("level = 3").first()
    assert total["n"] == 6


def test_imbalance_of_a_known_corpus(spark):
    counts = {"large": 14061, "medium": 8232, "small": 6172}
    df = spark.createDataFrame([(k, n) for k, n in counts.items()], "complexity_label string, n int")
    rows = df.select("complexity_label", F.explode(F.sequence(F.lit(1), "n")))
    row = profile.imbalance(rows).first()
    assert (row.max_count, row.min_count) == (14061, 6172) and round(row.ratio, 2) == 2.28
