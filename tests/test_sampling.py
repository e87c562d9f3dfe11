"""Quotas, determinism and skew of the hash-order samples, against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from promptroute.operators import sampling as sp


def position(key, seed=42):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key


def corpus(spark, counts):
    rows = [
        (f"{source}-{label}-{i}", f"prompt {i}", source, label)
        for (source, label), n in counts.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "row_key string, prompt string, source_dataset string, complexity_label string"
    )
    return df.repartition(5), rows


SKEWED = {
    ("a", "large"): 9000, ("a", "medium"): 40, ("a", "small"): 1, ("b", "small"): 300,
    ("b", "medium"): 7, ("c", "large"): 3,
}


@pytest.fixture(scope="module")
def skewed(spark):
    return corpus(spark, SKEWED)


def keys(df):
    return sorted(r.row_key for r in df.select("row_key").collect())


def first_per_group(rows, group, quota):
    groups = defaultdict(list)
    for r in rows:
        groups[group(r)].append(r[0])
    return sorted(k for g, ks in groups.items() for k in sorted(ks, key=position)[: quota(g, len(ks))])


def test_small_quotas_are_ranked_in_one_scan_and_equal_the_cuts(spark, monkeypatch):
    df = spark.range(4000).select(
        F.concat(F.lit("k"), "id").alias("row_key"), F.element_at(F.array(*map(F.lit, ("small", "medium", "large", "odd"))), (F.col("id") % 7 % 4 + 1).cast("int")).alias("complexity_label"),
        F.when(F.col("id") % 50 > 0, F.element_at(F.array(*map(F.lit, ("a", "b"))), (F.col("id") % 3 % 2 + 1).cast("int"))).alias("source_dataset"), F.lit("text").alias("prompt"),
    )
    few = [sp.sample_per_class(df, "row_key", 20), sp.judge_sample(df, "row_key", 150)]
    plan = sp.first_of_each(df, "row_key", ["complexity_label"], 20)._jdf.queryExecution().executedPlan().toString()
    # The limit of every task stands below the shuffle.
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit") and "Partial" in plan[plan.index("Exchange"):]
    assert "BroadcastHashJoin" in few[0]._jdf.queryExecution().executedPlan().toString()
    found = [sorted(map(tuple, x.collect())) for x in few]
    monkeypatch.setattr(sp, "FEW", 0)
    many = [sp.sample_per_class(df, "row_key", 20), sp.judge_sample(df, "row_key", 150)]
    assert found == [sorted(map(tuple, x.collect())) for x in many] and len(found[0]) == 60 and len(found[1]) == 150


def test_sample_per_class(skewed):
    df, rows = skewed
    for k in (1, 20, 500, 10**6):
        expected = first_per_group(rows, lambda r: r[3], lambda g, n: min(k, n))
        assert keys(sp.sample_per_class(df, "row_key", k)) == expected


def test_balance_cuts_to_the_factor(skewed):
    df, rows = skewed
    least = 47
    expected = first_per_group(rows, lambda r: r[3], lambda g, n: min(n, int(least * 2.5)))
    out = sp.balance(df, "row_key")
    assert keys(out) == expected and out.columns == df.columns
    assert sp.balance(df, "row_key", method="none") is df


def test_balance_leaves_even_classes(spark):
    df, rows = corpus(spark, {("a", "large"): 140, ("a", "medium"): 82, ("a", "small"): 61})
    assert keys(sp.balance(df, "row_key")) == sorted(r[0] for r in rows)


def test_balance_at_the_threshold(spark):
    df, _ = corpus(spark, {("a", "large"): 30, ("a", "small"): 10})
    counts = Counter(r.complexity_label for r in sp.balance(df, "row_key").collect())
    assert counts == {"large": 25, "small": 10}


def test_judge_sample(skewed):
    df, rows = skewed
    size = 60
    per_source = Counter(r[2] for r in rows)
    picked = first_per_group(
        rows, lambda r: (r[2], r[3]), lambda g, n: min(n, max(1, int(size * n / per_source[g[0]])))
    )
    expected = sorted(sorted(picked, key=position)[:size])
    assert keys(sp.judge_sample(df, "row_key", size)) == expected


def test_exact_split(skewed):
    df, rows = skewed
    out = sp.stratified_split(df, "row_key").collect()
    assert len(out) == len(rows)
    n, wanted = len(rows), math.ceil(len(rows) * 0.2)
    strata = Counter(f"{r[3]}_{r[2]}" for r in rows)
    quota = {s: c * wanted // n for s, c in strata.items()}
    lost = sorted(strata, key=lambda s: (-(strata[s] * wanted % n), s))
    for s in lost[: wanted - sum(quota.values())]:
        quota[s] += 1
    expected = first_per_group(rows, lambda r: f"{r[3]}_{r[2]}", lambda g, _: quota[g])
    assert sorted(r.row_key for r in out if r.split == "val") == expected
    assert sum(r.split == "val" for r in out) == wanted


def test_hashed_split_is_narrow_and_near_the_fraction(skewed):
    df, rows = skewed
    out = sp.stratified_split(df, "row_key", exact=False)
    share = out.filter("split = 'val'").count() / len(rows)
    assert abs(share - 0.2) < 0.02


def test_first_by_hash(skewed):
    df, rows = skewed
    for n in (0, 1, 777, 10**6):
        expected = sorted(sorted((r[0] for r in rows), key=position)[:n])
        assert keys(sp.first_by_hash(df, "row_key", n)) == expected


def test_same_sample_in_any_partitioning(skewed):
    df, _ = skewed
    one = keys(sp.balance(df.coalesce(1), "row_key"))
    assert one == keys(sp.balance(df.repartition(17, "prompt"), "row_key"))


def test_no_class_is_ranked_whole(skewed, monkeypatch):
    """Only rows with the prefix the quota falls into are ranked."""
    df, _ = skewed
    made = {}

    def spied(name):
        real = getattr(sp, name)
        monkeypatch.setattr(sp, name, lambda *args: made.setdefault(name, real(*args)))

    spied("quota_bounds")
    spied("cutoffs")
    sp.sample_per_class(df, "row_key", 500).count()
    cut = made["cutoffs"]
    ranked = made["quota_bounds"].filter("_prefix is not null")
    share = df.withColumn("_prefix", F.substring(sp.hash_order(F.col("row_key")), 1, 3)).join(
        ranked, ["complexity_label", "_prefix"], "left_semi"
    )
    assert share.count() < 60 < SKEWED[("a", "large")]
    assert cut.count() == 3


def test_rows_are_not_dealt_out_by_stratum(skewed):
    """Cuts go to the rows: a few strata would otherwise put all rows into as few tasks."""
    df, _ = skewed
    whole = df.withColumn("_whole", F.lit("").cast("string"))
    marked = [sp.stratified_split(df, "row_key"), sp.balance(df, "row_key"), sp.first_by_hash(whole, "row_key", 777)]
    for out in marked:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert out.rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_rows_without_label_are_not_lost_by_the_split(spark):
    df, rows = corpus(spark, {("a", "large"): 50, ("a", "small"): 50})
    extra = spark.createDataFrame([("x", "p", None, None)], df.schema)
    assert sp.stratified_split(df.unionByName(extra), "row_key").count() == len(rows) + 1


def test_rows_without_a_label_are_no_class(spark):
    def labelled(counts):
        rows = [(f"{label}{i}", "p", "a", label) for label, n in counts.items() for i in range(n)]
        return spark.createDataFrame(
            rows, "row_key string, prompt string, source_dataset string, complexity_label string"
        )

    assert sp.balance(labelled({"small": 3, "large": 3, None: 1}), "row_key").count() == 7
    cut = sp.balance(labelled({"small": 10, "large": 100, None: 1}), "row_key")
    kept = Counter(r.complexity_label for r in cut.collect())
    assert kept["small"] == 10 and 10 <= kept["large"] < 100 and None not in kept
    split = sp.stratified_split(labelled({"small": 10, "large": 10, None: 30}), "row_key", 0.2)
    parts = Counter((r.complexity_label, r.split) for r in split.collect())
    assert parts == {
        ("small", "val"): 2, ("small", "train"): 8, ("large", "val"): 2, ("large", "train"): 8, (None, "train"): 30
    }
