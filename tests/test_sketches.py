import random

from promptroute.operators import sketches as sk


def logged(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(f"d{i % 7}", f"m{i % 3}", rng.lognormvariate(6, 1) if i % 50 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "day string, model string, latency_ms double").repartition(5)


def test_merged_sketches_stay_within_the_bound_and_small_ones_are_exact(spark, tmp_path):
    for n, bound in ((3_000, 0.0), (120_000, 2.3 / sk.K)):
        rows, df = logged(spark, n)
        stored = f"{tmp_path}/{n}"
        sk.latency_sketches(df, ["day", "model"]).write.parquet(stored)
        kept = spark.read.parquet(stored)
        out = sk.merged(kept, ["model"]).select("model", "n", "most", *(sk.quantile(q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)))
        whole = {r.model: r for r in sk.latency_sketches(df, ["model"]).select("model", "n", sk.quantile(0.95).alias("q95")).collect()}
        assert out.count() == 3
        for r in out.collect():
            values = sorted(x for _, m, x in rows if m == r.model and x is not None)
            assert r.n == len(values) == whole[r.model].n and r.most == values[-1]
            for q in (0.05, 0.5, 0.95):
                found = r[f"q{int(q * 100)}"]
                rank = sum(v <= found for v in values) / len(values)
                assert abs(rank - q) <= bound + 1 / len(values)
            assert bound or r.q95 == whole[r.model].q95


def test_no_rows(spark):
    _, df = logged(spark, 10)
    assert sk.merged(sk.latency_sketches(df.limit(0), ["day", "model"]), ["model"]).count() == 0
