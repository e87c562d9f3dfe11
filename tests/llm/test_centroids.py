import hashlib
import math
import random

import pytest

from promptroute.llm import centroids
from tests.llm.helpers import frame


def lloyd(rows, dims, scale=64, n=16, rounds=3):
    """The contract in plain Python: (key, vector) to sorted results."""
    rows = [(k, [math.floor(scale * x) for x in v]) for k, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda k: hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest()
    centres = [v for _, v in sorted(rows, key=lambda r: (name(r[0]), r[1]))[:n]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [nearest(v) for _, v in rows]
        for c in range(len(centres)):
            own = [v for (_, v), o in zip(rows, of) if o == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    of = [nearest(v) for _, v in rows]
    apart = [far(v, centres[c]) for (_, v), c in zip(rows, of)]
    most = 2**63 - 1
    own = [sum(d for d, o in zip(apart, of) if o == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((k, c, min(d, most), min(own[c], most), min(sum(apart), most), sha[c])
                   for (k, _), c, d in zip(rows, of, apart)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(spark, rows, kind="long"):
    return frame(spark, rows, f"vec_id {kind}, embedding array<float>, label int")


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_equals_plain_lloyd_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [single(rng.gauss(i % 5 / 5, 0.3)) for _ in range(64)]) for i in range(300)]
    rows += [rows[3], rows[3], (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]),
           (905, [0.5] * 63 + [math.nan]), (906, [math.inf] + [0.5] * 63)]
    df = vectors(spark, [(*r, 1) for r in rows + odd]).repartition(5)
    out = centroids.cluster(df)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(out) == lloyd(rows + odd, 64)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    rows = [(i, [single(i * 0.1 + j * 0.01) for j in range(64)]) for i in range(n)]
    assert found(centroids.cluster(vectors(spark, [(*r, 0) for r in rows]))) == lloyd(rows, 64)


def test_equal_vectors_tie_to_the_smallest_number_and_leave_clusters_empty(spark):
    rows = [(i, [0.25] * 64) for i in range(40)] + [(100, [-0.25] * 64)]
    out = found(centroids.cluster(vectors(spark, [(*r, 0) for r in rows])))
    assert out == lloyd(rows, 64) and len({r[1] for r in out}) == 2


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    sizes = [1.0, 300.0, 4e4, 3e6, 1e12, 3e38]
    rows = [(i, [single(rng.uniform(-1, 1) * sizes[i % 6]) for _ in range(64)]) for i in range(48)]
    assert found(centroids.cluster(vectors(spark, [(*r, 0) for r in rows]), rounds=2)) == lloyd(rows, 64, rounds=2)


def test_other_sizes_text_keys_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(centroids, "TILE", 7)
    monkeypatch.setattr(centroids, "WIDTH", 4)
    rng = random.Random(9)
    rows = [(f"k{i}", [single(rng.uniform(-2, 2)) for _ in range(10)]) for i in range(60)]
    df = vectors(spark, [(*r, 0) for r in rows], "string").selectExpr(
        "vec_id as tile", "embedding as data", "label as key", "label as vector", "label as block")
    out = centroids.cluster(df, "tile", "data", dims=10, scale=16, n_clusters=5, rounds=4)
    assert out.columns[0] == "tile"
    assert found(out) == lloyd(rows, 10, scale=16, n=5, rounds=4)


def test_query(spark, sf_dir):
    from promptroute.llm.queries import op13_centroids

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(op13_centroids(spark, sf_dir)) == lloyd(rows, 64)
