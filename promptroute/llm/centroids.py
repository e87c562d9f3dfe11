"""Lloyd's clustering with the dimensions dealt over shards, in whole numbers throughout.

A vector is cut into blocks of columns.  Vectors are packed into tiles; a row of the written table is one block of a tile,
in the smallest integers that hold it, and the files of a block hold nothing else.  A round is:

1. Tasks of a block add up exact squared distances over its columns, from the vectors of a tile to the block's slice of
   every centroid.
2. The blocks' partial distances of a tile meet under its key, are added, and the least total gives each vector its
   centroid (of equal ones the smallest number).
3. Tasks of a block sum its columns by centroid; each block then makes its own slice anew: the floor of sum over count.
   A centroid without vectors stays.

The driver holds the centroids (a number for each centroid and column) and nothing that grows with the vectors.

Vectors of another length, a null one, and those with a null, infinite or not-a-number component are left out.  A null key is
kept and counts as empty text in the choice of the first centroids.  Rows with the same key are vectors of their own;
where their keys tie in that choice, the lower components come first.  With fewer vectors than centroids
there are as many centroids as vectors.  An empty table gives an empty one.  Other columns are not looked at.  Sums
and distances are exact at any size; what exceeds a long is returned as the largest long.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptroute.llm.frames import arrow_schema
from promptroute.session import materialise, new_path

#: Columns of a block, and vectors of a tile.
WIDTH, TILE = 16, 4096
#: Components below this size have exact squared distances in 64 bits over 64 columns and more.
_SAFE = 1 << 26
_LONGEST = (1 << 63) - 1


def whole_numbers(vector: Column, scale: int) -> Column:
    """The components as doubles: floor(scale * x), which beyond 2^53 is scale * x itself."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(vector, whole)


def kept(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``key`` and ``vector`` of the rows that are clustered."""
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where((F.size("vector") == dims) & F.forall("vector", lambda x: F.coalesce(fine(x), F.lit(False))))


def _small(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them all, or as Python's where none do."""
    if values.dtype != object and values.size:
        low, high = int(values.min()), int(values.max())
        for kind in (np.int8, np.int16, np.int32):
            if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
                return values.astype(kind)
    return values


def integers(values: np.ndarray) -> np.ndarray:
    """Floor of ``values`` (doubles that are whole) as integers of any size."""
    if values.size and np.abs(values).max() >= _SAFE:
        return np.vectorize(int, otypes=[object])(values)
    return _small(values.astype(np.int64))


def partial_distances(block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of a block's rows to the centroids' slices."""
    large = any(x.dtype == object or (x.size and int(np.abs(x.astype(np.int64)).max()) >= _SAFE) for x in (block, centroids))
    kind = object if large else np.int64
    a, b = block.astype(kind), centroids.astype(kind)
    found = np.empty((len(a), len(b)), kind)
    for i, centre in enumerate(b):
        found[:, i] = ((a - centre) ** 2).sum(axis=1)
    return _small(found)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = object if object in (a.dtype, b.dtype) else np.int64
    return a.astype(kind) + b.astype(kind)


def _one(row: dict[str, object], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=kinds)


def _tiles(rows: DataFrame, scale: int, dims: int) -> DataFrame:
    """Written blocks of tiles: ``tile``, ``block``, ``data``, and in block 0 the ``keys``."""
    key_type = rows.schema["key"].dataType
    schema = T.StructType([
        T.StructField("tile", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("data", T.BinaryType()),
        T.StructField("keys", T.ArrayType(key_type)),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    width, most = WIDTH, TILE

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for low in range(0, whole.num_rows, most):
                batch = whole.slice(low, most)
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                for block, first in enumerate(range(0, dims, width)):
                    data = integers(values[:, first : first + width])
                    keys = batch.column("key").to_pylist() if block == 0 else None
                    yield _one({"tile": number, "block": block, "data": pickle.dumps(data), "keys": keys}, kinds)
                number += 1

    path = new_path(rows.sparkSession, "tiles")
    packed = rows.select("key", whole_numbers(F.col("vector"), scale).alias("vector")).mapInArrow(pack, schema)
    packed.write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _assigned(tiles: DataFrame, centroids: list[np.ndarray]) -> DataFrame:
    """``tile``, ``labels`` and ``distances`` of its vectors."""
    partial = "tile long, partial binary"
    partial_kinds, found = arrow_schema(partial), "tile long, labels binary, distances binary"
    found_kinds = arrow_schema(found)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, block, data in zip(*(batch.column(c) for c in ("tile", "block", "data"))):
                part = partial_distances(pickle.loads(data.as_py()), centroids[block.as_py()])
                yield _one({"tile": tile.as_py(), "partial": pickle.dumps(part)}, partial_kinds)

    def settle(group: pa.Table) -> pa.Table:
        total = reduce(_add, (pickle.loads(x.as_py()) for x in group.column("partial")))
        labels = total.argmin(axis=1)
        nearest = np.minimum(total[np.arange(len(total)), labels], _LONGEST).astype(np.int64)
        row = {"tile": group.column("tile")[0].as_py(), "labels": pickle.dumps(_small(labels)), "distances": nearest.tobytes()}
        return pa.Table.from_pylist([row], schema=found_kinds)

    parts = tiles.select("tile", "block", "data").mapInArrow(measure, partial)
    return materialise(parts.groupBy("tile").applyInArrow(settle, found), "assigned")


def _updated(tiles: DataFrame, assigned: DataFrame, centroids: list[np.ndarray]) -> list[np.ndarray]:
    """Every block's slice of the centroids after their vectors."""
    k = len(centroids[0])
    schema = "block int, sums binary, counts binary"
    kinds = arrow_schema(schema)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for block, data, labels in zip(*(batch.column(c) for c in ("block", "data", "labels"))):
                values, of = pickle.loads(data.as_py()), pickle.loads(labels.as_py())
                sums = np.zeros((k, values.shape[1]), object if values.dtype == object else np.int64)
                np.add.at(sums, of, values.astype(sums.dtype))
                counts = np.bincount(of, minlength=k)
                known = held.get(block.as_py())
                held[block.as_py()] = (sums, counts) if known is None else (_add(known[0], sums), known[1] + counts)
        for block, (sums, counts) in held.items():
            yield _one({"block": block, "sums": pickle.dumps(sums), "counts": counts.tobytes()}, kinds)

    slices = "block int, slice binary"
    slice_kinds = arrow_schema(slices)

    def renew(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        sums = reduce(_add, (pickle.loads(x.as_py()) for x in group.column("sums")))
        counts = sum(np.frombuffer(x.as_py(), np.int64) for x in group.column("counts"))
        new = centroids[block].astype(sums.dtype)
        some = counts > 0
        new[some] = sums[some] // counts[some][:, None].astype(sums.dtype)
        return pa.Table.from_pylist([{"block": block, "slice": pickle.dumps(_small(new))}], schema=slice_kinds)

    both = tiles.select("tile", "block", "data").join(assigned.select("tile", "labels"), "tile")
    sums = both.select("block", "data", "labels").mapInArrow(total, schema)
    found = {r["block"]: pickle.loads(r["slice"]) for r in sums.groupBy("block").applyInArrow(renew, slices).collect()}
    return [found[b] for b in range(len(centroids))]


def first_centroids(rows: DataFrame, scale: int, n: int) -> list[list[float]]:
    """Whole numbers of the ``n`` vectors whose keys hash lowest, in that order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    ranked = rows.select(hashed.alias("hash"), whole_numbers(F.col("vector"), scale).alias("vector"))
    return [r["vector"] for r in ranked.orderBy("hash", "vector").limit(n).collect()]


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 64,
    n_clusters: int = 16, rounds: int = 3,
) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of every kept vector."""
    spark, rows = vectors.sparkSession, kept(vectors, key, vector, dims)
    first = np.array(first_centroids(rows, scale, n_clusters), float).reshape(-1, dims)
    centroids = [integers(first[:, a : a + WIDTH]) for a in range(0, dims, WIDTH)]
    tiles = _tiles(rows, scale, dims)
    if len(first):
        for _ in range(rounds):
            centroids = _updated(tiles, _assigned(tiles, centroids), centroids)
        assigned = _assigned(tiles, centroids)
    else:
        assigned = spark.createDataFrame([], "tile long, labels binary, distances binary")
    return _described(tiles, assigned, centroids, key)


def _described(tiles: DataFrame, assigned: DataFrame, centroids: list[np.ndarray], key: str) -> DataFrame:
    spark = tiles.sparkSession
    schema = T.StructType([
        T.StructField("key", tiles.schema["keys"].dataType.elementType), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, labels, distances in zip(*(batch.column(c) for c in ("keys", "labels", "distances"))):
                columns = [
                    keys.values, pa.array(pickle.loads(labels.as_py()).astype(np.int32)),
                    pa.array(np.frombuffer(distances.as_py(), np.int64)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(k.type) for c, k in zip(columns, kinds)], schema=kinds)

    found = tiles.where("block = 0").select("tile", "keys").join(assigned, "tile").select("keys", "labels", "distances")
    found = materialise(found.mapInArrow(unpack, schema), "clustered")
    whole = np.concatenate([c.astype(object) for c in centroids], axis=1)
    digests = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in whole]
    named = spark.createDataFrame([(i, d) for i, d in enumerate(digests)], "cluster int, centroid_sha256 string")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = inertia.agg(F.sum("own").alias("every")).first()["every"] or 0
    bounded = F.least("own", F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    inertia = inertia.select("cluster", bounded.alias("cluster_inertia")).join(named, "cluster")
    return found.join(inertia, "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia",
        F.lit(min(int(total), _LONGEST)).cast("long").alias("inertia"), "centroid_sha256",
    )
