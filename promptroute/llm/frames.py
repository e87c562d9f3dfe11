"""Helpers shared by the operators: Arrow maps over frames, key columns, table reading."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task works on together.
ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind))


def map_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
) -> DataFrame:
    """``df`` with the columns ``fields`` computed batch by batch in Python.

    ``make`` runs once per task and returns the function that turns a record batch into the new
    columns (Arrow arrays or lists).  A column of ``df`` that has the name of a new one is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]
    schema = T.StructType(kept + fields)
    kinds = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            # A few rows at a time: what Python holds of a batch of long texts stays small.
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                made = [
                    x if isinstance(x, pa.Array) else pa.array(x, kind)
                    for x, kind in zip(compute(batch), kinds)
                ]
                columns = [batch.column(i) for i in places] + made
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def share(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` in a task: sent once to each executor, its classes by value."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that are only needed for a while: ``names``, with strokes where ``df`` has them already."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a key written as text, modulo ``divisor``; a null key has the remainder of ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor
