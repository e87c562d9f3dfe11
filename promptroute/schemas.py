"""Explicit schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


TURN = _struct(("role", T.StringType()), ("content", T.StringType()))

CHAT_RECORDS = _struct(("language", T.StringType()), ("conversation", T.ArrayType(TURN)))

PROMPTS = _struct(
    ("row_key", T.StringType()),
    ("prompt", T.StringType()),
    ("source_dataset", T.StringType()),
)

LABELED = T.StructType(
    [*PROMPTS.fields, T.StructField("complexity_label", T.StringType(), True)]
)

PREDICTIONS = _struct(
    ("prompt_id", T.LongType()),
    ("predicted", T.StringType()),
    ("confidence", T.DoubleType()),
    ("all_probs", T.MapType(T.StringType(), T.DoubleType())),
)

MODELS = _struct(
    ("model_id", T.StringType()),
    ("name", T.StringType()),
    ("size_gb", T.DoubleType()),
    ("timeout_s", T.IntegerType()),
)

TIERS = _struct(
    ("complexity", T.StringType()),
    ("recommended", T.ArrayType(T.StringType())),
    ("fallback", T.ArrayType(T.StringType())),
)

RESPONSES = _struct(
    ("prompt_id", T.LongType()),
    ("model", T.StringType()),
    ("raw_response", T.StringType()),
    ("latency_ms", T.DoubleType()),
    ("error", T.StringType()),
)
