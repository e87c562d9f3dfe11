"""Structured Streaming forms of scoring, energy totals and response matching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from promptroute.operators.routing import route_and_account, with_size
from promptroute.session import delete, folders
from promptroute.settings import ERROR_TIMEOUT, ERROR_UNBOUNDED

#: Batches after which a stream's totals become the base.
COMPACTED = 16
REQUEST = ("prompt_id", "model", "request_ts")


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(
    predictions: DataFrame,
    tiers: DataFrame,
    models: DataFrame,
    overrides: Mapping[str, str] | None = None,
    every_rule: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rules, routing and accounting of a stream of predictions.

    The batch code itself: it is stateless, and its tables of tiers and models are static.
    """
    return route_and_account(
        predictions, tiers, models, overrides, every_rule=every_rule, keep=keep
    )


def join_registry(routed: DataFrame, models: DataFrame, model: str = "routed_model") -> DataFrame:
    """Stream-static join with the model registry."""
    return with_size(routed, models, model)


def window_energy(
    routed: DataFrame, width: str = "1 hour", delay: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Prompts and energy per class and tumbling window of event time.

    State is one sum per open window and class: in update and append mode a window leaves it once the
    watermark has passed its end, and later rows for it are dropped.
    """
    return (
        routed.withWatermark(ts, delay)
        .groupBy(F.window(ts, width), "complexity")
        .agg(
            F.count("*").alias("prompts"),
            F.sum("energy_kwh").alias("energy_kwh"),
            F.sum("co2_kg").alias("co2_kg"),
        )
        .select(F.col("window.start").alias("window_start"), "complexity", "prompts", "energy_kwh", "co2_kg")
    )


def longest_timeout(models: DataFrame) -> int:
    """The longest timeout of a registry, in whole seconds: what bounds the state of a match."""
    return models.agg(F.ceil(F.max("timeout_s")).cast("int")).first()[0]


def match_responses(
    requests: DataFrame, responses: DataFrame, longest_timeout_s: int, delay: str = "1 minute"
) -> DataFrame:
    """Requests, each once, with the first response that came within their own timeout.

    ``requests``: (prompt_id, model, timeout_s, request_ts);
    ``responses``: (prompt_id, model, response_ts, raw_response, error).
    A request left unanswered comes out with the timeout error once the watermark has passed
    its deadline.  ``longest_timeout_s``, that of the registry in use, bounds the state of the join;
    the request's own timeout decides the match.  A request with a longer one has its answer if that came within the
    bound, and otherwise an error of its own, since nothing is known of later ones.
    A request comes out when the watermark rules out any other answer, so the first by time counts, whatever the
    order of arrival; open requests are the state.
    """
    asked = requests.withWatermark("request_ts", delay).alias("q")
    answered = responses.withWatermark("response_ts", delay).alias("a")
    bounded = F.col("timeout_s") <= longest_timeout_s
    deadline = F.col("request_ts") + F.make_dt_interval(secs=F.col("timeout_s").cast("decimal(18,6)"))
    matched = asked.join(
        answered,
        (F.col("q.prompt_id") == F.col("a.prompt_id"))
        & (F.col("q.model") == F.col("a.model"))
        & (F.col("response_ts") >= F.col("request_ts"))
        & (F.col("response_ts") <= F.col("request_ts") + F.expr(f"INTERVAL {longest_timeout_s} SECONDS"))
        & (F.col("response_ts") <= deadline),
        "left_outer",
    )
    unanswered = F.col("response_ts").isNull()
    missing = F.when(bounded, ERROR_TIMEOUT).otherwise(ERROR_UNBOUNDED)
    rows = matched.select(
        F.col("q.prompt_id").alias("prompt_id"),
        F.col("q.model").alias("model"),
        "request_ts",
        F.struct(
            unanswered.alias("unanswered"),
            "response_ts",
            F.when(~unanswered, F.col("raw_response")).alias("raw_response"),
            F.when(unanswered, missing).otherwise(F.col("error")).alias("error"),
        ).alias("answer"),
    )
    first = rows.groupBy(*REQUEST).agg(F.min("answer").alias("answer"))
    told = F.col("answer.response_ts")
    return first.select(
        *REQUEST,
        told.alias("response_ts"),
        "answer.raw_response",
        "answer.error",
        ((F.unix_micros(told) - F.unix_micros("request_ts")) / 1000).alias("latency_ms"),
    )


def settle_matches(
    matched: DataFrame, requests: DataFrame, responses: DataFrame, longest_timeout_s: int
) -> DataFrame:
    """The table of a finished match: one row for every request.

    A stream holds requests back until its watermark passes their deadline.  Those still open when the input ended
    are matched here, with the ``responses`` that there are.  All are batch tables.
    """
    still_open = requests.join(matched.select(*REQUEST), list(REQUEST), "left_anti").select(*requests.columns)
    return matched.unionByName(match_responses(still_open, responses, longest_timeout_s).select(*matched.columns))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream over all input there is, into Parquet, and return that table.

    ``path`` and ``checkpoint`` belong together and to the caller: a query started again with
    both goes on where the last one stopped, and adds to the same table.
    """
    writer = stream.writeStream.format("parquet").outputMode("append")
    _all_there_is(writer, checkpoint).start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_totals_to_table(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("window_start", "complexity")
) -> DataFrame:
    """The same for totals by ``keys``: a batch writes the totals it has changed, the latest count.

    A batch has a folder of its own, named after its number.  One that is run again
    replaces that folder, so nothing is counted twice, and no reader sees half of it as the latest.
    Every ``COMPACTED`` batches the totals so far become the base, and the folders of older batches go.
    """
    schema = stream.schema

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % COMPACTED == COMPACTED - 1:
            compact_totals(batch.sparkSession, path, schema, keys)

    _all_there_is(stream.writeStream.outputMode("update").foreachBatch(upsert), checkpoint).start().awaitTermination()
    return latest_totals(stream.sparkSession, path, stream.schema, keys)


def latest_totals(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ("window_start", "complexity")
) -> DataFrame:
    """The totals as of the last batch in ``path``: the base, and the batches after it."""
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rest = [f.name for f in schema.fields if f.name not in keys]
    upto = max(_bases(spark, path), default=None)
    rows = spark.read.schema(numbered).parquet(path)
    if upto is not None:
        base = spark.read.schema(schema).parquet(_base(path, upto)).withColumn("batch", F.lit(upto).cast("long"))
        rows = rows.where(F.col("batch") > upto).unionByName(base)
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}") for c in rest]).select(*schema.names)


def _base(path: str, upto: int) -> str:
    # Spark takes no folder with a leading stroke for a part of a table.
    return f"{path}/_base/upto-{upto}"


def _bases(spark: SparkSession, path: str) -> list[int]:
    """The last batch of every base that was written to the end: its mark is written last."""
    found = folders(spark, f"{path}/_base")
    return [int(f.removeprefix("upto-")) for f in found if "_SUCCESS" in folders(spark, f"{path}/_base/{f}")]


def compact_totals(
    spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str] = ("window_start", "complexity")
) -> None:
    """Make the totals as of the last batch in ``path`` its base.

    The base counts from the moment its mark is there, so a failure on the way changes nothing.  The base before and the
    batches after that one stay for those who are still reading them; what is older is deleted.  Reading
    then costs the base and the batches since, not all there ever were.
    """
    batches = [int(f.removeprefix("batch=")) for f in folders(spark, path) if f.startswith("batch=")]
    before = max(_bases(spark, path), default=None)
    upto = max(batches, default=None)
    if upto is None or (before is not None and upto <= before):
        return
    latest_totals(spark, path, schema, keys).write.mode("overwrite").parquet(_base(path, upto))
    if before is None:
        return
    for number in batches:
        if number <= before:
            delete(spark, f"{path}/batch={number}")
    for number in _bases(spark, path):
        if number < before:
            delete(spark, _base(path, number))


def _all_there_is(writer: DataStreamWriter, checkpoint: str) -> DataStreamWriter:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
