"""Streaming evaluation (T1-T7): messages in, decisions and quarantine out.

The reference consumes one message at a time and logs-and-skips bad ones.
Here each micro-batch is one job: messages are validated, scored, explained
and graded (M12), and a single write partitioned by outcome puts decisions
and rejected messages side by side. Nothing is cached. Batch and stream share
the same function, so a stream equals the batch run on the same messages.

Delivery. A batch is written to a folder of its own attempt; then its
decisions go to the bus, if there is one; last, a manifest row names the
attempt. Readers take the attempts that the manifest names and no others. A
batch that fails anywhere in between is replayed by Spark from the offsets of
the query checkpoint: it writes another attempt, and the manifest of the batch
is replaced. So both sinks hold each message once, whenever the job died. A
message bus gets a replayed batch again (at least once).
"""

from __future__ import annotations

import os
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.ml.scoring import judge_requests, result_json
from txrisk.ml.tree_tables import TreeModel
from txrisk.operators.validation import write_outcomes
from txrisk.session import checkpoint_dir, prepare
from txrisk.sources.kafka import BusConfig, read_kafka

_MANIFEST = "batch_id long, attempt string"


def process_batch(batch: DataFrame, model: PipelineModel | TreeModel, names: list[str], *, with_explanation: bool | str = True,
                  evaluated_at: Column | None = None) -> DataFrame:
    """One row per message with a ``value`` column: the message, ``is_valid``, ``errors`` and the decision."""
    return judge_requests(model, batch, names, keep=tuple(batch.columns), with_explanation=with_explanation, evaluated_at=evaluated_at)


def write_batch(judged: DataFrame, batch_id: int, output: str, bus: BusConfig | None = None) -> None:
    """One attempt of a batch: its rows, the bus, and last the manifest that makes it count."""
    spark = judged.sparkSession
    attempt = uuid.uuid4().hex
    path = os.path.join(output, "batches", f"batch_id={batch_id}", f"attempt={attempt}")
    write_outcomes(judged, path)
    if bus is not None:
        # from the rows just written: nothing is scored again
        decided = spark.read.schema(judged.schema).parquet(path).filter("is_valid")
        (result_json(decided).write.format("kafka")
            .option("kafka.bootstrap.servers", bus.bootstrap_servers)
            .option("topic", bus.result_topic).save())
    commit_batch(spark, output, batch_id, attempt)


def commit_batch(spark: SparkSession, output: str, batch_id: int, attempt: str) -> None:
    (spark.createDataFrame([(batch_id, attempt)], _MANIFEST).coalesce(1)
        .write.mode("overwrite").json(os.path.join(output, "manifest", str(batch_id))))


def committed(spark: SparkSession, output: str) -> DataFrame:
    """All rows of committed batches, with ``batch_id`` and ``is_valid``."""
    manifest = spark.read.schema(_MANIFEST).json(os.path.join(output, "manifest", "*"))
    rows = spark.read.option("basePath", os.path.join(output, "batches")).parquet(os.path.join(output, "batches"))
    rows = rows.withColumns({"batch_id": F.col("batch_id").cast("long"), "attempt": F.col("attempt").cast("string"),
                             "is_valid": F.col("is_valid").cast("boolean")})
    return rows.join(manifest, ["batch_id", "attempt"], "left_semi").drop("attempt")


def committed_results(spark: SparkSession, output: str) -> DataFrame:
    """Decisions of committed batches."""
    return committed(spark, output).filter("is_valid").drop("is_valid", "errors")


def committed_rejected(spark: SparkSession, output: str) -> DataFrame:
    """Rejected messages of committed batches with their reasons."""
    from txrisk.ml.scoring import RESULT_FIELDS
    return committed(spark, output).filter("NOT is_valid").drop("is_valid", *RESULT_FIELDS)


def start(stream: DataFrame, model: PipelineModel | TreeModel, names: list[str], output: str, *,
          checkpoint: str | None = None, available_now: bool = False, processing_time: str | None = None,
          with_explanation: bool | str = True, evaluated_at: Column | None = None, query_name: str | None = None,
          bus: BusConfig | None = None):
    """Run the evaluation on a streaming DataFrame with a ``value`` column into the folder ``output``.

    ``checkpoint`` defaults to a folder named after ``query_name`` under the
    session's checkpoint dir; one of the two is required, so that no two
    streams share a folder.
    ``available_now`` processes what is there and stops (bounded runs).
    ``bus``: also publish results (camelCase JSON) to the result topic.
    """
    spark = prepare(stream.sparkSession)
    if not checkpoint and not query_name:
        raise ValueError("a stream needs a checkpoint folder or a query name")
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), f"stream-{query_name}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = process_batch(batch, model, names, with_explanation=with_explanation, evaluated_at=evaluated_at)
        write_batch(judged, batch_id, output, bus)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_bounded(stream: DataFrame, model: PipelineModel | TreeModel, names: list[str], output: str, **kw):
    """Process everything available, then stop."""
    q = start(stream, model, names, output, available_now=True, **kw)
    q.awaitTermination()
    return q


def run_service(spark, cfg: BusConfig, model_path: str, output: str, *, processing_time: str = "1 second", max_offsets_per_trigger: int | None = None,
                checkpoint: str | None = None):
    """Request topic -> validate -> evaluate -> result topic; decisions and rejected
    messages with reasons -> ``output``. Needs the Kafka connector package on the cluster classpath."""
    from txrisk.ml.prep import split_columns
    from txrisk.ml.train import load
    from txrisk.ml.prep import feature_names
    from txrisk.schemas import TRANSFER_FEATURE_COLUMNS, L4_TRANSFER_RAW
    model = load(model_path)
    probe = spark.createDataFrame([], L4_TRANSFER_RAW)
    from txrisk.operators.transfer import transfer_features
    num, cat = split_columns(transfer_features(probe), TRANSFER_FEATURE_COLUMNS)
    names = feature_names(model, num, cat)
    stream = read_kafka(spark, cfg, max_offsets_per_trigger=max_offsets_per_trigger)
    return start(stream, model, names, output, checkpoint=checkpoint, processing_time=processing_time,
                 bus=cfg, query_name="fraud_evaluation")
