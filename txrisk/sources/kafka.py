"""Message-bus reader/writer options.

The Kafka connector package (spark-sql-kafka-0-10) must be on the
classpath of the cluster; the core evaluation job takes any streaming
DataFrame with a ``value`` column, so tests drive it with a file source.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

__all__ = ["BusConfig", "bus_config", "kafka_reader_options", "kafka_writer_options", "read_kafka",
           "write_kafka"]

# fixed values: configuration names and defaults of the reference service
ENV_DEFAULTS = {
    "KAFKA_BOOTSTRAP_SERVERS": "localhost:9092",
    "KAFKA_REQUEST_TOPIC": "fraud-evaluation-request",
    "KAFKA_RESULT_TOPIC": "fraud-evaluation-result",
    "KAFKA_CONSUMER_GROUP": "fraud-detection-service",
}


@dataclass(frozen=True)
class BusConfig:
    bootstrap_servers: str
    request_topic: str
    result_topic: str
    consumer_group: str


def bus_config(env: Mapping[str, str] | None = None) -> BusConfig:
    """Job arguments from a mapping (e.g. the job's environment), with defaults."""
    env = env or {}
    get = lambda k: env.get(k) or ENV_DEFAULTS[k]
    return BusConfig(get("KAFKA_BOOTSTRAP_SERVERS"), get("KAFKA_REQUEST_TOPIC"),
                     get("KAFKA_RESULT_TOPIC"), get("KAFKA_CONSUMER_GROUP"))


def kafka_reader_options(cfg: BusConfig, starting_offsets: str = "earliest",
                         max_offsets_per_trigger: int | None = None, fail_on_data_loss: bool = True) -> dict[str, str]:
    """``fail_on_data_loss``: stop when offsets have aged out before they were read; False skips them."""
    opts = {
        "kafka.bootstrap.servers": cfg.bootstrap_servers,
        "subscribe": cfg.request_topic,
        "startingOffsets": starting_offsets,
        # offsets live in the query checkpoint; the group id only labels the consumer
        "kafka.group.id": cfg.consumer_group,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


def kafka_writer_options(cfg: BusConfig, checkpoint_location: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": cfg.bootstrap_servers, "topic": cfg.result_topic,
            "checkpointLocation": checkpoint_location}


def read_kafka(spark: SparkSession, cfg: BusConfig, **kw) -> DataFrame:
    """Streaming (key, value) strings from the request topic."""
    raw = spark.readStream.format("kafka").options(**kafka_reader_options(cfg, **kw)).load()
    return raw.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")


def write_kafka(results: DataFrame, cfg: BusConfig, checkpoint_location: str):
    """Results (key, value) to the result topic; at-least-once delivery."""
    return results.writeStream.format("kafka").options(**kafka_writer_options(cfg, checkpoint_location)).start()
