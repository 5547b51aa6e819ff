"""Session helpers.

Queries only *read* cluster-level settings; the few SQL settings the
semantics depend on (UTC session time zone, ANSI mode) are set at
runtime on whatever session the caller hands in.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the results depend on; applied to any session passed in.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # a JSON key given twice: the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings for scale; applied only where the caller left them unset.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast only when the measured build side is below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    # The JVM never compiles a method beyond this many bytes: wide projections are then cut into smaller methods
    # instead of one per stage, which would be interpreted for every row.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; fill scale defaults left unset."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    for key, value in SCALE_DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared lineage-cut folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set (a shared filesystem path). Only
    when it is unset -- local tests -- is a private folder created.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="txrisk-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as Parquet in the checkpoint folder: for a table that several jobs read."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "txrisk") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TXRISK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SEMANTIC_CONF, **SCALE_DEFAULTS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)
