"""Pieces shared by the training-data operators: word and white-space rules, hashes, shared scratch tables."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import checkpoint_dir

# The white space of the contracts is exactly space and U+0009..U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
# Matches only where one plain space would not already do, so ordinary prose has few matches.
_IRREGULAR_SPACE = rf"[\x09-\x0D][{SPACE_CLASS}]*|\x20[{SPACE_CLASS}]+"

I64_MAX = 2**63 - 1
I64_MIN = -(2**63)


def single_spaced(text: Column | str) -> Column:
    """``text`` (null: empty) with every run of white space replaced by one space."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), _IRREGULAR_SPACE, " ")


def word_array(text: Column | str) -> Column:
    """The words of ``text`` in order; an empty array for null or blank text."""
    flat = F.trim(single_spaced(text))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column | str) -> Column:
    """Number of words (long): a word starts at each non-space that follows a space or the start."""
    flat = F.trim(single_spaced(text))
    spaces = F.char_length(flat) - F.char_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def lower_ascii(text: Column | str) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(_col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs only a re-read. The folder is the
    one the cluster names in ``spark.checkpoint.dir``; the tables live as long
    as that folder does (:func:`drop_scratch` removes those of this session).
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Writes inside delete the shuffle files of their query when they end, not when the driver's garbage is collected."""
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def light_arrow_batches(spark: SparkSession, size: int = 8 << 20):
    """Inside, Arrow batches end at ``size`` bytes: for rows of megabytes each, of which two or three copies are held per batch."""
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size)):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared scratch folder."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later read needs."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(table: DataFrame) -> None:
    """Delete a :func:`scratch_table` that no later read needs."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        remove_path(table.sparkSession, folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it once no result that reads them is needed."""
    remove_path(spark, _root(spark))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches of text columns small unless the session already chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10000:
        spark.conf.set(key, str(rows))


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker remembers for ``owner`` between tasks. Workers outlive a stage, so the caches of other owners, whose
    stages have ended, are dropped and their memory goes back to the system: they would add up to the next stages' needs."""
    others = [k for k in _caches if k != owner]
    if any(_caches.pop(k) for k in others):
        import ctypes
        import gc
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):       # another C library
            pass
    return _caches.setdefault(owner, {})


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/txrisk-llm/{spark.sparkContext.applicationId}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may run where it is not installed; once per application."""
    import os
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_txrisk_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="txrisk-code-"), "txrisk.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)     # served by the driver, fetched by every executor
    sc._txrisk_shipped = True
