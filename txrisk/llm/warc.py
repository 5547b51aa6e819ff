"""WARC archives through a chunked record table.

Write: payloads are cut into rows (record, chunk number, chunk), so no Python
worker ever holds a whole record; digest and length come from the JVM, so
record headers are known before the first chunk. Chunks stream through one
gzip member per record. Records with equal payloads (by SHA-1 and length)
are one response, of the largest id, and revisits that refer to it.

Read: archives are read in bounded blocks into rows (record, chunk number,
chunk) that carry the digest and byte count so far; the last chunk of a
record has the whole payload's.

Files are written under names of the task attempt; only those of successful
attempts are in the manifest that :func:`write` returns, so a lost executor
leaves at most an unlisted file. The folder may be on any store that
pyarrow's filesystems reach; by default it is in the shared folder named by
``spark.checkpoint.dir``.

Defined results: null payloads are empty ones. A null id sorts below any
other. Rows that repeat id and payload are equal records: if the id is the
largest of its payload, each is a response.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.common import scratch_path, scratch_table, ship_package, small_arrow_batches

CHUNK_BYTES = 64 * 1024     # of a payload per row
BLOCK = 256 * 1024          # bytes read or inflated at once
MIN_BYTES = 0               # smaller payloads are never deduplicated


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, payload`` (UTF-8 bytes)``, bytes, sha1, refers_to`` per row; ``refers_to`` is null for responses."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    # only repeated payloads need a partner; the texts stay out of this shuffle
    repeated = (base.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes")
                .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return (base.join(repeated, ["sha1", "bytes"], "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id"))


def _header(r, date: str) -> bytes:
    revisit = r.kind == "revisit"
    fields = [("WARC-Type", r.kind), ("WARC-Record-ID", f"<urn:page:{r.page_id}>"), ("WARC-Date", date),
              ("WARC-Target-URI", (r.url or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Payload-Digest", f"sha1:{base32(r.sha1)}"), ("X-Payload-Length", str(r.bytes))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{r.refers_to}>")]
    fields += [("Content-Type", "text/html"), ("Content-Length", "0" if revisit else str(r.bytes))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          min_bytes: int = MIN_BYTES, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write gzip WARC files, one per partition; returns the manifest (path, store, records)."""
    spark = pages.sparkSession
    ship_package(spark)
    small_arrow_batches(spark)
    folder = folder or scratch_path(spark, "warc")
    null_id = F.lit("null")
    chunk = F.lit(CHUNK_BYTES)
    whole = records(pages, id_col, url_col, payload_col, min_bytes).withColumn(
        "kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    # all chunks of a record follow one another in one partition: explode keeps their order. Chunks are cut from bytes, whose
    # offsets cost nothing; positions in a string are found by walking it from the start, for every chunk anew
    last = F.when(F.col("kind") == "revisit", F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil(F.col("bytes") / chunk) - 1)).cast("int")
    chunks = (whole.withColumn("last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), "last")))
              .select(F.coalesce(F.col("page_id").cast("string"), null_id).alias("page_id"), "url", "bytes", "sha1", "kind",
                      F.coalesce(F.col("refers_to").cast("string"), null_id).alias("refers_to"), "chunk_no", "last",
                      F.when(F.col("kind") == "response", F.substr("payload", F.col("chunk_no") * chunk + 1, chunk)).alias("chunk")))

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get()
        store, path = _filesystem(folder)
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, member, count = None, None, 0
        try:
            for frame in frames:
                for r in frame.itertuples(index=False):
                    if out is None:
                        store.create_dir(path, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    if r.chunk_no == 0:
                        member = zlib.compressobj(1, zlib.DEFLATED, 31)
                        out.write(member.compress(_header(r, date)))
                    if r.chunk:
                        out.write(member.compress(r.chunk))
                    if r.chunk_no == r.last:
                        out.write(member.compress(b"\r\n\r\n") + member.flush())
                        count += 1
        finally:
            if out is not None:
                out.close()
        if count:
            yield pd.DataFrame({"path": [name], "store": [folder], "records": [count]})

    return scratch_table(chunks.mapInPandas(save, "path string, store string, records long"), "warc-manifest")


def _members(read) -> Iterator[tuple[int, bytes]]:
    """(member number, inflated bytes) of a gzip file, in bounded blocks. ``read(n)`` gives the next bytes."""
    number, inflate, data = 0, zlib.decompressobj(31), b""
    while True:
        if not data:
            data = read(BLOCK)
            if not data:
                return
        if inflate.eof:
            number, inflate = number + 1, zlib.decompressobj(31)
        part = inflate.decompress(data, BLOCK)
        data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        if part:
            yield number, part


def parse(read) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(headers, chunk number, chunk, whether it is the last) per block of payload; every record gives at least one."""
    current, head, fields, left, number = -1, b"", None, 0, 0
    for member, part in _members(read):
        if member != current:
            current, head, fields, number = member, b"", None, 0
        if fields is None:
            head += part
            end = head.find(b"\r\n\r\n")
            if end < 0:
                continue
            lines = head[:end].decode("utf-8").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            left, part = int(fields["Content-Length"]), head[end + 4:]
            if left == 0:
                yield fields, 0, b"", True
                left = -1
        if left > 0 and part:
            body = part[:left]
            left -= len(body)
            yield fields, number, body, left == 0
            number += 1


def read_chunks(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Chunk rows of the archives: page_id (text), record_type, refers_to, header_digest, header_bytes, chunk_no, is_last,
    bytes_so_far, sha1_so_far (hex) and, if asked, ``chunk`` (binary)."""
    ship_package(spark)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, uri in zip(frame["path"], frame["store"]):
                store, _ = _filesystem(uri)
                out, held = [], 0
                with store.open_input_stream(path, compression=None) as f:
                    for fields, number, chunk, last in parse(f.read):
                        if number == 0:
                            digest, total = hashlib.sha1(), 0
                        digest.update(chunk)
                        total += len(chunk)
                        refers = fields.get("WARC-Refers-To")
                        out.append((fields["WARC-Record-ID"][10:-1], fields["WARC-Type"], refers and refers[10:-1],
                                    fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"]), number, last, total,
                                    digest.hexdigest(), *((chunk,) if with_payload else ())))
                        held += len(chunk) if with_payload else 0
                        if len(out) >= 2000 or held > 4 * BLOCK:
                            yield pd.DataFrame(out, columns=names)
                            out, held = [], 0
                yield pd.DataFrame(out, columns=names)

    names = ["page_id", "record_type", "refers_to", "header_digest", "header_bytes", "chunk_no", "is_last", "bytes_so_far",
             "sha1_so_far", *["chunk"] * with_payload]
    schema = ("page_id string, record_type string, refers_to string, header_digest string, header_bytes long, chunk_no int, "
              "is_last boolean, bytes_so_far long, sha1_so_far string" + ", chunk binary" * with_payload)
    files = manifest.select("path", "store")
    return files.repartition(max(1, manifest.count())).mapInPandas(load, schema)      # about one archive per task


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record: page_id (text), payload_bytes and payload_digest of the full payload, record_type, refers_to.

    A response's are those of the bytes read; a revisit has none and states the full payload's in its headers.
    A response whose bytes do not match its header's digest fails the job.
    """
    last = read_chunks(spark, manifest, with_payload=False).filter("is_last")

    @F.pandas_udf("string")
    def to_base32(digests: pd.Series) -> pd.Series:
        return digests.map(base32)

    response = F.col("record_type") == "response"
    read = last.withColumn("read_digest", to_base32("sha1_so_far"))
    whole = (F.col("read_digest") == F.col("header_digest")) & (F.col("bytes_so_far") == F.col("header_bytes"))
    digest = F.when(~response | whole, F.col("header_digest")).otherwise(
        F.raise_error(F.concat(F.lit("archive damaged at record "), "page_id")))
    return read.select("page_id", F.when(response, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
                       digest.alias("payload_digest"), "record_type", "refers_to")
