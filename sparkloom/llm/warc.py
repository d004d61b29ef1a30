"""WARC archives whose records are compressed one by one against an embedded dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary,
followed by one Zstandard frame per record, so any record can be read from its offset with the
dictionary alone.  The dictionary is trained once from records as they are archived: headers and
payloads of those ``SAMPLE_ROWS`` responses with the smallest hash of the payload, of a longer payload
``SAMPLE_BYTES`` from a place that the hash picks, a bounded sample; too few records for training
serve as raw content.  It only affects size, never content.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page id is the
response and the others are revisit records without payload that name it.  Every payload has exactly
one response, whatever ids its rows have: rows are told apart by payload, id and url.

A payload leaves a task once, for its response; revisits are written from their ids, urls and digests.
Files are named by kind, task and number, rows are sorted within tasks, and a file appears by rename:
a task that runs again writes the same files.  A file closes after ``ROLL`` bytes.

Rows: a null payload is empty; a null url is written without a target; a null id ranks last, is written
empty and read back as null, also as the id that revisits name; of rows with one payload and one id the
one with the smallest url (null last) is the response, of equal rows any one, the others revisit it.
An empty table gives no archive and an empty result.  Only the three named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Stage, new_path, shuffle_width

MAGIC = 0x184D2A5D
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 1000, 16 << 10, 64 << 10
ROLL = 32 << 20
EQUAL = 4096  # equal rows that one task writes
_END = b"\r\n"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; raw content where they are too few to train on."""
    full = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, full).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(full)[:DICT_BYTES]


def record(kind: str, page: str, url: str | None, payload: bytes, digest: str, size: int, refers: str) -> bytes:
    """One record; ``digest`` and ``size`` are the full payload's, which a revisit does not hold."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {url}".replace("\r", " ").replace("\n", " ")] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return _END.join(x.encode() for x in head) + _END * 2 + body + _END * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(_END * 2)
    fields = dict(x.decode().split(": ", 1) for x in head.split(_END)[1:])
    return fields, rest[: int(fields["Content-Length"])]


def dictionary_frame(data: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(data)) + data


def records(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed from its own frame.

    A frame is fed in steps that double, so that what is handed over past its end, and is copied back,
    is no longer than the frame: reading is linear in the archive.
    """
    at, plain = 0, None
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == MAGIC:
        n = struct.unpack_from("<I", archive, 4)[0]
        plain, at = zstandard.ZstdCompressionDict(archive[8 : 8 + n]) if n else None, 8 + n
    tool = zstandard.ZstdDecompressor(dict_data=plain)
    view = memoryview(archive)
    while at < len(archive):
        one, out, step = tool.decompressobj(), [], 512
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends inside a record")
            fed = view[at : at + step]
            out.append(one.decompress(fed))
            at, step = at + len(fed), step * 2
        at -= len(one.unused_data)
        yield b"".join(out)


def _local(uri: str) -> str:
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise ValueError(f"the shared folder must be mounted on the executors, not {u.scheme}:")
    return u.path


def _writer(target: str, kind: str, words):
    """Arrow batches (id, url, html, digest, size, first) to archive files; a row per file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tool = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(words.value) if words.value else None)
        buffer, count, number, done = bytearray(), 0, 0, []
        named = lambda x: "" if x is None else str(x)

        def close() -> None:
            nonlocal buffer, count, number
            name = f"{target}/{kind}-{part:06d}-{number:05d}.warc.zst"
            os.makedirs(target, exist_ok=True)
            with open(f"{name}.{TaskContext.get().taskAttemptId()}.tmp", "wb") as f:
                f.write(dictionary_frame(words.value) + buffer)
            os.replace(f.name, name)
            done.append((name, count, len(buffer)))
            buffer, count, number = bytearray(), 0, number + 1

        for batch in batches:
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                buffer += tool.compress(record(kind, named(r["id"]), r["url"], (r["html"] or "").encode(), digest, r["size"], named(r["first"])))
                count += 1
                if len(buffer) >= ROLL:
                    close()
        if count:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["file", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0) -> DataFrame:
    """Write all pages below ``folder``, a path that all executors mount; (file, records, bytes) per archive."""
    spark = pages.sparkSession
    stage = Stage(spark, "warc")
    html = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"))
    place = F.xxhash64(F.col("id").isNull(), "id", F.col("url").isNull(), "url").alias("place")  # equal for rows of one id and url
    rows = rows.select("*", place)
    hashed = rows.select("id", "url", "place", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("same"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    what = ["id", "url", "place", "size", "same", "digest"]
    seen = stage.table(hashed.groupBy(*what).agg(F.count(F.lit(1)).alias("n")), "seen")
    rank = F.struct(F.col("id").isNull().alias("z"), "id", F.col("url").isNull().alias("y"), "url")
    best = stage.table(seen.where(F.col("size") >= least).groupBy("same").agg(F.min(F.struct(rank.alias("r"), "place", "size", "digest")).alias("x")).select("same", "x.r.id", "x.r.url", "x.place", "x.size", "x.digest"), "best")
    small = seen.where(F.col("size") < least)
    # Every other row of a payload, equal ones counted, is a revisit; it needs no payload.
    named = best.select("same", F.col("id").alias("first"), F.col("url").alias("first_url"))
    is_best = F.col("id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    others = seen.where(F.col("size") >= least).join(named, "same").withColumn("n", F.col("n") - is_best.cast("long"))
    others = _times(others.where("n > 0").select(*what, "first", "n"), shuffle_width(spark))
    words = spark.sparkContext.broadcast(train_dictionary(_sample(rows, best.unionByName(small.select(*best.columns)))))
    target = _local(folder)
    out = "file string, records long, bytes long"
    order = ["id", "url", "same"]
    # Of each payload one leaves a task, whatever number of rows has it there.
    whole = rows.select(rank.alias("r"), "html", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("same"))
    found = whole.where(F.col("size") >= least).groupBy("same").agg(F.min("r").alias("r"), F.first("html").alias("html"), F.first("size").alias("size"))
    if least:
        found = found.unionByName(whole.where(F.col("size") < least))
    found = found.select("r.id", "r.url", "html", F.sha1(F.col("html").cast("binary")).alias("digest"), "size", "same")
    none = F.lit(None)
    responses = found.withColumn("first", none.cast(pages.schema[id_col].dataType)).sortWithinPartitions(*order)
    revisits = others.withColumn("html", none.cast("string")).sortWithinPartitions(*order)
    cols = ["id", "url", "html", "digest", "size", "first"]
    files = stage.table(responses.select(*cols).mapInArrow(_writer(target, "response", words), out), "manifest")
    more = stage.table(revisits.select(*cols).mapInArrow(_writer(target, "revisit", words), out), "manifest-revisits")
    stage.drop("seen", "best")
    return files.unionByName(more)


def _times(df: DataFrame, width: int) -> DataFrame:
    """Each row ``n`` times; a large ``n`` is dealt out over many tasks in blocks of ``EQUAL``."""
    many = df.where(F.col("n") > EQUAL)
    blocks = many.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {EQUAL}"))))
    blocks = blocks.repartition(width, "same", "place", "k").withColumn("n", F.least(F.lit(EQUAL), F.col("n") - F.col("k") * EQUAL)).drop("k")
    return df.where(F.col("n") <= EQUAL).unionByName(blocks).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("again", "n")


def _sample(rows: DataFrame, responses: DataFrame) -> list[bytes]:
    """At most SAMPLE_ROWS records as they are archived, of at most about SAMPLE_BYTES each."""
    keys = responses.select("id", "url", "place", "size", "same", "digest").orderBy("same", "id", "url").limit(SAMPLE_ROWS).select("place", "same", "size", "digest")
    raw = F.col("html").cast("binary")
    start = F.pmod(F.conv(F.substring("same", 1, 8), 16, 10).cast("long"), F.greatest(F.lit(1), F.col("size") - SAMPLE_BYTES + 1)) + 1
    chunk = F.substring(raw, start.cast("int"), F.lit(SAMPLE_BYTES)).alias("chunk")
    near = rows.join(F.broadcast(keys.select("place").distinct()), "place", "left_semi").withColumn("same", F.sha2("html", 256))
    found = near.join(F.broadcast(keys), ["place", "same"]).select("id", "url", "size", "digest", "same", chunk)
    found = found.groupBy("same", "id", "url", "size", "digest").agg(F.min("chunk").alias("chunk"))
    name = lambda d: base64.b32encode(bytes.fromhex(d)).decode()
    return [record("response", "" if r["id"] is None else str(r["id"]), r["url"], bytes(r["chunk"]), name(r["digest"]), r["size"], "") for r in found.orderBy("same", "id", "url").collect()]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed from the payload read; a mismatch is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                out, held = [], 0
                for raw in records(content.as_py()):
                    f, body = parse(raw)
                    digest, n = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
                    if f["WARC-Type"] == "response" and (payload_digest(body) != digest or len(body) != n):
                        raise ValueError(f"record {f['WARC-Record-ID']} is damaged")
                    place = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
                    out.append((place(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), body, n, digest, f["WARC-Type"], place(f.get("WARC-Refers-To"))))
                    held += len(body)
                    if held > 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a fresh folder of the shared space and read the archives back."""
    spark = pages.sparkSession
    folder = new_path(spark, "archives")
    files = write_archives(pages, folder)
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
