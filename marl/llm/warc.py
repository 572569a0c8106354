"""WARC archives: one gzip member a record, written and read sequentially.

Writing. Payload digests and lengths alone are grouped: of records whose equal payloads have at least
`min_bytes` bytes, the one with the smallest page_id is a response and the others revisit it. These decisions
are joined to the pages by page_id and digest, both of them, so a payload that a third of the pages share
meets in no task. Each task streams its records into archives of about `ROLL` bytes in the shared folder, under a
temporary name until an archive is complete and then under one that no other attempt has. The manifest, written
by Spark, lists the archives of the attempts that were committed; whatever lost or repeated tasks left
beside them is never read.

Reading. The manifest's archives are dealt over tasks by name. A task opens each as a stream and reads it front to
back, `PIECE` bytes at a time: members are decompressed piece by piece, headers end at an empty line,
Content-Length frames the block, and block and payload digests are verified. The first bad byte raises
`BadArchive`. A task holds one record and a batch of rows. `broken_revisits` holds revisits against their responses.

Archives are written and read through Arrow's file systems: local, HDFS, S3 (s3a and s3n too), GCS and ABFS.

Block: an HTTP header and the payload; a revisit has the header alone, whose Content-Length still says how long
the full payload is, and WARC-Payload-Digest its digest.

Defined results: a null payload is empty; an empty table writes no archive and reads as no rows; a row with a
null page_id revisits a record of equal payload that has one, and otherwise is a response; rows that repeat
page_id and payload are all written, alike; a null URL leaves the header out; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import common

MIN_BYTES = 0
LEVEL = 4
#: Compressed bytes that the reader takes at a time, and payload bytes that the writer compresses at a time.
PIECE = 1 << 16
#: Compressed bytes after which a task begins another archive.
ROLL = 1 << 30
#: Hadoop's names of schemes that Arrow has others for.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadArchive(Exception):
    """An archive whose framing or digests don't hold."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """The parts of one record, uncompressed; with refers_to it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = b"" if refers_to is not None else payload
    block = hashlib.sha1(http)
    block.update(body)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base64.b32encode(block.digest()).decode()}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    yield "\r\n".join(head).encode()
    yield http
    for at in range(0, len(body), PIECE):
        yield body[at : at + PIECE]
    yield b"\r\n\r\n"


def member(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts as one gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for part in parts:
        if out := packer.compress(part):
            yield out
    yield packer.flush()


def _uri(folder: str) -> str:
    """Arrow's name of a folder that Spark names."""
    scheme, colon, rest = folder.partition(":")
    return f"file:///{(rest if colon else folder).lstrip('/')}" if scheme == "file" or not colon else SCHEMES.get(scheme, scheme) + ":" + rest


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder that Spark names, and the folder's path there."""
    return fs.FileSystem.from_uri(_uri(folder))


class _Archives:
    """The archives of one task."""

    def __init__(self, folder: str, roll: int) -> None:
        self.store, self.root = _store(folder)
        self.store.create_dir(self.root, recursive=True)
        self.roll, self.out, self.records, self.size = roll, None, 0, 0

    def add(self, parts: Iterator[bytes]) -> bool:
        """Writes a record; whether the archive is now large enough."""
        if self.out is None:
            self.draft, self.records, self.size = f"{self.root}/draft-{uuid.uuid4().hex}", 0, 0
            self.out = self.store.open_output_stream(self.draft, compression=None)
        for part in member(parts):
            self.size += len(part)
            self.out.write(part)
        self.records += 1
        return self.size >= self.roll

    def close(self) -> Iterator[pa.RecordBatch]:
        """The archive's line of the manifest, if one is open."""
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.store.move(self.draft, f"{self.root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([self.records], pa.int64()), pa.array([self.size], pa.int64())], names=["archive", "records", "bytes"])


def _written(batches: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Streams (page_id, url, payload, refers_to) to this task's archives; gives their lines of the manifest."""
    made = _Archives(folder, roll)
    for batch in common.rows_of(batches):
        for page_id, url, payload, refers_to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), common.as_bytes(batch.column("payload")), batch.column("refers_to").to_pylist(), strict=True):
            if made.add(record_bytes(page_id, url, payload or b"", refers_to)):
                yield from made.close()
    yield from made.close()


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, roll: int = ROLL, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[str, DataFrame]:
    """Writes the archives; their folder and manifest."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    known = common.materialise(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).distinct(), "payloads")
    shared = known.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("ids")).where("ids > 1 and first is not null").select("digest", "first")
    revisits = known.join(shared.hint("merge"), "digest").where(F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))).select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), F.col("first").alias("refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    ready = rows.join(revisits.hint("merge"), same, "left").select("page_id", "url", "payload", "refers_to")
    folder = common.scratch(spark, "warc")
    _store(folder)  # fails here and now if Arrow has no such file system
    ready.mapInArrow(lambda b: _written(b, folder, roll), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder, manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, records, bytes) of a folder's complete archives."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members of a stream of bytes, each read piece by piece."""
    packer, parts, fed = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            fed = True
            parts.append(packer.decompress(piece))
            if not packer.eof:
                break
            yield b"".join(parts)
            piece, packer, parts, fed = packer.unused_data, zlib.decompressobj(31), [], False
    if fed:
        raise BadArchive("the archive ends within a member")


def _headers(data: bytes, first: str) -> tuple[dict[str, str], int]:
    """Headers by lower-case name and the offset behind them."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(first.encode()):
        raise BadArchive(f"no {first} header")
    lines = data[:end].decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, end + 4


def parse(data: bytes) -> dict:
    """One record, its framing and digests verified."""
    head, at = _headers(data, "WARC/1.")
    n = int(head.get("content-length", -1))
    block = data[at : at + n]
    if n < 0 or len(block) != n or data[at + n :] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't frame the block")
    if head.get("warc-block-digest") != "sha1:" + base32_sha1(block):
        raise BadArchive("the block has another digest")
    http, body = _headers(block, "HTTP/1.")
    payload, kind, digest = block[body:], head["warc-type"], head.get("warc-payload-digest", "")
    if kind == "response" and (digest != "sha1:" + base32_sha1(payload) or len(payload) != int(http["content-length"])):
        raise BadArchive("the payload has another digest or length")
    uri = head.get("warc-target-uri")
    return {
        "page_id": _page(head.get("warc-record-id")),
        "target_uri": None if uri is None else unquote(uri),
        "payload": payload if kind == "response" else None,
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest.removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")),
    }


_RECORD_TYPES = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _pieces(stream: pa.NativeFile) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, root = _store(folder)
    for batch in common.rows_of(batches):
        for name in batch.column("archive").to_pylist():
            rows, held = [], 0
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for data in members(_pieces(stream)):
                    rows.append(parse(data) if payloads else parse(data) | {"payload": None})
                    held += len(rows[-1]["payload"] or b"") + 200
                    if held > common.BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD_TYPES)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _RECORD_TYPES)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the archives in a folder's manifest; a manifest without archives gives none."""
    common.bounded_batches(spark)
    names = manifest(spark, folder).select("archive").repartition(common.partitions(spark))
    return names.mapInArrow(lambda b: _read(b, folder, payloads), RECORD)


def broken_revisits(records: DataFrame) -> DataFrame:
    """The revisits of RECORD rows that no response with their payload digest has the page_id for."""
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("of"), F.col("payload_digest").alias("digest")).distinct()
    same = (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("digest"))
    return records.where("record_type = 'revisit'").join(responses.hint("merge"), same, "left_anti")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = write_archives(common.table(spark, sf_dir, "pages"))
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS h FROM p),
r AS (SELECT *, page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM f)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, ((j // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (j % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""
}
