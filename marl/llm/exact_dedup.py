"""Exact dedup through a cuckoo-filter index of live digests.

Texts are equal when identical after all `[\\x20\\x09-\\x0D]` are deleted; of equal texts the row with the
most code points stays, then the smallest doc_id.

Every scan task feeds its rows to a `DigestIndex`, which acts as the map-side combiner: a filter miss is a
new digest, a hit is verified against the stored digests of that bucket: 32 bytes stand for a text, which never
enters the shuffle. What a task holds is bounded (`COMBINE_KEYS`), so a group of copies, however large,
costs the shuffle one row a task and flush. A second index on each digest shard merges these rows; shards are hash
partitions, so no key meets more than one, and are sorted by digest, so that the index hands on what it
holds at the same bound and keeps only the digest that may go on.

Defined results: a null text counts as empty; null and empty texts are one group; a null doc_id sorts after
all others; of rows that repeat in every respect exactly one stays; an empty table gives an empty result;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import common
from marl.llm.cuckoo import CuckooFilter, FilterFull, filter_of

#: Digests that a task holds before it hands them on.
COMBINE_KEYS = 200_000

Best = tuple[int, bool, int, int, int]  # -n_chars, doc_id is null, doc_id, hash of the raw text, row: the least stays

SIGNED = "row long, doc_id long, n_chars long, raw long, digest binary"
GROUP = "digest binary, n long, chars long, keep_id long, raw long, row long"


class DigestIndex:
    """Live digests with the number of their rows and the best row.

    A cuckoo filter stands before the stored digests, which lie in buckets of their leading bytes. A miss
    needs no look at a bucket; a hit is verified there. When the filter overflows it is rebuilt with twice
    the room from the stored digests. With `keep_rows` each digest also stores its live rows, so that `delete`
    can name the next best; without, the index only grows.
    """

    def __init__(self, capacity: int = 1024, keep_rows: bool = False) -> None:
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[int, dict[bytes, list]] = {}
        self.keep_rows = keep_rows
        self.size = 0

    @staticmethod
    def _hash(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def find(self, digest: bytes) -> list | None:
        """[rows, best row, live rows] of a digest, or None."""
        h = self._hash(digest)
        if not self._may_hold(h):
            return None
        return self.buckets.get(h >> 40, {}).get(digest)

    def _may_hold(self, h: int) -> bool:
        table = self.filter.table
        mark = max(h >> 48, 1)
        first = h & (len(table) - 1)
        if mark in table[first].tolist():
            return True
        return mark in table[first ^ int(self.filter._step(np.array([mark], np.uint16))[0])].tolist()

    def insert(self, digest: bytes, best: Best, n: int = 1) -> None:
        entry = self.find(digest)
        if entry is None:
            h = self._hash(digest)
            self.buckets.setdefault(h >> 40, {})[digest] = entry = [0, best, {}]
            self.size += 1
            try:
                self.filter.insert(np.array([h], np.uint64))
            except FilterFull:
                self._resize()
        entry[0] += n
        entry[1] = min(entry[1], best)
        if self.keep_rows:
            entry[2][best] = entry[2].get(best, 0) + n

    def insert_new(self, digests: list[bytes], entries: list[tuple[Best, int]]) -> None:
        """Many digests that the index doesn't hold, distinct, in one step."""
        hashes = np.array([self._hash(d) for d in digests], np.uint64)
        for d, h, (best, n) in zip(digests, hashes.tolist(), entries, strict=True):
            self.buckets.setdefault(h >> 40, {})[d] = [n, best, {best: n} if self.keep_rows else {}]
        self.size += len(digests)
        if self.size > len(self.filter.table) * 3:
            self._resize()
            return
        try:
            self.filter.insert(hashes)
        except FilterFull:
            self._resize()

    def delete(self, digest: bytes, best: Best) -> bool:
        """Takes one live row out; its digest leaves the filter with its last row. False if it isn't there."""
        if not self.keep_rows:
            raise ValueError("deletion needs the live rows; make the index with keep_rows")
        entry = self.find(digest)
        if entry is None or best not in entry[2]:
            return False
        entry[0] -= 1
        entry[2][best] -= 1
        if not entry[2][best]:
            del entry[2][best]
        if entry[2]:
            entry[1] = min(entry[2])
            return True
        h = self._hash(digest)
        del self.buckets[h >> 40][digest]
        if not self.buckets[h >> 40]:
            del self.buckets[h >> 40]
        self.filter.delete(np.array([h], np.uint64))
        self.size -= 1
        return True

    def take(self, digest: bytes) -> list:
        """Takes a digest out with all its rows; its entry."""
        h = self._hash(digest)
        entry = self.buckets[h >> 40].pop(digest)
        self.filter.delete(np.array([h], np.uint64))
        self.size -= 1
        return entry

    def _resize(self) -> None:
        keys = [self._hash(d) for b in self.buckets.values() for d in b]
        self.filter = filter_of(np.array(keys, np.uint64), 2 * len(keys))

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.buckets.values():
            yield from bucket.items()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        digests, chars, raws = [], [], []
        for text in common.as_bytes(batch.column("text")):
            text = text or b""
            digests.append(hashlib.sha256(text.translate(None, common.WHITE_BYTES)).digest())
            chars.append(len(text.decode("utf-8", "replace")))
            raws.append(xxhash.xxh64_intdigest(text) - (1 << 63))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(raws, pa.int64()), pa.array(digests, pa.binary())],
            names=["row", "doc_id", "n_chars", "raw", "digest"],
        )


def _emitted(index: DigestIndex) -> Iterator[pa.RecordBatch]:
    rows = [(d, e[0], -e[1][0], None if e[1][1] else e[1][2], e[1][3], e[1][4]) for d, e in index.items()]
    for at in range(0, len(rows), 20_000):
        part = list(zip(*rows[at : at + 20_000], strict=True))
        kinds = [pa.binary(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=["digest", "n", "chars", "keep_id", "raw", "row"])


def _indexed(batches: Iterator[pa.RecordBatch], bound: int, in_order: bool = False) -> Iterator[pa.RecordBatch]:
    """Feeds (digest, n, chars, keep_id, raw, row) to an index; hands its entries on at the bound and the end.

    Of rows in the order of their digests, a digest is handed on once: the last one met stays, as it may go on.
    """
    index = DigestIndex(4096)
    for batch in common.rows_of(batches):
        new: dict[bytes, tuple[Best, int]] = {}
        for digest, n, chars, keep, raw, row in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "chars", "keep_id", "raw", "row")), strict=True):
            best = (-chars, keep is None, keep or 0, raw, row)
            entry = index.find(digest)
            if entry is not None:
                entry[0] += n
                if best < entry[1]:
                    entry[1] = best
            elif digest in new:
                was, m = new[digest]
                new[digest] = (min(was, best), m + n)
            else:
                new[digest] = (best, n)
        if new:
            index.insert_new(list(new), list(new.values()))
        if index.size > bound:
            held = index.take(digest) if in_order else None
            yield from _emitted(index)
            index = DigestIndex(4096)
            if held:
                index.insert_new([digest], [(held[1], held[0])])
    yield from _emitted(index)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SIGNED rows, written once: the digest of the normalised text and what decides which row stays."""
    common.bounded_batches(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return common.materialise(rows.mapInArrow(_signatures, SIGNED), "digests")


def groups(signed: DataFrame) -> DataFrame:
    """GROUP rows: one for each digest, merged from the combiners by the index of its shard."""
    one = signed.select("digest", F.lit(1).cast("long").alias("n"), F.col("n_chars").alias("chars"), F.col("doc_id").alias("keep_id"), "raw", "row")
    combined = one.mapInArrow(lambda b: _indexed(b, COMBINE_KEYS), GROUP)
    shards = combined.repartition(common.partitions(signed.sparkSession), "digest").sortWithinPartitions("digest")
    return shards.mapInArrow(lambda b: _indexed(b, COMBINE_KEYS, True), GROUP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; see the module's text for edge cases."""
    signed = signatures(docs, id_col, text_col)
    kept = groups(signed).select("digest", F.col("n").alias("group_size"), "keep_id", F.col("row").alias("keep_row"))
    # both sides are exchanged by the digest alone, so a hot digest's rows are split by the skew join of AQE
    return signed.join(kept.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""
}
