"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

A line's key is the line with all `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z lower-cased. A key of at
least `MIN_CHARS` code points that at least `MIN_DOCS` documents hold loses all its lines except in the
largest doc_id that holds it. Keys travel as 128-bit hashes.

State of an index, all tables in the shared folder, each change a new part beside the old ones:
  postings (doc_id, k1, k2)              a row for each key of a document; what makes deletion possible
  gone     (doc_id)                      deleted documents; holds for the postings written before it
  counts   (k1, k2, n, max_doc)          exact reference counts of the keys that a change touched; the last part holds
  filters  (shard, size, slots, data)    cuckoo filters of the shards that a change touched; the last part holds
A shard's filter holds its shared keys, those that `MIN_DOCS` documents or more have. `insert` adds the keys whose
count reaches that, `delete` takes out those whose count falls below it, so filters and tables after a
deletion are those of an index that never held the document. A filter without room for a change is built
anew with twice the room from the stored counts; should a key find no place in one with room, the shard goes
without filter, all its probes are verified, and the next change of the shard builds it again.

A probe streams each shard's postings through its stored filter and verifies hits against the exact
counts. Keys that alone would fill more than an average partition are probed from a broadcast instead: as
counts sum to the postings, there are fewer of them than partitions, so that broadcast has a proven bound.

Defined results: a document is a row. A null or empty text is one empty line; rows that repeat a doc_id count
each, and are kept or dropped alike; a null doc_id counts as a document but is below every other;
deleting a doc_id takes all its rows out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import common
from marl.llm.cuckoo import LOAD, CuckooFilter, FilterFull, filter_of

MIN_CHARS, MIN_DOCS = 40, 5

POSTING = "doc_id long, k1 long, k2 long"
FILTER = "shard int, size long, slots long, data binary"
#: Shards of an index for each shuffle partition that it is made with.
SHARDS = 4


def key_of(line: bytes) -> bytes:
    return line.strip(common.WHITE_BYTES).lower()  # of bytes, lower() changes A-Z alone


def _long_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, None if the key is too short to count."""
    key = key_of(line)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        ids, keys = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.as_bytes(batch.column("text")), strict=True):
            own = {_long_key(line, min_chars) for line in (text or b"").split(b"\n")}
            own.discard(None)
            ids += [doc_id] * len(own)
            keys += own
        k = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["doc_id", "k1", "k2"])


def postings(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    common.bounded_batches(docs.sparkSession)
    return common.texts(docs, id_col, text_col).mapInArrow(lambda b: _postings(b, min_chars), POSTING)


def counts(posted: DataFrame) -> DataFrame:
    """The exact reference counts (k1, k2, n, max_doc)."""
    return posted.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("max_doc"))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the column `shard`, which they are sorted by, changes."""
    for batch in common.rows_of(batches):
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield int(shards[at]), batch.slice(at, end - at)


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _refiltered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, op, h, data), sorted by shard, the shards' new filters: op 0 is the old one, 1 adds h, -1 takes it out."""

    def made(shard: int, old: bytes | None, op: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        new, lost = h[op == 1].view(np.uint64), h[op == -1].view(np.uint64)
        sieve = filter_of(new, 2 * len(new)) if old is None else CuckooFilter.from_bytes(old)
        try:
            if old is not None:
                sieve.insert(new)
            sieve.delete(lost)
            row = [shard, sieve.size, sieve.table.size, sieve.to_bytes()]
        except FilterFull:
            row = [shard, 0, 0, None]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "size", "slots", "data"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    now, old = None, None
    for shard, rows in _by_shard(batches):
        if shard != now:
            if now is not None:
                yield made(now, old, *(np.concatenate(x) for x in zip(*held, strict=True)))
            held, now, old = [], shard, None
        op = _long(rows, "op")
        base = np.flatnonzero(op == 0)
        if len(base):
            old = rows.column("data")[int(base[0])].as_py()
        held.append((op, _long(rows, "h")))
    if now is not None:
        yield made(now, old, *(np.concatenate(x) for x in zip(*held, strict=True)))


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, part, doc_id, k1, k2, max_doc, data) sorted by shard and part, part 0 being the shard's filter,
    1 its shared keys and 2 postings: the postings to drop.
    """
    now, held, table, sieve = None, [], None, None
    for shard, rows in _by_shard(batches):
        if shard != now:
            now, held, table, sieve = shard, [], None, None
        part = _long(rows, "part")
        ends = np.searchsorted(part, [0, 1, 2], "right")
        if ends[0] and (data := rows.column("data")[0].as_py()) is not None:
            sieve = CuckooFilter.from_bytes(data)
        if ends[1] > ends[0]:
            known = rows.slice(ends[0], ends[1] - ends[0])
            held.append(tuple(_long(known, c).astype(np.int64) for c in ("k1", "k2", "max_doc")))
        asked = rows.slice(ends[1])
        if not asked.num_rows or not held:
            continue
        if table is None:
            k1, k2, most = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((k2, k1))
            table = k1[order], k2[order], most[order]
        yield from _dropped(sieve, table, _long(asked, "k1").astype(np.int64), _long(asked, "k2").astype(np.int64), asked.column("doc_id"))


def _dropped(sieve, table, k1: np.ndarray, k2: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    hit = np.arange(len(k1)) if sieve is None else np.flatnonzero(sieve.contains((k1 ^ k2).view(np.uint64)))
    if not len(hit):
        return
    t1, t2, most = table
    a, b = np.searchsorted(t1, k1[hit], "left"), np.searchsorted(t1, k1[hit], "right")
    at = a.copy()
    for _ in range(int((b - a).max(initial=0)) - 1):  # first halves that two keys share
        at += (at < b - 1) & (t2[np.minimum(at, len(t2) - 1)] != k2[hit])
    sure = (at < b) & (t2[np.minimum(at, len(t2) - 1)] == k2[hit])
    hit, at = hit[sure], at[sure]
    own = ids.take(pa.array(hit))
    null = np.asarray(own.is_null())
    less = null | (own.fill_null(0).to_numpy(zero_copy_only=False) < most[at])
    if less.any():
        yield pa.RecordBatch.from_arrays([own.filter(pa.array(less)), pa.array(k1[hit][less]), pa.array(k2[hit][less])], names=["doc_id", "k1", "k2"])


def _shard(shards: int) -> Column:
    return F.pmod("k1", F.lit(shards)).cast("int").alias("shard")


def drops(posted: DataFrame, counted: DataFrame, filters: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """The postings whose lines go. `posted` and `counted` rest on written tables: each is read more than once."""
    spark = posted.sparkSession
    often = counted.where((F.col("n") >= min_docs) & F.col("max_doc").isNotNull())
    total = counted.agg(F.sum("n")).first()[0] or 0
    n = common.partitions(spark)
    many = max(min_docs, total // n + 1)  # fewer than n keys can be this frequent
    hot = often.where(F.col("n") >= many).select("k1", "k2", F.col("max_doc").alias("hot_doc"))
    joined = posted.join(F.broadcast(hot), ["k1", "k2"], "left")
    below = F.col("doc_id").isNull() | (F.col("doc_id") < F.col("hot_doc"))
    from_hot = joined.where(F.col("hot_doc").isNotNull() & below).select("doc_id", "k1", "k2")
    none, no_data = F.lit(None).cast("long"), F.lit(None).cast("binary").alias("data")
    rest = joined.where(F.col("hot_doc").isNull()).select(_shard(shards), F.lit(2).alias("part"), "doc_id", "k1", "k2", none.alias("max_doc"), no_data)
    known = often.where(F.col("n") < many).select(_shard(shards), F.lit(1).alias("part"), none.alias("doc_id"), "k1", "k2", "max_doc", no_data)
    zero = F.lit(0).cast("long")
    stored = filters.select("shard", F.lit(0).alias("part"), none.alias("doc_id"), zero.alias("k1"), zero.alias("k2"), none.alias("max_doc"), "data")
    probe = stored.unionByName(known).unionByName(rest).repartition(n, "shard").sortWithinPartitions("shard", "part")
    return from_hot.unionByName(probe.mapInArrow(_probed, POSTING))


def _cleaned(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Drops each row's `gone` keys from its text."""
    for batch in common.rows_of(batches):
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(common.as_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            n_lines.append(len(lines))
            if gone:
                bad = set(gone)
                lines = [x for x in lines if _long_key(x, min_chars) not in bad]
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(b"\n".join(lines))
        out = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept, pa.binary())}
        names = [n for n in batch.schema.names if n not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out.values()], names=[*names, *out])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()]
        yield batch.select(["doc_id", "n_lines", "n_dropped"]).append_column("kept_sha256", pa.array(digests, pa.string()))


def _with_gone(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """`rows` (doc_id, text, ...) with the array `gone` of 128-bit keys, through a join on doc_id that takes nulls as equal."""
    half = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    packed = gone.groupBy("doc_id").agg(F.collect_set(F.concat(half("k1"), half("k2"))).alias("gone"))
    return rows.join(packed.withColumnRenamed("doc_id", "gone_id").hint("merge"), F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").drop("gone_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _latest(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of tables in the order that they were written, each key's last row."""
    if len(parts) == 1:
        return parts[0]
    rest = [c for c in parts[0].columns if c not in keys]
    dated = _union([p.withColumn("version", F.lit(i)) for i, p in enumerate(parts)])
    last = dated.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select(*keys, *(F.col("last").getField(c).alias(c) for c in rest))


class LineIndex:
    """An incremental index. A change gives a new index that shares the old one's tables and adds what it changed."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> None:
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.shards = shards or SHARDS * common.partitions(spark)
        self.parts: list[tuple[str, DataFrame]] = []  # ("held" | "gone", table) in the order of changes
        self.counts: list[DataFrame] = []
        self.sieves: list[DataFrame] = []

    @property
    def posted(self) -> DataFrame:
        """(doc_id, k1, k2) of the documents held now."""
        live, gone = [], None
        for kind, table in reversed(self.parts):
            if kind == "gone":
                gone = table if gone is None else gone.unionByName(table).distinct()
            else:
                live.append(table if gone is None else table.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti"))
        return _union(live)

    @property
    def counted(self) -> DataFrame:
        """(k1, k2, n, max_doc) of the keys held now."""
        return _latest(self.counts, ["k1", "k2"]).where("n > 0")

    @property
    def filters(self) -> DataFrame:
        """(shard, size, slots, data) of the shards that have shared keys, or had some."""
        return _latest(self.sieves, ["shard"])

    def _changed(self, kind: str, table: DataFrame, changed: DataFrame) -> LineIndex:
        """The index after a change that gave `changed` (k1, k2, n, max_doc, was) for the keys that it touched."""
        made = LineIndex(self.spark, self.min_chars, self.min_docs, self.shards)
        changed = common.materialise(changed, "counts")
        made.parts, made.counts = [*self.parts, (kind, table)], [*self.counts, changed.drop("was")]
        crossed = F.when((F.col("was") < self.min_docs) & (F.col("n") >= self.min_docs), 1).when((F.col("was") >= self.min_docs) & (F.col("n") < self.min_docs), -1)
        hashed = F.col("k1").bitwiseXOR(F.col("k2")).alias("h")
        crossing = changed.select(_shard(self.shards), crossed.alias("op"), hashed).where("op is not null")
        if not self.sieves:
            rows = crossing.withColumn("data", F.lit(None).cast("binary"))
        else:
            added = crossing.groupBy("shard").agg(F.count(F.when(F.col("op") == 1, 1)).alias("added"))  # one row a shard at most, and so are the next
            full = F.col("data").isNull() | (F.col("size") + F.col("added") > F.col("slots") * LOAD)
            state = common.materialise(added.join(self.filters, "shard", "left").select("shard", "data", full.alias("full")), "filters")
            whole = made.counted.where(F.col("n") >= self.min_docs).select(_shard(self.shards), F.lit(1).alias("op"), hashed)
            anew = whole.join(F.broadcast(state.where("full").select("shard")), "shard")
            kept = crossing.join(F.broadcast(state.where("not full").select("shard")), "shard")
            old = state.where("not full").select("shard", F.lit(0).alias("op"), F.lit(0).cast("long").alias("h"), "data")
            rows = old.unionByName(anew.unionByName(kept).withColumn("data", F.lit(None).cast("binary")))
        spread = rows.repartition(common.partitions(self.spark), "shard").sortWithinPartitions("shard")
        made.sieves = [*self.sieves, common.materialise(spread.mapInArrow(_refiltered, FILTER), "filters")]
        return made

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The index with more documents: their counts are added to those of the keys that they hold."""
        new = common.materialise(postings(docs, self.min_chars, id_col, text_col), "postings")
        own = counts(new)
        if not self.counts:
            return self._changed("held", new, own.withColumn("was", F.lit(0).cast("long")))
        before = self.counted.select("k1", "k2", F.col("n").alias("was"), F.col("max_doc").alias("most"))
        changed = own.join(before, ["k1", "k2"], "left").withColumn("was", F.coalesce("was", F.lit(0).cast("long")))
        return self._changed("held", new, changed.select("k1", "k2", (F.col("n") + F.col("was")).alias("n"), F.greatest("max_doc", "most").alias("max_doc"), "was"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without these documents (column doc_id): counts of the keys they held are taken anew from what is left."""
        gone = common.materialise(doc_ids.select(F.col("doc_id").cast("long").alias("gone_id")).distinct(), "gone")
        same = F.col("doc_id").eqNullSafe(F.col("gone_id"))
        touched = common.materialise(self.posted.join(gone, same, "left_semi").select("k1", "k2").distinct(), "touched")
        redone = counts(self.posted.join(gone, same, "left_anti").join(touched, ["k1", "k2"], "left_semi"))
        before = self.counted.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", F.col("n").alias("was"))
        changed = before.join(redone, ["k1", "k2"], "left")
        return self._changed("gone", gone, changed.select("k1", "k2", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "max_doc", "was"))

    def compact(self) -> LineIndex:
        """The same index in one part a table, for when changes have added up."""
        made = LineIndex(self.spark, self.min_chars, self.min_docs, self.shards)
        made.parts = [("held", common.materialise(self.posted, "postings"))]
        made.counts, made.sieves = [common.materialise(self.counted, "counts")], [common.materialise(self.filters, "filters")]
        return made

    def drops(self) -> DataFrame:
        """(doc_id, k1, k2): the keys whose lines a document loses."""
        return drops(self.posted, self.counted, self.filters, self.shards, self.min_docs)

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept) of documents that the index holds; `kept` is UTF-8."""
        rows = _with_gone(common.texts(docs, id_col, text_col), self.drops())
        min_chars = self.min_chars
        return rows.mapInArrow(lambda b: _cleaned(b, min_chars), "doc_id long, n_lines long, n_dropped long, kept binary")

    def clean_rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of `docs`, all columns, with the lines that go taken out of the text (null: empty)."""
        rest = [c for c in docs.columns if c != text_col]
        packed = F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), packed)
        rows = _with_gone(rows, self.drops())
        min_chars, kind = self.min_chars, rows.schema["rest"].dataType.simpleString()
        out = rows.mapInArrow(lambda b: _cleaned(b, min_chars), f"doc_id long, rest {kind}, n_lines long, n_dropped long, kept binary")
        text = F.decode("kept", "UTF-8").alias(text_col)
        return out.select(*(text if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of `docs`; see the module's text for edge cases."""
    return LineIndex(docs.sparkSession, min_chars, min_docs).insert(docs, id_col, text_col).clean(docs, id_col, text_col)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.table(spark, sf_dir, "documents")).mapInArrow(_digested, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLES = {
    "op2_line_dedup": """
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM rows),
keyed AS (
  SELECT r, doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
often AS (
  SELECT k, max(doc_id) AS most FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT r) >= 5),
marked AS (
  SELECT keyed.*, most IS NOT NULL AND (doc_id IS NULL OR doc_id < most) AS gone
  FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
}
