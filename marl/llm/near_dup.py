"""SimHash near-dedup with pivot distance tables.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, every three-word shingle joined by spaces (fewer
words: the whole sequence) hashed by XXH64 with seed 42; a bit is 1 if set in over half of the hashes; no
words give zero. Fingerprints link at `RADIUS` or fewer differing bits; components of links are groups.

Search, over distinct fingerprints only, so that copies cost nothing:
1. The pivot table holds each fingerprint's Hamming distances to `PIVOTS` reference fingerprints and is
   written once. For links, no distance may differ by more than the radius.
2. Unit references (one bit set) and the zero reference give exact coordinates: the difference of the
   distances to both is one bit. Four blocks of 16 coordinates: of fingerprints within three bits one
   block agrees, and of the other 48 one of four blocks of 12. The 16 combinations are the buckets (28 bits);
   a radius r takes r + 1 blocks twice.
3. In a bucket, rows sorted by their first pivot distance are compared while it differs by the radius at
   most; pairs whose maximum coordinate difference over all pivots exceeds the radius are discarded;
   survivors are verified on the fingerprints. Buckets above `DENSE` rows are divided again by the blocks
   of the coordinates left, which loses no pair for the same reason, so a dense bucket never costs its square.
4. A bucket's links are reduced to a spanning forest before they leave the task, so no group emits its pairs.

Defined results: null texts count as empty; a null doc_id is never a component's id unless all are null;
repeated rows share a component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import common, votes
from marl.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Reference fingerprints of the table; 8 distances share one column.
PIVOTS = 16
#: Rows of a bucket above which it is divided again.
DENSE = 2048
#: Rows of the largest bucket that a task may gather; a task holds twice as many rows at most, in whole buckets.
GATHER = 400_000

_digest = xxhash.xxh64_intdigest


def references() -> np.ndarray:
    return np.array([_digest(b"reference %d" % i, SEED) for i in range(PIVOTS)], np.uint64)


def shingles(text: bytes | None, width: int = SHINGLE) -> list[bytes]:
    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII white-space characters
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprints_of(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """The fingerprints of some texts; hashes are gathered up to a bound, then voted on together."""
    done, hashes, sizes, held = [], [], [], 0
    for text in texts:
        own = np.array([_digest(s, SEED) for s in shingles(text, width)], np.uint64)
        hashes.append(own)
        sizes.append(len(own))
        held += len(own)
        if held > 1 << 17:
            done.append(votes.majority(np.concatenate(hashes), np.array(sizes)))
            hashes, sizes, held = [], [], 0
    if sizes:
        done.append(votes.majority(np.concatenate(hashes), np.array(sizes)))
    return np.concatenate(done) if done else np.empty(0, np.uint64)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint in the place of the text."""
    for batch in common.rows_of(batches):
        fp = fingerprints_of(common.as_bytes(batch.column("text")))
        rest = [c for c in batch.schema.names if c != "text"]
        yield batch.select(rest).append_column("fp", pa.array(fp.view(np.int64)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long; with `hashed` also `text_hash` before it, for whoever must tell texts apart."""
    common.bounded_batches(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col)
    if hashed:
        rows = rows.select("doc_id", _text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(_fingerprinted, "doc_id long, " + "text_hash long, " * hashed + "fp long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


# -- the search ------------------------------------------------------------------------------------------


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """`bits` in n runs of nearly equal length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_masks(radius: int) -> list[tuple[int, list[int]]]:
    """For each kind of bucket: its number and the bits that agree in it."""
    made, everything = [], list(range(64))
    for outer in blocks(everything, radius + 1):
        rest = [b for b in everything if b not in set(outer)]
        made += [outer + inner for inner in blocks(rest, radius + 1)]
    return list(enumerate(made))


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the distances to the references, eight to a long."""
    refs = references()
    for batch in common.rows_of(batches):
        fp = batch.column("fp").to_numpy().view(np.uint64)
        far = np.ascontiguousarray(np.stack([votes.hamming(fp, r) for r in refs], axis=1).astype(np.uint8)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("fp"), *(pa.array(far[:, i].copy()) for i in range(far.shape[1]))], names=["fp", "far0", "far1"])


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, far0, far1): the distinct fingerprints with their distances to the references, written once."""
    return common.materialise(fps.select("fp").distinct().mapInArrow(_tabled, "fp long, far0 long, far1 long"), "pivots")


def _pairs(key: np.ndarray, fp: np.ndarray, far: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked positions among rows sorted by (key, first distance)."""
    found, at, n = [], np.arange(len(fp)), len(fp)
    near = far[:, 0]
    step = 1
    while len(at):
        at = at[at + step < n]
        at = at[(key[at] == key[at + step]) & (near[at + step] - near[at] <= radius)]
        if not len(at):
            break
        other = at + step
        close = np.abs(far[at] - far[other]).max(axis=1) <= radius
        a, b = at[close], other[close]
        sure = votes.hamming(fp[a], fp[b]) <= radius
        found.append((a[sure], b[sure]))
        step += 1
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each position's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def links_in(key: np.ndarray, kind: np.ndarray, fp: np.ndarray, far: np.ndarray, masks: list[list[int]], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprint, fingerprint) links that connect what is linked in each bucket. `far` is a signed array of distances."""
    order = np.lexsort((far[:, 0], key, kind))
    key, kind, fp, far = key[order], kind[order], fp[order], far[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]))
    size = np.diff(np.append(new, len(key)))
    bucket = np.repeat(np.arange(len(new)), size)
    small = np.repeat((size > 1) & (size <= DENSE), size)
    if small.any():
        yield from _linked(bucket[small], fp[small], far[small], radius)
    for i in np.flatnonzero(size > DENSE):
        rows = slice(new[i], new[i] + size[i])
        agreed = set(masks[kind[new[i]]])
        yield from _divided(fp[rows], far[rows], [b for b in range(64) if b not in agreed], radius)


def _linked(bucket: np.ndarray, fp: np.ndarray, far: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    root = _forest(len(fp), *_pairs(bucket, fp, far, radius))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    if len(moved):
        yield fp[moved], fp[root[moved]]


def _divided(fp: np.ndarray, far: np.ndarray, bits: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A dense bucket, by the blocks of the bits that may still differ."""
    if len(bits) <= radius:  # any two rows are within the radius
        yield fp[1:], np.full(len(fp) - 1, fp[0])
        return
    for own in blocks(bits, radius + 1):
        key = fp & np.uint64(mask_of(own))
        order = np.lexsort((far[:, 0], key))
        k, f, d = key[order], fp[order], far[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(new, len(k)))
        small = np.repeat((size > 1) & (size <= DENSE), size)
        if small.any():
            yield from _linked(k[small], f[small], d[small], radius)
        taken = set(own)
        for i in np.flatnonzero(size > DENSE):
            rows = slice(new[i], new[i] + size[i])
            yield from _divided(f[rows], d[rows], [b for b in bits if b not in taken], radius)


def _bits_of(mask: int) -> list[int]:
    return [b for b in range(64) if mask >> b & 1]


def _searched(batches: Iterator[pa.RecordBatch], radius: int, gather: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, key, fp, far0, far1) sorted by (mask, key): whole buckets are compared, `gather` rows or more at a time."""
    held: list[np.ndarray] = []
    total = 0

    def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        far = np.ascontiguousarray(rows[:, 3:]).view(np.uint8).astype(np.int8)
        masks, kind = np.unique(rows[:, 0], return_inverse=True)
        for u, v in links_in(rows[:, 1], kind, rows[:, 2].view(np.uint64).copy(), far, [_bits_of(int(m)) for m in masks], radius):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in common.rows_of(batches):
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _ROW], axis=1))
        total += batch.num_rows
        if total >= gather:
            rows = np.ascontiguousarray(np.concatenate(held))
            other = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on
            yield from compared(np.ascontiguousarray(rows[:cut]))
            held, total = [rows[cut:]], len(rows) - cut
    if held:
        yield from compared(np.ascontiguousarray(np.concatenate(held)))


_ROW = ("mask", "key", "fp", "far0", "far1")
_ROWS = "mask long, key long, fp long, far0 long, far1 long"


def _redivided(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each row in the buckets into which its own is divided: one of the blocks of the bits left agrees too."""
    for batch in common.rows_of(batches):
        mask, fp = (batch.column(c).to_numpy() for c in ("mask", "fp"))
        for own in np.unique(mask):
            at = np.flatnonzero(mask == own)
            agreed = set(_bits_of(int(own)))
            rest = pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in _ROW[2:]], names=list(_ROW[2:]))
            for block in blocks([b for b in range(64) if b not in agreed], radius + 1):
                finer = np.int64(signed(mask_of([*agreed, *block])))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), finer)), pa.array(fp[at] & finer), *rest.columns], names=list(_ROW))


def links(tabled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between fingerprints of a pivot table that connect each of its components."""
    n = common.partitions(tabled.sparkSession)
    gather = max(GATHER, 1 << radius)  # b bits left make 2^b rows at most, so a crowded bucket has more than `radius` left
    masks = F.array(*(F.lit(signed(mask_of(m))).cast("long") for _, m in bucket_masks(radius)))
    rows = tabled.select(F.explode(masks).alias("mask"), "fp", "far0", "far1").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), *_ROW[2:])
    found = None
    while True:
        crowded = common.materialise(rows.groupBy("mask", "key").count().where(F.col("count") > gather).select("mask", "key"), "crowded")
        last = crowded.isEmpty()
        whole = rows if last else rows.join(crowded.hint("merge"), ["mask", "key"], "left_anti")
        spread = whole.repartition(n, "mask", "key").sortWithinPartitions("mask", "key")
        near = spread.mapInArrow(lambda b: _searched(b, radius, gather), "u long, v long")
        found = near if found is None else found.unionByName(near)
        if last:
            return found
        inside = rows.join(crowded.hint("merge"), ["mask", "key"], "left_semi").select(*_ROW)
        rows = common.materialise(inside.mapInArrow(lambda b: _redivided(b, radius), _ROWS).dropDuplicates(["mask", "fp"]), "divided")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_dedup(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; the component's id is its smallest doc_id."""
    fps = common.materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = _classes(fps, radius)
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids.hint("merge"), "root").select("fp", "component_id")
    return fps.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of one document of each group: the smallest doc_id, nulls last, then the
    smallest hash of the text. Rows that repeat doc_id and text are one document.
    """
    fps = common.materialise(fingerprints(docs, id_col, text_col, True), "fingerprints")
    rooted = fps.join(_classes(fps, radius).select("fp", "root").hint("merge"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _text_hash(F.col(f"`{text_col}`")).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    return rows.join(first.hint("merge"), same, "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _classes(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root, least) of the distinct fingerprints: the group, and the smallest doc_id that has the fingerprint."""
    rooted = components(links(pivot_table(fps), radius)).withColumnRenamed("node", "fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted.hint("merge"), "fp", "left")
    return common.materialise(classes.select("fp", F.coalesce("root", "fp").alias("root"), "least"), "classes")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "documents"))


QUERIES = {"op10_near_dedup": op10_near_dedup}
ORACLES: dict[str, str] = {}
