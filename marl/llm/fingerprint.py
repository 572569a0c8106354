"""Document fingerprints: 64-bit SimHash of weighted terms, and search within a Hamming radius.

Terms are the shingles of `WIDTH` words (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words: the whole
sequence). A term's weight is its number of occurrences; it votes for its hash's one bits and against the
others. No terms give zero. Likeness is the share of equal bits.

`compare_edits` walks documents by ascending doc_id without a global sort in one task: each document is sent
once to the task of its doc_id range, and the first document of a range also to the range before it (the
first of all to the last range). Range bounds are a fixed number of doc_ids, so the driver's part is bounded.

`within` finds fingerprints near queries by permuted block tables: 64 bits in `BLOCKS` blocks, of which two
fingerprints within the radius agree in all but that many. There is a table for each choice of agreeing
blocks, ordered by their bits; candidates share a table's key and are verified. With 5 blocks and radius 3
a key has 25 or 26 bits in 10 tables, with 6 it has 32 in 20: more blocks for more than some 10^9 fingerprints.
`op7_fingerprint` asks for every row whose doc_id is divisible by `ASKED` how many other fingerprints are near.

Defined results: null texts count as empty; null doc_ids come after all others; rows with the same doc_id are
taken in the order of their texts; one document alone is its own next document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import common, votes

WIDTH = 5
#: The search: Hamming radius, blocks of the permuted tables, and which doc_ids are queries.
RADIUS, BLOCKS, ASKED = 3, 5, 20
_word = xxhash.xxh64_intdigest
#: Odd multipliers that order the words of a shingle.
_ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1234567 * i) for i in range(WIDTH)]
#: Distinct words whose hashes a worker keeps; beyond it starts anew.
WORD_CACHE = 1 << 18


class _Words(dict):
    """Hashes of words by the word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = made = _word(word)
        return made


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Fingerprinter:
    def __init__(self) -> None:
        self.words = _Words()

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The fingerprints of some texts."""
        done, held, size = [], [], 0
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split()
            held.append(np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words)))
            size += len(words)
            if size > 1 << 17:
                done.append(self._voted(held))
                held, size = [], 0
        if held:
            done.append(self._voted(held))
        return np.concatenate(done) if done else np.empty(0, np.uint64)

    @staticmethod
    def _voted(docs: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in docs])
        width = np.minimum(sizes, WIDTH)  # fewer words: all of them
        words = np.concatenate(docs) if len(docs) else np.empty(0, np.uint64)
        n = len(words)
        of = np.repeat(np.arange(len(docs)), sizes)
        end = np.cumsum(sizes)
        at = np.flatnonzero(np.arange(n) + width[of] <= end[of]) if n else np.empty(0, np.int64)
        terms = np.zeros(len(at), np.uint64)
        for i in range(WIDTH):
            part = words[np.minimum(at + i, max(n - 1, 0))] * _ODD[i]
            short = width[of[at]] <= i
            if short.any():
                part[short] = 0
            terms += part
        return votes.majority(_mixed(terms), np.where(sizes > 0, sizes - width + 1, 0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - votes.hamming(a, b) / 64.0


def edited(text: str, after: str) -> str:
    """The last quarter of `text`, in code points, replaced by as many of `after`."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


# -- the walk by ascending doc_id ------------------------------------------------------------------------

COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, fp long"


def _ranged(batches: Iterator[pa.RecordBatch], bounds: list[int], last: int, firsts: dict[int | None, int]) -> Iterator[pa.RecordBatch]:
    """Adds `range` and `tail`: tail rows are copies for the range before."""
    for batch in common.rows_of(batches):
        ids = batch.column("doc_id").to_pylist()
        where = [last if i is None else bisect.bisect_right(bounds, i) for i in ids]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(where, pa.int32()), pa.array([False] * len(ids))], names=["doc_id", "text", "range", "tail"])
        copied = [k for k, i in enumerate(ids) if i in firsts]
        if copied:
            take = pa.array(copied)
            to = [firsts[ids[k]] for k in copied]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("text").take(take), pa.array(to, pa.int32()), pa.array([True] * len(to))], names=["doc_id", "text", "range", "tail"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, tail, doc_id): each but a tail row is compared with the row after it."""
    prints = Fingerprinter()
    held: tuple | None = None  # the last document seen, if it still waits for the next
    for batch in common.rows_of(batches):
        raw = [(t or b"").decode("utf-8", "replace") for t in common.as_bytes(batch.column("text"))]
        fps = prints(raw)
        rows = list(zip(batch.column("doc_id").to_pylist(), raw, fps.tolist(), batch.column("tail").to_pylist(), strict=True))
        pairs = []
        for row in rows:
            if held is not None:
                pairs.append((held, row))
            held = None if row[3] else row
        if pairs:
            yield _compared_pairs(prints, pairs)
    if held is not None:
        raise RuntimeError("a range ended without the first document of the next")


def _compared_pairs(prints: Fingerprinter, pairs: list) -> pa.RecordBatch:
    new = [edited(a[1], b[1]) for a, b in pairs]
    own = np.array([a[2] for a, _ in pairs], np.uint64)
    after = np.array([b[2] for _, b in pairs], np.uint64)
    changed = prints(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([a[0] for a, _ in pairs], pa.int64()),
            pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array(votes.hex16(own), pa.string()),
            pa.array(votes.hex16(changed), pa.string()),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, after)),
            pa.array(own.view(np.int64)),
        ],
        names=[x.split()[0] for x in COMPARED.split(", ")],
    )


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COMPARED for every row: its fingerprint against its edited text's and the next document's, and again as a signed long."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = common.texts(docs, id_col, text_col)
    n = max(2, common.partitions(spark))
    ids = rows.select("doc_id")
    bounds = sorted({int(x) for x in ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) or []})
    last = len(bounds)
    where = F.when(F.col("doc_id").isNull(), last).otherwise(_range_of(F.col("doc_id"), bounds))
    least = {r[0]: r[1] for r in ids.select(where.alias("r"), "doc_id").groupBy("r").agg(F.min("doc_id")).collect()}  # one row a range
    used = sorted(least)
    firsts = {least[r]: used[i - 1] for i, r in enumerate(used)}
    spread = rows.mapInArrow(lambda b: _ranged(b, bounds, last, firsts), "doc_id long, text string, range int, tail boolean").repartitionById(last + 1, F.col("range"))
    walked = spread.sortWithinPartitions("range", "tail", F.asc_nulls_last("doc_id"), "text")
    return walked.mapInArrow(_compared_once, COMPARED)


def _range_of(column: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below a value."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= column))


def _compared_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_compared` on the rows up to the first tail row: rows that repeat the first doc_id are copied too."""

    def cut() -> Iterator[pa.RecordBatch]:
        for batch in common.rows_of(batches):
            tails = np.flatnonzero(batch.column("tail").to_numpy(zero_copy_only=False))
            if len(tails):
                yield batch.slice(0, int(tails[0]) + 1)
                return
            yield batch

    yield from _compared(cut())
    for _ in batches:
        pass


# -- search -----------------------------------------------------------------------------------------------


def table_masks(radius: int, blocks: int) -> list[int]:
    """The bits that agree in each table, as signed longs."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(a, z)) for a, z in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(own, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance): for each distinct `fp` of `queries`, every distinct `fp` of `fps` within the radius.

    Both have a signed long `fp`; `blocks` is more than the radius. Tables hold distinct fingerprints, so copies
    cost nothing; a key that many share is split by the skew join of AQE.
    """
    masks = table_masks(radius, blocks)

    def listed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)))
        return df.select("fp").where("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("k")).select(name, "k.table", "k.bits")

    joined = listed(queries, "query").hint("merge").join(listed(fps, "fp"), ["table", "bits"])
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(True)
    for i, m in enumerate(masks):  # a pair that agrees in several tables is reported by the first
        first &= (F.col("table") <= i) | (apart.bitwiseAND(F.lit(m).cast("long")) != 0)
    return joined.select("query", "fp", F.bit_count(apart).alias("distance"), first.alias("first")).where((F.col("distance") <= radius) & F.col("first")).drop("first")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and `n_within`: for queries the number of other fingerprints within RADIUS, else null."""
    made = common.materialise(compare_edits(common.table(spark, sf_dir, "documents")), "compared")
    is_query = F.coalesce(F.col("doc_id") % ASKED == 0, F.lit(False))
    near = within(made, made.where(is_query)).where("query <> fp").groupBy("query").agg(F.count("*").alias("n_within"))
    asked = made.where(is_query).join(near.hint("merge"), F.col("fp") == F.col("query"), "left").drop("query").withColumn("n_within", F.coalesce("n_within", F.lit(0).cast("long")))
    return asked.unionByName(made.where(~is_query).withColumn("n_within", F.lit(None).cast("long"))).drop("fp")


QUERIES = {"op7_fingerprint": op7_fingerprint}
ORACLES: dict[str, str] = {}
