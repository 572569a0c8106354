"""Mixing sources to target weights, in DataFrame functions alone.

Sources by code point, null last, weigh 3, 1, 2, 3, 1, 2, ... and share `BUDGET` times all words by weight;
a target stops at `CAP` times its source's words and its excess is shared again by weight until none is
above. A source's rate is target / words; each document is emitted floor(rate) times, plus one Bernoulli
copy whose probability is the fraction.

Every document's draw is the same: 52 bits of the MD5 of its doc_id, plus its source's seed, modulo 2^52, against
the fraction of 2^52. A seed is one of `SEEDS` even turns of the circle. Over all turns a source takes its
target on average, so one of them is near it; each source uses the turn whose words come nearest to its
target, the least of ties. What every turn would take is known from one aggregate by source and arc of the circle,
which is combined before the shuffle, so a source of any size costs a task `SEEDS` rows.

Sources are ranked over range partitions, and shares are found by aggregates (one row a round), so neither
documents nor sources meet in one task. Documents get their source's row by a join that the planner broadcasts if
the written table of sources is below its size threshold, and else merges, hot sources split.

Defined results: a null or blank text has size 0, and its copies add no words; a null source is a source;
a source without words gets target 0 and rate 0; null doc_ids are drawn by the hash of the empty
string; rows that share doc_id and source are drawn alike; an empty table gives an empty result; columns of any
names are kept apart from our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marl.llm import common

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2.0
#: Turns of the circle that a source chooses its seed from, a power of two; bits of a draw.
SEEDS, BITS = 64, 52
WORD = r"[^\x20\x09-\x0D]+"


def drawn_bits(text: Column) -> Column:
    """`BITS` bits of the MD5 of a string as a long."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the bits of a string."""
    return drawn_bits(text) / F.lit(float(1 << BITS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, words, weight) of (source, words), one row a source: the rank is a range partition's offset plus the place in it."""
    spark = sizes.sparkSession
    order = [F.asc_nulls_last("source")]
    spread = sizes.repartitionByRange(common.partitions(spark), *order).withColumn("part", F.spark_partition_id())
    spread = common.materialise(spread, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("offset")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    return spread.join(F.broadcast(offsets), "part").select("source", "words", weight.cast("long").alias("weight"))


def level(ranked: DataFrame, budget: float, cap: float) -> float | None:
    """The words that one unit of weight gets once no target is above its cap; None: every source is at its cap.

    Each round shares what the sources at their cap leave among the others; a round is one aggregate.
    """
    total = ranked.agg(F.sum("words")).first()[0]
    if not total:
        return None
    now, capped_before = 0.0, -1
    while True:
        capped = F.lit(cap) * F.col("words") <= F.col("weight") * F.lit(now)
        fixed, weight, n = ranked.agg(F.sum(F.when(capped, F.col("words"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if not weight:
            return None
        if n == capped_before:
            return now
        now, capped_before = (budget * total - cap * (fixed or 0)) / weight, n


def targets(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) of (source, words)."""
    ranked = common.materialise(ranked_sources(sizes), "weights")
    per_weight = level(ranked, budget, cap)
    most = F.lit(cap) * F.col("words")
    target = most if per_weight is None else F.least(most, F.lit(per_weight) * F.col("weight"))
    return ranked.select("source", F.col("words").alias("source_size"), target.cast("double").alias("target"))


def _key(doc_id: Column) -> Column:
    return drawn_bits(F.coalesce(doc_id.cast("string"), F.lit("")))


_ARC = (1 << BITS) // SEEDS


def _turned(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """`goals` (source, source_size, target) with `whole`, `limit` (the fraction of 2^BITS) and `seed`, written once."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(rate)).withColumn("limit", F.floor((rate - F.floor(rate)) * float(1 << BITS)).cast("long"))
    goals = common.materialise(goals, "rates")
    ends = goals.select(F.col("source").alias("own"), F.pmod("limit", F.lit(_ARC)).alias("rest"))
    placed = sized.join(ends, F.col("source").eqNullSafe(F.col("own")))
    key = F.col("key")
    arcs = placed.groupBy("source", F.floor(key / _ARC).cast("int").alias("arc")).agg(F.sum("size").alias("all"), F.sum(F.when(F.pmod(key, F.lit(_ARC)) < F.col("rest"), F.col("size")).otherwise(F.lit(0))).alias("head"))
    circles = arcs.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("arc", F.struct("all", "head")))).alias("circle"))  # SEEDS arcs at most
    joined = goals.join(circles.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own")
    full = F.floor(F.col("limit") / _ARC).cast("int")  # whole arcs below the limit; the arc behind them counts by its head
    words = lambda arc, part: F.coalesce(F.try_element_at("circle", F.pmod(arc, F.lit(SEEDS)))[part], F.lit(0))
    below = lambda seed: F.when(full > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(full - 1, F.lit(0))), F.lit(0).cast("long"), lambda acc, i: acc + words(i - seed, "all"))).otherwise(F.lit(0))
    taken = lambda seed: below(seed) + words(full - seed, "head")
    missed = lambda seed: F.abs((F.col("whole") * F.col("source_size") + taken(seed)).cast("double") - F.col("target"))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda seed: F.struct(missed(seed).alias("missed"), seed.alias("seed"))))
    return common.materialise(joined.select("source", "source_size", "target", "whole", "limit", best["seed"].alias("seed")), "seeds")


def _copies(key: Column) -> Column:
    """Copies of a document with this key, from its source's row."""
    return F.col("whole") + (F.pmod(key + F.col("seed") * F.lit(_ARC), F.lit(1 << BITS)) < F.col("limit")).cast("long")


def _planned(docs: DataFrame, budget: float, cap: float, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key) of every row, and the sources' rows; both written."""
    doc_id = F.col(f"`{id_col}`").cast("long")
    sized = docs.select(doc_id.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), _key(doc_id).alias("key"))
    sized = common.materialise(sized, "sizes")
    return sized, _turned(sized, targets(sized.groupBy("source").agg(F.sum("size").alias("words")), budget, cap))


def mix(docs: DataFrame, budget: float = BUDGET, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every row of `docs`."""
    sized, goals = _planned(docs, budget, cap, id_col, text_col, source_col)
    joined = sized.join(goals.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own")))
    return joined.select("doc_id", "size", "source", "source_size", "target", _copies(F.col("key")).alias("copies"))


def emit(docs: DataFrame, budget: float = BUDGET, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of `docs`, all its columns, as many times as `mix` takes it (0: not at all)."""
    _, goals = _planned(docs, budget, cap, id_col, text_col, source_col)
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(goals.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).select("row", _copies(_key(F.col("doc_id"))).alias("copies"))
    taken = joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op4_mixing": op4_mixing}
ORACLES = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (
  SELECT source, words, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(words) OVER before, 0) AS fixed, sum(weight) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         sum(words) OVER () AS total
  FROM w WINDOW before AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT max((1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * fixed::DOUBLE) / open::DOUBLE) AS per FROM o),
t AS (SELECT source, words AS source_size, least(2.0::DOUBLE * words, coalesce(per, 1e300) * weight) AS target FROM w, l),
r AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t),
g AS (SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 4503599627370496.0::DOUBLE)::BIGINT AS edge FROM r),
k AS (
  SELECT doc_id, size, d.source, source_size, target, whole, edge, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
turns AS (
  SELECT source, turn, abs((whole * source_size + coalesce(sum(size) FILTER ((h + turn * 70368744177664) % 4503599627370496 < edge), 0))::DOUBLE - target) AS missed
  FROM k, range(64) x(turn) GROUP BY source, turn, whole, source_size, target),
best AS (SELECT source, arg_min(turn, {'missed': missed, 'turn': turn}) AS turn FROM turns GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (whole + ((h + turn * 70368744177664) % 4503599627370496 < edge)::INT))::BIGINT AS taken
FROM k JOIN best ON k.source IS NOT DISTINCT FROM best.source
"""
}
