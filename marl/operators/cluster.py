"""Clustering from sufficient statistics: summaries, Mahalanobis distances, and BFR in rounds.

Points are (idx, x) with x an array of doubles; a summary is (cid, n, sum, sumsq).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.sources.shared import cut

#: Points a bounded k-means is fitted on at a time are one chunk of the table; clusters a round at most.
CHUNKS, SEED = 5, 553


def summaries(assigned: DataFrame) -> DataFrame:
    """(cid, n, sum, sumsq) of (cid, x): element-wise sums, combined before the shuffle."""
    flat = assigned.select("cid", F.posexplode("x").alias("dim", "v"))
    sums = flat.groupBy("cid", "dim").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows = sums.groupBy("cid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return rows.select("cid", "n", F.transform("d", lambda e: e["s"]).alias("sum"), F.transform("d", lambda e: e["q"]).alias("sumsq"))


def merged(summary: DataFrame) -> DataFrame:
    """Summaries of the same cid added up."""
    flat = summary.select("cid", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
    sums = flat.groupBy("cid", "dim").agg(F.sum("n").alias("n"), F.sum("v.sum").alias("s"), F.sum("v.sumsq").alias("q"))
    rows = sums.groupBy("cid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("d"))
    return rows.select("cid", "n", F.transform("d", lambda e: e["s"]).alias("sum"), F.transform("d", lambda e: e["q"]).alias("sumsq"))


def centroid(n: Column, total: Column) -> Column:
    return F.transform(total, lambda s: s / n)


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """The population deviation in each dimension; rounding below zero counts as zero."""
    return F.zip_with(total, squares, lambda s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))


def mahalanobis(x: Column, centre: Column, std: Column) -> Column:
    """With diagonal covariance; a dimension without deviation adds nothing if equal, else makes the distance infinite."""
    parts = F.zip_with(F.zip_with(x, centre, lambda a, b: a - b), std, lambda d, s: F.when(s > 0, d / s).when(d == 0, 0.0).otherwise(F.lit(float("inf"))))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p * p))


def between_clusters(summary: DataFrame) -> DataFrame:
    """(a, b, distance) of every two summaries, a < b: squared differences of centroids over the product of both deviations."""
    rows = summary.select("cid", centroid(F.col("n"), F.col("sum")).alias("c"), deviation(F.col("n"), F.col("sum"), F.col("sumsq")).alias("s"))
    a, b = rows.select(F.col("cid").alias("a"), F.col("c").alias("ca"), F.col("s").alias("sa")), rows.select(F.col("cid").alias("b"), F.col("c").alias("cb"), F.col("s").alias("sb"))
    both = a.join(b, F.col("a") < F.col("b"))  # summaries, not points: a few a round
    parts = F.zip_with(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.zip_with("sa", "sb", lambda x, y: x * y), lambda d, s: F.when(s > 0, d / s).when(d == 0, 0.0).otherwise(F.lit(float("inf"))))
    return both.select("a", "b", F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p)).alias("distance"))


def nearest(points: DataFrame, summary: DataFrame) -> DataFrame:
    """`points` with cid and distance of the nearest summary, the least cid of ties; null without summaries."""
    shape = F.struct("cid", centroid(F.col("n"), F.col("sum")).alias("c"), deviation(F.col("n"), F.col("sum"), F.col("sumsq")).alias("s"))
    one = summary.agg(F.collect_list(shape).alias("__all"))  # all summaries in one row
    best = F.array_min(F.transform("__all", lambda k: F.struct(mahalanobis(F.col("x"), k["c"], k["s"]).alias("distance"), k["cid"].alias("cid"))))
    return points.crossJoin(F.broadcast(one)).withColumn("__best", best).select(*points.columns, F.col("__best.cid").alias("cid"), F.col("__best.distance").alias("distance"))


def _k_means(points: DataFrame, k: int) -> DataFrame:
    """`points` with `cid` of k-means; as many clusters as there are points at most."""
    k = min(k, points.count())
    if k < 2:
        return points.withColumn("cid", F.lit(0))
    fed = points.withColumn("__v", array_to_vector("x"))
    model = KMeans(featuresCol="__v", predictionCol="cid", k=k, seed=SEED, maxIter=20).fit(fed)
    return model.transform(fed).drop("__v")


def bfr(points: DataFrame, k: int, chunks: int = CHUNKS, clusterer: Callable[[DataFrame, int], DataFrame] = _k_means) -> tuple[DataFrame, DataFrame]:
    """(rounds, labels) of BFR over (idx, x).

    rounds: (round, ds_points, cs_clusters, cs_points, rs_points). labels: (idx, cluster), -1 for outliers.
    A chunk is idx mod `chunks`. Points of a round are assigned against the summaries that the round began
    with; summaries are added up after it. A point joins the nearest discard summary within 2 sqrt(d), else the
    nearest compressed one, else it is retained and clustered with the others; groups of two or more are
    compressed. Then the closest two compressed summaries within the limit are merged until there are none, and at the
    end each is merged with the nearest discard summary within it.

    What is kept is (idx, kind, cid) of assigned points, retained points, each written once, and summaries, of which
    there are at most k and 5 k a round: these alone are on the driver. `clusterer` adds `cid` to points.
    """
    spark, points = points.sparkSession, points.select("idx", "x")
    chunk = lambda number: points.where(F.pmod("idx", F.lit(chunks)) == number)
    d = chunk(0).select(F.size("x")).first()
    limit = 2 * float(d[0] if d else 1) ** 0.5
    groups, alone = _grouped(chunk(0), 5 * k, clusterer)
    crowd = chunk(0).join(groups.select("idx"), "idx", "left_semi")
    first = cut(clusterer(crowd, k).select("idx", F.lit("ds").alias("kind"), F.col("cid").cast("long").alias("cid")))
    held = {"ds": summaries(chunk(0).join(first.select("idx", "cid"), "idx")), "cs": _no_summaries(spark)}
    held = {kind: cut(made) for kind, made in held.items()}
    placed, kept, into, rounds = [first], [cut(chunk(0).join(alone, "idx", "left_semi"))], {}, []
    for number in range(chunks):
        if number:
            near = _placed(chunk(number), held, limit)
            sums = cut(summaries(near.where("kind <> 'rs'").select(F.struct("kind", "cid").alias("cid"), "x")))
            for kind in held:
                new = sums.where(F.col("cid.kind") == kind).select(F.col("cid.cid").alias("cid"), "n", "sum", "sumsq")
                held[kind] = cut(merged(held[kind].unionByName(new)))
            placed.append(cut(near.where("kind <> 'rs'").select("idx", "kind", "cid")))
            kept.append(cut(near.where("kind = 'rs'").select("idx", "x")))
            alone = cut(alone.unionByName(kept[-1].select("idx")))
        pool = _union(kept).join(alone, "idx", "left_semi")
        groups, alone = _grouped(pool, 5 * k, clusterer)
        groups = cut(groups.select("idx", F.lit("cs").alias("kind"), (F.col("cid") + k * (1 + 5 * number)).cast("long").alias("cid")))
        placed.append(groups)
        grown = held["cs"].unionByName(summaries(_union(kept).join(groups.select("idx", "cid"), "idx")))
        small, moves = _merged_closest(_summary_list(grown), limit)
        into |= moves
        held["cs"] = cut(spark.createDataFrame(small, SUMMARY))
        ds = held["ds"].agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rounds.append((number + 1, ds, len(small), sum(n for _, n, *_ in small), alone.count()))
    final = _into_discard(_summary_list(held["cs"]), _summary_list(held["ds"]), limit)
    for cid in into:
        end = into[cid]
        while end in into:
            end = into[end]
        final[cid] = final[end]
    named = spark.createDataFrame(sorted(final.items()), "old long, cluster long")  # one row a compressed summary
    assigned = _union(placed)
    ds_labels = assigned.where("kind = 'ds'").select("idx", F.col("cid").alias("cluster"))
    cs_labels = assigned.where("kind = 'cs'").join(F.broadcast(named), F.col("cid") == F.col("old")).select("idx", "cluster")
    labels = ds_labels.unionByName(cs_labels).unionByName(alone.select("idx", F.lit(-1).cast("long").alias("cluster")))
    return spark.createDataFrame(rounds, "round long, ds_points long, cs_clusters long, cs_points long, rs_points long"), labels


SUMMARY = "cid long, n long, sum array<double>, sumsq array<double>"


def _no_summaries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SUMMARY)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _grouped(points: DataFrame, k: int, clusterer: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(idx, cid) of points in clusters of two or more, and (idx) of those alone."""
    made = cut(clusterer(points, k).select("idx", "cid"))
    both = cut(made.join(made.groupBy("cid").agg(F.count("*").alias("size")), "cid"))
    return both.where("size > 1").select("idx", "cid"), both.where("size = 1").select("idx")


def _placed(points: DataFrame, held: dict[str, DataFrame], limit: float) -> DataFrame:
    """(idx, x, kind, cid): `ds` or `cs` with the nearest summary within the limit, `rs` for the rest."""
    ds = nearest(points, held["ds"]).withColumnsRenamed({"cid": "ds_cid", "distance": "ds_distance"})
    both = nearest(ds, held["cs"])
    is_ds, is_cs = F.coalesce(F.col("ds_distance") < limit, F.lit(False)), F.coalesce(F.col("distance") < limit, F.lit(False))
    kind = F.when(is_ds, "ds").when(is_cs, "cs").otherwise("rs")
    return both.select("idx", "x", kind.alias("kind"), F.when(is_ds, F.col("ds_cid")).when(is_cs, F.col("cid")).cast("long").alias("cid"))


def _summary_list(summary: DataFrame) -> list[tuple[int, int, list[float], list[float]]]:
    return sorted((r["cid"], r["n"], r["sum"], r["sumsq"]) for r in summary.collect())  # k, or 5 k a round


def _shape(summary: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Centroid and deviation."""
    _, n, total, squares = summary
    centre = np.array(total) / n
    return centre, np.sqrt(np.maximum(np.array(squares) / n - centre * centre, 0.0))


def _apart(gap: np.ndarray, width: np.ndarray) -> float:
    """The root of the summed gaps over widths; without width a gap is infinite and none adds nothing."""
    return float(np.sqrt(np.where(width > 0, gap / np.where(width > 0, width, 1.0), np.where(gap == 0, 0.0, np.inf)).sum()))


def _merged_closest(summary: list[tuple], limit: float) -> tuple[list[tuple], dict[int, int]]:
    """The closest two summaries, ties by cid, are added up while they are within the limit; and which went into which."""
    left, into = {s[0]: s for s in summary}, {}
    shape = {c: _shape(s) for c, s in left.items()}
    far = lambda a, b: _apart((shape[a][0] - shape[b][0]) ** 2, shape[a][1] * shape[b][1])
    known = {(a, b): far(a, b) for a in left for b in left if a < b}
    while known:
        (a, b), distance = min(known.items(), key=lambda item: (item[1], item[0]))
        if distance >= limit:
            break
        (_, n, s, q), (_, m, t, r) = left[a], left.pop(b)
        left[a] = (a, n + m, [x + y for x, y in zip(s, t, strict=True)], [x + y for x, y in zip(q, r, strict=True)])
        shape[a], into[b] = _shape(left[a]), a
        known = {pair: x for pair, x in known.items() if b not in pair}
        known |= {(min(a, c), max(a, c)): far(min(a, c), max(a, c)) for c in left if c != a}
    return sorted(left.values()), into


def _into_discard(compressed: list[tuple], discard_set: list[tuple], limit: float) -> dict[int, int]:
    """For each compressed summary the nearest discard one within the limit, -1 without."""
    shapes = [(s[0], *_shape(s)) for s in discard_set]
    out = {}
    for summary in compressed:
        centre = _shape(summary)[0]
        near = min(((_apart((centre - c) ** 2, std * std), cid) for cid, c, std in shapes), default=(np.inf, -1))
        out[summary[0]] = near[1] if near[0] < limit else -1
    return out
