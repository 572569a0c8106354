"""Basket and itemset queries. An itemset is shown as its items joined by commas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import itemsets as its
from marl.plans.views import BASKETS, with_
from marl.sources import tables
from marl.sources.shared import cut

#: Relative supports: pairs of brands are held by 2 % of the baskets, triples by a thousandth.
SUPPORT, TRIPLE_SUPPORT, LARGER_THAN, PARTS = 0.02, 0.001, 4, 4


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tables.basket_items(spark, sf_dir))


def _least(pairs: DataFrame, share: float) -> int:
    return max(1, math.ceil(share * its.n_baskets(pairs)))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("items", F.array_join("items", ","))


def user_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return its.baskets(tables.basket_items(spark, sf_dir), LARGER_THAN).select("basket", F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("items"))


def item_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = its.baskets(its.swapped(tables.basket_items(spark, sf_dir)))
    return made.select(F.col("basket").alias("item"), F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", ",")).alias("digest"))


def _size(spark: SparkSession, sf_dir: str, size: int, share: float) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return _shown(its.levels(pairs, F.col("n") >= _least(pairs, share), size)[size - 1]).select("items", "n")


def frequent_singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir, 1, SUPPORT)


def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir, 2, SUPPORT)


def frequent_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _size(spark, sf_dir, 3, TRIPLE_SUPPORT)


def son_local_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return _shown(its.local_candidates(pairs, _least(pairs, SUPPORT), PARTS))


def son_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    least = _least(pairs, SUPPORT)
    return _shown(its.count_candidates(pairs, its.local_candidates(pairs, least, PARTS), least))


def fp_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    return _shown(its.fp_growth(pairs, _least(pairs, SUPPORT), its.n_baskets(pairs)))


def pair_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return its.pair_buckets(tables.basket_items(spark, sf_dir))


QUERIES = {f.__name__: f for f in (user_baskets, item_baskets, frequent_singles, frequent_pairs, frequent_triples, son_local_candidates, son_frequent, fp_growth, pair_bucket_counts)}

_N = "total AS (SELECT count(DISTINCT basket) AS n FROM pairs)"


def _frequent(size: int, share: float) -> str:
    return f"SELECT {_items(size)} AS items, count(*) AS n FROM {_joined(size)} GROUP BY 1 HAVING count(*) >= (SELECT ceil({share} * n) FROM total)"


#: Sizes that the SQL counts sets up to; the queries mine until a level is empty.
_SIZES = 4


def _joined(size: int) -> str:
    names = [f"p{i}" for i in range(size)]
    return f"pairs {names[0]}" + "".join(f" JOIN pairs {b} ON {a}.basket = {b}.basket AND {a}.item < {b}.item" for a, b in zip(names, names[1:], strict=False))


def _items(size: int) -> str:
    return " || ',' || ".join(f"p{i}.item" for i in range(size))


def _some(largest: int) -> str:
    return " UNION ALL ".join(f"SELECT {n} AS size, items, n FROM ({_frequent(n, SUPPORT)})" for n in range(1, largest + 1))


_FOUND = "\n  UNION ".join(f"SELECT {n} AS size, {_items(n)} AS items FROM {_joined(n)} JOIN local ON p0.basket % {PARTS} = pid GROUP BY pid, least, {_items(n)} HAVING count(*) >= least" for n in range(1, _SIZES + 1))
_LOCAL = f"""local AS (
  SELECT basket % {PARTS} AS pid, ceil((SELECT ceil({SUPPORT} * n) FROM total) * count(DISTINCT basket) / (SELECT n FROM total)) AS least
  FROM pairs GROUP BY 1),
found AS ({_FOUND})"""
_CODE = "list_sum(list_transform(string_split({}, ''), lambda c: ascii(c)))"

ORACLES = {
    "user_baskets": with_(BASKETS) + f"SELECT basket, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM pairs GROUP BY basket HAVING count(*) > {LARGER_THAN}",
    "item_baskets": with_(BASKETS) + "SELECT item, count(*) AS n, md5(string_agg(basket::VARCHAR, ',' ORDER BY basket)) AS digest FROM pairs GROUP BY item",
    "frequent_singles": with_(BASKETS, _N) + _frequent(1, SUPPORT),
    "frequent_pairs": with_(BASKETS, _N) + _frequent(2, SUPPORT),
    "frequent_triples": with_(BASKETS, _N) + _frequent(3, TRIPLE_SUPPORT),
    "son_local_candidates": with_(BASKETS, _N, _LOCAL) + "SELECT DISTINCT size, items FROM found",
    "son_frequent": with_(BASKETS, _N) + _some(_SIZES),
    "fp_growth": with_(BASKETS, _N) + _some(_SIZES),
    "pair_bucket_counts": with_(BASKETS) + f"SELECT (({_CODE.format('a.item')} + {_CODE.format('b.item')}) % 1000)::INT AS bucket, count(*) AS n FROM pairs a JOIN pairs b ON a.basket = b.basket AND a.item < b.item GROUP BY 1",
}
