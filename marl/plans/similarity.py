"""Set similarity queries over users and the keys of their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import similarity as sim
from marl.plans.views import USER_ITEMS, with_
from marl.sources import tables
from marl.sources.shared import cut

THRESHOLD = 0.5


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tables.user_items(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round("similarity", 9))


def jaccard_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sim.jaccard_pairs(_sets(spark, sf_dir), THRESHOLD))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.signatures(_sets(spark, sf_dir)).select("owner", F.posexplode("signature").alias("i", "least"))


def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim.band_candidates(sim.signatures(_sets(spark, sf_dir)))


def lsh_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sim.lsh_pairs(_sets(spark, sf_dir), THRESHOLD)).orderBy("owner", "other")


QUERIES = {f.__name__: f for f in (jaccard_exact, minhash_signatures, lsh_candidates, lsh_similar_pairs)}

_SIMILAR = f"""sizes AS (SELECT owner, count(*) AS n FROM sets GROUP BY owner),
common AS (SELECT a.owner AS owner, b.owner AS other, count(*) AS n FROM sets a JOIN sets b ON a.item = b.item AND a.owner < b.owner GROUP BY 1, 2),
alike AS (
  SELECT c.owner, c.other, round(c.n / (x.n + y.n - c.n), 9) AS similarity
  FROM common c JOIN sizes x ON c.owner = x.owner JOIN sizes y ON c.other = y.owner WHERE c.n / (x.n + y.n - c.n) >= {THRESHOLD})"""
_SIGNED = f"""numbered AS (SELECT owner, dense_rank() OVER (ORDER BY item) - 1 AS x FROM sets),
signed AS (
  SELECT owner, (i - 1)::INT AS i, min((i * (x + {sim.SHIFT})) % (SELECT count(DISTINCT item) FROM sets)) AS least
  FROM numbered, range(1, {sim.HASHES + 1}) t(i) GROUP BY owner, i)"""
_BANDS = f"""banded AS (SELECT owner, i // {sim.ROWS} AS band, string_agg(least::VARCHAR, ',' ORDER BY i) AS v FROM signed WHERE i < {sim.BANDS * sim.ROWS} GROUP BY 1, 2),
candidates AS (SELECT DISTINCT a.owner AS owner, b.owner AS other FROM banded a JOIN banded b ON a.band = b.band AND a.v = b.v AND a.owner < b.owner)"""

ORACLES = {
    "jaccard_exact": with_(USER_ITEMS, _SIMILAR) + "SELECT * FROM alike",
    "minhash_signatures": with_(USER_ITEMS, _SIGNED) + "SELECT * FROM signed",
    "lsh_candidates": with_(USER_ITEMS, _SIGNED, _BANDS) + "SELECT * FROM candidates",
    "lsh_similar_pairs": with_(USER_ITEMS, _SIMILAR, _SIGNED, _BANDS) + "SELECT alike.* FROM alike JOIN candidates USING (owner, other)",
}
