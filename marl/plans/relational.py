"""Relational queries: counts, distinct counts, top-k, averages, partitions, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import relational as rel
from marl.plans.views import RATINGS, REVIEWS, with_
from marl.sources import tables

YEAR, PARTS = 1998, 7


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reviews(spark, sf_dir)


def review_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.count_rows(_reviews(spark, sf_dir))


def review_count_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.count_year(_reviews(spark, sf_dir), YEAR)


def distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.count_distinct(_reviews(spark, sf_dir), "user_id")


def distinct_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.count_distinct(_reviews(spark, sf_dir), "business_id")


def top10_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(rel.distinct_per_key(_reviews(spark, sf_dir), "user_id", "review_id"), 10, "user_id")


def top10_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(rel.distinct_per_key(_reviews(spark, sf_dir), "business_id", "review_id"), 10, "business_id")


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.average_by_group(_reviews(spark, sf_dir).select("business_id", "stars"), tables.businesses(spark, sf_dir), "business_id", "city", "stars")


def avg_stars_by_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.rank_groups(_cities(spark, sf_dir), "city", "stars").withColumn("stars", F.round("stars", 9))


def top10_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.top_k(_cities(spark, sf_dir), 10, "city", "stars").withColumn("stars", F.round("stars", 9))


def partition_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.first_character_partition(tables.table(spark, sf_dir, "part").select("p_type"), "p_type", PARTS)


def partition_default_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.partition_sizes(tables.table(spark, sf_dir, "orders").select("o_custkey").repartition(PARTS, "o_custkey"))


def _by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviews(spark, sf_dir).repartition(PARTS, "business_id")


def partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.partition_count(tables.table(spark, sf_dir, "orders").select("o_custkey").repartition(PARTS, "o_custkey"))


def top10_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`top10_businesses` over rows dealt by business beforehand: the bench times both ways."""
    return rel.top_k(rel.distinct_per_key(_by_hand(spark, sf_dir), "business_id", "review_id"), 10, "business_id")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.word_count(tables.table(spark, sf_dir, "documents"), "text")


def user_item_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marl.operators.recommend import global_mean, means

    rated = tables.ratings(spark, sf_dir)
    parts = [
        means(rated, "user_id").select(F.lit("user").alias("kind"), F.col("user_id").alias("key"), "mean", "n"),
        means(rated, "business_id").select(F.lit("item").alias("kind"), F.col("business_id").alias("key"), "mean", "n"),
        global_mean(rated).crossJoin(rel.count_rows(rated)).select(F.lit("all").alias("kind"), F.lit(0).cast("long").alias("key"), F.col("global_mean").alias("mean"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("mean", F.round("mean", 6))


QUERIES = {f.__name__: f for f in (review_count, review_count_year, distinct_users, distinct_businesses, top10_users, top10_businesses, avg_stars_by_city, top10_cities, partition_item_counts, partition_default_counts, partition_count, top10_by_hand, word_count, user_item_means)}

_TOP = with_(REVIEWS) + "SELECT {0}, count(DISTINCT review_id) AS n FROM reviews GROUP BY {0} ORDER BY n DESC, {0} LIMIT 10"
_CITY = with_(REVIEWS) + "SELECT n_name AS city, round(sum(stars) / count(stars), 9) AS stars FROM reviews JOIN supplier ON business_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"

ORACLES = {
    "review_count": with_(REVIEWS) + "SELECT count(*) AS n FROM reviews",
    "review_count_year": with_(REVIEWS) + f"SELECT count(*) AS n FROM reviews WHERE year(date) = {YEAR}",
    "distinct_users": with_(REVIEWS) + "SELECT count(DISTINCT user_id) AS n FROM reviews",
    "distinct_businesses": with_(REVIEWS) + "SELECT count(DISTINCT business_id) AS n FROM reviews",
    "top10_users": _TOP.format("user_id"),
    "top10_businesses": _TOP.format("business_id"),
    "top10_by_hand": _TOP.format("business_id"),
    "partition_count": f"SELECT {PARTS}::INT AS partitions",
    "avg_stars_by_city": _CITY,
    "top10_cities": _CITY + " ORDER BY sum(stars) / count(stars) DESC, city LIMIT 10",
    "partition_item_counts": f"SELECT (ascii(p_type) % {PARTS})::INT AS partition, count(*) AS items FROM part GROUP BY 1",
    "word_count": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word",
    "user_item_means": with_(RATINGS)
    + """SELECT 'user' AS kind, user_id AS key, round(avg(stars), 6) AS mean, count(*) AS n FROM ratings GROUP BY user_id
UNION ALL SELECT 'item', business_id, round(avg(stars), 6), count(*) FROM ratings GROUP BY business_id
UNION ALL SELECT 'all', 0, round(sum(stars) / count(stars), 6), count(*) FROM ratings""",
}
