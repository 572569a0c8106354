"""Logical views over the star-schema tables: what each data-mining operator takes as its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, user_id, business_id, date, stars): a line of an order is a customer's review of a supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_suppkey").alias("business_id"),
        F.col("o_orderdate").alias("date"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, city)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("business_id"), "city")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, business_id, stars), one row a pair."""
    return reviews(spark, sf_dir).groupBy("user_id", "business_id").agg(F.avg("stars").alias("stars"))


def is_test(user: str = "user_id", item: str = "business_id") -> Column:
    """The fifth of the rating pairs that predictions are made for."""
    return F.pmod(F.col(user) * 31 + F.col(item), F.lit(5)) == 0


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): distinct brands of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def user_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, item): distinct keys that a user's events carry."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").cast("long").alias("item")).where("item is not null").distinct()


def stream(spark: SparkSession, sf_dir: str, batch: int = 100) -> DataFrame:
    """(seq, user_id, batch_id) in the order of arrival."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", F.floor(F.col("event_id") / batch).cast("long").alias("batch_id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, label, x)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.col("embedding").cast("array<double>").alias("x"))
