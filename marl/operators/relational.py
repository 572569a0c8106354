"""Counts, distinct counts, top-k, averages by group, and how rows lie in partitions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_year(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    """Rows of a year, by a range that reaches the scan."""
    inside = (F.col(date) >= F.lit(datetime(year, 1, 1))) & (F.col(date) < F.lit(datetime(year + 1, 1, 1)))
    return df.where(inside).agg(F.count("*").alias("n"))


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    """Two plain aggregates, so a frequent value costs a task no more than one row."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count("*").alias("n"))


def distinct_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): distinct non-null values; combined before each shuffle."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("n"))


def top_k(counts: DataFrame, k: int, key: str, value: str = "n") -> DataFrame:
    """The k largest values, ties by key; each task keeps k rows."""
    return counts.orderBy(F.desc(value), F.asc(key)).limit(k)


def average_by_group(facts: DataFrame, dimension: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(group, value): means over facts that join the dimension. Sums are taken before the join, so it moves one row a key."""
    sums = facts.groupBy(key).agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    joined = sums.join(dimension.select(key, group), key).groupBy(group).agg(F.sum("__sum").alias("s"), F.sum("__n").alias("n"))
    return joined.select(group, (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias(value))


def rank_groups(averages: DataFrame, group: str, value: str) -> DataFrame:
    return averages.orderBy(F.desc(value), F.asc(group))


def first_character_partition(df: DataFrame, key: str, n: int) -> DataFrame:
    """(partition, items): rows dealt by the code of the key's first character; partitions are places, not just numbers."""
    where = (F.ascii(F.col(key)) % n).cast("int")
    return df.withColumn("__p", where).repartitionById(n, F.col("__p")).groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("items"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, items) as the rows lie now; empty partitions have no row."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("items"))


def partition_count(df: DataFrame) -> DataFrame:
    """One row: how many partitions the rows lie in, empty ones too."""
    return df.sparkSession.createDataFrame([(df.rdd.getNumPartitions(),)], "partitions int")


def word_count(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of the pieces between single blanks; empty pieces count."""
    return df.select(F.explode(F.split(text, " ", -1)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
