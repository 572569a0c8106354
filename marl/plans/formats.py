"""Sources and sinks as queries: tables written in a format by a sink and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import itemsets as its
from marl.operators import recommend as rec
from marl.operators import relational as rel
from marl.operators import similarity as sim
from marl.plans import graphs, itemsets, similarity
from marl.plans.relational import ORACLES as RELATIONAL
from marl.plans.similarity import ORACLES as SIMILAR
from marl.plans.views import BASKETS, RATINGS, with_
from marl.sources import readers, sinks, tables
from marl.sources.shared import cut, scratch
from marl.streaming import streams as st

SECOND = "yyyy-MM-dd HH:mm:ss"


def _back(spark: SparkSession, write, read) -> DataFrame:
    path = scratch(spark, "format")
    write(path)
    return read(path)


def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text file, in at least two partitions, counted."""
    lines = tables.table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" "), F.pmod("user_id", F.lit(7))).alias("value"))
    read = _back(spark, lambda p: lines.write.text(p), lambda p: readers.text(spark, p, 2))
    return read.groupBy("value").agg(F.count("*").alias("n"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews as JSON objects carry them, with numbers of votes."""
    rows = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(text("l_orderkey").alias("review_id"), text("o_custkey").alias("user_id"), text("l_suppkey").alias("business_id"), F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
                       F.date_format("o_orderdate", SECOND).alias("date"), F.col("l_linenumber").cast("long").alias("useful"), F.col("l_quantity").cast("long").alias("funny"), F.lit(1).cast("long").alias("cool"))


def source_json_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _reviews(spark, sf_dir)
    return _back(spark, lambda p: sinks.json_objects(made, p), lambda p: readers.json_lines(spark, p, readers.REVIEW)).select("review_id", "user_id", "business_id", "stars", "date")


def source_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _reviews(spark, sf_dir)
    return readers.evaluations(_back(spark, lambda p: sinks.json_objects(made, p), lambda p: readers.json_lines(spark, p, readers.REVIEW)))


def source_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _reviews(spark, sf_dir).select("user_id", "business_id")
    return readers.tip_counts(_back(spark, lambda p: sinks.json_objects(made, p), lambda p: readers.json_lines(spark, p, readers.TIP)))


def source_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = tables.table(spark, sf_dir, "nation")
    made = tables.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("n_name").alias("city"), F.lit(4.5).alias("stars"), F.length("s_name").cast("long").alias("review_count"), F.col("s_acctbal").alias("longitude"), (-F.col("s_acctbal")).alias("latitude"))
    return _back(spark, lambda p: sinks.json_objects(made, p), lambda p: readers.json_lines(spark, p, readers.BUSINESS))


def source_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("c_name").cast("long")
    made = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_acctbal").alias("average_stars"), length.alias("review_count"), F.col("c_nationkey").cast("long").alias("useful"), (length + 1).alias("funny"), (length + 2).alias("cool"), F.lit(None).cast("long").alias("fans"))
    return _back(spark, lambda p: sinks.json_objects(made, p), lambda p: readers.json_lines(spark, p, readers.USER))


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tables.ratings(spark, sf_dir).select(F.col("user_id").cast("string"), F.col("business_id").cast("string"))
    return _back(spark, lambda p: sinks.csv(made, p), lambda p: readers.pairs(spark, p))


def source_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rating without stars reads as 0."""
    given = F.when(F.col("business_id") % 7 != 0, F.col("stars"))
    made = tables.ratings(spark, sf_dir).select(F.col("user_id").cast("string"), F.col("business_id").cast("string"), given.alias("stars"))
    return _back(spark, lambda p: sinks.csv(made, p), lambda p: readers.rating_triples(spark, p)).withColumn("stars", F.round("stars", 6))


def source_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with commas in them; products lose leading zeros."""
    rows = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = rows.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE"), F.col("o_custkey").cast("string").alias("CUSTOMER"), F.lit("a, b").alias("AGE"), F.col("l_linestatus").alias("STATUS"), F.lit("x").alias("CLASS"), F.concat(F.lit("00"), F.col("l_partkey").cast("string")).alias("PRODUCT"))
    read = _back(spark, lambda p: sinks.csv(made, p), lambda p: readers.retail(spark, p))
    return read.groupBy("basket").agg(F.count_distinct("item").alias("n"), F.sum("item").alias("total"))


def source_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.concat(F.array(F.col("idx").cast("string"), F.concat(F.lit("L"), F.col("label").cast("string"))), F.transform("x", lambda v: v.cast("string")))
    lines = tables.points(spark, sf_dir).select(F.array_join(cells, ",").alias("value"))
    read = _back(spark, lambda p: lines.write.text(p), lambda p: readers.points(spark, p))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return read.select("idx", "label", F.size("x").cast("long").alias("dims"), F.round(total, 6).alias("total"))


def sink_city_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = rel.average_by_group(tables.reviews(spark, sf_dir).select("business_id", "stars"), tables.businesses(spark, sf_dir), "business_id", "city", "stars")
    made = rel.rank_groups(means, "city", "stars")
    return _back(spark, lambda p: sinks.csv(made, p), lambda p: spark.read.csv(p, header=True, schema="city string, stars double")).withColumn("stars", F.round("stars", 9))


def sink_itemset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the report: one for each size, itemsets in order."""
    pairs = itemsets._pairs(spark, sf_dir)
    made = its.frequent(pairs, itemsets._least(pairs, itemsets.SUPPORT), 2)
    return _back(spark, lambda p: sinks.itemset_report(made, p), lambda p: readers.text(spark, p)).where("value <> ''")


def sink_similarity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header with blanks in it; pairs in order."""
    made = sim.lsh_pairs(cut(tables.user_items(spark, sf_dir)), similarity.THRESHOLD).orderBy("owner", "other")
    names = ["owner", " other", " similarity"]
    return _back(spark, lambda p: sinks.csv(made, p, names), lambda p: spark.read.csv(p, header=True, schema="owner long, other long, similarity double")).withColumn("similarity", F.round("similarity", 9))


def sink_prediction_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = tables.ratings(spark, sf_dir)
    items = rec.means(rated.where(~tables.is_test()), "business_id", "prediction").select("business_id", "prediction")
    made = rated.where(tables.is_test()).join(items, "business_id").select("user_id", "business_id", "prediction")
    return _back(spark, lambda p: sinks.csv(made, p), lambda p: spark.read.csv(p, header=True, schema="user_id long, business_id long, prediction double")).withColumn("prediction", F.round("prediction", 6))


def sink_community_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graphs.communities(spark, sf_dir).orderBy("size", "members")
    return _back(spark, lambda p: sinks.member_lines(made.select(F.transform("members", lambda m: m.cast("string")).alias("members")), "members", p), lambda p: readers.text(spark, p))


def sink_betweenness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graphs.edge_betweenness(spark, sf_dir).withColumn("betweenness", F.round(F.col("betweenness") * 1000).cast("long"))
    return _back(spark, lambda p: sinks.edge_lines(made, p), lambda p: readers.text(spark, p))


def sink_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as they are first seen, appended to a CSV by a stream."""
    path = scratch(spark, "format")
    sinks.stream_metrics(st.first_seen(st.events(spark, sf_dir)), path, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.csv(path, header=True, schema="user_id long")


def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports: rmse, least, most and mean of the items' means as predictions."""
    rated = cut(tables.ratings(spark, sf_dir))
    items = rec.means(rated.where(~tables.is_test()), "business_id", "prediction").select("business_id", "prediction")
    made = sinks.metrics(F.col("stars"), F.col("prediction"), rated.where(tables.is_test()).join(items, "business_id"))
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


QUERIES = {f.__name__: f for f in (source_text, source_json_reviews, source_evaluations, source_tips, source_businesses, source_users, source_pairs, source_ratings, source_retail, source_points, sink_city_csv, sink_itemset_report, sink_similarity_csv, sink_prediction_csv, sink_community_lines, sink_betweenness_lines, sink_stream_metrics, prediction_metrics)}

_JOINED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_MEANS = "means AS (SELECT business_id, avg(stars) AS prediction FROM train GROUP BY 1)"
_NEXT = "chr(39) || ', ' || chr(39)"
_QUOTED = f"'(' || chr(39) || replace(items, ',', {_NEXT}) || chr(39) || ')'"

ORACLES = {
    "source_text": "SELECT event_type || ' ' || user_id % 7 AS value, count(*) AS n FROM events GROUP BY 1",
    "source_json_reviews": f"SELECT l_orderkey::VARCHAR AS review_id, o_custkey::VARCHAR AS user_id, l_suppkey::VARCHAR AS business_id, ceil(l_quantity / 10)::DOUBLE AS stars, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date {_JOINED}",
    "source_evaluations": f"SELECT o_custkey::VARCHAR AS user_id, sum(l_linenumber)::BIGINT AS useful, sum(trunc(l_quantity)::BIGINT)::BIGINT AS funny, count(*) AS cool {_JOINED} GROUP BY 1",
    "source_tips": f"SELECT o_custkey::VARCHAR AS user_id, l_suppkey::VARCHAR AS business_id, count(*) AS tips {_JOINED} GROUP BY 1, 2",
    "source_businesses": "SELECT s_suppkey::VARCHAR AS business_id, n_name AS city, 4.5::DOUBLE AS stars, length(s_name) AS review_count, s_acctbal AS longitude, -s_acctbal AS latitude FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "source_users": "SELECT c_custkey::VARCHAR AS user_id, c_acctbal AS average_stars, length(c_name) AS review_count, c_nationkey::BIGINT AS useful, length(c_name) + 1 AS funny, length(c_name) + 2 AS cool, NULL::BIGINT AS fans FROM customer",
    "source_pairs": with_(RATINGS) + "SELECT user_id::VARCHAR AS user_id, business_id::VARCHAR AS business_id FROM ratings",
    "source_ratings": with_(RATINGS) + "SELECT user_id::VARCHAR AS user_id, business_id::VARCHAR AS business_id, round(CASE WHEN business_id % 7 <> 0 THEN stars ELSE 0 END, 6) AS stars FROM ratings",
    "source_retail": f"SELECT strftime(o_orderdate, '%Y-%m-%d') || o_custkey AS basket, count(DISTINCT l_partkey) AS n, sum(l_partkey)::BIGINT AS total {_JOINED} GROUP BY 1",
    "source_points": "SELECT vec_id AS idx, 'L' || label AS label, len(embedding)::BIGINT AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "sink_city_csv": RELATIONAL["avg_stars_by_city"],
    "sink_itemset_report": with_(BASKETS, itemsets._N) + f"SELECT string_agg({_QUOTED}, ',' ORDER BY items) AS value FROM ({itemsets._some(2)}) GROUP BY size",
    "sink_similarity_csv": SIMILAR["lsh_similar_pairs"],
    "sink_prediction_csv": with_(RATINGS, _MEANS) + "SELECT user_id, business_id, round(prediction, 6) AS prediction FROM test JOIN means USING (business_id)",
    "sink_community_lines": f"SELECT chr(39) || replace(members, ',', {_NEXT}) || chr(39) AS value FROM ({graphs.ORACLES['lpa_communities']})",
    "sink_betweenness_lines": f"SELECT '(' || chr(39) || src || {_NEXT} || dst || chr(39) || '), ' || round(betweenness * 1000)::BIGINT AS value FROM ({graphs.ORACLES['edge_betweenness']})",
    "sink_stream_metrics": "SELECT DISTINCT user_id FROM events",
    "prediction_metrics": with_(RATINGS, _MEANS) + "SELECT round(sqrt(avg((stars - prediction) * (stars - prediction))), 6) AS rmse, round(min(prediction), 6) AS least, round(max(prediction), 6) AS most, round(avg(prediction), 6) AS mean FROM test JOIN means USING (business_id)",
}
