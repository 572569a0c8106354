"""Stream queries: sketches in batch form, event-time windows, and the same by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import sketches as sk
from marl.plans.views import STREAM, with_
from marl.sources import readers, tables
from marl.sources.shared import scratch
from marl.streaming import streams as st


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.stream(spark, sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def _shown(df: DataFrame) -> DataFrame:
    for c in ("start", "end"):
        if c in df.columns:
            df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("total", F.round("total", 2)) if "total" in df.columns else df


def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.bloom(_stream(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


def fm_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.flajolet_martin(_stream(spark, sf_dir))


def batch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.batch_distinct(_stream(spark, sf_dir))


def fm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of all estimates over the sum of all true counts."""
    both = sk.flajolet_martin(_stream(spark, sf_dir)).join(sk.batch_distinct(_stream(spark, sf_dir)), "batch_id")
    return both.agg(F.round(F.sum("estimate") / F.sum("n"), 9).alias("ratio"))


def reservoir_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.reservoir(_stream(spark, sf_dir))


def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(st.tumbling(_events(spark, sf_dir)))


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(st.sliding(_events(spark, sf_dir)))


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(st.sessions(_events(spark, sf_dir)))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(st.run_once(st.tumbling(st.events(spark, sf_dir)), "complete"))


def stream_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.run_once(st.flajolet_martin(st.events(spark, sf_dir)), "complete")


def stream_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.run_once(st.first_seen(st.events(spark, sf_dir)))


def bloom_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter over ids that are strings, hashed by their bytes."""
    named = _stream(spark, sf_dir).withColumn("user_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return sk.bloom(named).withColumn("rate", F.round("rate", 9))


def _in_files(spark: SparkSession, sf_dir: str, files: int = 4):
    """The events as a stream of several files that arrive one after another."""
    path = scratch(spark, "arrivals")
    rows = tables.table(spark, sf_dir, "events").select("event_id", "user_id")
    n = (rows.agg(F.max("event_id")).first()[0] or 0) // files + 1
    for i in range(files):
        rows.where((F.col("event_id") >= i * n) & (F.col("event_id") < (i + 1) * n)).coalesce(1).write.mode("append").parquet(path)
    return st.arrivals(spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(path))


def stream_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.bloom(_in_files(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


def stream_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.reservoir(_in_files(spark, sf_dir))


def replacement_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty batches of a hundred users, drawn from the events with replacement."""
    events = tables.table(spark, sf_dir, "events").select("event_id", "user_id")
    return readers.sampled_batches(events, "event_id", 100, 30).select("seq", "batch_id", "user_id")


QUERIES = {f.__name__: f for f in (bloom_strings, stream_bloom, stream_reservoir, replacement_stream, bloom_fpr, fm_estimates, batch_distinct, fm_ratio, reservoir_snapshots, tumbling_counts, sliding_counts, session_counts, stream_tumbling, stream_fm, stream_users)}


def _hash(x: str, i: int, prime: int, length: int) -> str:
    a, b = sk.coefficients(i)
    return f"(({a % prime} * ({x} % {prime}) + {b % prime}) % {prime}) % {length}"


def _bits(x: str) -> str:
    return "\nUNION ALL ".join(f"SELECT seq, user_id, {_hash(x, i, sk.BLOOM_PRIME, sk.BLOOM_BITS)} AS bit FROM stream" for i in range(1, sk.BLOOM_HASHES + 1))


def _bloom(x: str) -> str:
    return f""", bits AS ({_bits(x)}),
first AS (SELECT bit, min(seq) AS at FROM bits GROUP BY bit),
seen AS (SELECT user_id, min(seq) AS at FROM stream GROUP BY user_id),
judged AS (SELECT b.seq, max(f.at) < b.seq AS reported FROM bits b JOIN first f USING (bit) GROUP BY b.seq)
SELECT batch_id, sum((reported AND s.at >= seq)::INT)::BIGINT AS false_positives, count(*) AS n, round(sum((reported AND s.at >= seq)::INT) / count(*), 9) AS rate
FROM stream JOIN judged USING (seq) JOIN seen s USING (user_id) GROUP BY batch_id"""


#: The bytes of a string as one number modulo the prime.
_BYTES = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(user_id, ''), lambda c: ascii(c)::BIGINT)), lambda x, y: (x * 256 + y) % {sk.BLOOM_PRIME})"
_ZEROS = "CASE WHEN {0} = 0 THEN 1 ELSE bit_count(({0} & -({0})) - 1) END"
_FM = " + ".join(f"pow(2, max({_ZEROS.format('(' + _hash('user_id', i, sk.FM_PRIME, sk.FM_RANGE) + ')')}))" for i in range(1, sk.FM_HASHES + 1))
_FM = f"fm AS (SELECT batch_id, floor(({_FM}) / {sk.FM_HASHES})::BIGINT AS estimate FROM stream GROUP BY batch_id)"
_DISTINCT = "truth AS (SELECT batch_id, count(DISTINCT user_id) AS n FROM stream GROUP BY batch_id)"
_DRAW = "(({} * 1103515245 + 12345) % 2147483648)"
_DAY = "SELECT {} AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {} GROUP BY 1, 2"
_TUMBLING = _DAY.format("strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')", "events")

_RESERVOIR = (
    with_(STREAM)
    + f""", taken AS (
  SELECT seq, user_id, CASE WHEN seq < {sk.SLOTS} THEN seq % {sk.SLOTS} ELSE ({_DRAW.format("(" + _DRAW.format("seq") + " + 7)")} // 65536) % {sk.SLOTS} END AS slot
  FROM stream WHERE seq < {sk.SLOTS} OR ({_DRAW.format("seq")} % 1000003) * (seq + 1) < {1000003 * sk.SLOTS}),
ends AS (SELECT batch_id, max(seq) AS seq FROM stream GROUP BY batch_id)
SELECT batch_id, e.seq, {", ".join(f"arg_max(user_id, t.seq) FILTER (slot = {s}) AS slot{s}" for s in sk.SHOWN)}
FROM ends e LEFT JOIN taken t ON t.seq <= e.seq GROUP BY 1, 2"""
)

ORACLES = {
    "bloom_fpr": with_(STREAM) + _bloom("user_id"),
    "stream_bloom": with_(STREAM) + _bloom("user_id"),
    "bloom_strings": with_(STREAM.replace("user_id,", "'user-' || user_id AS user_id,")) + _bloom(_BYTES),
    "replacement_stream": f"""SELECT i AS seq, i // 100 AS batch_id, user_id FROM range(3000) r(i)
JOIN events ON event_id = (((i + {553 * 1000003}) % 2147483648) * 1103515245 + 12345) % 2147483648 % (SELECT count(*) FROM events)""",
    "fm_estimates": with_(STREAM, _FM) + "SELECT * FROM fm",
    "batch_distinct": with_(STREAM, _DISTINCT) + "SELECT * FROM truth",
    "fm_ratio": with_(STREAM, _FM, _DISTINCT) + "SELECT round(sum(estimate) / sum(n), 9) AS ratio FROM fm JOIN truth USING (batch_id)",
    "reservoir_snapshots": _RESERVOIR,
    "stream_reservoir": _RESERVOIR,
    "tumbling_counts": _TUMBLING,
    "sliding_counts": _DAY.format("strftime(date_trunc('day', ts) - to_days(back), '%Y-%m-%d %H:%M:%S')", "events, (VALUES (0), (1)) b(back)"),
    "session_counts": """WITH marked AS (SELECT user_id, ts, (ts - lag(ts) OVER w <= INTERVAL 12 HOUR) IS NOT TRUE AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
runs AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM runs GROUP BY user_id, run""",
    "stream_tumbling": _TUMBLING,
    "stream_fm": with_(STREAM, _FM) + "SELECT * FROM fm",
    "stream_users": "SELECT DISTINCT user_id FROM events",
}
