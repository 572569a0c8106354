"""Structured Streaming forms of the stream summaries, and event-time windows.

Each takes a streaming (or batch) DataFrame of events; `run_once` drives one to the end of what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.operators import sketches
from marl.sources.shared import cut, scratch

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with `at`, a timestamp that watermarks accept."""
    read = spark.readStream.schema(EVENT).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return read.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of one width."""
    return _windowed(df, F.window("at", width), late)


def sliding(df: DataFrame, width: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    return _windowed(df, F.window("at", width, step), late)


def _windowed(df: DataFrame, window, late: str | None) -> DataFrame:
    seen = df.withWatermark("at", late) if late else df
    return seen.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no longer pause than the gap."""
    seen = df.withWatermark("at", late) if late else df
    return seen.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(df: DataFrame) -> DataFrame:
    """Users as they are first seen: the exact set that membership filters are held against."""
    return df.select("user_id").dropDuplicates(["user_id"])


def flajolet_martin(df: DataFrame, size: int = 100) -> DataFrame:
    """The estimates by batch of `size` events; in a stream, batches are updated as they fill."""
    return sketches.flajolet_martin(arrivals(df, size))


def arrivals(df: DataFrame, size: int = 100) -> DataFrame:
    """Events as the sketches take them: (seq, user_id, batch_id)."""
    return df.select(F.col("event_id").alias("seq"), "user_id", F.floor(F.col("event_id") / size).cast("long").alias("batch_id"))


def bloom(df: DataFrame, home: str | None = None) -> DataFrame:
    """(batch_id, false_positives, n, rate) of a stream of (seq, user_id, batch_id), over all that is there.

    State between micro-batches: when each bit was set, and when each user was first seen. A micro-batch is judged by
    the state before it and itself, so the result doesn't depend on where the stream was cut. With `home`, a folder,
    a later run goes on where the last one ended.
    """

    def step(rows: DataFrame, before: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        bits = sketches.first_bits(rows).unionByName(before["bits"]).groupBy("bit").agg(F.min("first").alias("first"))
        users = sketches.first_arrivals(rows).unionByName(before["users"]).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"))
        here = users.join(rows.select("user_id").distinct(), "user_id", "left_semi")
        return sketches.bloom_judged(rows, bits, here), {"bits": bits, "users": users}

    kinds = {"bits": "bit long, first long", "users": f"user_id {dict(df.dtypes)['user_id']}, first_seen long"}
    made = _stepped(df, step, "batch_id long, false_positives long, n long", kinds, home)
    return sketches.with_rate(made.groupBy("batch_id").agg(F.sum("false_positives").alias("false_positives"), F.sum("n").alias("n")))


def reservoir(df: DataFrame, home: str | None = None) -> DataFrame:
    """The snapshots of `sketches.reservoir` from a stream; state is the last owner of each shown slot."""
    slots, kind = [f"slot{s}" for s in sketches.SHOWN], dict(df.dtypes)["user_id"]

    def step(rows: DataFrame, before: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
        owners = sketches.slot_owners(rows).unionByName(before["owners"])
        return sketches.snapshots(rows, owners), {"owners": sketches.last_owners(owners)}

    kinds = {"owners": f"slot long, batch_id long, taken_at long, owner {kind}"}
    made = _stepped(df, step, f"batch_id long, seq long, {', '.join(f'{s} {kind}' for s in slots)}", kinds, home)
    last = made.groupBy("batch_id").agg(F.max_by(F.struct("seq", *slots), "seq").alias("last"))  # a batch may span micro-batches
    return last.select("batch_id", "last.*")


Step = Callable[[DataFrame, dict[str, DataFrame]], tuple[DataFrame, dict[str, DataFrame]]]


def _stepped(df: DataFrame, step: Step, schema: str, kinds: dict[str, str], home: str | None) -> DataFrame:
    """Runs a stream through `step` (rows, state) -> (result, new state); all results so far.

    A micro-batch's result and state are written under its number, so one that is repeated writes the same again.
    """
    spark, home = df.sparkSession, home or scratch(df.sparkSession, "stream")

    def batch(rows: DataFrame, number: int) -> None:
        before = {name: spark.read.schema(kind).parquet(f"{home}/{name}/at={number - 1}") if number else spark.createDataFrame([], kind) for name, kind in kinds.items()}
        made, new = step(cut(rows, "micro-batch"), before)
        for name, table in new.items():
            table.write.mode("overwrite").parquet(f"{home}/{name}/at={number}")
        made.write.mode("overwrite").parquet(f"{home}/result/at={number}")

    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{home}/result/at=-1")  # so that a stream without rows reads as none
    query = df.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{home}/result")


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives its result as a table."""
    spark = df.sparkSession
    path, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        write: Callable[[DataFrame, int], None] = lambda rows, n: rows.write.mode("overwrite").parquet(path)
        query = df.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
