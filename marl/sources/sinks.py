"""Sinks: Spark writes the rows, so a result never passes through the driver. Formats stay at the sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def json_objects(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A headered CSV; `names` may hold blanks."""
    (df.toDF(*names) if names else df).write.mode("overwrite").csv(path, header=True)


def itemset_line(items: Column) -> Column:
    """('a', 'b') as reports show it; one item has no trailing comma."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_report(itemsets: DataFrame, path: str) -> None:
    """One line for each size, its itemsets in order, joined by commas. Rows: (size, items)."""
    lines = itemsets.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("items")), itemset_line), ",").alias("value"))
    lines.orderBy("size").select("value").write.mode("overwrite").text(path, lineSep="\n\n")


def member_lines(df: DataFrame, members: str, path: str) -> None:
    """One community a line, its members quoted and joined by commas and blanks."""
    df.select(F.concat(F.lit("'"), F.array_join(members, "', '"), F.lit("'")).alias("value")).write.mode("overwrite").text(path)


def edge_lines(df: DataFrame, path: str, value: str = "betweenness") -> None:
    """One edge a line, its ends as a pair of quoted names, a comma and its number."""
    pair = F.concat(F.lit("('"), F.col("src").cast("string"), F.lit("', '"), F.col("dst").cast("string"), F.lit("'), "))
    df.select(F.concat(pair, F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def stream_metrics(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A streaming result as CSV with a header, exactly once."""
    return df.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def metrics(actual: Column, predicted: Column, df: DataFrame) -> DataFrame:
    """One row: rmse, least, most and mean of the predictions."""
    return df.agg(F.sqrt(F.avg(F.pow(actual - predicted, 2))).alias("rmse"), F.min(predicted).alias("least"), F.max(predicted).alias("most"), F.avg(predicted).alias("mean"))
