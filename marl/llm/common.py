"""What the operators share: the shared folder, written tables, Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.sources.shared import cut, scratch

__all__ = ["WHITE", "WHITE_BYTES", "as_bytes", "bounded_batches", "materialise", "partitions", "rows_of", "scratch", "table", "texts"]

#: The six ASCII white-space characters, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()

#: Rows and bytes of one Arrow batch: long texts must not meet in a worker by the ten thousand.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

def materialise(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a written table: cuts the lineage, survives lost executors, and is computed once."""
    return cut(df, tag)


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes for this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, never reach an operator's plan."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; before the first and after the last, what earlier ones freed goes back to the system."""
    release()
    yield from (b for b in batches if b.num_rows)
    release()


def release() -> None:
    """Hands freed memory back to the system: workers idle between stages, beside others that need it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: glibc's; other C libraries keep no such reserve or have no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
