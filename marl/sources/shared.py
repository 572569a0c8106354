"""Written tables in the folder that driver and executors share: how iterative plans cut their lineage.

The folder is the one that the cluster names in spark.checkpoint.dir. Tables stay until `discard` or `forget`, as
results that are still to be computed may read them.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
_written: set[str] = set()
_path_of: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is named, a local session gets a temporary one; on a cluster that is
    an error, as executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="marl-"))
    return _own_dir[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    _written.add(path := f"{shared_dir(spark)}/marl/{tag}-{uuid.uuid4().hex}")
    return path


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """`df` as a table that survives lost executors, has no lineage, and is computed once."""
    df.write.parquet(path := scratch(df.sparkSession, tag))
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _path_of[made] = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` gave, once nothing that is still to be computed reads them."""
    for table in tables:
        if path := _path_of.pop(table, None):
            _delete(table.sparkSession, path)


def forget(spark: SparkSession) -> int:
    """Deletes what this process has written to the shared folder, once results are stored elsewhere; how many paths."""
    return sum(_delete(spark, path) for path in list(_written))


def _delete(spark: SparkSession, name: str) -> bool:
    _written.discard(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
