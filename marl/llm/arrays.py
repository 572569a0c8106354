"""Array helpers that DataFrame functions lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of `before`; appending to an array copies it, so long arrays are summed by blocks.
_BLOCK = 64


def _before(lengths: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, x: F.struct((acc["pos"] + x).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))
    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


def before(lengths: Column) -> Column:
    """For each element of an integer array: the sum of those before it."""
    lengths = F.transform(lengths, lambda x: x.cast("long"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    whole = F.flatten(F.zip_with(cut, _before(F.transform(cut, total)), lambda b, o: F.transform(_before(b), lambda x: x + o)))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<bigint>"))
