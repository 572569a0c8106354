"""Stream summaries in forms that need no sequential state.

Input is (seq, user_id, batch_id): unique ascending numbers from 0, and ids that are whole numbers or strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marl.functions.scalars import affine, bytes_mod, trailing_zeros

#: Sizes that the hash families fix: inner modulus and length.
BLOOM_HASHES, BLOOM_PRIME, BLOOM_BITS = 5, 24593, 69997
FM_HASHES, FM_PRIME, FM_RANGE = 10, 12289, 769
#: Reservoir slots whose owner is reported.
SLOTS, SHOWN = 100, (0, 20, 40, 60, 80)


def coefficients(i: int) -> tuple[int, int]:
    """(a, b) of the i-th hash: fixed, so that equal ids hash alike."""
    return 7919 * i + 101, 104729 * i + 13


def _hashes(x: Column, n: int, prime: int, length: int) -> list[Column]:
    return [affine(x, *coefficients(i), prime, length) for i in range(1, n + 1)]


def id_number(stream: DataFrame, column: str, prime: int) -> Column:
    """What the hashes of an id start from: itself, or a string's bytes as one number modulo the prime."""
    return bytes_mod(F.col(column), prime) if dict(stream.dtypes)[column] == "string" else F.col(column)


def first_bits(stream: DataFrame, hashes: int = BLOOM_HASHES, prime: int = BLOOM_PRIME, bits: int = BLOOM_BITS) -> DataFrame:
    """(bit, first): when each bit of the filter is set; `bits` rows at most."""
    x = id_number(stream, "user_id", prime)
    flat = stream.select("seq", F.explode(F.array(*_hashes(x, hashes, prime, bits))).alias("bit"))
    return flat.groupBy("bit").agg(F.min("seq").alias("first"))


def first_arrivals(stream: DataFrame) -> DataFrame:
    """(user_id, first_seen)."""
    return stream.groupBy("user_id").agg(F.min("seq").alias("first_seen"))


def bloom_judged(stream: DataFrame, first_bit: DataFrame, first_user: DataFrame, hashes: int = BLOOM_HASHES, prime: int = BLOOM_PRIME, bits: int = BLOOM_BITS) -> DataFrame:
    """(batch_id, false_positives, n) of events by when bits were set and users first seen, here or before."""
    x = id_number(first_user, "user_id", prime)
    # a user's bits depend on the user alone: the latest first arrival is found once a user
    users = first_user.select("user_id", "first_seen", F.explode(F.array(*_hashes(x, hashes, prime, bits))).alias("bit"))
    latest = users.join(F.broadcast(first_bit), "bit").groupBy("user_id", "first_seen").agg(F.max("first").alias("set_at"))
    judged = stream.join(latest, "user_id").select("batch_id", ((F.col("set_at") < F.col("seq")) & (F.col("first_seen") >= F.col("seq"))).cast("long").alias("fp"))
    return judged.groupBy("batch_id").agg(F.sum("fp").alias("false_positives"), F.count("*").alias("n"))


def with_rate(counted: DataFrame) -> DataFrame:
    return counted.withColumn("rate", F.col("false_positives") / F.col("n"))


def bloom(stream: DataFrame, hashes: int = BLOOM_HASHES, prime: int = BLOOM_PRIME, bits: int = BLOOM_BITS) -> DataFrame:
    """(batch_id, false_positives, n, rate) of a Bloom filter fed in the order of seq.

    A bit is set from its first arrival on, so an event is reported as seen iff all its bits have an earlier
    first arrival, and has been seen iff its user has. There are at most `bits` first arrivals of bits.
    """
    return with_rate(bloom_judged(stream, first_bits(stream, hashes, prime, bits), first_arrivals(stream), hashes, prime, bits))


def flajolet_martin(stream: DataFrame, hashes: int = FM_HASHES, prime: int = FM_PRIME, length: int = FM_RANGE) -> DataFrame:
    """(batch_id, estimate): int(mean of 2^R) over the hashes; R is the most trailing zeros in the batch."""
    most = [F.max(trailing_zeros(h)).alias(f"r{i}") for i, h in enumerate(_hashes(F.col("user_id"), hashes, prime, length))]
    powers = [F.pow(F.lit(2.0), F.col(f"r{i}")) for i in range(hashes)]
    total = powers[0]
    for p in powers[1:]:
        total = total + p
    return stream.groupBy("batch_id").agg(*most).select("batch_id", (total / hashes).cast("long").alias("estimate"))


def batch_distinct(stream: DataFrame) -> DataFrame:
    return stream.groupBy("batch_id").agg(F.count_distinct("user_id").alias("n"))


def _draw(seq: Column) -> Column:
    return (seq * 1103515245 + 12345) % 2147483648


def reservoir(stream: DataFrame, slots: int = SLOTS, shown: tuple[int, ...] = SHOWN) -> DataFrame:
    """(batch_id, seq, slot0, ...): the owners of the shown slots after each batch.

    The first `slots` arrivals fill the slots; arrival n (from 1) is taken with probability slots / n and ousts the
    owner of a slot drawn uniformly. Both draws depend on seq alone, so a slot's owner is the last taken
    arrival that drew it. Taken arrivals number about slots * ln(n / slots): they are broadcast, as intervals of batches.
    """
    return snapshots(stream, slot_owners(stream, slots, shown), shown)


def slot_owners(stream: DataFrame, slots: int = SLOTS, shown: tuple[int, ...] = SHOWN) -> DataFrame:
    """(slot, batch_id, taken_at, owner): the last taken arrival of each batch that drew a shown slot."""
    n = F.col("seq") + 1
    draw = _draw(F.col("seq"))
    taken = (n <= slots) | ((draw % 1000003) * n < F.lit(1000003 * slots))
    slot = F.when(n <= slots, F.col("seq") % slots).otherwise(F.floor(_draw(draw + 7) / 65536) % slots)
    owners = stream.where(taken).select("batch_id", "seq", "user_id", slot.cast("long").alias("slot")).where(F.col("slot").isin(*shown))
    return owners.groupBy("slot", "batch_id").agg(F.max("seq").alias("taken_at"), F.max_by("user_id", "seq").alias("owner"))


def snapshots(stream: DataFrame, owners: DataFrame, shown: tuple[int, ...] = SHOWN) -> DataFrame:
    """The shown slots after each batch of `stream`; `owners` may go back further."""
    until = F.lead("batch_id").over(Window.partitionBy("slot").orderBy("batch_id", "taken_at"))
    spans = owners.select("slot", "owner", F.col("batch_id").alias("since"), until.alias("until"))
    ends = stream.groupBy("batch_id").agg(F.max("seq").alias("seq"))
    held = ends.join(F.broadcast(spans), (F.col("batch_id") >= F.col("since")) & (F.col("until").isNull() | (F.col("batch_id") < F.col("until"))), "left")
    return held.groupBy("batch_id", "seq").agg(*(F.max(F.when(F.col("slot") == s, F.col("owner"))).alias(f"slot{s}") for s in shown))


def last_owners(owners: DataFrame) -> DataFrame:
    """Of (slot, batch_id, taken_at, owner) the last of each slot: all that a reservoir must remember."""
    rest = F.struct("taken_at", "batch_id", "owner")
    return owners.groupBy("slot").agg(F.max(rest).alias("last")).select("slot", "last.batch_id", "last.taken_at", "last.owner")
