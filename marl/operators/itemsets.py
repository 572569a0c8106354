"""Frequent itemsets: A-Priori by levels, SON over keyed partitions, PCY buckets, FP-growth.

Input is (basket, item), distinct. An itemset is a sorted array of items.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marl.functions.scalars import character_sum
from marl.sources.shared import cut


def baskets(pairs: DataFrame, larger_than: int = 0) -> DataFrame:
    """(basket, items) of baskets with more than `larger_than` distinct items."""
    made = pairs.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return made.where(F.size("items") > larger_than)


def swapped(pairs: DataFrame) -> DataFrame:
    """The other orientation: items as baskets."""
    return pairs.select(F.col("item").alias("basket"), F.col("basket").alias("item"))


def n_baskets(pairs: DataFrame) -> int:
    return pairs.select("basket").distinct().count()


def _joined(frequent: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of the next size: sets that share all but their last item, every subset of which is frequent."""
    head = frequent.select(*keys, F.slice("items", 1, F.size("items") - 1).alias("head"), F.element_at("items", -1).alias("last"))
    other = head.withColumnRenamed("last", "more")
    made = head.join(other, [*keys, "head"]).where("last < more").select(*keys, F.concat("head", F.array("last", "more")).alias("items"))
    subsets = made.select(*keys, "items", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.filter("items", lambda x, j: j != i - 1))).alias("subset"))
    known = frequent.select(*keys, F.col("items").alias("subset"))
    sound = subsets.join(known, [*keys, "subset"]).groupBy(*keys, "items").agg(F.count("*").alias("n"))
    return sound.where(F.col("n") == F.size("items")).select(*keys, "items")


def levels(pairs: DataFrame, enough: Column, largest: int | None, keys: list[str] | None = None) -> list[DataFrame]:
    """For each size up to `largest`, or until a level is empty: (keys, items, n) with n enough. `keys`, columns of
    `pairs`, are mined apart.

    `enough` is a condition on n. A basket's frequent items meet once, in one array: with a support of a share of the
    baskets, there are no more of them than the mean basket's size over that share, however large the tables. Each occurrence
    of an itemset is a row that carries the basket's later items, so it grows in place. Items are shuffled once, by basket;
    after that only counts are, combined before, while a level's sets are below the planner's broadcast threshold.
    """
    keys = keys or []
    single = cut(pairs.groupBy(*keys, "item").agg(F.count("*").alias("n")).where(enough).select(*keys, F.array("item").alias("items"), "n"))
    found = [single]
    if largest == 1:
        return found
    often = pairs.join(single.select(*keys, F.element_at("items", 1).alias("item")), [*keys, "item"], "left_semi").where("basket is not null")
    none = F.slice("rest", 1, 0).alias("items")
    seen = _grown(often.groupBy(*keys, "basket").agg(F.array_sort(F.collect_list("item")).alias("rest")).select(*keys, none, "rest"), keys)
    while len(found) < largest if largest is not None else not found[-1].isEmpty():
        seen = cut(_within(seen.where(F.size("rest") > 0), found[-1], keys) if len(found) > 1 else seen.where(F.size("rest") > 0))
        seen = _grown(seen, keys)
        if len(found) > 1:  # of frequent items, every pair is a candidate
            seen = _within(seen, cut(_joined(found[-1], keys)), keys)
        found.append(cut(seen.groupBy(*keys, "items").agg(F.count("*").alias("n")).where(enough)))
    return found if largest is not None or len(found) == 1 else found[:-1]


def _grown(seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items, rest): each itemset with each of the later items of its basket, and what comes after that one."""
    each = seen.select(*keys, "items", "rest", F.posexplode("rest").alias("at", "more"))
    return each.select(*keys, F.concat("items", F.array("more")).alias("items"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))


def _within(seen: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """The occurrences of these itemsets; a written table below the planner's threshold is broadcast."""
    return seen.join(sets.select(*keys, "items"), [*keys, "items"], "left_semi")


def frequent(pairs: DataFrame, support: int, largest: int) -> DataFrame:
    """(size, items, n) of itemsets in at least `support` baskets."""
    parts = [df.select(F.lit(i).alias("size"), "items", "n") for i, df in enumerate(levels(pairs, F.col("n") >= support, largest), 1)]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


def local_candidates(pairs: DataFrame, support: int, parts: int, largest: int | None = None) -> DataFrame:
    """(size, items): itemsets frequent in one part at least, of any size unless `largest` is given; a part is basket
    mod `parts`, its support in proportion."""
    pid = F.pmod("basket", F.lit(parts)).alias("pid")
    sizes = cut(pairs.select("basket").distinct().groupBy(pid).agg(F.count("*").alias("n")))
    n = sizes.agg(F.sum("n")).first()[0]
    local = sizes.select("pid", F.ceil(F.lit(float(support)) * F.col("n") / F.lit(float(n or 1))).alias("least"))
    keyed = pairs.select("basket", "item", pid).join(F.broadcast(local), "pid")  # `parts` rows
    found = levels(keyed, F.col("n") >= F.col("least"), largest, ["pid", "least"])
    made = [df.select(F.lit(i).alias("size"), "items") for i, df in enumerate(found, 1)]
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out.distinct()


def count_candidates(pairs: DataFrame, candidates: DataFrame, support: int) -> DataFrame:
    """(size, items, n) of the candidates in enough baskets. Each candidate meets the baskets at its first item and is
    looked for among their later ones. Items are shuffled once, by basket, and then only counts, combined before, while the
    candidates are below the planner's broadcast threshold; beyond it the join is by first item, hot ones split by AQE.
    """
    candidates = cut(candidates)
    known = candidates.select(F.explode("items").alias("item")).distinct()
    lists = pairs.join(known, "item", "left_semi").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("rest"))
    starts = _grown(lists.select(F.slice("rest", 1, 0).alias("items"), "rest"), []).select(F.element_at("items", 1).alias("first"), "rest")
    met = starts.join(candidates.withColumn("first", F.element_at("items", 1)), "first")
    held = met.where(F.size(F.array_except(F.slice("items", 2, F.size("items")), "rest")) == 0)
    return held.groupBy("size", "items").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def pair_buckets(pairs: DataFrame, buckets: int = 1000) -> DataFrame:
    """(bucket, n): pairs of a basket's items by the sum of their characters' codes."""
    coded = pairs.select("basket", "item", character_sum(F.col("item").cast("string")).alias("code"))
    other = coded.select("basket", F.col("item").alias("more"), F.col("code").alias("other"))
    both = coded.join(other, "basket").where("item < more")
    return both.groupBy(((F.col("code") + F.col("other")) % buckets).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def fp_growth(pairs: DataFrame, support: int, total: int) -> DataFrame:
    """(size, items, n) by FP-growth, of any size."""
    fitted = FPGrowth(itemsCol="items", minSupport=max(support - 0.5, 0) / max(total, 1)).fit(baskets(pairs))
    return fitted.freqItemsets.select(F.size("items").alias("size"), F.array_sort("items").alias("items"), F.col("freq").alias("n"))
