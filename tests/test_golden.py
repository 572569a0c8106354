"""Micro fixtures with results derived by hand, and properties that hold between operators."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marl.functions import scalars
from marl.operators import cluster, graph, itemsets, recommend, relational, similarity, sketches
from marl.operators.ranking import dense_index
from marl.streaming import streams
from marl.plans import itemsets as plans
from marl.sources import readers, sinks


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_city_average(spark):
    facts = spark.createDataFrame([("b1", 4.0), ("b1", 2.0), ("b2", 5.0), ("b3", 1.0)], "business_id string, stars double")
    city = spark.createDataFrame([("b1", "A"), ("b2", "A"), ("b3", "B"), ("b4", "C")], "business_id string, city string")
    assert got(relational.average_by_group(facts, city, "business_id", "city", "stars")) == [("A", 11 / 3), ("B", 1.0)]
    assert relational.average_by_group(facts.limit(0), city, "business_id", "city", "stars").count() == 0


def test_top_k_ties(spark):
    counts = spark.createDataFrame([("u2", 3), ("u1", 3), ("u3", 1)], "u string, n long")
    assert [r["u"] for r in relational.top_k(counts, 2, "u").collect()] == ["u1", "u2"]


def test_first_character_partition(spark):
    df = spark.createDataFrame([("apple",), ("avocado",), ("banana",), ("été",)], "k string")
    wanted = {}
    for k in ("apple", "avocado", "banana", "été"):
        wanted[ord(k[0]) % 3] = wanted.get(ord(k[0]) % 3, 0) + 1
    assert dict(got(relational.first_character_partition(df, "k", 3))) == wanted


BASKETS = [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (4, "b")]


def test_itemsets_agree(spark):
    pairs = spark.createDataFrame(BASKETS, "basket long, item string")
    wanted = [(1, "a", 3), (1, "b", 3), (1, "c", 2), (2, "a,b", 2), (2, "a,c", 2)]
    show = lambda df: sorted((r["size"], ",".join(r["items"]), r["n"]) for r in df.collect())
    assert show(itemsets.frequent(pairs, 2, 3)) == wanted
    assert show(itemsets.fp_growth(pairs, 2, 4)) == wanted
    assert show(itemsets.count_candidates(pairs, itemsets.local_candidates(pairs, 2, 2, 3), 2)) == wanted
    assert itemsets.frequent(pairs.limit(0), 1, 2).count() == 0


def test_itemsets_brute_force(spark):
    rng = random.Random(3)
    baskets = {i: set(rng.sample("abcdefg", rng.randint(1, 5))) for i in range(60)}
    pairs = spark.createDataFrame([(i, x) for i, b in baskets.items() for x in b], "basket long, item string")
    wanted = {}
    for size in (1, 2, 3):
        for c in itertools.combinations("abcdefg", size):
            n = sum(set(c) <= b for b in baskets.values())
            if n >= 6:
                wanted[c] = n
    found = {tuple(r["items"]): r["n"] for r in itemsets.frequent(pairs, 6, 3).collect()}
    assert found == wanted
    assert all(sub in found for s in found if len(s) > 1 for sub in itertools.combinations(s, len(s) - 1))


def test_candidates_of_any_shape(spark):
    """Candidates need no subset beside them; a null basket is a basket to the count and none to the levels above one item."""
    rng = random.Random(8)
    baskets = {i: set(rng.sample("abcdefg", rng.randint(1, 6))) for i in range(30)} | {None: set("abcdefg")}
    pairs = spark.createDataFrame([(i, x) for i, b in baskets.items() for x in sorted(b)], "basket long, item string")
    asked = ["g", "ac", "bdf", "az", "abcdefg"]
    candidates = spark.createDataFrame([(len(c), list(c)) for c in asked], "size int, items array<string>")
    wanted = sorted((len(c), list(c), n) for c in asked if (n := sum(set(c) <= b for b in baskets.values())))
    assert got(itemsets.count_candidates(pairs, candidates, 1)) == wanted
    assert itemsets.count_candidates(pairs, candidates.limit(0), 1).count() == 0
    held = lambda c: sum(set(c) <= b for i, b in baskets.items() if i is not None)
    found = got(itemsets.levels(pairs, F.col("n") >= 1, 3)[2], "items", "n")
    assert found == sorted((list(c), held(c)) for c in itertools.combinations("abcdefg", 3) if held(c))


def test_son_has_no_largest_size(spark, monkeypatch):
    rng = random.Random(6)
    baskets = {i: set(rng.sample("abcdefgh", rng.randint(1, 6))) for i in range(40)} | {40: set("abcd"), 41: set("efgh")}
    pairs = spark.createDataFrame([(i, x) for i, b in baskets.items() for x in sorted(b)], "basket long, item string")
    monkeypatch.setattr(plans, "_pairs", lambda spark, sf_dir: pairs)
    monkeypatch.setattr(plans, "SUPPORT", 0.1)
    every = [c for size in range(1, 9) for c in itertools.combinations("abcdefgh", size)]
    held = lambda c, some: sum(set(c) <= b for i, b in baskets.items() if some is None or i % plans.PARTS == some)
    least = math.ceil(0.1 * len(baskets))
    parts = {p: math.ceil(least * sum(i % plans.PARTS == p for i in baskets) / len(baskets)) for p in range(plans.PARTS)}
    wanted = sorted((len(c), ",".join(c), held(c, None)) for c in every if held(c, None) >= least)
    assert wanted[-1][0] >= 4
    assert got(plans.son_frequent(spark, "")) == wanted == got(plans.fp_growth(spark, ""))
    local = itemsets.local_candidates(pairs, least, plans.PARTS)
    assert sorted(tuple(r["items"]) for r in local.collect()) == sorted(c for c in every if any(held(c, p) >= n for p, n in parts.items()))
    monkeypatch.setattr(plans, "_pairs", lambda spark, sf_dir: pairs.limit(0))
    assert got(plans.son_frequent(spark, "")) == []


def _sets(spark, n=40, seed=5):
    rng = random.Random(seed)
    base = [set(rng.sample(range(60), rng.randint(3, 20))) for _ in range(n // 2)]
    sets = base + [set(s) ^ set(rng.sample(range(60), 2)) for s in base]
    rows = [(i, x) for i, s in enumerate(sets) for x in s]
    return sets, spark.createDataFrame(rows, "owner long, item long")


def test_jaccard_brute_force(spark):
    sets, pairs = _sets(spark)
    wanted = {(i, j): len(a & b) / len(a | b) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) >= 0.5 * len(a | b)}
    exact = {(r["owner"], r["other"]): r["similarity"] for r in similarity.jaccard_pairs(pairs, 0.5).collect()}
    assert exact == pytest.approx(wanted)
    lsh = {(r["owner"], r["other"]) for r in similarity.lsh_pairs(pairs, 0.5).collect()}
    assert lsh <= set(exact) and len(lsh) >= 0.8 * len(exact)
    overlap = {(r["owner"], r["other"], r["n"]) for r in similarity.overlapping_pairs(pairs, 5).collect()}
    assert overlap == {(i, j, len(a & b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if len(a & b) >= 5}


def test_dense_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "k string")
    assert got(dense_index(df, "k")) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("x, y, wanted", [([4.0], [2.0], 0.0), ([3.0, 3.0], [1.0, 5.0], 0.0), ([1.0, 2.0, 3.0], [2.0, 4.0, 6.0], 1.0)])
def test_pearson(spark, x, y, wanted):
    rows = [(u, 1, v) for u, v in enumerate(x)] + [(u, 2, v) for u, v in enumerate(y)]
    made = recommend.pearson(spark.createDataFrame(rows, "user_id long, business_id long, stars double"))
    assert got(made) == [(1, 2, len(x), wanted)]


def test_rescale_and_bins(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 4.0)], "user_id long, business_id long, prediction double")
    assert [r["prediction"] for r in recommend.rescaled(df).orderBy("business_id").collect()] == [1.0, 3.0, 5.0]
    errors = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (4.0,), (4.1,)], "e double")
    assert got(errors.groupBy(scalars.error_bin(F.col("e")).alias("b")).count()) == [("0-1", 2), ("1-2", 1), ("3-4", 1), (">4", 1)]
    n = spark.createDataFrame([(0,), (20,), (50,), (80,)], "n long")
    assert [r[0] for r in n.select(scalars.blend_weight(F.col("n"))).collect()] == [0, 0.2, 0.5, 0.5]


def test_scalars(spark):
    zeros = spark.createDataFrame([(12,), (1,), (0,)], "x long")
    assert [r[0] for r in zeros.select(scalars.trailing_zeros(F.col("x"))).collect()] == [2, 0, 1]
    texts = ["u1", "", "é", "a longer id of 22 chars"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(scalars.bytes_mod(F.col("t"), 24593)).collect()] == [int.from_bytes(t.encode(), "big") % 24593 for t in texts]
    assert df.select(scalars.bytes_mod(F.col("t"), 24593)).first()[0] == 5408


BARBELL = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("e", "f")]


@pytest.mark.parametrize("broadcast_edges", [graph.BROADCAST_EDGES, 0])
def test_betweenness(spark, broadcast_edges):
    edges = spark.createDataFrame(BARBELL, "src string, dst string")
    made = {(r["src"], r["dst"]): r["betweenness"] for r in graph.betweenness(edges, broadcast_edges).collect()}
    assert made == pytest.approx({("c", "d"): 9, ("a", "c"): 4, ("b", "c"): 4, ("d", "e"): 4, ("d", "f"): 4, ("a", "b"): 1, ("e", "f"): 1})
    path = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [r["betweenness"] for r in graph.betweenness(path, broadcast_edges).collect()] == [2, 2]
    assert graph.betweenness(path.limit(0), broadcast_edges).count() == 0


def test_modularity_and_cuts(spark):
    edges = spark.createDataFrame(BARBELL, "src string, dst string")
    split = spark.createDataFrame([(v, "a" if v in "abc" else "d") for v in "abcdef"], "id string, label string")
    cut_edges = edges.where("not (src = 'c' and dst = 'd')")
    assert graph.modularity(edges, split).first()[0] == pytest.approx(0.357143, abs=1e-6)
    assert graph.modularity(edges, split, cut_edges, "reference").first()[0] == pytest.approx(0.306122, abs=1e-6)
    assert got(graph.girvan_newman(edges)) == sorted((v, "a" if v in "abc" else "d") for v in "abcdef")
    assert got(graph.girvan_newman(edges.limit(0))) == got(graph.girvan_newman(edges.limit(0), until_drop=True)) == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    assert dict(got(graph.components(edges))) == {**dict.fromkeys(range(21), 0), 50: 50, 51: 50}


def _stream(spark, n=2000, users=150, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.randint(1, users), i // 100) for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, user_id long, batch_id long")


def test_bloom_is_sequential(spark):
    rows, df = _stream(spark)
    prime, bits, k = 331, 400, 3
    hashes = [[((a % prime) * (u % prime) + b % prime) % prime % bits for a, b in (sketches.coefficients(i) for i in range(1, k + 1))] for _, u, _ in rows]
    seen, filled, wanted = set(), set(), {}
    for (_, u, batch), own in zip(rows, hashes, strict=True):
        reported = filled.issuperset(own)
        assert not (u in seen and not reported)  # no false negatives
        wanted[batch] = wanted.get(batch, 0) + (reported and u not in seen)
        seen.add(u)
        filled.update(own)
    assert {r["batch_id"]: r["false_positives"] for r in sketches.bloom(df, k, prime, bits).collect()} == wanted
    assert sum(wanted.values()) > 0


def test_reservoir_is_sequential(spark):
    rows, df = _stream(spark, 3000)
    draw = lambda x: (x * 1103515245 + 12345) % 2147483648
    slots, after = {}, {}
    for seq, user, batch in rows:
        if seq < 100:
            slots[seq] = user
        elif draw(seq) % 1000003 * (seq + 1) < 1000003 * 100:
            slots[draw(draw(seq) + 7) // 65536 % 100] = user
        assert len(slots) <= 100
        after[batch] = tuple(slots.get(s) for s in sketches.SHOWN)
    made = {r["batch_id"]: tuple(r[f"slot{s}"] for s in sketches.SHOWN) for r in sketches.reservoir(df).collect()}
    assert made == after


def test_flajolet_martin(spark):
    rows, df = _stream(spark, 500)
    wanted = {}
    for batch in range(5):
        powers = []
        for i in range(1, 11):
            a, b = sketches.coefficients(i)
            values = {((a % 12289) * (u % 12289) + b % 12289) % 12289 % 769 for _, u, t in rows if t == batch}
            powers.append(2 ** max(1 if v == 0 else (v & -v).bit_length() - 1 for v in values))
        wanted[batch] = int(sum(powers) / 10)
    assert {r["batch_id"]: r["estimate"] for r in sketches.flajolet_martin(df).collect()} == wanted


def test_cluster_statistics(spark):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [9.0, 9.0]), (2, [11.0, 5.0])], "cid long, x array<double>")
    made = {r["cid"]: r for r in cluster.summaries(points).collect()}
    assert (made[1]["n"], made[1]["sum"], made[1]["sumsq"]) == (2, [2.0, 2.0], [4.0, 2.0])
    std = spark.createDataFrame([(2, [4.0], [10.0])], "n long, s array<double>, q array<double>")
    assert std.select(cluster.deviation(F.col("n"), F.col("s"), F.col("q"))).first()[0] == [1.0]
    one = spark.createDataFrame([([3.0, 0.0], [1.0, 0.0], [1.0, 1.0])], "x array<double>, c array<double>, s array<double>")
    assert one.select(cluster.mahalanobis(F.col("x"), F.col("c"), F.col("s"))).first()[0] == 2 < 2 * math.sqrt(2)
    two = cluster.summaries(points)
    again = cluster.merged(two.unionByName(two))
    assert {r["cid"]: r["n"] for r in again.collect()} == {1: 4, 2: 4}


def test_bfr_accounts_for_every_point(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(20 * (i % 3), 1), rng.gauss(-20 * (i % 3), 1)]) for i in range(150)] + [(150, [500.0, 500.0])]
    points = spark.createDataFrame(rows, "idx long, x array<double>")
    rounds, labels = cluster.bfr(points, 3)
    last = rounds.orderBy(F.desc("round")).first()
    assert last["ds_points"] + last["cs_points"] + last["rs_points"] == 151 == labels.select("idx").distinct().count()
    found = dict(got(labels))
    assert found[150] == -1


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\nu1,b1,4.0\nu2,b2\n")
    assert got(readers.rating_triples(spark, str(tmp_path / "r.csv"))) == [("u1", "b1", 4.0), ("u2", "b2", 0.0)]
    assert got(readers.pairs(spark, str(tmp_path / "r.csv"))) == [("u1", "b1"), ("u2", "b2")]
    (tmp_path / "t.csv").write_text('"D","C","x","y","z","P"\n"11/1/2000","77","a, b","","","0042"\n')
    assert got(readers.retail(spark, str(tmp_path / "t.csv"))) == [("11/1/200077", 42)]
    (tmp_path / "p.txt").write_text("3,L,1.5,-2\n")
    assert got(readers.points(spark, str(tmp_path / "p.txt"))) == [(3, "L", [1.5, -2.0])]
    (tmp_path / "j.json").write_text('{"user_id": "u", "useful": 2, "funny": 1, "cool": 0, "other": [1]}\n{"user_id": "u", "useful": 3, "funny": 0, "cool": 1}\n')
    read = readers.json_lines(spark, str(tmp_path / "j.json"), readers.REVIEW)
    assert got(readers.evaluations(read)) == [("u", 5, 1, 1)]
    assert got(readers.tip_counts(read.select("user_id", F.lit("b").alias("business_id")))) == [("u", "b", 2)]
    assert readers.text(spark, str(tmp_path / "p.txt"), 3).rdd.getNumPartitions() == 3
    sets = spark.createDataFrame([(1, ["b"]), (1, ["a"]), (2, ["a", "b"])], "size long, items array<string>")
    sinks.itemset_report(sets, str(tmp_path / "report"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))) == "('a'),('b')\n\n('a', 'b')\n\n"
    sinks.csv(sets.select("size"), str(tmp_path / "csv"), ["the size"])
    sinks.json_objects(sets, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["the size"]
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    sinks.member_lines(sets, "items", str(tmp_path / "members"))
    assert got(spark.read.text(str(tmp_path / "members"))) == [("'a'",), ("'a', 'b'",), ("'b'",)]


def test_streaming_equals_batch(spark, sf_dir):
    from marl.sources import tables

    batch = tables.table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    late = got(streams.run_once(streams.tumbling(streams.events(spark, sf_dir), late="1 hour")), "start", "event_type", "n")
    whole = got(streams.tumbling(batch), "start", "event_type", "n")
    assert late and set(late) <= set(whole)  # the last window stays open
    assert got(streams.run_once(streams.first_seen(streams.events(spark, sf_dir)))) == got(batch.select("user_id").distinct())


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """State outlives a run, wherever the stream is cut; string ids too."""
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(60)}") for i in range(700)]
    source, last = str(tmp_path / "in"), None
    for end in (90, 430, 700):
        begin = 0 if last is None else last
        spark.createDataFrame(rows[begin:end], "event_id long, user_id string").coalesce(1).write.mode("append").parquet(source)
        last = end
        read = lambda: streams.arrivals(spark.readStream.schema("event_id long, user_id string").parquet(source))
        so_far = streams.arrivals(spark.createDataFrame(rows[:end], "event_id long, user_id string"))
        bloom = streams.bloom(read(), str(tmp_path / "bloom"))
        assert got(bloom.select("batch_id", "false_positives", "n", "rate")) == got(sketches.bloom(so_far))
        kept = streams.reservoir(read(), str(tmp_path / "reservoir"))
        assert got(kept) == got(sketches.reservoir(so_far))


def test_source_with_replacement(spark):
    lines = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "number long, value string")
    made = readers.sampled_batches(lines, "number", 50, 4)
    rows = got(made.select("seq", "batch_id", "value"))
    assert [r[0] for r in rows] == list(range(200)) and all(r[1] == r[0] // 50 for r in rows)
    assert rows == got(readers.sampled_batches(lines.repartition(3), "number", 50, 4).select("seq", "batch_id", "value"))
    assert len({r[2] for r in rows}) > 15 and readers.sampled_batches(lines.limit(0), "number", 5, 2).count() == 0


def test_strip_end(spark):
    df = spark.createDataFrame([("1100",), ("a\n",), ("0",)], "t string")
    assert [r[0] for r in df.select(scalars.strip_end(F.col("t"), "0")).collect()] == ["11", "a\n", ""]
    assert df.select(scalars.strip_end(F.col("t"), "\r\n")).collect()[1][0] == "a"


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from marl.sources import shared

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)


def test_written_tables_can_be_discarded(spark):
    from marl.sources import shared

    made, kept = shared.cut(spark.range(3)), shared.cut(spark.range(4))
    path = made.inputFiles()[0].removeprefix("file:").lstrip("/")
    shared.discard(made, made, spark.range(1))
    import os

    assert not os.path.exists("/" + path) and kept.count() == 4


def test_written_tables_can_be_forgotten(spark):
    from marl.sources import shared

    made = shared.cut(spark.range(3))
    assert made.count() == 3 and shared.forget(spark) >= 1 and shared.forget(spark) == 0
