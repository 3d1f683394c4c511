import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from litgrid.llm import mixing, sharding


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets_by_resharing(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Deal by weight, stop at the caps, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {s: Fraction(0) for s in order}, set(order)
    while left > 0 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: min(left * weight[s] / total, most * sizes[s] - out[s]) for s in open_}
        for s, g in given.items():
            out[s] += g
        left -= sum(given.values())
        open_ = {s for s in open_ if out[s] < most * sizes[s]}
        if not sum(given.values()):
            break
    return out


@pytest.mark.parametrize("bucket_rows", [None, 3])
def test_mixing(docs, rows, bucket_rows):
    got = mixing.mix(docs, bucket_rows=bucket_rows).withColumn("k", F.lit(1)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = targets_by_resharing(sizes)
    by_target = defaultdict(int)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert sorted((s, round(float(want[k]), 6)) for k, s in sizes.items()) == sorted(by_target)
    largest = max(words(r[1]) for r in rows)
    for (_, target), taken in by_target.items():
        assert abs(taken - target) <= largest
    again = mixing.mix(docs.repartition(5), bucket_rows=bucket_rows).withColumn("k", F.lit(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_come_as_often_as_taken(docs, rows):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert sum(words(r["text"]) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_mixing_of_nothing(empty, docs):
    assert mixing.mix(empty).collect() == [] == mixing.mix_documents(empty).collect()
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}


@pytest.mark.parametrize(("shards", "slot_rows"), [(40, 200_000), (4, 5), (1, 10)])
def test_sharding(docs, rows, shards, slot_rows):
    got = sharding.assign(docs, shards=shards, slot_rows=slot_rows).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    assert sorted(((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got), key=str) == sorted(want, key=str)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text_of = {str(r[0]): r[1] for r in rows if r[0] is not None}
    places = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            places[text_of[str(r["doc_id"])]].add(r["shard"])
    assert all(len(p) == 1 for p in places.values())  # equal texts stay together


def minimax(sizes, shards):
    """The smallest capacity by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min([best[j]] + [max(best[i], sum(sizes[i:j])) for i in range(j)]) for j in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("sizes", [[5, 3, 8, 1, 9, 2, 2, 7], [1] * 30, [4], [100, 1, 1, 1, 1, 1, 1]])
@pytest.mark.parametrize("shards", [1, 3, 5])
def test_capacity_is_minimax(spark, sizes, shards):
    one = spark.createDataFrame([(sizes,)], "sizes array<bigint>")
    assert one.select(sharding.smallest_capacity(F.col("sizes"), F.lit(shards))).first()[0] == minimax(sizes, shards)


@pytest.mark.parametrize(("shards", "first_bits"), [(7, 2), (7, 16), (3, 1), (1, 4)])
def test_shards_of_split_ranges_are_minimax_over_the_groups(spark, shards, first_bits):
    rng = random.Random(shards)
    docs = spark.createDataFrame([(i, f"t{i % 90} " * (1 + (i % 90) ** 2 % 37)) for i in range(300)] + [(i, "y" * rng.randrange(400)) for i in range(60)], "doc_id bigint, text string").repartition(3)
    groups = [r["size"] for r in sharding.measured(docs).groupBy("h").agg(F.sum("size").alias("size")).orderBy("h").collect()]
    got = [r["size"] for r in sharding.assign(docs, shards=shards, first_bits=first_bits).groupBy("shard").agg(F.sum("size").alias("size")).collect()]
    assert len(got) == shards and sum(got) == sum(groups) and max(got) == minimax(groups, shards)


def test_sizes_are_near_equal(spark):
    got = sharding.assign(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("shard").agg(F.sum("size").alias("s")).agg(F.count("*"), F.min("s"), F.max("s"), F.avg("s")).first()
    assert got[0] == 40 and got[1] > 0.75 * got[3] and got[2] < 1.1 * got[3]


def test_hot_text_gets_its_own_shard(spark):
    docs = spark.createDataFrame([(i, "hot " * 50 if i % 3 == 0 else f"text {i} " * 10) for i in range(3000)], "doc_id bigint, text string")
    got = sharding.assign(docs, shards=10, slot_rows=100).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    rest = sorted(r["s"] for r in got)[:-1]
    assert len(got) == 10 and max(rest) < 1.2 * min(rest)


CLASHES = ["c", "k", "__key", "__grp", "shard", "shard_no", "a.b", "c0", "c1", "DOC_ID2", "t", "h", "n", "share", "nth", "size", "key", "class"]


def clashing(docs):
    return docs.drop("shard", "c0").select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)], F.lit("x").alias("lang"))


def test_columns_of_any_name_are_kept(docs, rows):
    wide = clashing(docs)
    mixed, placed = mixing.mix_documents(wide), sharding.shard_documents(wide, shards=5)
    assert mixed.columns == wide.columns and placed.columns == [*wide.columns, "shard_no_2"]
    assert sorted(map(str, mixed.collect())) == sorted(map(str, clashing(mixing.mix_documents(docs)).collect()))
    got = placed.collect()
    assert len(got) == len(rows) and {tuple(r[5:-2]) for r in got} == {tuple(range(len(CLASHES)))}


def test_rows_of_one_id_and_equal_rows_are_dealt_to_many_buckets(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"w{i % 300} x y", "s") for i in range(3000)] + [(5, "a b c", "s")] * 1000, "doc_id bigint, text string, source string").repartition(4)
    got = mixing.mix(docs, bucket_rows=100)
    assert got.count() == 4000 and abs(got.agg(F.sum("taken")).first()[0] - 1.5 * 12000) <= 3
    copied = mixing.mix_documents(docs, bucket_rows=100)
    assert copied.count() * 3 == got.agg(F.sum("taken")).first()[0]
    slots = sharding.assign(docs, shards=3, slot_rows=50).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots) and sum(r["n"] for r in slots) == 4000


def test_shard_documents(docs, rows, empty):
    out = sharding.shard_documents(docs, shards=5)
    assert out.columns == [*docs.columns, "shard_no"] and out.count() == len(rows)
    assert sharding.shard_documents(empty).collect() == [] == sharding.assign(empty).collect()
