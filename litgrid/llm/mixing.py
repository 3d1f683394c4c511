"""Mixing sources to target weights by systematic sampling.

Each source gets a target: `share` of all words, dealt by weight, at most `most` times its own words, the excess dealt again by
weight until none is above (the water level, solved in closed form over the sorted sources). A document's expected copies are
target / source words. Within a source, documents stand in order of size and then of a hash of the id; the running sum of expected copies plus one
random offset of the source crosses an integer boundary now and then, and each crossing emits the document once. Neighbours in
that order have like sizes, so a source's words come out near its target, and no document is emitted more than `most` times.

The prefix sum is distributed: rows are dealt into buckets of (source, size class, hash of id and text), bucket counts are summed over a
small table, and a row's rank is its bucket's base plus its place in the bucket. A hot source is many buckets, and so are rows without an id or
of one id; rows equal in id, text and source are counted where they lie before they are dealt.

Cases: null texts have size 0 and take part with 0 words; null sources are one source, weighed last; a source of size 0 has target 0
and emits nothing; empty tables give no rows; repeated rows are ranked one by one and are interchangeable; extra columns are ignored and, in mix_documents,
kept whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_place, by_place, cut, named_again

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: Size classes of all sources that are broadcast; more are joined by shuffle.
BROADCAST_CLASSES = 100_000


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def uniform(column: Column) -> Column:
    """[0, 1) from the first 28 bits of md5."""
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("double") / F.lit(float(2**28))


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    doc = F.col("doc_id").cast("bigint")
    size = words(F.col("text").cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.md5(text))), 1, 16)
    return docs.select(doc.alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"), *more)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source, source_size): target words of each. One row per source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("place") % len(weights)).cast("int")]
    weighed = sources.withColumn("place", place).withColumn("weight", weight)
    weighed = weighed.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, 0)
    weighed = weighed.withColumns({"goal": F.lit(share) * F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "capped": F.sum("cap").over(rising) - F.col("cap"), "passed": F.sum("weight").over(rising) - F.col("weight")})
    level = (F.col("goal") - F.col("capped")) / (F.col("all_weight") - F.col("passed"))
    # sources below the level stand at their caps; the first that isn't gives the level
    first = F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "place", level.alias("level")))).over(everything)
    weighed = weighed.withColumn("level", first["level"])
    return weighed.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, bucket_rows: int | None = None, **rule) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken."""
    found = taken(cut(measured(docs)), bucket_rows, **rule)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def taken(rows: DataFrame, bucket_rows: int | None = None, most: float = MOST, **rule) -> DataFrame:
    """The rows (kept in the checkpoint folder) with source_size, target, and copies of each. bucket_rows: rows that one task ranks; the square root of all
    rows if not given, so that neither buckets nor their table grow too large."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # a null source is a key too
    keyed = rows.withColumns({"key": source, "class": F.floor(F.sqrt("size")).cast("int")})
    per_class = cut(keyed.groupBy("key", "source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("total")))
    classes, everything = per_class.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bucket_rows = bucket_rows or max(100, math.isqrt(everything))
    dealt = targets(per_class.groupBy("source").agg(F.sum("total").alias("source_size")), most=most, **rule)
    dealt = cut(dealt.withColumn("key", source).select("key", "source_size", "target"))
    # sub-buckets of a class by leading hex digits of the hash keep the order (size class, hash)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / bucket_rows))).cast("int")
    small = F.broadcast if classes <= BROADCAST_CLASSES else lambda df: df
    # equal rows of one partition are one row with a count: at most one for each partition, however many there are
    names = [c for c in keyed.columns if c not in ("key", "class")]
    equal = keyed.groupBy(*names, "key", "class", F.spark_partition_id().alias("part")).agg(F.count("*").alias("c"))
    bucketed = equal.join(small(per_class.select("key", "class", digits.alias("digits"))), ["key", "class"]).withColumn("bucket", F.expr("substring(h, 1, digits)"))
    bucketed = bucketed.drop("digits").repartition("key", "class", "bucket")
    counts = bucketed.groupBy("key", "class", "bucket").agg(F.sum("c").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("key").orderBy("class", "bucket")) - F.col("n")).drop("n")
    order = ("h", "doc_id", "size", "part")
    own = F.sum("c").over(Window.partitionBy("key", "class", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = bucketed.withColumn("own", own).join(counts, ["key", "class", "bucket"]).join(dealt, "key")
    ranked = ranked.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("c"))))
    rank = F.col("base") + F.col("own") + F.col("nth")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform(F.concat(F.lit(SEED + ":"), F.col("key")))
    crossed = F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)
    return ranked.select(*names, "source_size", "target", crossed.cast("bigint").alias("copies"))


def mix_documents(docs: DataFrame, bucket_rows: int | None = None, **rule) -> DataFrame:
    """docs, each row emitted as often as the mix takes it; columns unchanged. Rows equal in id, text and source share their copies."""
    inner = by_place(docs)
    doc, text, source = (at_place(docs, n).cast(t) for n, t in (("doc_id", "bigint"), ("text", "string"), ("source", "string")))
    text_key = F.xxhash64(text, source)
    light = cut(measured(inner.select(doc.alias("doc_id"), text.alias("text"), source.alias("source"), text_key.alias("text_key")), F.col("text_key")))
    shared = taken(light, bucket_rows, **rule).groupBy("doc_id", "text_key").agg(F.sum("copies").alias("k"), F.count("*").alias("n"))
    shared = cut(shared.where("k > 0"))
    keyed = inner.select("*", doc.alias("d"), text_key.alias("t"))
    joined = keyed.join(shared.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_key")))
    single = joined.where("n = 1").withColumn("share", F.col("k"))
    out = [*[f"c{i}" for i in range(len(docs.columns))], "share"]
    parts = single.select(*out)
    if not shared.where("n > 1").isEmpty():
        # repeated rows are numbered by their place in a partition and the partition's base, so a hot one is in many tasks
        many = cut(joined.where("n > 1").repartition(docs.sparkSession.sparkContext.defaultParallelism * 4)).withColumn("part", F.spark_partition_id())
        held = many.groupBy("d", "t", "part").agg(F.count("*").alias("m"))
        held = held.withColumn("base", F.sum("m").over(Window.partitionBy("d", "t").orderBy("part")) - F.col("m")).drop("m")
        held = held.withColumnsRenamed({"d": "hd", "t": "ht", "part": "hp"})
        own = F.row_number().over(Window.partitionBy("d", "t", "part").orderBy("part")) - 1
        numbered = many.withColumn("own", own).join(held, F.col("d").eqNullSafe(F.col("hd")) & (F.col("t") == F.col("ht")) & (F.col("part") == F.col("hp")))
        share = F.floor(F.col("k") / F.col("n")) + (F.col("own") + F.col("base") < F.col("k") % F.col("n")).cast("int")
        parts = parts.unionByName(numbered.withColumn("share", share).where("share > 0").select(*out))
    copied = parts.withColumn("one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("share").cast("bigint"))))
    return named_again(copied, docs)
