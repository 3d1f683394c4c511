"""Sharding by minimax contiguous partition, in DataFrame and SQL functions only.

Documents with equal texts are one atomic group; the groups in order of a 64-bit hash of the text are the ordered atomic sizes. The smallest shard
capacity is found by binary search; whether a capacity is feasible is checked by filling shards greedily; the shards are cut at that capacity: each as near
the mean of what is left as the capacity allows. A group above the mean that would be left for each other shard (for instance thousands of
copies of one text) gets a shard of its own first, so that it doesn't raise the capacity of the others.

The sizes are held as a table of hash ranges of bounded length. Ranges start with 2^16 prefixes of the hash; those in which greedy filling
cuts at a capacity one below the one found are split further, down to single groups, and the search is repeated. Once all these cuts lie between
single groups, that lesser capacity is known to be too small for the groups themselves, and so the one found is the minimum over all of them, however many
there are. Search and check run as SQL higher-order functions over one array.

law is "bytes": shard sizes near equal. slot numbers a shard's rows from 0: rows are counted by (shard, sub-group of a hash of id and text), and equal
rows where they lie, so no task numbers more than about the square root of all rows.

Cases: null texts are one group, of size 16 each and with a null crc; an empty table gives no rows; equal rows (even with equal
or null ids) get slots of their own in an unspecified order among themselves; different texts of one hash are one group; very long texts are atomic; extra
columns are ignored and, in shard_documents, kept whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at_place, by_place, cut, named_again

SHARDS = 40
OVERHEAD = 16
STEPS = 48
#: Bits of the hash that a first range shares, and by which a range is split.
FIRST_BITS, SPLIT_BITS = 16, 8
#: A range above this part of a shard's mean is split down to its groups: it may hold one that needs a shard of its own.
LARGE = 0.5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and hash of each row; the text goes no further than this scan."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bigint(size).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def bigint(column: Column) -> Column:
    return column.cast("bigint")


def struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def smallest_capacity(sizes: Column, shards: Column) -> Column:
    """The smallest feasible capacity by binary search, each tried by greedy filling."""
    total = F.aggregate(sizes, bigint(F.lit(0)), lambda a, x: a + x)
    largest = bigint(F.coalesce(F.array_max(sizes), F.lit(0)))
    mean = bigint(F.ceil(total / shards))

    def used(capacity: Column) -> Column:
        """Shards that greedy filling opens."""
        step = lambda a, x: F.when(a["filled"] + x <= capacity, struct(n=a["n"], filled=a["filled"] + x)).otherwise(struct(n=a["n"] + 1, filled=x))
        return F.aggregate(sizes, struct(n=F.lit(1), filled=bigint(F.lit(0))), step, lambda a: a["n"])

    def halve(a: Column, _: Column) -> Column:
        middle = F.shiftright(a["lo"] + a["hi"], 1)
        lower, upper = struct(lo=a["lo"], hi=middle), struct(lo=middle + 1, hi=a["hi"])
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.when(used(middle) <= shards, lower).otherwise(upper))

    # filling at the mean plus the largest size leaves every shard above the mean, so that is always feasible
    start = struct(lo=F.greatest(largest, mean), hi=mean + largest)
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda a: a["hi"])


EMPTY = "cast(array() as array<bigint>)"


def greedy_ends(sizes: Column, capacity: Column) -> Column:
    """Running sizes at which shards end when each is filled up to the capacity; a size above it is a shard of its own."""
    empty = struct(filled=bigint(F.lit(0)), run=bigint(F.lit(0)), ends=F.expr(EMPTY))
    more = lambda a, x: struct(filled=a["filled"] + x, run=a["run"] + x, ends=a["ends"])
    new = lambda a, x: struct(filled=x, run=a["run"] + x, ends=F.concat(a["ends"], F.array(a["run"])))
    return F.aggregate(sizes, empty, lambda a, x: F.when((a["filled"] + x <= capacity) | (a["run"] == 0), more(a, x)).otherwise(new(a, x)), lambda a: a["ends"])


def even_ends(sizes: Column, capacity: Column, shards: Column, earliest: Column, total: Column) -> Column:
    """Running sizes at which shards end: near the mean of what is left, no shard above the capacity. earliest: the least running size at which the k-th cut
    leaves no more than the others can hold."""
    empty = struct(filled=bigint(F.lit(0)), run=bigint(F.lit(0)), ends=F.expr(EMPTY))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["ends"])
        target = (total - (a["run"] - a["filled"])) / (shards - n)
        full = (a["filled"] > 0) & (a["filled"] + x > capacity)
        near = (a["filled"] > 0) & (n < shards - 1) & (a["run"] >= F.coalesce(F.get(earliest, n), F.lit(0))) & (a["filled"] + x / 2 > target)
        new = struct(filled=x, run=a["run"] + x, ends=F.concat(a["ends"], F.array(a["run"])))
        return F.when(full | near, new).otherwise(struct(filled=a["filled"] + x, run=a["run"] + x, ends=a["ends"]))

    return F.aggregate(sizes, empty, step, lambda a: a["ends"])


def range_sizes(rows: DataFrame, shift: int, wanted: Column | None = None) -> DataFrame:
    """(shift, prefix, lo, hi, total): hash ranges of one width with the least and largest hash in each. A range with lo = hi is a single group."""
    rows = rows if wanted is None else rows.where(wanted)
    prefix = F.shiftright("h", shift) if shift else F.col("h")
    return rows.groupBy(prefix.alias("prefix")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("size").alias("total")).select(F.lit(shift).alias("shift"), "prefix", "lo", "hi", "total")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once: the optimiser would put a search into each step of a lambda that uses it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def searched(ranges: DataFrame, shards: int) -> DataFrame:
    """One row: alone (ranges with shards of their own), items (the others in order), sizes and total of these, shards left for them, capacity, and below (running sizes
    of the cuts at one below the capacity)."""
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    down = Window.orderBy(F.desc("total"), "lo")
    ranked = ranges.withColumns({"rank": F.row_number().over(down), "left": F.sum("total").over(all_rows) - F.sum("total").over(down) + F.col("total")})
    # once one fits its share of what is left, all smaller ones do
    fits = (F.col("total") * (shards - F.col("rank") + 1) <= F.col("left")) | (F.col("rank") >= shards)
    ranked = ranked.withColumn("alone", F.coalesce(F.min(F.when(fits, F.col("rank"))).over(all_rows) - 1, F.count("*").over(all_rows)))
    item = F.struct("lo", "hi", "shift", "prefix", "total")
    one = ranked.agg(F.sort_array(F.collect_list(F.when(F.col("rank") > F.col("alone"), item))).alias("items"), F.sort_array(F.collect_list(F.when(F.col("rank") <= F.col("alone"), item))).alias("alone"))
    sizes = F.transform("items", lambda x: x["total"])
    one = cut(one.withColumns({"sizes": sizes, "total": F.aggregate(sizes, bigint(F.lit(0)), lambda a, x: a + x), "shards": F.lit(shards) - F.size("alone")}))
    found = once(smallest_capacity(F.col("sizes"), F.col("shards")), lambda c: struct(capacity=c, below=F.slice(greedy_ends(F.col("sizes"), c - 1), 1, shards)))
    return cut(one.withColumn("found", found)).select("*", "found.capacity", "found.below")


def even_cuts(planned: DataFrame) -> DataFrame:
    """planned with ends, the running sizes of the cuts."""
    spare = lambda back: F.greatest(F.col("shards") - 1 - F.size(back), F.lit(0))
    # k cuts from behind leave the k-th shard from the end its earliest begin; there may be fewer than shards - 1
    back = greedy_ends(F.reverse("sizes"), F.col("capacity"))
    earliest = once(back, lambda b: F.concat(F.array_repeat(bigint(F.lit(0)), spare(b)), F.transform(F.reverse(b), lambda x: F.col("total") - x)))
    ends = once(earliest, lambda e: even_ends(F.col("sizes"), F.col("capacity"), F.col("shards"), e, F.col("total")))
    return cut(planned.withColumn("ends", ends))


def open_ranges(ranges: DataFrame, planned: DataFrame, shards: int) -> DataFrame:
    """(shift, prefix) of ranges of several groups that must be split: where filling at one below the capacity cuts, and large ones."""
    items = planned.select("below", F.posexplode("items").alias("k", "x")).select("below", "k", "x.*")
    # the range that a shard could not take whole begins at its end
    before = F.sum("total").over(Window.orderBy("k")) - F.col("total")
    at_cut = items.withColumn("before", before).where(F.array_contains("below", F.col("before")))
    most = LARGE * (ranges.agg(F.sum("total")).first()[0] or 0) / shards
    return at_cut.select(*ranges.columns).unionByName(ranges.where(F.col("total") > most)).where("lo < hi").select("shift", "prefix").distinct()


def shard_plan(rows: DataFrame, shards: int, first_bits: int = FIRST_BITS) -> tuple[list[int], list[int]]:
    """(the least hash of each shard, in order; hashes of groups with shards of their own): as many as shards together. rows: h, size."""
    ranges = cut(range_sizes(rows, 64 - first_bits))
    while True:
        planned = searched(ranges, shards)
        to_split = cut(open_ranges(ranges, planned, shards))
        # at most some dozens
        by_shift = {r["shift"]: r["prefixes"] for r in to_split.groupBy("shift").agg(F.collect_list("prefix").alias("prefixes")).collect()}
        if not by_shift:
            break
        finer = [range_sizes(rows, max(0, s - SPLIT_BITS), F.shiftright("h", s).isin(p)) for s, p in by_shift.items()]
        ranges = ranges.join(F.broadcast(to_split), ["shift", "prefix"], "left_anti")
        for f in finer:
            ranges = ranges.unionByName(f)
        ranges = cut(ranges)
    planned = even_cuts(planned)
    placed = planned.select("ends", F.posexplode("items").alias("k", "x")).withColumn("run", F.sum("x.total").over(Window.orderBy("k")) - F.col("x.total"))
    begins = placed.where((F.col("k") == 0) | F.array_contains("ends", F.col("run"))).agg(F.sort_array(F.collect_list("x.lo"))).first()[0]
    return begins, planned.select(F.transform("alone", lambda x: x["lo"])).first()[0]


def shard_of(h: Column, begins: list[int], alone: list[int]) -> Column:
    """The shard of a hash: first the groups that are alone, then the others in order."""
    fixed = lambda values: F.array(*[bigint(F.lit(v)) for v in values]) if values else F.expr(EMPTY)
    own = F.array_position(fixed(alone), h)
    return F.when(own > 0, own - 1).otherwise(len(alone) + F.size(F.filter(fixed(begins), lambda b: b <= h)) - 1).cast("int")


def assign(docs: DataFrame, shards: int = SHARDS, slot_rows: int | None = None, first_bits: int = FIRST_BITS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not "key")."""
    rows = cut(measured(docs))
    placed = rows.withColumn("shard", shard_of(F.col("h"), *shard_plan(rows, shards, first_bits)))
    return numbered(placed, slot_rows or max(1000, math.isqrt(rows.count())))


def numbered(rows: DataFrame, slot_rows: int) -> DataFrame:
    """rows(doc_id, size, text_crc32, h, shard) with gapless slots in each shard."""
    # equal rows of one partition are one row with a count
    equal = rows.groupBy("shard", "doc_id", "size", "text_crc32", "h", F.spark_partition_id().alias("part")).agg(F.count("*").alias("c"))
    subs = equal.groupBy("shard").agg(F.ceil(F.sum("c") / slot_rows).cast("int").alias("subs"))
    dealt = equal.join(F.broadcast(subs), "shard").withColumn("sub", F.pmod(F.xxhash64("doc_id", "h"), F.col("subs")).cast("int"))
    counts = dealt.groupBy("shard", "sub").agg(F.sum("c").alias("n"))
    bases = counts.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("base"))
    own = F.sum("c").over(Window.partitionBy("shard", "sub").orderBy("doc_id", "h", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    placed = dealt.repartition("shard", "sub").withColumn("own", own).join(bases, ["shard", "sub"])
    placed = placed.withColumn("nth", F.explode(F.sequence(bigint(F.lit(0)), F.col("c") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", bigint(F.col("base") + F.col("own") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, first_bits: int = FIRST_BITS) -> DataFrame:
    """docs with one more column, shard (shard_no, shard_no_2, ... if there is one of that name): each row's text picks its hash, and that its shard."""
    inner = by_place(docs)
    text = at_place(docs, "text").cast("string")
    taken = {n.lower() for n in docs.columns}
    names = ["shard", "shard_no", *(f"shard_no_{k}" for k in range(2, len(docs.columns) + 2))]
    name = next(n for n in names if n not in taken)
    hashed = cut(inner.select(F.xxhash64(text).alias("h"), bigint(F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).alias("size")))
    placed = inner.withColumn("s", shard_of(F.xxhash64(text), *shard_plan(hashed, shards, first_bits)))
    return named_again(placed, docs, F.col("s").alias(name))
