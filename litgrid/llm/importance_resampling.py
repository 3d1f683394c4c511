"""Quality classification by data selection via importance resampling.

Target text (documents labelled good) and raw text (all documents) each get a generative model over hashed word n-grams (one and two words, case and
symbols kept, for they tell prose from junk).
A document's log importance weight is the sum over its n-grams of log p_target - log p_raw. Adding Gumbel noise, fixed by seed and id, and
keeping the k largest draws k documents without replacement in proportion to their weights. The k-th largest is found exactly by
narrowing a histogram, so nothing but bucket counts reaches the driver.

The target model may be fitted on at most `most_labels` labelled rows (those of the smallest hash); counts of raw text cover all documents.

Cases: null and wordless texts have no n-grams and weight 0; null ids and labels are no targets; ties at the k-th place are copies of one row, of which any are drawn;
with no target rows all weights are 0; empty tables give no rows; repeated rows are drawn one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import cut

BUCKETS = 10_000
SHARE = 0.8
MOST_LABELS = 20_000
SEED = "dsir-1"


def bucket_codes(words: tv.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a batch, and the text of each."""
    h = tv.word_hashes(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    pair = tv.ngram_hashes(h, 2)
    inside = owner[1:] == owner[:-1]
    codes = np.append(tv.mix(h), pair[inside]) % np.uint64(buckets)
    return codes.astype(np.int64), np.append(owner, owner[:-1][inside])


def bucket_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams per bucket of raw and of target rows. docs: text, target. Bounded by the number of buckets."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target_rows = np.array(batch.column("target").to_pylist(), bool)
            done = 0
            for piece in tv.pieces([batch]):
                target = target_rows[done : done + piece.num_rows]
                done += piece.num_rows
                codes, owner = bucket_codes(tv.split_words(tv.texts(piece.column("text")), lower=False), buckets)
                total[0] += np.bincount(codes, minlength=buckets)
                total[1] += np.bincount(codes[target[owner]], minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])

    out = np.zeros((2, buckets), np.int64)
    for b, raw, target in docs.mapInArrow(run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        out[:, b] = raw, target
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, smoothed by adding one; 0 without target text."""
    if not target.sum():
        return np.zeros(len(raw))
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + len(c)))
    return smooth(target) - smooth(raw)


def weights(docs: DataFrame, ratio: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(ratio)
    slim = docs.select(*keep, "text")
    schema = StructType(slim.drop("text").schema.fields + StructType.fromDDL("n_features bigint, log_weight double").fields)

    def run(batches):
        for batch in tv.pieces(batches):
            codes, owner = bucket_codes(tv.split_words(tv.texts(batch.column("text")), lower=False), len(sent.value))
            n = np.bincount(owner, minlength=batch.num_rows)
            total = np.bincount(owner, weights=sent.value[codes], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n.astype(np.int64)), pa.array(total.astype(np.float64))], names=[*keep, "n_features", "log_weight"])

    return slim.mapInArrow(run, schema)


def gumbel(h) -> F.Column:
    """Gumbel noise from a hash: -log(-log u), u in (0, 1)."""
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, fine: int = 4096, direct: int = 20_000) -> tuple[float, int]:
    """(the k-th largest key, how many of the keys equal to it belong to the k largest). keys(key double); 1 <= k <= rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / fine
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        counts = dict(inside.groupBy(F.least(F.lit(fine - 1), F.floor((F.col("key") - low) / width)).cast("int").alias("b")).count().collect()) if width > 0 else {0: None}
        if width <= 0 or sum(counts.values()) <= direct:
            break
        for b in sorted(counts, reverse=True):
            if above + counts[b] >= k:
                edges = inside.where(F.least(F.lit(fine - 1), F.floor((F.col("key") - low) / width)).cast("int") == b).agg(F.min("key"), F.max("key")).first()
                low, high = edges
                break
            above += counts[b]
    # few distinct keys are left: count each
    rest = sorted(keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy("key").count().collect(), reverse=True)
    for key, n in rest:
        if above + n >= k:
            return key, k - above
        above += n
    raise ValueError("fewer rows than k")


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS, most_labels: int = MOST_LABELS, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, n_features, log_weight, gumbel_key, selected (round(share * rows) rows are)."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    # a bounded sample of ids: broadcast
    ids = good.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most_labels).withColumn("target", F.lit(True))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = slim.join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratio = log_ratio(*bucket_counts(marked, buckets))
    tie = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    weighed = weights(slim.withColumn("h", tie), ratio, ("doc_id", "h"))
    keyed = cut(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("h"))).withColumn("row", F.monotonically_increasing_id()))
    rows = keyed.count()
    k = round(share * rows)
    if not k:
        return keyed.select("doc_id", "n_features", "log_weight", "gumbel_key", F.lit(False).alias("selected"))
    edge, places = kth_largest(keyed.select(F.col("gumbel_key").alias("key")), k)
    # rows whose noisy weights are equal to the last bit are copies of one row: they are numbered by partition, however many they are
    parted = keyed.withColumn("part", F.spark_partition_id())
    tied = F.col("gumbel_key") == edge
    held = parted.where(tied).groupBy("part").agg(F.count("*").alias("n"))
    bases = held.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # a row for each partition
    nth = F.row_number().over(Window.partitionBy("part").orderBy("h", F.col("doc_id").asc_nulls_last(), "row"))
    chosen = parted.where(tied).withColumn("nth", nth).join(F.broadcast(bases), "part").where(F.col("base") + F.col("nth") <= places).select("row", F.lit(True).alias("chosen"))
    inside = (F.col("gumbel_key") > edge) | F.coalesce("chosen", F.lit(False))
    return keyed.join(chosen, "row", "left").select("doc_id", "n_features", "log_weight", "gumbel_key", inside.alias("selected"))

