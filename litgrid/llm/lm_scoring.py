"""Language-model scoring with a log-frequency Bloom filter.

n-gram counts (words and word pairs) of the training documents are quantised on a log scale, q(c) = 1 + floor(log_b(c)). The filter
holds, for each n-gram, the keys (n-gram, 1) .. (n-gram, q). A worker reads a count back by probing levels 1, 2, 3, ... until one is absent, and
takes the middle of the last level present. The filter holds all n-grams and grows with them: each group of keys has a bitmap sized by its counted
entries. Bitmaps are joined into shards of bounded size, each a broadcast of its own; a worker holds the keys of a bounded amount of text, probes shard after
shard for them, and has one shard at a time in memory.

Scores are smoothed by a Dirichlet prior: P(w | v) = (c(v, w) + mu * P(w)) / (c(v) + mu), with P(w) = (c(w) + 1) / (N + V + 1).

Beside the model, exact word counts give the base score: the most frequent words, at most `head` and none longer than WORD_BYTES, are broadcast (a bound in bytes that does
not grow with the data), all other words of the documents are joined with the counts by word. Neither way drops a word.

Cases: null texts are empty: their end is their one token; with no training documents N = V = 0 and all scores are 0; very long texts
are pieces of their own; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import copy
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bitmaps, radix
from . import textvec as tv
from .common import cut

BASE = 2.0
MU = 20.0
HEAD = 500_000
#: Longest word in the broadcast head, in bytes.
WORD_BYTES = 64
#: Bits for each entry (n-gram and level) that is there: with bitmaps.PROBES probes about 0.8 % of absent ones read as present.
BITS = 10.0
#: Bound of a shard of the filter; each is a broadcast.
MOST_BYTES = 48_000_000
#: Text whose keys are held while all shards are probed, if they are several.
ROUND_BYTES = 8_000_000
#: Training tokens for each group of n-grams that is counted at once.
GROUP_TOKENS = 1_000_000
#: The end of a text; no word holds white space.
END = b"\n"
LEVELS = 48


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_value(level: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of [b^(q-1), b^q); 0 for none."""
    return np.where(level > 0, np.where(level == 1, 1.0, BASE ** (level - 1.0) * (1 + BASE) / 2), 0.0)


def level_keys(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return tv.mix(keys + tv.M1 * np.asarray(level, np.uint64))


class Tokens:
    """A batch's tokens: a text's are its words and one end. Codes index `hashes`: dictionary words, then the end, then the start."""

    def __init__(self, column: pa.Array) -> None:
        self.words = tv.split_words(column)
        v, n = len(self.words.words), np.diff(self.words.offsets)
        self.hashes = np.append(tv.word_hashes(self.words.words), [END_HASH, START_HASH])
        self.offsets = self.words.offsets + np.arange(len(self.words.offsets))
        self.codes = np.full(len(self.words.codes) + len(n), v, np.int64)
        self.codes[np.arange(len(self.words.codes)) + np.repeat(np.arange(len(n)), n)] = self.words.codes
        self.before = np.append(0, self.codes[:-1])[: len(self.codes)]
        self.before[self.offsets[:-1]] = v + 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (token before, token) as keys and codes of the two, and each token's place among them."""
        v = len(self.hashes)
        both, place = np.unique(self.before * v + self.codes, return_inverse=True)
        return pair_key(self.hashes[both // v], self.hashes[both % v]), both, place


def _hash(word: bytes) -> np.uint64:
    return tv.word_hashes(pa.array([word], pa.binary()))[0]


END_HASH, START_HASH = _hash(END), _hash(b"\n\n")


#: n-gram keys have 48 bits (the high ones of a word): far fewer clashes than the filter has false positives, at three quarters of the size.
HIGH, FLAG = np.uint64(0xFFFF_FFFF_FFFE_0000), np.uint64(1 << 16)


def word_key(h: np.ndarray) -> np.ndarray:
    """Keys of words have the flag, those of pairs don't."""
    return tv.mix(h ^ np.uint64(0x1111)) & HIGH | FLAG


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return tv.mix(tv.mix(before) * tv.M1 + h) & HIGH


def packed(keys: np.ndarray) -> bytes:
    """6 bytes a key."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def word_counts(training: DataFrame) -> DataFrame:
    """(word binary, c bigint) over all training documents, summed on the map side first."""

    def run(batches):
        for batch in tv.pieces(batches, most=5_000_000):
            column = tv.texts(batch.column("text"))
            words = tv.split_words(column)
            counts = np.bincount(words.codes, minlength=len(words.words))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.words.cast(pa.binary()), pa.array([END], pa.binary())]), pa.array(np.append(counts, len(column)))], names=["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    total = np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts[order], new) if len(new) else np.zeros(0, np.int64)
    return keys[new], total.astype(np.int64)


BLOB = "grp int, keys binary, counts binary, large binary"


def blob_batch(keys: np.ndarray, counts: np.ndarray, groups: int) -> pa.RecordBatch:
    """Sorted keys and their counts as packed rows by group. large: counts over 254."""
    cuts = radix.runs(keys, groups)
    small, big = np.minimum(counts, 255).astype(np.uint8), counts >= 255
    return pa.RecordBatch.from_arrays(
        [pa.array([g for g, _, _ in cuts], pa.int32()), pa.array([packed(keys[a:b]) for _, a, b in cuts], pa.binary()), pa.array([small[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([counts[a:b][big[a:b]].astype(np.int64).tobytes() for _, a, b in cuts], pa.binary())],
        names=["grp", "keys", "counts", "large"],
    )


def gram_blobs(training: DataFrame, groups: int) -> DataFrame:
    """(grp, keys, counts, large): n-gram counts of each piece of text, as packed arrays dealt by key."""

    def run(batches):
        for batch in tv.pieces(batches, most=5_000_000):
            t = Tokens(tv.texts(batch.column("text")))
            keys, _, place = t.pairs()
            counts = np.bincount(place, minlength=len(keys))
            keys = np.append(keys, word_key(t.hashes[:-1]))
            counts = np.append(counts, np.bincount(t.codes, minlength=len(t.hashes) - 1))
            order = np.argsort(keys)
            yield blob_batch(keys[order], counts[order], groups)

    return training.select("text").mapInArrow(run, BLOB)


def dealt_again(groups: int):
    """Gathers blobs of like keys, sums them, and cuts them finer."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for blob in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "large")), strict=True):
                held.append(blob)
                size += len(blob[1])
                if size >= radix.RUN_KEYS:
                    yield blob_batch(*merged(held), groups)
                    held, size = [], 0
        if held:
            yield blob_batch(*merged(held), groups)

    return run


def merged(blobs: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of one group and their counts."""
    keys, counts = [], []
    for k, c, large in blobs:
        c = np.frombuffer(c, np.uint8).astype(np.int64)
        c[c == 255] = np.frombuffer(large, np.int64)
        keys.append(unpacked(k))
        counts.append(c)
    return summed(np.concatenate(keys), np.concatenate(counts))


SALT = np.uint64(0x5851F42D4C957F2D)


def bit_places(g: np.ndarray, step: np.ndarray, k: int, sizes: np.ndarray | np.uint64) -> np.ndarray:
    """Bits of the k-th probe in bitmaps of so many bits (below 2^32)."""
    return ((((g + np.uint64(k) * step) & np.uint64(0xFFFF_FFFF)) * sizes) >> np.uint64(32)).astype(np.int64)


def group_bitmap(keys: np.ndarray, counts: np.ndarray, bits: float) -> bytes:
    """The bitmap of a group's n-grams with all their levels, sized by these entries."""
    q = quantised(counts)
    size = 64 * max(1, -(-int(q.sum() * bits) // 64))
    here = np.zeros(size, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        g = tv.mix(level_keys(keys[q >= level], level) + SALT)
        step = (g >> np.uint64(32)) | np.uint64(1)
        for k in range(bitmaps.PROBES):
            here[bit_places(g, step, k, np.uint64(size))] = True
    return bitmaps.pack(here)


class Places:
    """Where each group's bitmap is: its shard (-1: it has no keys), first byte, and bits."""

    def __init__(self, groups: int) -> None:
        self.shard, self.start, self.size = np.full(groups, -1, np.int32), np.zeros(groups, np.int64), np.zeros(groups, np.uint64)

    def probe(self, shard: int, data: np.ndarray, keys: np.ndarray, level: np.ndarray) -> None:
        """Sets the levels of the keys that live in the shard, by probing level after level."""
        home = radix.group_of(keys, len(self.shard))
        alive = np.flatnonzero(self.shard[home] == shard)
        for q in range(1, LEVELS):
            g = tv.mix(level_keys(keys[alive], q) + SALT)
            step = (g >> np.uint64(32)) | np.uint64(1)
            for k in range(bitmaps.PROBES):
                at = home[alive]
                b = bit_places(g, step, k, self.size[at])
                on = (data[self.start[at] + (b >> 3)] >> (b & 7).astype(np.uint8)) & 1 == 1
                alive, g, step = alive[on], g[on], step[on]
            if not len(alive):
                break
            level[alive] = q


def gather(rows: DataFrame, groups: int, most_bytes: int) -> tuple[Places, list]:
    """Broadcast shards of rows(grp int, bits binary), one per group that has keys. The driver holds one shard at a time."""
    places, shards, held, size = Places(groups), [], [], 0

    def send() -> None:
        shards.append(rows.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(held), np.uint8)))
        held.clear()

    for grp, bits in cut(rows).toLocalIterator():
        if held and size + len(bits) > most_bytes:
            send()
            size = 0
        places.shard[grp], places.start[grp], places.size[grp] = len(shards), size, 8 * len(bits)
        held.append(bytes(bits))
        size += len(bits)
    if held:
        send()
    return places, shards


class Grams:
    """A piece's tokens and the levels of its n-grams."""

    def __init__(self, column: pa.Array) -> None:
        self.tokens = Tokens(column)
        self.pairs, self.both, self.place = self.tokens.pairs()
        self.words = word_key(self.tokens.hashes)
        self.word_levels, self.pair_levels = np.zeros(len(self.words), np.int8), np.zeros(len(self.pairs), np.int8)


class Model:
    """What workers score with; shards: broadcasts of the filter. head: the most frequent words, with their exact counts; all: no other words are known."""

    kept: dict[str, Model] = {}

    def __init__(self, places: Places, shards: list, n: int, v: int, ends: int, head: pa.Array, head_counts: np.ndarray, all_words: bool) -> None:
        self.places, self.shards, self.n, self.v, self.ends, self.head, self.head_counts, self.all_words = places, shards, n, v, ends, head, head_counts, all_words

    def probe(self, shards: list, pieces: list[Grams]) -> None:
        """Sets the pieces' levels, with one shard at a time."""
        for k, shard in enumerate(shards):
            data = shard.value
            for x in pieces:
                self.places.probe(k, data, x.words, x.word_levels)
                self.places.probe(k, data, x.pairs, x.pair_levels)
            if len(shards) > 1:
                del data
                shard.__dict__.pop("_value", None)  # read again from the worker's disk for the next texts

    def log_probabilities(self, x: Grams) -> np.ndarray:
        """log10 probability of each token."""
        t, both = x.tokens, x.both
        single = level_value(x.word_levels.astype(np.int64))
        single[-2:] = self.ends  # as often as a text ends, one begins
        before, word = single[both // len(t.hashes)], np.minimum(single[both % len(t.hashes)], self.n)
        prior = (word + 1) / (self.n + self.v + 1)
        pair = np.minimum(level_value(x.pair_levels.astype(np.int64)), np.minimum(before, word))
        return np.log10((pair + MU * prior) / (before + MU))[x.place]

    def exact(self, t: Tokens) -> np.ndarray:
        """Exact count of each dictionary word and of the end; -1: not among the head."""
        found = pa.compute.fill_null(pa.compute.index_in(t.words.words.cast(pa.binary()), self.head), -1).to_numpy(zero_copy_only=False) if len(self.head) else np.full(len(t.words.words), -1)
        counts = np.where(found >= 0, self.head_counts[found] if len(self.head) else 0, 0 if self.all_words else -1)
        return np.append(counts, self.ends)


def train(training: DataFrame, head: int = HEAD, bits: float = BITS, most_bytes: int = MOST_BYTES, group_tokens: int = GROUP_TOKENS) -> tuple[Model, DataFrame]:
    """The model, and the exact word counts."""
    counts = cut(word_counts(training))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    # the least count whose words are at most `head`
    held, from_count = 0, None
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    for c, m in short.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
        if held + m > head:
            break
        held, from_count = held + m, c
    top = short.where(F.col("c") >= from_count if from_count else F.lit(False)).toArrow()
    levels = radix.rounds(-(-n // group_tokens))

    def fill(batches):
        """Bitmaps of a partition's groups."""
        for grp, keys, c in grouped(batches):
            yield pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([group_bitmap(keys, c, bits)], pa.binary())], names=["grp", "bits"])

    blobs = radix.dealt(gram_blobs(training, levels[0]), levels, dealt_again)
    places, shards = gather(blobs.mapInArrow(fill, "grp int, bits binary"), levels[-1], most_bytes)
    words = top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.binary())
    return Model(places, shards, n, v, ends, words.cast(pa.binary()), top.column("c").to_numpy().astype(np.int64), held == v), counts


def grouped(batches):
    """(group, keys, counts) of each group of a partition. A partition holds all blobs of its groups."""
    held: dict[int, list] = {}
    for batch in batches:
        for grp, *blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "keys", "counts", "large")), strict=True):
            held.setdefault(grp, []).append(tuple(blob))
    for grp in list(held):
        yield grp, *merged(held.pop(grp))
        tv.trim()


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of docs: the kept columns, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    shards, model = model.shards, copy.copy(model)
    model.shards = []  # a broadcast can't be sent within another
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("__row"))
    more = "n_tokens bigint, n_known bigint, base_score double, score double, tail array<struct<word:binary,tf:bigint>>"
    part = StructType(slim.drop("text").schema.fields + StructType.fromDDL(more).fields)
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))

    def rounds(model, batches):
        """Pieces with their levels; as many at once as make it worth to go through the shards."""
        held, size = [], 0
        for batch in tv.pieces(batches, most=2_000_000):
            held.append((batch, Grams(tv.texts(batch.column("text")))))
            size += batch.nbytes
            if len(shards) < 2 or size >= ROUND_BYTES:
                model.probe(shards, [x for _, x in held])
                yield from held
                held, size = [], 0
        if held:
            model.probe(shards, [x for _, x in held])
            yield from held

    def run(batches):
        if key not in Model.kept:
            Model.kept.clear()
            Model.kept[key] = sent.value
        model = Model.kept[key]
        scale = math.log10(model.n + model.v + 1)
        for batch, grams in rounds(model, batches):
            t = grams.tokens
            exact = model.exact(t)
            c = exact[t.codes]
            base = tv.segments(np.where(c >= 0, np.log10(np.maximum(c, 0) + 1) - scale, 0.0), t.offsets)
            total = tv.segments(model.log_probabilities(grams), t.offsets)
            # words that the head doesn't hold, once per text
            rare = np.flatnonzero(c < 0)
            owner = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))[rare]
            pair, tf = np.unique(owner * len(t.hashes) + t.codes[rare], return_counts=True)
            offsets = np.searchsorted(pair // len(t.hashes), np.arange(len(t.offsets)))
            words = t.words.words.cast(pa.binary()).take(pa.array(pair % len(t.hashes)))
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([words, pa.array(tf.astype(np.int64))], names=["word", "tf"])).cast(tail_type)
            names = [*keep, "__row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(np.diff(t.offsets)), pa.array(tv.segments(c > 0, t.offsets)), pa.array(base), pa.array(total), tail], names=[*names, "n_tokens", "n_known", "base_score", "score", "tail"])

    scored = slim.mapInArrow(run, part)
    out = [*keep, "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score"]
    if model.all_words:
        return scored.select(*out)
    # a text without rare words gets a key of its own that no word has
    flat = scored.select("*", F.explode_outer("tail").alias("x")).select(*scored.drop("tail").columns, F.coalesce("x.word", F.concat(F.lit(" "), F.col("__row").cast("string")).cast("binary")).alias("word"), F.coalesce("x.tf", F.lit(0)).alias("tf"))
    c = F.coalesce("c", F.lit(0))
    joined = flat.join(counts, "word", "left")
    summed_up = joined.groupBy("__row").agg(
        *[F.first(k).alias(k) for k in (*keep, "n_tokens", "score")],
        (F.first("n_known") + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.first("base_score") + F.sum(F.col("tf") * (F.log10(c + 1) - math.log10(model.n + model.v + 1)))).alias("base_score"),
    )
    return summed_up.select(*out)


def fit_and_score(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",), **rule) -> DataFrame:
    """Scores of docs under the model of training's texts."""
    model, counts = train(training.select(F.col("text").cast("string").alias("text")), **rule)
    return score(docs, model, counts, keep)
