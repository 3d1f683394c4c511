"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a piece of a partition) of training documents gets a word-level suffix array. Every suffix of every benchmark
item is binary-searched in it, depth by depth: at depth k all test suffixes still alive hold the rank interval of the
training suffixes that share their first k words, and one searchsorted moves them to depth k + 1. That gives each test
suffix's longest verbatim match with its locations. Documents that hold a whole window of an item are marked or removed.

The suffix array is sparse: a training suffix takes part only if its first two words stand side by side in some item, which
no match can lack (one-word items use the first word alone). The benchmark is a stated query set: it is streamed to the workers
in broadcast blocks of bounded size, of which the driver and a worker hold one at a time; texts are split into words once, and a worker holds
those of a bounded amount of text while it goes through the blocks. Equal windows of a block are searched once, however many items share them.

Cases: null or wordless texts have no words and no hits; a null item id shows as the empty text; repeated item ids count
once; an empty benchmark marks nothing; repeated rows give repeated results; extra columns are ignored and, in decontaminate, kept whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import at_place, by_place, named_again

WINDOW = 10
#: Characters of benchmark text in one block, which is broadcast (a longer item is a block of its own).
BLOCK_BYTES = 8_000_000
#: Text whose words are held while all blocks are searched, if they are several.
ROUND_BYTES = 32_000_000


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES):
    """Benchmark items as lists of (item_id as text, text), each list of bounded size."""
    held, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string")).toLocalIterator():
        if text is None:
            continue
        held.append((item, text))
        size += len(text)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Tests:
    """The distinct windows of a block of items: win (rows of word codes of its own dictionary, padded by -1) and length of each. Window k occurs at
    places[starts[k] : starts[k + 1]], each an item's number shifted left by OFFSET_BITS plus its first word in the item."""

    OFFSET_BITS = 36

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = tv.split_words(tv.texts(pa.array([t for _, t in items], pa.string())), "alnum")
        self.vocabulary = words.words
        self.ids = [i for i, _ in items]
        count = np.diff(words.offsets)
        length = np.minimum(window, count)
        each = np.where(length > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(items)), each)
        offset = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        length = length[item]
        at = (words.offsets[:-1][item] + offset)[:, None] + np.arange(window)
        padded = np.append(words.codes, np.full(window, -1, np.int64))
        win = np.where(np.arange(window) < length[:, None], padded[np.minimum(at, len(padded) - 1)], -1).astype(np.int64)
        order = np.lexsort(win.T[::-1]) if len(win) else np.zeros(0, np.int64)
        win, places = win[order], (item.astype(np.int64) << self.OFFSET_BITS)[order] + offset[order]
        new = np.flatnonzero(np.append(True, (win[1:] != win[:-1]).any(axis=1))) if len(win) else np.zeros(0, np.int64)
        self.win, self.length = win[new], length[order][new]
        self.starts, self.places = np.append(new, len(win)), places
        v = len(self.vocabulary) + 1
        self.singles = np.unique(self.win[self.length == 1, 0])
        many = self.win[self.length > 1]
        self.pairs = np.unique(many[:, 0] * v + many[:, min(1, window - 1)])

    def places_of(self, window: int) -> np.ndarray:
        return self.places[self.starts[window] : self.starts[window + 1]]


def suffix_array(seq: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions `at` of seq in lexicographic order of their first `depth` words, and those words (row per suffix)."""
    padded = np.append(seq, np.full(depth, -2, np.int64))
    columns = padded[at[:, None] + np.arange(depth)]
    order = np.lexsort(columns.T[::-1])
    return at[order], columns[order]


def search(columns: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, depth): per test window the interval of the suffix array that shares its longest matching prefix."""
    n, v = len(columns), len(tests.vocabulary) + 4
    lo, hi = np.zeros(len(tests.win), np.int64), np.full(len(tests.win), n, np.int64)
    depth, alive = np.zeros(len(tests.win), np.int64), np.arange(len(tests.win))
    rank = np.zeros(n, np.int64)
    for k in range(columns.shape[1]):
        alive = alive[tests.length[alive] > k]
        if not len(alive) or not n:
            break
        key = rank * v + columns[:, k] + 3  # sorted: the suffix array is in this order
        want = rank[lo[alive]] * v + tests.win[alive, k] + 3
        left, right = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
        found = left < right
        alive = alive[found]
        lo[alive], hi[alive], depth[alive] = left[found], right[found], k + 1
        rank = np.zeros(n, np.int64)
        rank[1:] = np.cumsum(key[1:] != key[:-1])
    return lo, hi, depth


def shard_matches(words: tv.Words, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """All verbatim occurrences of whole windows in a shard: (training position, window index)."""
    coded = pa.compute.index_in(words.words, tests.vocabulary) if len(tests.vocabulary) else pa.nulls(len(words.words), pa.int32())
    local = pa.compute.fill_null(coded, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    seq = local[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    ends = np.zeros(len(seq), bool)  # a suffix ends with its document
    last = words.offsets[1:][np.diff(words.offsets) > 0] - 1
    ends[last] = True
    v = len(tests.vocabulary) + 1
    nxt = np.append(seq[1:], -1)
    nxt[ends] = -1
    ok = np.zeros(len(seq), bool)
    inside = (seq >= 0) & (nxt >= 0)
    key = seq[inside] * v + nxt[inside]
    if len(tests.pairs):
        slot = np.minimum(np.searchsorted(tests.pairs, key), len(tests.pairs) - 1)
        ok[np.flatnonzero(inside)[tests.pairs[slot] == key]] = True
    if len(tests.singles):
        ok |= np.isin(seq, tests.singles)
    # one sentinel after each document keeps suffixes within it
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    spread = np.full(len(seq) + len(words.offsets) - 1, -2, np.int64)
    spread[np.arange(len(seq)) + owner] = seq
    at = np.flatnonzero(ok)
    suffixes, columns = suffix_array(spread, at + owner[at], tests.win.shape[1] if len(tests.win) else 1)
    lo, hi, depth = search(columns, tests)
    whole = np.flatnonzero((depth == tests.length) & (tests.length > 0))
    counts = hi[whole] - lo[whole]
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    found = suffixes[np.repeat(lo[whole], counts) + inner]
    back = np.cumsum(spread == -2)  # sentinels up to a place
    return found - back[found], np.repeat(whole, counts)


MATCH = "struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>"
FOUND = f"n_words bigint, n_hit bigint, items array<string>, matches array<{MATCH}>"


class Piece:
    """A shard: its words, and what the blocks searched so far gave: covered words, items and maximal matches of each document."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.batch = batch
        self.words = tv.split_words(tv.texts(batch.column("text")), "alnum")
        self.change = np.zeros(len(self.words.codes) + 1, np.int64)  # running sum above 0: covered
        self.items: dict[int, set] = {}
        self.matches: dict[int, list] = {}

    def search(self, tests: Tests) -> None:
        position, window = shard_matches(self.words, tests)
        if not len(position):
            return
        np.add.at(self.change, position, 1)
        np.add.at(self.change, position + tests.length[window], -1)
        doc = np.searchsorted(self.words.offsets, position, "right") - 1
        pair = np.unique(doc * len(tests.win) + window)
        for d, w in zip((pair // len(tests.win)).tolist(), (pair % len(tests.win)).tolist(), strict=True):
            self.items.setdefault(d, set()).update(tests.ids[i] for i in np.unique(tests.places_of(w) >> tests.OFFSET_BITS))
        order = np.lexsort((position, tests.length[window], doc))
        run = None  # document, length of windows, first and next word, places in items at the next word
        for d, p, w in zip(doc[order].tolist(), position[order].tolist(), window[order].tolist(), strict=True):
            n, places = int(tests.length[w]), tests.places_of(w)
            both = np.intersect1d(run[4], places) if run and run[:2] == (d, n) and run[3] == p else places[:0]
            if len(both):
                run = (d, n, run[2], p + 1, both + 1)
                continue
            self.close(run, tests)
            run = (d, n, p, p + 1, places + 1)
        self.close(run, tests)

    def close(self, run: tuple | None, tests: Tests) -> None:
        """Notes a maximal match: at the first of the items that hold it whole."""
        if run:
            d, n, first, after, places = run
            item, end = divmod(int(places.min()), 1 << tests.OFFSET_BITS)
            self.matches.setdefault(d, []).append({"item_id": tests.ids[item], "doc_word": first - int(self.words.offsets[d]), "item_word": end - (after - first), "n_words": after - first + n - 1})

    def result(self) -> pa.RecordBatch:
        covered = np.cumsum(self.change[:-1]) > 0
        names = [n for n in self.batch.schema.names if n != "text"]
        rows = range(self.batch.num_rows)
        found = [
            pa.array(np.diff(self.words.offsets)), pa.array(tv.segments(covered, self.words.offsets)), pa.array([sorted(self.items.get(d, ())) for d in rows], pa.list_(pa.string())),
            pa.array([self.matches.get(d, []) for d in rows], pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))),
        ]
        return pa.RecordBatch.from_arrays([*(self.batch.column(n) for n in names), *found], names=[*names, "n_words", "n_hit", "items", "matches"])


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """docs (with a column text, and no n_words, n_hit, items, matches) without the text, with n_words, n_hit (hit words), items (sorted) and matches: maximal verbatim
    matches of whole windows with places, a passage that several items share at the first of them."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(block) for block in blocks(benchmark, block_bytes)]  # the driver keeps them on its disk only

    def searched(held: list[Piece]):
        for block in sent:
            tests = Tests(block.value, window)
            block.__dict__.pop("_value", None)  # read again from the worker's disk for the next texts
            for piece in held:
                piece.search(tests)
        for piece in held:
            yield piece.result()

    def run(batches):
        only = Tests(sent[0].value, window) if len(sent) == 1 else None
        held, size = [], 0
        for batch in tv.pieces(batches):
            piece = Piece(batch)
            if len(sent) < 2:
                if only:
                    piece.search(only)
                yield piece.result()
                continue
            held.append(piece)
            size += batch.nbytes
            if size >= round_bytes:
                yield from searched(held)
                held, size = [], 0
        yield from searched(held)

    return docs.mapInArrow(run, StructType(docs.drop("text").schema.fields + StructType.fromDDL(FOUND).fields))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches."""
    slim = by_place(docs).select(at_place(docs, "doc_id").cast("bigint").alias("doc_id"), at_place(docs, "text").cast("string").alias("text"))
    found = find_matches(slim, benchmark, window, block_bytes, round_bytes)
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a whole window of a benchmark item; columns unchanged."""
    inner = by_place(docs).withColumn("text", at_place(docs, "text").cast("string"))
    return named_again(find_matches(inner, benchmark, window).where("n_hit = 0"), docs)
