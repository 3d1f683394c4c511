"""Ranked lexical search by inverted treaps.

Each piece of the corpus (some megabytes of texts) gets an index of its own. A term's postings are a treap in it: a search tree by document, a heap by impact, so that a node's impact is the
most that its whole subtree holds. A query walks the treaps of all its terms together, over one range of documents at a time: the sum of the nodes' weighted impacts bounds every score of the
range. A range whose bound can't enter the best k is pruned whole; otherwise the document of the heaviest node is scored and splits the range in two. Ranges of the highest bounds go first, and
a task's best k of one piece are the bar for its next.

Weights need counts of all documents, so there are two jobs over the corpus: one that keeps pieces (lengths and postings of the queries' terms) in the shared folder, one that searches them.
Queries come in blocks of at most `BLOCK_WORDS` words, which bounds what is broadcast; each task gives k rows per query at most, and a window with partial ranking gives the final k.

    weight w of a term = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))
    impact of tf occurrences = (1000000000 * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * N) div L

N: documents with a term, L: all terms, n: the document's terms, df: documents that hold the term. A score sums w * impact over the query's terms, repeats included.

Cases: null and wordless texts hold no term and are never found; null and wordless queries find nothing; equal scores go by ascending doc_id, null ids first; repeated rows of documents are
documents of their own, and so are repeated rows of queries; an empty table on either side gives no rows; a very long text is a piece of its own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut

TOP = 20
#: Bytes of text in a piece, words of a block of queries, ranges that are split at once.
PIECE_BYTES, BLOCK_WORDS, SPLITS = 32_000_000, 200_000, 256


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) if values.nbytes else b""


def unpacked(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd"), kind) if n else np.zeros(0, kind)


PIECE = "n_docs bigint, n_with_terms bigint, n_terms bigint, n_postings bigint, doc_ids array<bigint>, lengths binary, terms array<int>, counts array<int>, docs binary, tfs binary"


def pieces_of(docs: DataFrame, terms: list[bytes], most: int = PIECE_BYTES) -> DataFrame:
    """One row per piece: documents with a term, by ascending doc_id, and the postings of the given terms, by term and document."""
    wanted = pa.array(terms, pa.large_binary())

    def run(batches):
        for batch in tv.pieces(batches, most=most):
            words = tv.split_words(tv.texts(batch.column("text")), split="alnum")
            lengths = np.diff(words.offsets)
            ids = batch.column("doc_id")
            order = pc.array_sort_indices(ids, order="ascending").to_numpy()  # nulls last here
            order = np.roll(order, ids.null_count)
            order = order[lengths[order] > 0]
            place = np.full(len(lengths), -1)
            place[order] = np.arange(len(order))
            known = pc.fill_null(pc.index_in(words.words.cast(pa.large_binary()), value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[words.codes] if len(words.codes) else words.codes
            owner = np.repeat(place, lengths)
            key, tf = np.unique((term * max(1, len(order)) + owner)[term >= 0], return_counts=True)
            term, doc = np.divmod(key, max(1, len(order)))
            found, counts = np.unique(term, return_counts=True)
            row = {"n_docs": len(order), "n_with_terms": len(order), "n_terms": int(lengths.sum()), "n_postings": len(key), "doc_ids": ids.take(pa.array(order)), "lengths": packed(lengths[order].astype(np.int64)), "terms": found.astype(np.int32), "counts": counts.astype(np.int32), "docs": packed(doc.astype(np.int32)), "tfs": packed(tf.astype(np.int32))}
            kinds = {"doc_ids": pa.list_(pa.int64()), "terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "lengths": pa.binary(), "docs": pa.binary(), "tfs": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v], kinds.get(k, pa.int64())) for k, v in row.items()], names=list(row))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def nearest_greater(rank: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one before (step -1) or behind (+1) it of a higher rank. The ends must be of the highest rank."""
    at = np.clip(np.arange(len(rank)) + step, 0, len(rank) - 1)
    todo = np.flatnonzero(rank[at] < rank)
    while len(todo):
        # whatever lies between a place's candidate and the candidate's own is lower than the candidate, which is lower than the place
        at[todo] = at[at[todo]]
        todo = todo[rank[at[todo]] < rank[todo]]
    return at


class Treaps:
    """The postings of all terms of a piece: in the order of term and document, with a sentinel (document -1, impact 0) before each term's. Node 0 is the empty treap."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> None:
        n = len(docs) + len(terms) + 1
        begins = np.append(0, np.cumsum(counts))[:-1] + np.arange(len(terms))
        own = np.ones(n, bool)
        own[begins] = own[-1] = False
        self.doc, self.impact = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.doc[own], self.impact[own] = docs, impacts
        # like impacts are ordered by a hash, so that the tree stays shallow
        order = np.lexsort((tv.mix(np.arange(n).astype(np.uint64)), np.where(own, self.impact, np.iinfo(np.int64).max)))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        rank[~own] = n
        before, behind = nearest_greater(rank, -1), nearest_greater(rank, 1)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        places = np.flatnonzero(own)
        b, e = before[places], behind[places]
        under_left = rank[b] < rank[e]
        under_right = rank[e] < rank[b]
        self.right[b[under_left]] = places[under_left]
        self.left[e[under_right]] = places[under_right]
        roots = places[rank[b] == rank[e]]  # between two sentinels
        self.root = dict(zip(terms.tolist(), roots.tolist(), strict=True))

    def within(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The heaviest nodes of the treaps with a document in low <= document < high, or 0."""
        out = nodes.ravel().copy()
        low, high = np.broadcast_to(low, nodes.shape).ravel(), np.broadcast_to(high, nodes.shape).ravel()
        at = np.flatnonzero(out)
        while len(at):
            doc = self.doc[out[at]]
            under, over = doc < low[at], doc >= high[at]
            moved = under | over
            at = at[moved]
            now = out[at]
            out[at] = np.where(under[moved], self.right[now], self.left[now])
            at = at[out[at] != 0]
        return out.reshape(nodes.shape)


def search(treaps: Treaps, n_docs: int, terms: np.ndarray, weights: np.ndarray, top: int, bar: int, splits: int = SPLITS) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a piece that can be among the best `top` with a score of at least bar (and above 0). weights: of the terms, times their repeats."""
    known = [(treaps.root[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in treaps.root and w]
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not known:
        return docs, scores
    nodes = np.array([[r for r, _ in known]], np.int64)
    weight = np.array([w for _, w in known], np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n_docs, np.int64)
    bound = treaps.impact[nodes] @ weight
    bar, last, batch = max(bar, 1), n_docs, 16
    while len(bound):
        # of equal scores the lower document goes before, so a range behind the last that is kept must be better
        alive = (bound > bar) | ((bound == bar) & (low < last))
        if not alive.all():
            nodes, low, high, bound = nodes[alive], low[alive], high[alive], bound[alive]
        if not len(bound):
            break
        if len(bound) > batch:
            first = np.argpartition(-bound, batch - 1)[:batch]
            rest = np.ones(len(bound), bool)
            rest[first] = False
        else:
            first, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
        part, lo, hi = nodes[first], low[first], high[first]
        heavy = np.argmax(treaps.impact[part] * weight, axis=1)
        doc = treaps.doc[part[np.arange(len(part)), heavy]]
        k = len(part)
        three = treaps.within(np.concatenate([part, part, part]), np.concatenate([doc, lo, doc + 1])[:, None], np.concatenate([doc + 1, doc, hi])[:, None])
        sums = treaps.impact[three] @ weight
        docs, scores = np.append(docs, doc), np.append(scores, sums[:k])
        if len(docs) > top:
            best = np.lexsort((docs, -scores))[:top]
            docs, scores = docs[best], scores[best]
        if len(docs) == top:
            worst = np.lexsort((docs, -scores))[-1]
            if scores[worst] > bar or (scores[worst] == bar and last == n_docs):
                bar, last = int(scores[worst]), int(docs[worst])
            elif scores[worst] == bar:
                last = min(last, int(docs[worst]))
        open_ = sums[k:] >= bar
        nodes = np.concatenate([nodes[rest], three[k:][open_]])
        low = np.concatenate([low[rest], np.concatenate([lo, doc + 1])[open_]])
        high = np.concatenate([high[rest], np.concatenate([doc, hi])[open_]])
        bound = np.concatenate([bound[rest], sums[k:][open_]])
        batch = min(2 * batch, splits)
    good = scores > 0
    return docs[good], scores[good]


def found_in(pieces: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best of its pieces. items: (number, terms, weights times repeats)."""

    def run(batches):
        best: dict[int, list[tuple[int, bool, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
                n = unpacked(row["lengths"], row["n_docs"], np.int64)
                docs, tf = unpacked(row["docs"], row["n_postings"], np.int32), unpacked(row["tfs"], row["n_postings"], np.int32).astype(np.int64)
                m = 75 + (25 * n * n_docs) // n_terms
                treaps = Treaps(terms, counts, docs, (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]))
                ids = row["doc_ids"]
                for number, wanted, weights in items:
                    before = best.get(number, [])
                    bar = -before[-1][0] if len(before) == top else 1
                    at, scores = search(treaps, row["n_docs"], wanted, weights, top, bar)
                    if len(at):
                        more = [(-s, ids[d] is not None, ids[d] or 0) for d, s in zip(at.tolist(), scores.tolist(), strict=True)]
                        best[number] = sorted(before + more)[:top]
                tv.trim()
        rows = [(number, i if known else None, -s) for number, kept in best.items() for s, known, i in kept]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return pieces.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def blocks(queries: DataFrame, most: int):
    """[(item_id, term counts)] of at most so many words together (one longer query is alone), streamed over the driver block by block."""
    rows = queries.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = tv.split_words(tv.texts(pa.array([row["text"]])), split="alnum")
        counts = Counter([words.words[c].as_py() for c in words.codes.tolist()])
        if not counts:
            continue
        if block and size + len(words.codes) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], counts))
        size += len(words.codes)
    if block:
        yield block


def rank(docs: DataFrame, queries: DataFrame, top: int = TOP, piece: int = PIECE_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of each query(item_id, text)."""
    spark, out = docs.sparkSession, None
    kind = queries.schema["item_id"].dataType
    for block in blocks(queries, block_words):
        terms = sorted(set().union(*[c for _, c in block]))
        number = {t: i for i, t in enumerate(terms)}
        pieces = cut(pieces_of(docs, terms, piece))
        n_docs, n_terms = pieces.agg(F.coalesce(F.sum("n_with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n_docs:
            continue
        # at most a row per term of the block
        held = dict(pieces.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts")).collect())
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
        items = []
        for i, (_, counts) in enumerate(block):
            own = [(number[t], weight[number[t]] * c) for t, c in counts.items() if number[t] in weight]
            items.append((i, np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
        found = found_in(pieces, items, n_docs, n_terms, top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item bigint, item_id " + kind.simpleString())
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], "item_id " + kind.simpleString() + ", rank int, doc_id bigint, score bigint")
    return out
