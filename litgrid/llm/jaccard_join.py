"""Exact n-gram Jaccard join with set-relation skipping.

Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of k-word shingles. No link is missed and none is made up, but for clashes of 64-bit
hashes: a linked pair of 32 shingles or more shares an index list but for one pair in 1e11, and two sets of one fingerprint are taken for one when links are followed.
A row is never dropped for such a clash: keep_one knows rows and unlinked sets by 128 bits.

1. Nodes. Equal sets are one node (a fingerprint). Each node has an odd sketch: a shingle flips one bit, so the Hamming distance of two
   sketches is never more than the symmetric difference of the sets, and a pair whose sketches differ too much is no link.
2. Index lists. A linked pair of sizes a and b differs in at most d = (a + b)(1 - t) / (1 + t) shingles. A set is cut into m > d parts by shingle
   hash, so a linked pair agrees on a part; the first part agreed on is among the first d + 1 filled parts of both (each filled part
   before it differs). So a node stands in d + 1 lists only: position filtering by construction. Sets near a power of two stand in the
   lists of both size classes. Sets of fewer than 32 shingles use their smallest shingles as lists (prefix filter).
3. Index-level skipping. Lists with the same members are one list. Within a list, nodes stand in order of size, and blocks too small to link are skipped.
4. Answer-level skipping. Nodes of a list that can link form clusters with a leader and a radius. A new node is compared with the leaders: a
   leader that may link answers for its whole cluster, and the distance to a leader less the radius bounds the distance to all members, which skips the others.
   What is left to check exactly is a spanning forest of each list, not its pairs. A list of more than CHUNK nodes is dealt into chunks by hash: each chunk
   gives its forest and clusters in a task of its own, then the leaders of all chunks meet, and only clusters that no leaders join and no radii keep apart are compared.
5. Exact check of the forest's edges on the full sets. Where an edge fails, the lists that hold it give all their remaining
   pairs between different components, which are checked too (a long list chunk by chunk, in tasks of two chunks). Components follow by label propagation in DataFrame joins.

Cases: null, empty and wordless texts have empty sets and link with nothing; with fewer than k words the whole sequence is the one shingle;
repeated rows and equal texts are one node; a null id takes part but is no component's name unless all its members' ids are null; very long
texts are pieces of their own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps, radix
from . import textvec as tv
from .common import at_place, by_place, cut, named_again

SHINGLE, PERCENT = 5, 80
SMALL = 32
#: Nodes of a list that one task compares; longer lists are dealt into chunks. And nodes in one packed cell.
CHUNK, CELL = 8192, 1_000_000
#: Postings to a bucket of lists.
BUCKET_POSTINGS = 1_500_000
#: Bound of the bitmap that says which documents to read again for the exact check (a filter only: what passes in excess is dropped by the join).
BITMAP_BYTES = 32_000_000


def most_different(a, b, percent: int):
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, end to end, and where each text's begin."""
    words = tv.split_words(column)
    h = tv.word_hashes(words.words)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    grams = tv.ngram_hashes(h, k)
    n = np.diff(words.offsets)
    few = {m: tv.ngram_hashes(h, m) for m in set(n[(n > 0) & (n < k)].tolist())}
    sets = []
    for a, m in zip(words.offsets[:-1].tolist(), n.tolist(), strict=True):
        if m >= k:
            s = np.sort(grams[a : a + m - k + 1])
            if len(s) > 1:
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                s = s[new]
            sets.append(s)
        else:
            sets.append(few[m][a : a + 1] if m else np.zeros(0, np.uint64))
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offsets


def fingerprints(values: np.ndarray, offsets: np.ndarray, seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(values[a:b], seed) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, len(offsets) - 1)


def sketch(s: np.ndarray) -> bytes:
    """Odd sketch of a set: 4 to 8 bits for a shingle, from 64 to 2^20."""
    bits = min(1 << 20, max(64, 8 << (max(len(s), 1).bit_length() - 1)))
    flips = np.bincount(((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int | None = None) -> np.ndarray:
    """Sketches as rows of 64-bit words, larger ones folded to the smallest, or to so many bytes (which flips the bits a smaller sketch would)."""
    size = size or min(map(len, sketches))
    out = np.zeros((len(sketches), size // 8), np.uint64)
    for i, s in enumerate(sketches):
        w = np.frombuffer(s, np.uint64)
        out[i] = w if len(s) == size else np.bitwise_xor.reduce(w.reshape(-1, size // 8), axis=0)
    return out


def distance(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ one).sum(axis=1, dtype=np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, owner) of all index lists that the sets stand in."""
    n = np.diff(offsets)
    out = []
    small = (n > 0) & (n * percent < SMALL * 100)
    length = np.where(small, n - -(-percent * n // 100) + 1, 0)
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offsets[:-1], length)
    out.append((tv.mix(values[at] + np.uint64(11)), np.repeat(np.arange(len(n)), length)))
    level = np.frexp(np.maximum(n, 1))[1] - 1  # floor(log2 n)
    own = n >= SMALL
    above = own & (n * 100 >= percent * (2 << level))
    for use, shift in ((own, 0), (above, 1)):
        docs = np.flatnonzero(use)
        if not len(docs):
            continue
        size = n[docs]
        k = level[docs] + shift
        m = 3 * most_different(2 << k, (2 << k) * 100 // percent, percent) // 2 + 8
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[docs], size)
        s = values[at]
        row = np.repeat(np.arange(len(docs)), size)
        part = ((s >> np.uint64(24)) % np.repeat(m, size).astype(np.uint64)).astype(np.int64)
        key = row * (int(m.max()) + 1) + part
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(tv.mix(s[order]), new)
        row, part = key[new] // (int(m.max()) + 1), key[new] % (int(m.max()) + 1)
        first = np.searchsorted(row, np.arange(len(docs)))
        place = np.arange(len(row)) - first[row]
        kept = place <= most_different(size, size * 100 // percent, percent)[row]
        row, part, total = row[kept], part[kept], total[kept]
        out.append((tv.mix(total + tv.mix(part.astype(np.uint64) + (k[row].astype(np.uint64) << np.uint64(32)) + np.uint64(5))), docs[row]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of the two by which a row is found again."""
    inner = by_place(docs)
    doc, text = at_place(docs, "doc_id").cast("bigint"), at_place(docs, "text").cast("string")
    return inner.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("row_key"))


def proof(doc, text):
    """128 bits of a row's id and text; null and empty texts differ."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.when(text.isNull(), F.lit("n")).otherwise(F.lit(":")), F.coalesce(text, F.lit("")))))


def node_rows(rows: DataFrame, k: int) -> DataFrame:
    """Per row its node (fingerprint of its set) with a second hash of the set, the set's size and sketch."""
    def run(batches):
        for batch in tv.pieces(batches):
            values, offsets = shingle_sets(tv.texts(batch.column("text")), k)
            sketches = [sketch(values[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), as_long(fingerprints(values, offsets)), as_long(fingerprints(values, offsets, 1)), pa.array(np.diff(offsets)), pa.array(sketches, pa.binary())], names=["doc_id", "row_key", "node", "second", "n", "sketch"])

    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, node bigint, second bigint, n bigint, sketch binary")


def sorted_pairs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (signature, node) in order: copies stand in a list once."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    return sig[new], node[new]


def list_batch(sig: np.ndarray, node: np.ndarray, groups: int) -> pa.RecordBatch:
    cuts = radix.runs(sig, groups)
    return pa.RecordBatch.from_arrays([pa.array([g for g, _, _ in cuts], pa.int32()), pa.array([sig[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([node[a:b].tobytes() for _, a, b in cuts], pa.binary())], names=["grp", "sigs", "nodes"])


def unpacked(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64)


def dealt_again(groups: int):
    """Gathers postings of like signatures and cuts them finer."""

    def run(batches):
        sigs, nodes, size = [], [], 0
        for batch in batches:
            for s, n in zip(batch.column("sigs").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
                sigs.append(s)
                nodes.append(n)
                size += len(s) // 8
                if size >= radix.RUN_KEYS:
                    yield list_batch(*sorted_pairs(unpacked(sigs), unpacked(nodes)), groups)
                    sigs, nodes, size = [], [], 0
        if sigs:
            yield list_batch(*sorted_pairs(unpacked(sigs), unpacked(nodes)), groups)

    return run


def index_lists(rows: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(list, part, m, nodes): every index list with two nodes or more (m of them), packed in cells of bounded size; a list of the same members comes once."""
    levels = radix.rounds(buckets)

    def deal(batches):
        for batch in tv.pieces(batches, most=8_000_000):
            values, offsets = shingle_sets(tv.texts(batch.column("text")), k)
            sig, owner = signatures(values, offsets, percent)
            node = fingerprints(values, offsets)[owner]
            sig, node = sorted_pairs(sig, node)
            yield list_batch(sig, node, levels[0])

    def lists(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for b, s, n in zip(*(batch.column(c).to_pylist() for c in ("grp", "sigs", "nodes")), strict=True):
                x = held.setdefault(b, ([], []))
                x[0].append(s)
                x[1].append(n)
        for b in list(held):
            sigs, nodes = held.pop(b)
            sig, node = sorted_pairs(unpacked(sigs), unpacked(nodes))
            edge = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            ends = np.append(edge[1:], len(sig))
            several = ends - edge > 1
            packed = {node[a:e].tobytes() for a, e in zip(edge[several], ends[several], strict=True)}
            rows = [(xxhash.xxh3_64_intdigest(p), k // (8 * CELL), len(p) // 8, p[k : k + 8 * CELL]) for p in packed for k in range(0, len(p), 8 * CELL)]
            names, part, m, cells = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([as_long(np.array(names, np.uint64)), pa.array(part, pa.int32()), pa.array(m, pa.int64()), pa.array(cells, pa.binary())], names=["list", "part", "m", "nodes"])
            tv.trim()

    dealt = radix.dealt(rows.select("text").mapInArrow(deal, "grp int, sigs binary, nodes binary"), levels, dealt_again, "sigs")
    found = dealt.mapInArrow(lists, "list bigint, part int, m bigint, nodes binary")
    return found.groupBy("list", "part").agg(F.first("m").alias("m"), F.first("nodes").alias("nodes"))


def members(lists: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(list, chunk, chunks, node) of packed lists; chunks is 1 for lists that one task compares."""

    def run(batches):
        for batch in batches:
            nodes = [np.frombuffer(x, np.int64) for x in batch.column("nodes").to_pylist()]
            n = np.fromiter(map(len, nodes), np.int64, len(nodes))
            every = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            chunks = np.repeat(-(-batch.column("m").to_numpy() // chunk), n)
            place = (tv.mix(every.view(np.uint64) + np.uint64(29)) % chunks.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("list").to_numpy(), n)), pa.array(place), pa.array(chunks), pa.array(every)], names=["list", "chunk", "chunks", "node"])

    return lists.mapInArrow(run, "list bigint, chunk bigint, chunks bigint, node bigint")


def forest(sizes: np.ndarray, rows: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], list[tuple[list[int], int]]]:
    """Edges that span all pairs of a list that can link, and the clusters they make, each with its radius and its leader first. sizes must not decrease."""
    leaders: list[int] = []
    clusters: list[list[int]] = []
    radius: list[int] = []
    edges: list[tuple[int, int]] = []
    for j in range(len(sizes)):
        hits: list[int] = []
        if leaders:
            at = np.array(leaders)
            d = distance(rows[at], rows[j])
            may = (d <= most_different(sizes[at], sizes[j], percent)) & (sizes[at] * 100 >= percent * sizes[j])
            for c in range(len(leaders)):
                if may[c]:
                    edges.append((leaders[c], j))
                    hits.append(c)
                elif len(clusters[c]) > 1 and sizes[clusters[c][-1]] * 100 >= percent * sizes[j] and d[c] - radius[c] <= most_different(sizes[j], sizes[j], percent):
                    m = np.array(clusters[c])
                    m = m[np.searchsorted(sizes[m] * 100, percent * sizes[j]) :]  # the smaller are too small
                    ok = np.flatnonzero(distance(rows[m], rows[j]) <= most_different(sizes[m], sizes[j], percent))
                    if len(ok):
                        edges.append((int(m[ok[0]]), j))
                        hits.append(c)
        if not hits:
            leaders.append(j)
            clusters.append([j])
            radius.append(0)
            continue
        one = hits[0]
        for c in reversed(hits[1:]):
            apart = int(distance(rows[leaders[c] : leaders[c] + 1], rows[leaders[one]])[0])
            radius[one] = max(radius[one], apart + radius[c])
            clusters[one] = sorted(clusters[one] + clusters[c])
            del leaders[c], clusters[c], radius[c]
        clusters[one].append(j)
        radius[one] = max(radius[one], int(distance(rows[j : j + 1], rows[leaders[one]])[0]))
    return edges, [([leader, *(x for x in c if x != leader)], r) for leader, c, r in zip(leaders, clusters, radius, strict=True)]


def between_leaders(sizes: np.ndarray, rows: np.ndarray, radius: np.ndarray, top: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Leaders of clusters of one list, sizes not decreasing: (edges between leaders that can link, pairs of clusters that are still apart and may hold a pair that can
    link). top: the largest size in each cluster."""
    component = np.arange(len(sizes))
    edges, open_pairs = [], []
    for j in range(1, len(sizes)):
        d = distance(rows[:j], rows[j])
        for i in np.flatnonzero((d <= most_different(sizes[:j], sizes[j], percent)) & (sizes[:j] * 100 >= percent * sizes[j])):
            if component[i] != component[j]:
                edges.append((int(i), j))
                component[component == component[j]] = component[i]
    for j in range(1, len(sizes)):
        apart = np.flatnonzero(component[:j] != component[j])
        if len(apart):
            d = distance(rows[apart], rows[j]) - radius[apart] - radius[j]
            open_pairs += [(int(i), j) for i in apart[d <= most_different(top[apart], top[j], percent)]]
    return edges, open_pairs


def first_pair(sizes: np.ndarray, rows: np.ndarray, side: np.ndarray, percent: int) -> tuple[int, int] | None:
    """A pair of different sides that can link, if there is one."""
    left = np.flatnonzero(side == 0)
    for j in np.flatnonzero(side == 1):
        small, large = np.minimum(sizes[left], sizes[j]), np.maximum(sizes[left], sizes[j])
        ok = left[(distance(rows[left], rows[j]) <= most_different(small, large, percent)) & (small * 100 >= percent * large)]
        if len(ok):
            return int(ok[0]), int(j)
    return None


def crossing(sizes: np.ndarray, rows: np.ndarray, component: np.ndarray, percent: int, chunk: np.ndarray | None = None) -> list[tuple[int, int]]:
    """All pairs of a list that can link and are of different components (and of different chunks, if given)."""
    out = []
    for j in range(1, len(sizes)):
        low = int(np.searchsorted(sizes[:j] * 100, percent * sizes[j]))
        m = low + np.flatnonzero((component[low:j] != component[j]) & (True if chunk is None else chunk[low:j] != chunk[j]))
        if len(m):
            m = m[distance(rows[m], rows[j]) <= most_different(sizes[m], sizes[j], percent)]
            out += [(int(i), j) for i in m]
    return out


def by_group(rows: DataFrame, keys: list[str], order: list[str], one, schema: str) -> DataFrame:
    """Applies one(keys, columns as lists) to each group of rows with the same keys, in order; it gives rows of the schema."""
    names = [*keys, *(c for c in rows.columns if c not in keys)]
    rows = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "int": pa.int32()}[t] for _, t in fields]

    def run(batches):
        held: list[list] = [[] for _ in names]

        def flush(upto: int) -> pa.RecordBatch:
            """Results of the first `upto` rows held, which are whole groups."""
            out: dict[tuple, None] = {}
            changed = np.zeros(upto, bool)
            for h in held[: len(keys)]:
                name = np.array(h[:upto])
                changed[1:] |= name[1:] != name[:-1]
            edges = [0, *np.flatnonzero(changed).tolist(), upto]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                out |= dict.fromkeys(one([h[begin] for h in held[: len(keys)]], [h[begin:end] for h in held[len(keys) :]]))
            for h in held:
                del h[:upto]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for h, c in zip(held, batch.columns, strict=True):
                h += c.to_pylist()
            last = len(held[0])
            while last and all(h[last - 1] == h[-1] for h in held[: len(keys)]):
                last -= 1
            if last:
                yield flush(last)
        if held[0]:
            yield flush(len(held[0]))
        tv.trim()

    return rows.mapInArrow(run, schema)


def ordered(a: int, b: int) -> tuple[int, int]:
    return (a, b) if a <= b else (b, a)


def forest_edges(postings: DataFrame, nodes: DataFrame, percent: int, chunked: bool) -> DataFrame:
    """Distinct (a, b): a spanning forest of the pairs of each list that can link. chunked: is there a list of several chunks."""
    nodes = nodes.select("node", "n", "sketch")
    joined = postings.join(nodes, "node")
    if chunked:
        # chunks of a list fold their sketches alike, so that distances in one can be held against those in another
        folds = cut(joined.where("chunks > 1").groupBy("list").agg(F.min(F.octet_length("sketch")).alias("fold")))
    joined = (joined.join(folds, "list", "left") if chunked else joined.withColumn("fold", F.lit(None).cast("int"))).select("list", "chunk", "node", "n", "sketch", "fold")

    def chunk_edges(_, columns):
        node, n, sketches, fold = columns
        sizes, rows = np.array(n, np.int64), folded(sketches, fold[0])
        if fold[0] is None and len(node) == 2:
            if sizes[0] * 100 >= percent * sizes[1] and np.bitwise_count(rows[0] ^ rows[1]).sum() <= most_different(sizes[0], sizes[1], percent):
                yield (*ordered(*node), None, None, None)
            return
        edges, clusters = forest(sizes, rows, percent)
        for i, j in edges:
            yield (*ordered(node[i], node[j]), None, None, None)
        if fold[0] is not None:
            for c, radius in clusters:
                for x in c:
                    yield node[c[0]], node[x], _[0], radius, int(sizes[c].max())

    found = by_group(joined, ["list", "chunk"], ["n", "node"], chunk_edges, "a bigint, b bigint, list bigint, radius bigint, top bigint")
    if not chunked:
        return found.select("a", "b").distinct()
    found = cut(found)
    edges, clusters = found.where("list is null").select("a", "b"), found.where("list is not null")
    leaders = clusters.where("a = b").select("list", F.col("a").alias("node"), "radius", "top").join(nodes, "node").join(folds, "list")

    def leader_edges(key, columns):
        node, radius, top, n, sketches, fold = columns
        linked, still_open = between_leaders(np.array(n, np.int64), folded(sketches, fold[0]), np.array(radius, np.int64), np.array(top, np.int64), percent)
        for i, j in linked:
            yield (*ordered(node[i], node[j]), None)
        for i, j in still_open:
            yield node[i], node[j], key[0]

    met = cut(by_group(leaders.select("list", "node", "radius", "top", "n", "sketch", "fold"), ["list"], ["n", "node"], leader_edges, "a bigint, b bigint, list bigint"))
    edges = edges.unionByName(met.where("list is null").select("a", "b"))
    still_open = met.where("list is not null")
    if still_open.isEmpty():
        return edges.distinct()
    inside = clusters.select("list", F.col("a").alias("leader"), F.col("b").alias("node"))
    side = lambda end, k: still_open.withColumn("leader", F.col(end)).join(inside, ["list", "leader"]).select("list", "a", "b", "node", F.lit(k).alias("side"))
    pairs = side("a", 0).unionByName(side("b", 1)).join(nodes, "node").join(folds, "list")

    def pair_edges(_, columns):
        node, sides, n, sketches, fold = columns
        hit = first_pair(np.array(n, np.int64), folded(sketches, fold[0]), np.array(sides), percent)
        if hit:
            yield ordered(node[hit[0]], node[hit[1]])

    late = by_group(pairs.select("list", "a", "b", "node", "side", "n", "sketch", "fold").withColumnsRenamed({"a": "x", "b": "y"}), ["list", "x", "y"], ["side", "n", "node"], pair_edges, "a bigint, b bigint")
    return edges.unionByName(late).distinct()


def crossing_edges(postings: DataFrame, nodes: DataFrame, percent: int, components: DataFrame) -> DataFrame:
    """Distinct (a, b): all pairs of each list that can link and are of different components; a long list's in tasks of two chunks."""
    joined = postings.join(nodes.select("node", "n", "sketch"), "node").join(components, "node", "left")
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    joined = joined.select("list", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "node", "n", "sketch", F.coalesce("component", "node").alias("component"), "chunk")

    def pair_edges(key, columns):
        node, n, sketches, component, chunk = columns
        for i, j in crossing(np.array(n, np.int64), folded(sketches), np.array(component), percent, None if key[1] == key[2] else np.array(chunk)):
            yield ordered(node[i], node[j])

    return by_group(joined, ["list", "p", "q"], ["n", "node"], pair_edges, "a bigint, b bigint").distinct()


def checked(edges: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked): the exact verdict on each edge. The full sets of the nodes concerned come from reading their documents again."""
    needed = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    keys = cut(nodes.join(needed, "node").select("node", F.col("row_key").alias("k")))
    many = keys.count()
    bitmap = bitmaps.of_keys(keys.select("k"), bitmaps.segments_for(many, 16, BITMAP_BYTES))
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            k_all = tv.mix(batch.column("row_key").to_numpy().astype(np.int64).view(np.uint64))
            batch = batch.filter(pa.array(sent.value.has(k_all, k_all)))
            for piece in tv.pieces([batch]):
                values, offsets = shingle_sets(tv.texts(piece.column("text")), k)
                sets = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([as_long(fingerprints(values, offsets)), piece.column("row_key"), pa.array(sets, pa.binary())], names=["node", "row_key", "set"])

    sets = rows.select("text", "row_key").mapInArrow(run, "node bigint, row_key bigint, set binary").dropDuplicates(["node"]).select("node", "set")
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))

    def verdict(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])
            tv.trim()

    return edges.join(left, "a").join(right, "b").mapInArrow(verdict, "a bigint, b bigint, linked boolean")


def label_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by label propagation with pointer jumping."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        step = cut(step.join(jump, "next").select("node", F.least("next", "beyond").alias("component"), (F.least("next", "beyond") != F.col("component")).alias("moved")))
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels


def node_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bucket_postings: int = BUCKET_POSTINGS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(nodes of every row: doc_id, row_key, node, n; component of every node that has a link)."""
    rows = with_key(docs)
    every = cut(node_rows(rows, k))
    nodes = cut(every.where("n > 0").groupBy("node", "n").agg(F.min("row_key").alias("row_key"), F.first("sketch").alias("sketch")))
    size = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size * (100 - percent) * 3 // 100) // (2 * bucket_postings)))
    lists = cut(index_lists(rows, k, percent, buckets))
    postings = members(lists, chunk)
    edges = cut(forest_edges(postings, nodes, percent, not lists.where(F.col("m") > chunk).isEmpty()))
    verdicts = cut(checked(edges, rows, nodes, k, percent))
    links = verdicts.where("linked")
    components = label_components(links)
    failed = verdicts.where("not linked")
    if not failed.isEmpty():
        # lists that hold both ends of a failed edge
        one = postings.join(failed, postings["node"] == failed["a"]).select("list", F.col("b").alias("node"))
        again = one.join(postings, ["list", "node"], "left_semi").select("list").distinct()
        more = crossing_edges(postings.join(again, "list", "left_semi"), nodes, percent, components)
        more = cut(more.join(verdicts.select("a", "b"), ["a", "b"], "left_anti"))
        if not more.isEmpty():
            late = cut(checked(more, rows, nodes, k, percent)).where("linked")
            components = label_components(links.unionByName(late))
    return every.drop("sketch"), components


def components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, row_key, n_shingles, component_id (the smallest doc_id reachable)."""
    every, found = node_components(docs, k, percent, chunk=chunk)
    # one row per node before anything is joined
    firsts = every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    names = firsts.join(firsts.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    return every.join(names, "node", "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of the smallest id (null ids last); columns unchanged. Rows without words stay, repeated rows once."""
    every, found = node_components(docs, k, percent)
    worded = every.where("n > 0")
    firsts = worded.groupBy("node", "second").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key")).alias("first"))
    # a set without links is alone, whatever other set has its fingerprint
    labelled = firsts.join(found, "node", "left").select("first", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("second")).otherwise(0).alias("own"))
    kept = labelled.groupBy("component", "own").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("key"))
    kept = kept.unionByName(every.where("n = 0").select(F.col("row_key").alias("key")).distinct())
    doc, text = at_place(docs, "doc_id").cast("bigint"), at_place(docs, "text").cast("string")
    keyed = by_place(docs).select("*", F.xxhash64(doc, text).alias("key"), proof(doc, text).alias("proof"))
    return named_again(keyed.join(kept, "key", "left_semi").dropDuplicates(["key", "proof"]), docs)
