import re

import numpy as np
import pytest

from litgrid.llm import jaccard_join as jj


def brute(rows, k, percent):
    """Component (smallest id reachable) of every row by comparing all pairs of texts."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(table))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)] = min(ids.get(find(i), 10**9), rows[i][0])
    return [(r[0], len(s), ids.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 90)])
def test_components_match_brute_force(docs, rows, k, percent):
    got = [tuple(r) for r in jj.components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()]
    want = brute(rows, k, percent)
    assert order(got) == order(want)
    assert len({c for _, _, c in want}) < len(want) - 40  # there are links to find


@pytest.mark.parametrize(("chunk", "cell"), [(3, 2), (1, 10**6), (6, 10**6)])
def test_chunked_lists_give_the_same_components(docs, rows, chunk, cell, monkeypatch):
    monkeypatch.setattr(jj, "CELL", cell)
    got = [tuple(r) for r in jj.components(docs, 4, 85, chunk=chunk).select("doc_id", "n_shingles", "component_id").collect()]
    assert order(got) == order(brute(rows, 4, 85))


def test_chunks_leaders_and_open_pairs_span_what_can_link():
    rng = np.random.default_rng(21)
    late = 0
    for trial in range(40):
        base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
        sets = sorted((np.unique(np.append(rng.permutation(base)[int(rng.integers(0, 30)) :], rng.integers(0, 2**63, int(rng.integers(0, 30))).astype(np.uint64))) for _ in range(30)), key=len)
        sizes, rows = np.array([len(s) for s in sets]), jj.folded([jj.sketch(s) for s in sets])
        chunk = rng.integers(0, 5, len(sets))
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        def join(edges):
            for i, j in edges:
                parent[find(int(i))] = find(int(j))

        clusters = []
        for c in range(5):
            at = np.flatnonzero(chunk == c)
            edges, found = jj.forest(sizes[at], rows[at], 85)
            join((at[i], at[j]) for i, j in edges)
            clusters += [(at[x], r) for x, r in found]
        clusters.sort(key=lambda x: (sizes[x[0][0]], x[0][0]))
        lead = np.array([c[0] for c, _ in clusters])
        edges, still_open = jj.between_leaders(sizes[lead], rows[lead], np.array([r for _, r in clusters]), np.array([sizes[c].max() for c, _ in clusters]), 85)
        join((lead[i], lead[j]) for i, j in edges)
        for i, j in still_open:
            at = np.concatenate([clusters[i][0], clusters[j][0]])
            hit = jj.first_pair(sizes[at], rows[at], np.repeat([0, 1], [len(clusters[i][0]), len(clusters[j][0])]), 85)
            if hit:
                late += find(int(at[hit[0]])) != find(int(at[hit[1]]))
                join([(at[hit[0]], at[hit[1]])])
        for i, j in jj.crossing(sizes, rows, np.arange(len(sets)), 85):
            assert find(i) == find(j)
    assert late  # some pairs are found by comparing clusters only


def test_lists_dealt_in_rounds_are_the_same(docs, monkeypatch):
    rows = jj.with_key(docs)
    one = sorted(r["nodes"] for r in jj.index_lists(rows, 4, 85, 1).collect())
    monkeypatch.setattr(jj.radix, "rounds", lambda n: [2, 8, 32])
    assert sorted(r["nodes"] for r in jj.index_lists(rows, 4, 85, 30).collect()) == one


def test_keep_one(docs, rows):
    got = jj.keep_one(docs)
    assert got.columns == docs.columns
    want = {c for _, n, c in brute(rows, 5, 80) if n and c is not None} | {r[0] for r, (_, n, _) in zip(rows, brute(rows, 5, 80), strict=True) if not n}
    ids = [r[0] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if i is not None)


def test_keep_one_with_any_names(docs):
    wide = docs.drop("shard").selectExpr("*", "1 as __key", "2 as key", "3 as `a.b`", "4 as node", "5 as lang", "6 as row_key", "7 as proof")
    got = jj.keep_one(wide)
    assert got.columns == wide.columns
    assert sorted(map(str, (r[0] for r in got.collect()))) == sorted(map(str, (r[0] for r in jj.keep_one(docs).collect())))


def test_empty(empty):
    assert jj.components(empty).collect() == []
    assert jj.keep_one(empty).collect() == []


def test_sketch_distance_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 31, 64, 500, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[: n * 9 // 10], rng.integers(0, 2**63, n // 5).astype(np.uint64)))
        rows = jj.folded([jj.sketch(a), jj.sketch(b)])
        assert jj.distance(rows[:1], rows[1])[0] <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("percent", [80, 85, 90, 95])
def test_linked_sets_share_a_list(percent):
    rng = np.random.default_rng(5)
    for n in [*range(1, 80), 127, 128, 150, 256, 500, 511, 513, 2000]:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = jj.most_different(n, n, percent)
        drop = int(rng.integers(0, most + 1)) // 2
        b = np.unique(np.append(a[drop:], rng.integers(0, 2**63, most - drop).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        sig, owner = jj.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), n


def test_forest_spans_what_can_link():
    rng = np.random.default_rng(9)
    for _ in range(30):
        base = np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
        sets = sorted((np.unique(np.append(rng.permutation(base)[int(rng.integers(0, 25)) :], rng.integers(0, 2**63, int(rng.integers(0, 25))).astype(np.uint64))) for _ in range(25)), key=len)
        sizes, rows = np.array([len(s) for s in sets]), jj.folded([jj.sketch(s) for s in sets])
        def parts(edges):
            p = list(range(len(sets)))
            def find(x):
                while p[x] != x:
                    x = p[x]
                return x
            for i, j in edges:
                p[find(i)] = find(j)
            return [[find(i) == find(j) for j in range(len(sets))] for i in range(len(sets))]
        every = jj.crossing(sizes, rows, np.arange(len(sets)), 85)
        assert parts(jj.forest(sizes, rows, 85)[0]) == parts(every)
