import math
import re
from collections import Counter

import numpy as np
import pytest

from litgrid.llm import lexical_search as ls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, queries, top=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    each = [(i, Counter(w)) for i, t in docs if (w := words(t))]
    n_docs, n_terms = len(each), sum(c.total() for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c in each:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0))
        out += [(item, k + 1, i if known else None, -s) for k, (s, known, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def asked(rows):
    words = [" ".join((r[1] or "").split()[3:23]) for r in rows[:40]]
    return list(enumerate([*words, None, "", "...", "nowhere", "W1 w1 w1 W2", rows[20][1]])) + [(3, words[3]), (None, words[4])]


@pytest.mark.parametrize(("piece", "block"), [(20_000, 200_000), (10**9, 60), (1, 200_000)])
def test_ranks_match_brute_force(spark, docs, rows, asked, piece, block):
    queries = spark.createDataFrame([(i, t, 1) for i, t in asked], "item_id bigint, text string, score int")
    got = ls.rank(docs, queries, piece=piece, block_words=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute([(r[0], r[1]) for r in rows], asked)


def test_empty_sides_give_no_rows(spark, docs, empty):
    queries = spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ls.rank(docs, queries.limit(0)).count() == 0
    assert ls.rank(empty, queries).count() == 0
    assert ls.rank(empty, queries).schema["item_id"].dataType.simpleString() == "string"


def test_treaps_are_search_trees_and_heaps_and_prune():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, terms = 500, np.array([0, 3, 9])
        lists = [np.sort(rng.choice(n, int(rng.integers(1, n)), replace=False)) for _ in terms]
        docs, counts = np.concatenate(lists), np.array([len(x) for x in lists])
        impacts = rng.integers(1, 5, len(docs)) * 1000
        t = ls.Treaps(terms, counts, docs, impacts)

        def walk(node, low, high, most, t=t):
            if not node:
                return []
            assert low <= t.doc[node] < high and t.impact[node] <= most
            return walk(t.left[node], low, t.doc[node], t.impact[node]) + [int(t.doc[node])] + walk(t.right[node], t.doc[node] + 1, high, t.impact[node])

        for term, own in zip(terms.tolist(), lists, strict=True):
            assert walk(t.root[term], 0, n, 10**9) == own.tolist()
        low, high = 100, 300
        nodes = t.within(np.array([[t.root[x] for x in terms.tolist()]]), np.array([[low]]), np.array([[high]]))[0]
        begin = np.append(0, np.cumsum(counts))
        for k, own in enumerate(lists):
            inside = (own >= low) & (own < high)
            assert t.impact[nodes[k]] == (impacts[begin[k] : begin[k + 1]][inside].max() if inside.any() else 0)


def test_search_splits_few_ranges_and_keeps_ties_by_document():
    rng = np.random.default_rng(4)
    n, terms = 20_000, np.arange(12)
    lists = [np.sort(rng.choice(n, int(n * p), replace=False)) for p in (0.9, 0.8, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)]
    impacts = np.concatenate([rng.integers(1, 900, len(x)) for x in lists])
    docs, counts = np.concatenate(lists), np.array([len(x) for x in lists])
    t = ls.Treaps(terms, counts, docs, impacts)
    weights = np.array([math.floor(1000 * math.log(2 * n / (2 * len(x) + 1))) for x in lists])
    seen = []
    within = t.within
    t.within = lambda nodes, low, high: seen.append(len(nodes) // 3) or within(nodes, low, high)
    at, scores = ls.search(t, n, terms, weights, 20, 1)
    full = np.zeros(n, np.int64)
    for k, own in enumerate(lists):
        full[own] += weights[k] * impacts[sum(counts[:k]) : sum(counts[: k + 1])]
    best = np.lexsort((np.arange(n), -full))[:20]
    order = np.lexsort((at, -scores))
    assert at[order].tolist() == best.tolist() and scores[order].tolist() == full[best].tolist()
    assert sum(seen) < n / 5
    flat = ls.Treaps(np.array([0]), np.array([n]), np.arange(n), np.full(n, 7))
    at, scores = ls.search(flat, n, np.array([0]), np.array([3]), 20, 1)
    assert sorted(at.tolist()) == list(range(20)) and set(scores.tolist()) == {21}
