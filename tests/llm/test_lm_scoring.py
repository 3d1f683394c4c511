import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litgrid.llm import bitmaps, radix
from litgrid.llm import lm_scoring as lm
from litgrid.llm import textvec as tv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def brute(texts, training):
    """Exact base figures, and the model's score with exact counts in place of quantised ones."""
    single, pair = Counter(), Counter()
    for t in training:
        w = tokens_of(t)
        single.update(w)
        pair.update(zip(["\n\n", *w], w, strict=False))
    n, v, ends = sum(single.values()), len(single), single["\n"]
    value = lambda c: float(lm.level_value(lm.quantised(np.array([c])))[0]) if c else 0.0
    out = []
    for t in texts:
        w = tokens_of(t)
        base = sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip(["\n\n", *w], w, strict=False):
            before = ends if a in ("\n\n", "\n") else value(single[a])
            word = min(ends if b == "\n" else value(single[b]), n)
            score += math.log10((min(value(pair[a, b]), before, word) + lm.MU * (word + 1) / (n + v + 1)) / (before + lm.MU))
        out.append((len(w), sum(single[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("head", [500_000, 7, 0])
def test_scores_match_brute_force(docs, rows, head):
    texts = [r[1] for r in rows]
    training = [t for i, t in enumerate(texts) if i % 3]
    spark = docs.sparkSession
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    trained = spark.createDataFrame([(t,) for t in training], "text string")
    got = {r[0]: r[1:] for r in lm.fit_and_score(frame, trained, head=head, bits=24.0).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute(texts, training)):
        assert tuple(got[i][:3]) == want[:3], i
        assert got[i][3] == pytest.approx(want[3], abs=1e-6)
        assert got[i][4] == pytest.approx(want[4], rel=0.02, abs=0.1)


def test_long_words_are_joined_not_broadcast(docs, monkeypatch):
    scores = lambda: sorted(map(str, lm.fit_and_score(docs, docs).select("doc_id", "n_tokens", "n_known", F.round("base_score", 6), F.round("score", 6)).collect()))
    every = scores()
    monkeypatch.setattr(lm, "WORD_BYTES", 3)
    model, _ = lm.train(docs.select("text"))
    assert max(len(w.as_py()) for w in model.head) == 3 and not model.all_words
    assert scores() == every


def test_no_training_and_empty(docs, empty):
    found = lm.fit_and_score(docs, empty).collect()
    assert len(found) == docs.count() and all(r["score"] == 0 == r["base_score"] and r["train_tokens"] == 0 for r in found)
    assert lm.fit_and_score(empty, docs).collect() == []


def test_small_bound_still_scores(docs):
    tight = lm.fit_and_score(docs, docs, most_bytes=bitmaps.SEGMENT_BITS // 8).agg({"score": "sum", "n_tokens": "sum"}).first()
    assert tight["sum(score)"] < 0


def test_filter_of_many_shards_scores_alike(docs, monkeypatch):
    docs = docs.where("doc_id is not null")
    score = lambda bound: docs.sparkSession.createDataFrame(lm.fit_and_score(docs, docs, most_bytes=bound, group_tokens=2000).select("doc_id", "n_tokens", "score").toPandas()).orderBy("doc_id", "score").collect()
    one, many = score(10**8), score(20_000)
    assert one == many
    model, _ = lm.train(docs.select("text"), most_bytes=20_000, group_tokens=2000)
    assert len(model.shards) > 3 and all(len(x.value) <= 20_000 for x in model.shards)


def test_filter_at_production_settings(docs):
    text = docs.select("text")
    model, _ = lm.train(text)
    keys, counts = lm.merged([(r["keys"], r["counts"], r["large"]) for r in lm.gram_blobs(text, 1).collect()])
    other = np.setdiff1d(tv.mix(np.arange(200_000).astype(np.uint64)) & lm.HIGH, keys)

    def levels(of):
        out = np.zeros(len(of), np.int8)
        for k, shard in enumerate(model.shards):
            model.places.probe(k, shard.value, of, out)
        return out

    over = levels(keys) - lm.quantised(counts)
    assert over.min() >= 0 and (over > 0).mean() < 0.012
    assert (levels(other) > 0).mean() < 0.012


def test_bitmap_holds_its_keys(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as k")
    bitmap = bitmaps.of_keys(keys, bitmaps.segments_for(5000, 16, 1 << 20))
    held = tv.mix(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
    assert bitmap.has(held, held).all()
    other = tv.mix(np.arange(10**6, 10**6 + 20000).astype(np.uint64))
    assert bitmap.has(other, other).mean() < 0.05


def test_words_of_odd_texts():
    column = tv.texts(pa.array(["A b\tc", None, "", " x ", "é\x0bÀ\x1fz", "end"]))
    words = tv.split_words(column)
    flat = [words.words[int(c)].as_py().decode() for c in words.codes]
    assert flat == ["a", "b", "c", "x", "é", "À\x1fz", "end"]
    assert words.offsets.tolist() == [0, 3, 3, 3, 4, 6, 7]


@pytest.mark.parametrize(("groups", "fan", "want"), [(1, 256, [1]), (0, 256, [1]), (57, 256, [57]), (300, 256, [2, 512]), (100, 3, [2, 6, 18, 54, 162])])
def test_rounds(groups, fan, want):
    assert radix.rounds(groups, fan) == want


def test_dealing_in_rounds_counts_the_same(docs, monkeypatch):
    text = docs.select("text")
    total = lambda blobs: sorted(x for r in blobs.collect() for x in zip(*(a.tolist() for a in lm.merged([(r["keys"], r["counts"], r["large"])])), strict=True))
    def merged(blobs):
        out = {}
        for k, c in total(blobs):
            out[k] = out.get(k, 0) + c
        return out
    one = merged(lm.gram_blobs(text, 1))
    levels = [2, 6, 18]
    dealt = radix.dealt(lm.gram_blobs(text, 2), levels, lm.dealt_again).cache()
    assert merged(dealt) == one and dealt.select("grp").distinct().count() == 18
