import hashlib
import random

import numpy as np
import pytest

from litgrid.llm import bpe
from litgrid.llm.token_counts import tokenizer_path

KINDS = ["abcdefghij", "0123456789", "#$%'!.,-", "   \n\t", "é中文字あい", "'", " 　\x1c\xa0", "re ll s t'd", "A", "Ǆ٣x", "\U0001f600🏽‍"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(tokenizer_path(bpe.TOKENIZER))


def odd(rng):
    parts = [("<|endoftext|>" if rng.random() < 0.15 else "".join(rng.choice(k) for _ in range(rng.choice([1, 2, 3, 10, 60, 200])))) for k in rng.choices(KINDS, k=rng.randrange(1, 8))]
    return "".join(parts)


def test_trees_of_any_leaf_give_the_library_s_ids(codec):
    rng = random.Random(11)
    for _ in range(1500):
        text = odd(rng)
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        got = codec.encode([text.encode()], rng.choice([1, 3, 7, 16, 64, 500]))[0]
        assert got.tolist() == want, text
        assert codec.decode(got).decode() == codec.tokenizer.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["A", "ab", "中", "9", "-", "\n", "é", "qzx"])
def test_long_runs_are_joined_in_small_windows(codec, unit, monkeypatch):
    """A run without any anchor: windows agree by tokens, long before they are whole sides. (Where one sign repeats, a join may shift all tokens of the right side; then the window is that side.)"""
    text = (unit * 40_000)[:40_000].encode()[: 40_000 // len(unit.encode()) * len(unit.encode())]
    widest = []
    whole = codec.whole

    def watched(texts):
        widest.append(max(map(len, texts), default=0))
        return whole(texts)

    cuts = bpe.halves(text, 2_000)
    leaves = [bpe.Node(text[a:b], whole([text[a:b]])[0]) for a, b in zip(cuts, cuts[1:], strict=False)]
    monkeypatch.setattr(codec, "whole", watched)
    assert codec.trees([leaves])[0].ids.tolist() == whole([text])[0].tolist()
    assert unit in "A9-" or max(widest) <= 2_048


def test_every_anchor_splits(codec):
    """Where the pattern of anchors matches, both sides' encodings stand side by side."""
    rng = random.Random(5)
    seen = 0
    for _ in range(300):
        text = odd(rng).replace("<|endoftext|>", "").encode()
        ids = codec.whole([text])[0].tolist()
        for m in list(bpe.ANCHOR.finditer(text))[:20]:
            seen += 1
            left, right = codec.whole([text[: m.end()], text[m.end() :]])
            assert left.tolist() + right.tolist() == ids, (text, m.end())
    assert seen > 500


def test_rows_short_and_long(spark, docs, rows, empty, codec):
    rng = random.Random(3)
    texts = [r[1] for r in rows] + [odd(rng) * 30 for _ in range(20)] + ["w" * 9_000, "<|endoftext|>" * 500, "a<|endoftext|>b  <|endoftext|>", " " * 3_000, None, ""]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids int, key string").repartition(3)
    coded = bpe.encode(frame, leaf=200, block=1_000)
    got = {r["doc_id"]: r for r in bpe.decode(coded).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = codec.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want
        assert got[i]["decoded"] == codec.tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty).count() == 0
    repeated = spark.createDataFrame([(None, "x y" * 600), (None, "x y" * 600), (7, "x y" * 600)], "doc_id bigint, text string")
    assert len({r["ids_sha256"] for r in bpe.digests(repeated).collect()}) == 1
    assert sorted(str(r["doc_id"]) for r in bpe.encode(repeated, block=500).collect()) == ["7", "None", "None"]


def test_digests(docs, rows, codec):
    got = sorted((tuple(r) for r in bpe.digests(docs).collect()), key=str)
    want = []
    for r in rows:
        ids = codec.tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(codec.tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want, key=str)


def test_ids_that_are_no_text_are_replaced_and_other_tokenizers_refused(spark, codec):
    lead = codec.tokenizer.token_to_id("Ã")
    got = bpe.decode(spark.createDataFrame([(1, bytearray(np.array([lead], "<u4").tobytes())), (2, None)], "doc_id bigint, ids binary")).collect()
    assert [r["decoded"] for r in got] == [codec.tokenizer.decode([lead]), ""]
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Codec(tokenizer_path("word_bpe_49k.json"))
