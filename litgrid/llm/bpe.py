"""BPE encoding and decoding by tree concatenation.

A long text is halved until its leaves are short. Leaves are encoded in parallel: those of a text up to `BLOCK` bytes side by side in one batch, blocks of a longer one in tasks of their
own. Then neighbours are joined level by level, up to the whole text. Around a join a window of both sides is encoded again, and grows until its ends agree with what the sides have:

    an end agrees at an anchor, a place where any text splits, whatever stands around it: white space after something else, or two neighbours of different kinds (letter, digit, sign), so
    that nothing beyond can change what lies before it; or
    inside a run of one kind, when the window's outermost token is the one that the side has there. Byte-pair encoding with ranked merges is settled by pairs: a row of tokens is the
    encoding of its bytes if each two neighbours are the encoding of theirs. All pairs but those at the window's ends come from one encoding, and these are then pairs of the side's own.

A window without such ends grows to both whole sides at last, so a join always gives exactly what the library gives for the joined text.

Leaves are encoded by the tokenizers library, each distinct stretch between anchors of white space once. Decoding concatenates the tokens' bytes, as the byte-level decoder does.

Cases: a null text counts as empty (no tokens); special strings inside a text are their tokens, as is the library's default, wherever a leaf is cut; repeated rows give repeated results;
a very long text is shared out; an empty table gives no rows; extra columns are ignored. A tokenizer that isn't byte-level BPE with the usual pattern is refused with a ValueError.
"""

from __future__ import annotations

import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut
from .token_counts import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of a leaf, and of a text (or block of a longer one) that one task takes at once.
LEAF, BLOCK = 8_192, 65_536
#: Bytes of a side in its first window.
WINDOW = 64
#: Stretches remembered by a worker, and the longest of them in bytes.
MEMO_STRETCHES, MEMO_BYTES = 200_000, 64

#: ASCII places where any text splits: the second byte begins a new piece.
ANCHOR = re.compile(rb"[!-~](?=[ \t\n\x0b\x0c\r])|[A-Za-z](?=[!-@\[-`{-~])|[0-9](?=[!-/:-~])|[!-&(-/:-@\[-`{-~](?=[0-9A-Za-z])|'(?=[0-9])")


class Node(NamedTuple):
    """A stretch of UTF-8 and its token ids."""

    data: bytes
    ids: np.ndarray


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others are numbered on from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One tokenizer in one worker process."""

    kept: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before, model = said.get("pre_tokenizer") or {}, said["model"]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or said.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{os.path.basename(path)} is not byte-level BPE with the usual pattern")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(rb"\s", s) for s in self.special):
            raise ValueError(f"{os.path.basename(path)} has special strings with white space")
        self.reach = max([0, *map(len, self.special)]) - 1
        alphabet, vocabulary = byte_alphabet(), self.tokenizer.get_vocab()
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelt[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.sizes = np.array([len(s) for s in spelt], np.int64)
        self.begins = np.append(0, np.cumsum(self.sizes))
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.memo: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """What the library gives for each text by itself."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    # -- leaves ---------------------------------------------------------------------------------------------------------------------

    def leaves(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many leaves one after the other, and where each leaf's begin: distinct stretches between white-space anchors are encoded once."""
        starts = stretches(data, offsets)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        new = [w for w in words if w not in self.memo]
        fresh = {w: i.tobytes() for w, i in zip(new, self.whole(new), strict=True)}
        ids = [self.memo[w] if w in self.memo else fresh[w] for w in words]
        if len(self.memo) + len(fresh) > MEMO_STRETCHES:
            self.memo.clear()
        self.memo.update((w, i) for w, i in fresh.items() if len(w) <= MEMO_BYTES)
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        out = ragged(flat, np.append(0, np.cumsum(counts)), codes)
        running = np.append(0, np.cumsum(counts[codes]))
        return out, running[np.searchsorted(starts, offsets)]

    # -- joins ----------------------------------------------------------------------------------------------------------------------

    def splits(self, a: bytes, b: bytes, p: int) -> bool:
        """Whether no special string lies across byte p of the two sides, which may be cut within one."""
        joined = lambda begin, end: a[begin : min(end, len(a))] + b[max(begin - len(a), 0) : max(end - len(a), 0)]
        near = joined(max(0, p - self.reach), p + self.reach)
        return not any(s in near for s in self.special)

    def index(self, ids: np.ndarray, size: int, at: int, from_end: bool) -> int | None:
        """The token that begins at byte `at` of a stretch of `size` bytes, if one does; looked for from one end."""
        want, k = (size - at if from_end else at), 32
        while True:
            part = ids[-k:][::-1] if from_end else ids[:k]
            sums = np.append(0, np.cumsum(self.sizes[part]))
            i = int(np.searchsorted(sums, want))
            if i < len(sums):
                return None if sums[i] != want else (len(ids) - i if from_end else i)
            if k >= len(ids):
                return None
            k *= 4

    def one_run(self, piece: bytes) -> bool:
        """Whether the pattern takes all of it as one piece, from any place within a longer run."""
        text = piece.decode("utf-8", "ignore")  # a character cut at an end is left out
        if not text or "'" in text or (text[0].isspace() and text.strip()):
            return False
        return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) == 1

    def left_end(self, a: Node, b: Node, w: int) -> tuple[int, int, bool] | None:
        """(byte, token, settled): where the window begins in the left side; settled: what lies before can't change."""
        if w >= len(a.data):
            return 0, 0, True
        base = len(a.data) - w
        for m in reversed([m.end() for m in ANCHOR.finditer(a.data, base)]):
            if self.splits(a.data, b.data, m) and (i := self.index(a.ids, len(a.data), m, True)) is not None:
                return m, i, True
        if not self.one_run(a.data[base:]):
            return None
        sums = np.cumsum(self.sizes[a.ids[::-1][: w + 1]])  # bytes from each of the last tokens to the end
        for k in range(int(np.searchsorted(sums, w, "right")), 0, -1):
            p = len(a.data) - int(sums[k - 1])
            if a.data[p] & 0xC0 != 0x80 and self.splits(a.data, b.data, p):
                return p, len(a.ids) - k, False
        return None

    def right_end(self, a: Node, b: Node, w: int) -> tuple[int, int, bool] | None:
        """The same for where the window ends in the right side."""
        if w >= len(b.data):
            return len(b.data), len(b.ids), True
        head = b.data[: w + 1]
        for m in ANCHOR.finditer(head):
            # a contraction that the join makes may reach over the first two letters
            if m.end() > 3 and self.splits(a.data, b.data, len(a.data) + m.end()) and (j := self.index(b.ids, len(b.data), m.end(), False)) is not None:
                return m.end(), j, True
        if not self.one_run(head):
            return None
        sums = np.cumsum(self.sizes[b.ids[: w + 1]])
        for k in range(int(np.searchsorted(sums, w - 8, "right")), 0, -1):
            p = int(sums[k - 1])
            if p >= 16 and b.data[p] & 0xC0 != 0x80 and self.splits(a.data, b.data, len(a.data) + p):
                return p, k, False
        return None

    def joined(self, pairs: list[tuple[Node, Node]]) -> list[Node]:
        """The pairs' concatenations, each the library's own encoding of the joined text."""
        out: list[Node | None] = [None] * len(pairs)
        open_, w = list(range(len(pairs))), WINDOW
        while open_:
            ends = [(self.left_end(*pairs[k], w), self.right_end(*pairs[k], w)) for k in open_]
            ready = [(k, le, ri) for k, (le, ri) in zip(open_, ends, strict=True) if le is not None and ri is not None]
            again = self.whole([pairs[k][0].data[le[0] :] + pairs[k][1].data[: ri[0]] for k, le, ri in ready])
            for (k, (_, i, left_settled), (_, j, right_settled)), ids in zip(ready, again, strict=True):
                a, b = pairs[k]
                if (left_settled or (len(ids) and ids[0] == a.ids[i])) and (right_settled or (len(ids) and ids[-1] == b.ids[j - 1])):
                    out[k] = Node(a.data + b.data, np.concatenate([a.ids[:i], ids, b.ids[j:]]))
            open_ = [k for k in open_ if out[k] is None]
            w *= 2
        return out

    def trees(self, texts: list[list[Node]]) -> list[Node]:
        """The joined leaves of each text, all texts' joins of a level together."""
        while any(len(t) > 1 for t in texts):
            pairs = [(t[i], t[i + 1]) for t in texts for i in range(0, len(t) - 1, 2)]
            done = iter(self.joined(pairs))
            texts = [[next(done) for _ in range(0, len(t) - 1, 2)] + t[len(t) - len(t) % 2 :] for t in texts]
        return [t[0] if t else Node(b"", np.zeros(0, np.uint32)) for t in texts]

    def encode(self, texts: list[bytes], leaf: int = LEAF) -> list[np.ndarray]:
        """Ids of each text: leaves of all texts side by side, then their joins."""
        cuts = [halves(t, leaf) for t in texts]
        offsets = np.append(0, np.cumsum([b - a for c in cuts for a, b in zip(c, c[1:], strict=False)])).astype(np.int64)
        ids, begins = self.leaves(np.frombuffer(b"".join(texts), np.uint8), offsets)
        nodes, k = [], 0
        for t, c in zip(texts, cuts, strict=True):
            nodes.append([Node(t[a:b], ids[begins[k + i] : begins[k + i + 1]]) for i, (a, b) in enumerate(zip(c, c[1:], strict=False))])
            k += len(c) - 1
        return [n.ids for n in self.trees(nodes)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one after the other."""
        return ragged(self.spelt, self.begins, ids.astype(np.int64)).tobytes()


def ragged(flat: np.ndarray, begins: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Runs flat[begins[c] : begins[c + 1]] of the codes c, one after the other."""
    sizes = begins[codes + 1] - begins[codes]
    ends = np.cumsum(sizes)
    shift = np.repeat(begins[codes] - (ends - sizes), sizes)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + shift]


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin: at each (non-empty) leaf's begin, and at white space after anything that surely is none."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    sure = (data > 32) & (data != 127)
    # characters of these first bytes may be white space beyond ASCII: no anchor after them
    for lead, width in ((0xC2, 2), (0xE1, 3), (0xE2, 3), (0xE3, 3)):
        at = np.flatnonzero(data == lead) + width - 1
        sure[at[at < len(data)]] = False
    begin = np.zeros(len(data), bool)
    begin[1:] = white[1:] & sure[:-1]
    begin[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begin)


def halves(data: bytes, leaf: int) -> list[int]:
    """Cuts of a text that halve it until no part is above leaf bytes, between characters: [0, ..., len(data)]."""
    if not data:
        return [0]
    parts = 1
    while len(data) > parts * leaf:
        parts *= 2
    cuts = [0]
    for k in range(1, parts):
        p = len(data) * k // parts
        while p < len(data) and data[p] & 0xC0 == 0x80:
            p += 1
        if cuts[-1] < p < len(data):
            cuts.append(p)
    return [*cuts, len(data)]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id and ids, the token ids as little-endian unsigned 32-bit integers."""

    def short(batches):
        codec = Codec.of(tokenizer_path(tokenizer))
        for batch in tv.pieces(batches):
            texts = [t or b"" for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            ids = [i.astype("<u4").tobytes() for i in codec.encode(texts, leaf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    def blocks(batches):
        for batch in batches:
            for key, doc_id, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), pc.cast(batch.column("text"), pa.large_binary()).to_pylist(), strict=True):
                c = halves(text, block)
                for i, (a, b) in enumerate(zip(c, c[1:], strict=False)):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "doc_id": pa.array([doc_id], pa.int64()), "block": pa.array([i], pa.int64()), "text": pa.array([text[a:b]], pa.binary())})

    def each_block(batches):
        codec = Codec.of(tokenizer_path(tokenizer))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = codec.encode([row.column("text")[0].as_py()], leaf)[0]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([ids.astype("<u4").tobytes()], pa.binary())], names=[*row.schema.names, "ids"])

    def whole(batches):
        codec, now, nodes = Codec.of(tokenizer_path(tokenizer)), None, []

        def done():
            ids = codec.trees([nodes])[0].ids.astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[1]], pa.int64()), pa.array([ids], pa.binary())], names=["doc_id", "ids"])

        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and row["key"] != now[0]:
                    yield done()
                    nodes = []
                now = (row["key"], row["doc_id"])
                nodes.append(Node(row["text"], np.frombuffer(row["ids"], "<u4")))
        if now is not None:
            yield done()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    few = rows.where(size <= block).mapInArrow(short, "doc_id bigint, ids binary")
    # numbered once and kept, so that a lost task can't number them anew
    long = cut(rows.where(size > block).withColumn("key", F.monotonically_increasing_id()))
    parts = long.mapInArrow(blocks, "key bigint, doc_id bigint, block bigint, text binary").repartition("key", "block")
    coded = parts.mapInArrow(each_block, "key bigint, doc_id bigint, block bigint, text binary, ids binary")
    return few.unionByName(coded.repartition("key").sortWithinPartitions("key", "block").mapInArrow(whole, "doc_id bigint, ids binary"))


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The columns `keep` of encoded(ids, ...), and decoded: the text of the ids; bytes that are no UTF-8 become U+FFFD. Null ids give the empty text."""
    kept = encoded.select(*keep, *(["ids"] if "ids" not in keep else []))

    def run(batches):
        codec = Codec.of(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [codec.decode(np.frombuffer(i or b"", "<u4")).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    schema = kept.select(*keep).schema
    return kept.mapInArrow(run, schema.add("decoded", "string"))


def digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = decode(encode(docs, tokenizer), tokenizer)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
