"""Token counts by prefix dynamic programming.

A tokenizer that never joins across ASCII white space gives, for a text, the concatenation of what it
gives for the text's white-space separated words. So the state after a prefix is one number, the tokens so far, and

    tokens(prefix up to word k) = tokens(prefix up to word k - 1) + tokens(word k)
    tokens(prefix that ends j characters into word k) = tokens(prefix up to word k - 1) + tokens(first j characters of word k)

Each distinct word is encoded once by the tokenizer's own library (special strings inside it handled as the library does), and the running sums hold the
exact count of every prefix that ends at a word's end or in white space; with table="characters" each distinct word's own prefixes are encoded once too, and
the table holds the exact count of every prefix. Budget and truncation questions are then a search in that table (`prefix_within`), and never encode a text
again. Encoding a word's prefixes costs the square of its length; the table by words costs no more than the counts.

A tokenizer that joins across white space (byte-level ones put a space before a word into its token) is refused with a ValueError.

Cases: a null text counts as empty (0 tokens); a text of white space only has 0 tokens; a very long text is one piece of
its own and a very long word is encoded but not remembered; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
WHITE = " \t\n\x0b\x0c\r"
#: Texts whose counts must be the sums of their words' counts for a tokenizer to fit.
PROBES = ("a b", "Hello  world", " a", "a ", "a\nb\tc", "one, two; three 4 5.", "é ü  ñ\n\n ß", "x\u0301 \u0301y", "中 文 字", "the the the", "<|endoftext|> a <|endoftext|>")
#: Words remembered by a worker, and the longest of them in bytes.
MEMO_WORDS, MEMO_BYTES = 400_000, 64


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounter:
    """Token counts of words, by the library's own encoder, each word once."""

    kept: dict[str, WordCounter] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, int] = {}
        self.refuse_unless_separable(path)

    def refuse_unless_separable(self, path: str) -> None:
        count = lambda t: len(self.tokenizer.encode(t, add_special_tokens=False).ids)
        spaced = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content != t.content.strip(WHITE) or any(c in WHITE for c in t.content) or t.lstrip or t.rstrip]
        if spaced or any(count(t) != sum(count(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)) for t in PROBES):
            raise ValueError(f"{os.path.basename(path)} joins across white space")

    @classmethod
    def of(cls, path: str) -> WordCounter:
        """One per worker process."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def counts(self, words: pa.Array) -> np.ndarray:
        words = words.to_pylist()
        memo = self.memo
        new = [w for w in words if w not in memo]
        fresh: dict[bytes, int] = {}
        if new:
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            fresh = {w: len(c.ids) for w, c in zip(new, coded, strict=True)}
        out = np.fromiter((memo[w] if w in memo else fresh[w] for w in words), np.int64, len(words))
        if len(memo) + len(fresh) > MEMO_WORDS:
            memo.clear()
        memo.update((w, n) for w, n in fresh.items() if len(w) <= MEMO_BYTES)
        return out


    def prefixes(self, word: bytes) -> np.ndarray:
        """Tokens of the word's first 1, 2, ... characters."""
        text = word.decode()
        coded = self.tokenizer.encode_batch_fast([text[:j] for j in range(1, len(text) + 1)], add_special_tokens=False)
        return np.fromiter((len(c.ids) for c in coded), np.int64, len(text))


def character_table(text: str, counter: WordCounter, memo: dict[bytes, np.ndarray]) -> np.ndarray:
    """The exact tokens of the first 0, 1, 2, ... characters of a text."""
    out = np.zeros(len(text) + 1, np.int64)
    done, before = 0, 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word = m[0].encode()
        if word not in memo:
            memo[word] = counter.prefixes(word)
        out[done + 1 : m.start() + 1] = before
        out[m.start() + 1 : m.end() + 1] = before + memo[word]
        done, before = m.end(), before + int(memo[word][-1])
    out[done + 1 :] = before
    return out


def prefix_counts(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The DP table of a batch: per word the tokens of its text up to that word's end, and the offsets of the texts."""
    words = tv.split_words(column, lower=False)
    each = WordCounter.of(path).counts(words.words)[words.codes]
    running = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=running[1:])
    before = np.repeat(running[words.offsets[:-1]], np.diff(words.offsets))
    return running[1:] - before, words.offsets


def prefix_within(prefix: np.ndarray, budget: int) -> int:
    """Words in the longest prefix of whole words with at most so many tokens. prefix: one text's part of the DP table."""
    return int(np.searchsorted(prefix, budget, "right"))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, budgets: tuple[int, ...] = (), table: str = "") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit; for each budget, in `fits`, the words of the longest prefix of
    whole words within it; with table, `prefix_tokens`: "words": the exact count at every word's end, "characters": after the first 0, 1, 2, ... characters."""
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean" + ", fits array<bigint>" * bool(budgets) + ", prefix_tokens array<bigint>" * bool(table)

    def run(batches):
        path, memo = tokenizer_path(tokenizer), {}
        for batch in tv.pieces(batches):
            column = tv.texts(batch.column("text"))
            prefix, offsets = prefix_counts(column, path)
            total = np.where(np.diff(offsets) > 0, np.append(prefix, 0)[np.maximum(offsets[1:] - 1, 0)], 0)
            out = [batch.column("doc_id"), pa.array(np.diff(tv.raw(column)[1])), pa.array(total), pa.array(total > limit)]
            per_text = [prefix[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] if budgets or table else []
            if budgets:
                out.append(pa.array([[prefix_within(p, b) for b in budgets] for p in per_text], pa.list_(pa.int64())))
            if table == "characters":
                per_text = [character_table(t or "", WordCounter.of(path), memo) for t in batch.column("text").to_pylist()]
                memo.clear()  # a table of this kind holds far more than its words' prefixes
            if table:
                out.append(pa.array(per_text, pa.list_(pa.int64())))
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"] + ["fits"] * bool(budgets) + ["prefix_tokens"] * bool(table)
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
