"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cross-parsed against it: from each point the longest
match that stands anywhere in the labelled text is one phrase, and the next phrase begins behind it. A text needs few, long
phrases against its own language. With c phrases over n characters and N characters of labelled text, c * log2(N) / n estimates
the cross entropy; the language with the fewest such normalised phrases wins.

The automaton is turned into a dense table whose missing moves go to where the root would go with that character, with a flag
"a phrase ended here". Parsing is then one table look-up per character, and all texts and languages of a block are parsed in step, in
blocks of `BLOCK` characters (a block's end ends a phrase, for all languages alike).

The labelled text is a bounded sample of labelled rows: per language at most `rows` rows (smallest md5 of the id and text), of each at most
`row_chars` characters from a place given by its hash, together at most `chars` characters. There is no bound on languages: they are dealt into blocks whose
tables fit in `table_bytes`, each a broadcast of its own; with several, a worker holds a bounded amount of text, goes through the blocks, and keeps each
text's two best languages. Nor is there one on letters: beyond the most frequent, a letter is spelt in digits of its code point.

Cases: null and letterless texts are "und" with score 0; null labels teach nothing; with no labelled text all texts are "und"; ties go to
the language that sorts first; very long texts are many blocks; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv

SAMPLE = {"rows": 64, "row_chars": 8192, "chars": 65_536}
#: Bound of the tables of one block of languages (one language alone may need more).
TABLE_BYTES = 400_000_000
#: Characters of text held while all blocks are parsed, if they are several.
ROUND_CHARS = 32_000_000
BLOCK = 2048
ALPHABET = 255
#: Digits in which letters are spelt that have no symbol of their own.
DIGIT_BITS, DIGITS = 5, 4


def labelled_sample(docs: DataFrame, rows: int, row_chars: int, chars: int):
    """(language, texts) of each language, in order. docs: lang, text, and id. The driver holds one language's at a time."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    spare = F.greatest(F.length("text") - row_chars, F.lit(0)) + 1
    begin = (F.pmod(F.xxhash64("id", "text"), spare) + 1).cast("int")
    slim = labelled.select("lang", F.col("text").substr(begin, F.lit(row_chars)).alias("text"), F.md5(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), F.col("text"))).alias("h"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    now, texts, held = None, [], 0
    for lang, text in slim.withColumn("nth", nth).where(F.col("nth") <= rows).orderBy("lang", "nth").select("lang", "text").toLocalIterator():
        if lang != now:
            if texts:
                yield now, texts
            now, texts, held = lang, [], 0
        if held < chars:
            texts.append(text[: chars - held])
            held += len(texts[-1])
    if texts:
        yield now, texts


def frequent_letters(counts: dict[str, int]) -> tuple[str, bool]:
    """(letters with symbols of their own, most frequent first; whether the others are spelt in digits)."""
    order = sorted(counts, key=lambda c: (-counts[c], c))
    spelt = len(order) > ALPHABET - 2
    return "".join(order[: ALPHABET - 2 - (1 << DIGIT_BITS)] if spelt else order), spelt


def letters_of(texts: list[str], counts: dict[str, int]) -> None:
    for t in texts:
        for c, n in Counter(t.lower()).items():
            if c.isalpha() and len(c) == 1:
                counts[c] = counts.get(c, 0) + n


class Folding:
    """Code points to symbols: frequent letters of the labelled text, 0 for what is no letter, 1 for other letters or, if they are spelt, their digits."""

    def __init__(self, letters: str, spelt: bool) -> None:
        self.spelt = spelt
        self.digits = len(letters) + 2  # the first digit's symbol
        self.size = self.digits + (1 << DIGIT_BITS if spelt else 0)
        self.table = np.zeros(0x110000, np.uint8)
        known = np.array([cp for cp in range(0x3000) if chr(cp).isalpha()])
        self.table[known] = 1
        # beyond: blocks of letters as far as unicodedata tells; read once per worker
        for cp in range(0x3000, 0x33480):
            if unicodedata.category(chr(cp))[0] == "L":
                self.table[cp] = 1
        self.lower = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x20000):
            low = chr(cp).lower()
            if len(low) == 1:
                self.lower[cp] = ord(low)
        for k, c in enumerate(letters):
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.table[ord(form)] = k + 2

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a text; a run of non-letters is one 0."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[points]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        other = np.flatnonzero(s == 1) if self.spelt else s[:0]
        if not len(other):
            return s
        times = np.ones(len(s), np.int64)
        times[other] = DIGITS
        out = np.repeat(s, times)
        first = (np.cumsum(times) - times)[other]
        point = self.lower[points[keep][other]]
        for k in range(DIGITS):
            out[first + k] = self.digits + ((point >> np.uint32(DIGIT_BITS * (DIGITS - 1 - k))) & np.uint32((1 << DIGIT_BITS) - 1))
        return out


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of seq."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Texts:
    """Symbols of texts in blocks, for parsers of any languages: longest blocks first."""

    def __init__(self, texts: list[str], folding: Folding) -> None:
        seqs = [folding.symbols(t) for t in texts]
        self.n = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.lettered = np.fromiter((bool(s.any()) for s in seqs), bool, len(seqs))
        blocks = -(-self.n // BLOCK)
        owner = np.repeat(np.arange(len(seqs)), blocks)
        self.flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint8)
        first = np.repeat(np.cumsum(self.n) - self.n, blocks) + (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        size = np.minimum(BLOCK, np.repeat(np.cumsum(self.n), blocks) - first)
        order = np.argsort(-size, kind="stable")
        self.first, self.size, self.owner = first[order], size[order], owner[order]


class Parser:
    """The tables of a block of languages in one array of row offsets shifted left by one, with the phrase flag in the lowest bit."""

    kept: dict[str, tuple] = {}

    def __init__(self, sample: dict[str, list[str]], folding: Folding) -> None:
        self.langs = sorted(sample)
        a = folding.size
        tables, self.roots, lengths, base = [], [], [], 0
        for lang in self.langs:
            seq = np.concatenate([np.append(folding.symbols(t), np.uint8(0)) for t in sample[lang]])
            moves = suffix_automaton(seq.tolist())
            states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            symbols = np.fromiter((c for m in moves for c in m), np.int64, len(states))
            goals = np.fromiter((g for m in moves for g in m.values()), np.int64, len(states))
            # one more state, for a symbol that never occurs: a phrase of its own, which any next symbol ends
            literal = len(moves)
            restart = np.full(a, literal, np.int64)
            restart[symbols[states == 0]] = goals[states == 0]
            kind = np.int64 if (base + (len(moves) + 1) * a) * 2 > 2**31 - 2 else np.int32
            table = np.tile(((restart * a + base) * 2 + 1).astype(kind), (len(moves) + 1, 1))
            table[states, symbols] = (goals * a + base) * 2
            table[0] = (restart * a + base) * 2  # at the beginning no phrase ends
            tables.append(table.ravel())
            self.roots.append(base)
            lengths.append(len(seq))
            base += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.log_length = np.log2(np.maximum(lengths, 2)) if lengths else np.zeros(0)

    def phrases(self, texts: Texts) -> np.ndarray:
        """Phrases per language and text."""
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(texts.first), axis=1)
        count = np.ones((len(self.langs), len(texts.first)), np.int64)  # the last phrase of a block
        alive = len(texts.first)
        for t in range(int(texts.size[0]) if len(texts.size) else 0):
            alive = int(np.searchsorted(-texts.size[:alive], -t, "left"))
            move = self.table[state[:, :alive] + texts.flat[texts.first[:alive] + t]]
            count[:, :alive] += move & 1
            state[:, :alive] = move >> 1
        out = np.zeros((len(self.langs), len(texts.n)), np.int64)
        for k in range(len(self.langs)):
            out[k] = np.bincount(texts.owner, weights=count[k], minlength=len(texts.n))
        return out


class Learnt(NamedTuple):
    """Broadcast blocks of labelled texts by language, and the letters with symbols of their own."""

    blocks: list
    letters: str
    spelt: bool


def learn(docs: DataFrame, table_bytes: int = TABLE_BYTES, **sample) -> Learnt:
    """Blocks of languages. docs: lang, text, id. The driver holds one block at a time; broadcasts are files."""
    counts: dict[str, int] = {}
    blocks, held, size = [], {}, 0
    context = docs.sparkSession.sparkContext
    for lang, texts in labelled_sample(docs, **(SAMPLE | sample)):
        letters_of(texts, counts)
        # a table has fewer than two states for each symbol, each with a number of 4 bytes for each symbol of the alphabet
        needs = sum(map(len, texts)) * 8 * min(ALPHABET, len(counts) + 2) * (DIGITS if len(counts) > ALPHABET - 2 else 1)
        if held and size + needs > table_bytes:
            blocks.append(context.broadcast(held))
            held, size = {}, 0
        held[lang] = texts
        size += needs
    if held:
        blocks.append(context.broadcast(held))
    return Learnt(blocks, *frequent_letters(counts))


class Best:
    """Texts with their two lowest entropies so far."""

    def __init__(self, batch: pa.RecordBatch, folding: Folding) -> None:
        self.batch = batch
        self.texts = Texts([t or "" for t in batch.column("text").to_pylist()], folding)
        rows = batch.num_rows
        self.lang, self.low, self.second = np.full(rows, "und", object), np.full(rows, np.inf), np.full(rows, np.inf)

    def parse(self, parser: Parser) -> None:
        each = parser.phrases(self.texts) * parser.log_length[:, None] / np.maximum(self.texts.n, 1)
        for lang, bits in zip(parser.langs, each, strict=True):
            better = bits < self.low
            self.second = np.where(better, self.low, np.minimum(self.second, bits))
            self.low = np.where(better, bits, self.low)
            self.lang[better] = lang

    def result(self, keep: tuple[str, ...]) -> pa.RecordBatch:
        known = self.texts.lettered & np.isfinite(self.low)
        low, second = np.where(known, self.low, 0.0), np.where(known, self.second, 1.0)
        score = np.where(known, np.where(np.isfinite(second), 1 - low / np.maximum(second, 1e-12), 1.0), 0.0)
        lang = np.where(known, self.lang, "und")
        return pa.RecordBatch.from_arrays([*(self.batch.column(k) for k in keep), pa.array(lang, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(low)], names=[*keep, "lang_pred", "score", "entropy"])


def identify(docs: DataFrame, learnt: Learnt, keep: tuple[str, ...] = ("doc_id",), round_chars: int = ROUND_CHARS) -> DataFrame:
    """The kept columns, lang_pred, score, and entropy (bits per symbol against the winner). Only the text is looked at."""
    key, (blocks, letters, spelt) = uuid.uuid4().hex, learnt
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = slim.drop("text").schema.add("lang_pred", "string").add("score", "double").add("entropy", "double")

    def searched(held: list[Best], folding: Folding, only: Parser | None):
        for block in [] if only else blocks:
            parser = Parser(block.value, folding)
            block.__dict__.pop("_value", None)  # read again from the worker's disk for the next texts
            for x in held:
                x.parse(parser)
        for x in held:
            if only:
                x.parse(only)
            yield x.result(keep)

    def run(batches):
        if key not in Parser.kept:  # one per worker process and sample
            Parser.kept.clear()
            folding = Folding(letters, spelt)
            Parser.kept[key] = folding, Parser(blocks[0].value, folding) if len(blocks) == 1 else None
        folding, only = Parser.kept[key]
        held, size = [], 0
        for batch in tv.pieces(batches, most=3_000_000):
            held.append(Best(batch, folding))
            size += len(held[-1].texts.flat)
            if only or not blocks or size >= round_chars:
                yield from searched(held, folding, only)
                held, size = [], 0
        yield from searched(held, folding, only)

    return slim.mapInArrow(run, schema)


def predict(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", round_chars: int = ROUND_CHARS, **learning) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score, entropy; learnt from the labelled rows of training."""
    learnt = learn(training.select(F.col(id_column).cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), **learning)
    return identify(docs, learnt, round_chars=round_chars)
