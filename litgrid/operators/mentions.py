"""Mentions of many words at once: one automaton over a whole vocabulary reads each text a single time, however many words and mentions there are.

`mentions` says which words a text holds, `snippets` cuts their surroundings, and `index` is a table of mentions by place in the text: (key, word, begin, end), and (key, place, begin, end) for the
windows around names such as "Table 3". Joins of mentions with windows go by blocks of offsets (`within`), so that neither a text nor all mentions of one paper have to meet in one task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litgrid.functions.text import normalize, text

#: Characters of a block of offsets.
BLOCK = 4_096
#: Rows of the index that are handed on at once, of several short papers or of one.
OUT_ROWS = 10_000
#: Names of places whose surroundings are asked for; a place "table 1" is also mentioned by "table 12".
PLACES = r"table (\d+)"
FOUND = "struct<words:array<int>,firsts:array<int>,counts:array<int>,whole:array<int>>"


class Finder:
    """The automaton of a vocabulary, one per worker process. Words are found in lower case; mentions of one word don't overlap."""

    kept: dict[tuple, Finder] = {}

    def __init__(self, words: tuple[str, ...]) -> None:
        import ahocorasick

        self.sizes = [len(w) for w in words]
        numbers: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            numbers.setdefault(w.lower(), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, own in numbers.items():
            if w:
                self.automaton.add_word(w, (len(w), own))
        if len(self.automaton):
            self.automaton.make_automaton()

    @classmethod
    def of(cls, words: tuple[str, ...]) -> Finder:
        if words not in cls.kept:
            cls.kept[words] = cls(words)
        return cls.kept[words]

    def places(self, text: str) -> dict[int, list[int]]:
        """Where each word that the text holds begins."""
        found: dict[int, list[int]] = {}
        if text and len(self.automaton):
            for end, (size, own) in self.automaton.iter(text):
                begin = end + 1 - size
                before = found.get(own[0])
                if before is None:
                    for i in own:
                        found[i] = [begin]
                elif begin >= before[-1] + size:
                    for i in own:
                        found[i].append(begin)
        return found


def stands_alone(text: str, begin: int, end: int) -> bool:
    """Whether no letter, digit or underscore touches text[begin:end]."""
    inside = lambda c: c.isalnum() or c == "_"
    return not (begin and inside(text[begin - 1])) and not (end < len(text) and inside(text[end]))


def mentions(t: Column, words: list[str]) -> Column:
    """Of a lower-case text: the words' numbers in `words` (ascending), where each is first, how often, and the numbers of those that once stand alone. NULL holds none."""
    vocabulary = tuple(words)

    @F.arrow_udf(FOUND)
    def run(column: pa.Array) -> pa.Array:
        finder, rows = Finder.of(vocabulary), []
        for t in column.to_pylist():
            found = dict(sorted(finder.places(t or "").items()))
            whole = [i for i, at in found.items() if any(stands_alone(t, b, b + finder.sizes[i]) for b in at)]
            rows.append({"words": list(found), "firsts": [at[0] for at in found.values()], "counts": [len(at) for at in found.values()], "whole": whole})
        return pa.array(rows, pa.struct([(n, pa.list_(pa.int32())) for n in ("words", "firsts", "counts", "whole")]))

    return run(t)


def snippets(t: Column, words: list[str], window: int = 240, most: int = 8) -> Column:
    """Surroundings of the words' mentions, in order of words and places, distinct in their first 200 characters, the first `most`."""
    vocabulary = tuple(words)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, lows: pa.Array) -> pa.Array:
        finder, rows = Finder.of(vocabulary), []
        for t, low in zip(texts.to_pylist(), lows.to_pylist(), strict=True):
            found, kept = finder.places(low or ""), {}
            for i in sorted(found):
                for at in found[i]:
                    cut = around(t, at, finder.sizes[i], window)
                    kept.setdefault(cut[:200], cut)
                    if len(kept) == most:
                        break
                if len(kept) == most:
                    break
            rows.append(list(kept.values()))
        return pa.array(rows, pa.list_(pa.string()))

    return F.when(t.isNotNull(), run(t, F.lower(t)))


def around(t: str, at: int, size: int, window: int) -> str:
    return t[max(at - window, 0) : at + size + window].replace("\n", " ")


class Evidence(NamedTuple):
    """Whose surroundings to cut: the first of the words that the text (or, if normalised, the text with white space collapsed) holds."""

    words: tuple[str, ...]
    normalised: bool = False


def reading(body: Column, words: list[str], evidence: list[Evidence], window: int = 220) -> Column:
    """What a text says of a vocabulary, in one visit of Python: struct(words, whole, evidence). words, whole: as of `mentions`, of the normalised text; evidence: for each
    asked for the surroundings of the word's first mention in the text, blank without one."""
    vocabulary = tuple(words)
    asked = [([vocabulary.index(w) for w in e.words], e.normalised) for e in evidence]

    @F.arrow_udf("struct<words:array<int>,whole:array<int>,evidence:array<string>>")
    def run(bodies: pa.Array, flats: pa.Array, lows: pa.Array) -> pa.Array:
        finder, rows = Finder.of(vocabulary), []
        for body, flat, low in zip(bodies.to_pylist(), flats.to_pylist(), lows.to_pylist(), strict=True):
            found = finder.places(flat)
            raw = found if flat == low else finder.places(low)
            cut = []
            for numbers, normalised in asked:
                i = next((i for i in numbers if i in (found if normalised else raw)), None)
                cut.append(around(body, raw[i][0], finder.sizes[i], window) if i in raw else "")
            whole = [i for i, at in found.items() if any(stands_alone(flat, b, b + finder.sizes[i]) for b in at)]
            rows.append({"words": list(found), "whole": whole, "evidence": cut})
        return pa.array(rows, pa.struct([("words", pa.list_(pa.int32())), ("whole", pa.list_(pa.int32())), ("evidence", pa.list_(pa.string()))]))

    body = F.coalesce(text(body), F.lit(""))
    return run(body, normalize(body), F.lower(body))


class Said(NamedTuple):
    """A body and its reading, asked by words."""

    body: Column
    found: Column
    vocabulary: tuple[str, ...]
    asked: tuple[Evidence, ...] = ()

    def numbers(self, words: list[str]) -> Column:
        return F.array(*[F.lit(self.vocabulary.index(w)) for w in words])

    def any(self, words: list[str]) -> Column:
        return F.arrays_overlap(self.found["words"], self.numbers(words))

    def alone(self, words: list[str]) -> Column:
        """Whether one of the words is mentioned that no letter or digit touches."""
        return F.arrays_overlap(self.found["whole"], self.numbers(words))

    def first(self, words: list[str], normalised: bool = False) -> Column:
        return F.get(self.found["evidence"], F.lit(self.asked.index(Evidence(tuple(words), normalised))))


def section_texts(t: Column, aliases: dict[str, list[str]], longest: int = 70) -> Column:
    """[text of each section of aliases ..., all lines], blank if there is none: a short line that equals an alias opens its section. Lines before any stand in the last twice."""
    names, of_alias = [*aliases], {a: n for n, own in aliases.items() for a in own}

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        rows = []
        for t in column.to_pylist():
            parts, now = {n: [] for n in [*names, None]}, None
            for line in (t or "").split("\n"):
                line = line.strip()
                head = of_alias.get(" ".join(line.split()).lower()) if len(line) <= longest else None
                if head:
                    now = head
                elif line:
                    parts[now].append(line)
                    parts[None].append(line)
            rows.append(["\n".join(p) for p in parts.values()])
        return pa.array(rows, pa.list_(pa.string()))

    return run(t)


# --- the index -------------------------------------------------------------------------------------------------------------------------


def flattened(t: str) -> tuple[str, list[int], list[int]]:
    """A lower-case text with white space collapsed; where its words begin in it and in t."""
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", t)]
    flat_at, at = [], 0
    for _, w in words:
        flat_at.append(at)
        at += len(w) + 1
    return " ".join(w for _, w in words), flat_at, [b for b, _ in words]


def index(papers: DataFrame, key: str, body: str, words: list[str], places: str = PLACES, window: int = 1_200, most: int = 8) -> DataFrame:
    """(key, word, place, begin, end) of papers(key, body), read once per paper: mentions of the words in the normalised text, by offsets of the text itself, and the windows around the first
    mentions of each place (those that differ in their first 200 characters, at most `most` a place). Either word (its number) or place is null."""
    vocabulary, pattern = tuple(words), places

    def run(batches):
        finder = Finder.of(vocabulary)
        for batch in batches:
            keys, held, of = batch.column(key), [], []
            for i, (t, low) in enumerate(zip(batch.column("t").to_pylist(), batch.column("low").to_pylist(), strict=True)):
                rows = mention_rows(finder, low or "") + window_rows(t or "", low or "", pattern, window, most)
                held += rows
                of += [i] * len(rows)
                if len(held) >= OUT_ROWS:
                    yield packed(keys, held, of)
                    held, of = [], []
            if held:
                yield packed(keys, held, of)

    def packed(keys: pa.Array, rows: list[tuple], of: list[int]) -> pa.RecordBatch:
        word, place, begin, end = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(word, pa.int32()), pa.array(place, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=[key, "word", "place", "begin", "end"])

    kind = T.StructType([papers.schema[key], *T._parse_datatype_string("word int, place string, begin int, end int").fields])
    return papers.where(F.col(key).isNotNull()).select(key, text(body).alias("t"), F.lower(text(body)).alias("low")).mapInArrow(run, kind)


def mention_rows(finder: Finder, low: str) -> list[tuple]:
    flat, flat_at, at = flattened(low)

    def of(p: int) -> int:
        w = bisect_right(flat_at, p) - 1
        return at[w] + p - flat_at[w]

    return [(word, None, of(p), of(p + finder.sizes[word] - 1) + 1) for word, found in finder.places(flat).items() for p in found]


def window_rows(t: str, low: str, pattern: str, window: int, most: int) -> list[tuple]:
    kept: dict[str, dict[str, tuple[int, int]]] = {}
    for m in re.finditer(pattern, low):
        stem = low[m.start() : m.start(1)]
        for k in range(1, len(m[1]) + 1):
            own = kept.setdefault(stem + m[1][:k], {})
            if len(own) < most:
                begin, end = max(m.start() - window, 0), min(m.start(1) + k + window, len(low))
                own.setdefault(around(t, m.start(), m.start(1) + k - m.start(), window)[:200], (begin, end))
    return [(None, place, b, e) for place, own in kept.items() for b, e in own.values()]


def within(found: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, place, word, n): mentions of each word that lie wholly in a place's windows; one in several windows counts as often. A mention lies in one block of offsets, a window in a few."""
    windows = found.where("place is not null").select(key, "place", F.col("begin").alias("low"), F.col("end").alias("high"))
    dealt = windows.withColumn("block", F.explode(F.sequence((F.col("low") / block).cast("int"), (F.col("high") / block).cast("int"))))
    words = found.where("word is not null").select(key, "word", "begin", "end", (F.col("begin") / block).cast("int").alias("block"))
    both = dealt.join(words, [key, "block"]).where("begin >= low and end <= high")
    return both.groupBy(key, "place", "word").agg(F.count("*").alias("n"))
