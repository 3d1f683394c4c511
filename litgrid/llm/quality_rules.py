"""Quality rules on tokeniser fertility.

A public vocabulary's behaviour on a text tells prose from noise: characters per token, the share of tokens that fall back to
single bytes, and the entropy of the text's token distribution, held against what texts of that many tokens have. Each language has a band for the
three, and so has each script, for texts without a language; a text outside its band is rejected. Counting rules (too few words, too
many words in repeated three-word windows) come first.

Bands come from all documents, without labels: median and median deviation of the logarithm of characters per token and of the entropy's distance from the script's
curve over the number of tokens. The floors lie some deviations below the median (LIMITS). They are drawn toward the loose band BANDS (a language's entropy toward its script's) as if that were SHRINK or SCRIPT_SHRINK documents more,
so that a language of a few documents isn't its own measure. Labels, where given, move the numbers of deviations: those that reject the most junk and keep the most clean documents, of those that keep
LEAST_KEPT of the clean ones, weigh as much as the fewer of clean and junk labels against LABEL_SHRINK, first over all languages, then for each one. No number of documents or
labels turns anything on or off. A language or script of which most documents are noise is measured by that noise. At most `most_labels` labelled documents (those of the smallest hash) are used.

Words are encoded one by one, each distinct word once per worker; the measures are sums over a text's words. They are written once, as Parquet in the shared checkpoint folder; medians
come from counts of rounded values, so a language of any share of the documents is summed where its documents lie.

Cases: null and wordless texts have no words and fail the base rule; a text with fewer than LEAST_LETTERS letters a character (symbols,
digits, drawings) has script "none" and is rejected; letters of no known script are judged by the band "other"; texts of fewer than ENTROPY_TOKENS tokens are not judged by entropy; null languages are judged by script;
very long texts are a piece of their own; repeated rows give repeated results; extra columns are ignored and,
in `keep`, kept as they are.
"""

from __future__ import annotations

from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import at_place, by_place, named_again, stored
from .token_counts import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """chars per token from and to, most byte-fallback share, least entropy in bits (of texts with at least ENTROPY_TOKENS)."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


ENTROPY_TOKENS = 100
LEAST_LETTERS = 0.2
SCRIPTS = ("latin", "greek_cyrillic", "cjk", "other", "none")
BANDS = {
    "latin": Band(1.6, 8.0, 0.10, 3.0),
    "greek_cyrillic": Band(0.7, 8.0, 0.30, 3.0),
    "cjk": Band(0.25, 4.0, 0.90, 3.0),
    "other": Band(0.15, 8.0, 0.90, 2.5),
    "none": Band(np.inf, 0.0, 0.0, np.inf),
}
#: Deviations below the median at which the floors lie without labels (characters per token, entropy), and the least deviations.
LIMITS = (3.0, 2.5)
LEAST_SPREAD = (0.01, 0.03)
#: Documents that the wider band counts for against a language's and against a script's own (and SLOPE against a script's curve), labels that LIMITS count for.
SHRINK, SCRIPT_SHRINK, LABEL_SHRINK = 20, 5, 25
#: Bits that entropy grows by with each doubling of the tokens, before any document tells; tokens (powers of two) beyond which the curve is level, and its middle.
SLOPE, FROM, TO, MIDDLE = 0.35, 6.5, 14.0, 9.0
#: Rounded values in a unit, of which counts are kept: logarithm of characters per token, bits.
STEPS = (1000, 200)
MOST_LABELS = 20_000
LEAST_KEPT = 0.95
SEED = "bands-1"


def lead_classes() -> np.ndarray:
    """Per byte: the script (place in SCRIPTS) of the letters whose UTF-8 begins with it; 4 for what is no letter's first byte."""
    t = np.full(256, 4, np.int8)
    t[65:91] = t[97:123] = 0
    t[0xC3:0xCA] = 0
    t[0xCA:0xF5] = 3
    t[0xCD:0xD4] = 1
    t[0xE3:0xEE] = 2
    return t


def classes(data: np.ndarray) -> np.ndarray:
    """lead_classes of a text's bytes, but U+2000-2BFF and U+2E00-2FFF (punctuation, symbols, drawings) and U+1F000-1FFFF (pictures) are no letters."""
    out = lead_classes()[data]
    for lead, low, high in ((0xE2, 0x80, 0xAF), (0xE2, 0xB8, 0xBF), (0xF0, 0x9F, 0x9F)):
        at = np.flatnonzero(data[:-1] == lead)
        out[at[(data[at + 1] >= low) & (data[at + 1] <= high)]] = 4
    return out


class Pieces:
    """Token ids of words, each word encoded once."""

    kept: dict[str, Pieces] = {}
    MEMO_WORDS, MEMO_BYTES = 300_000, 64

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.memo: dict[bytes, bytes] = {}  # ids packed in 32 bits each

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all dictionary words, and where each word's begin (one more at the end)."""
        words, memo = words.to_pylist(), self.memo
        new = [w for w in words if w not in memo]
        fresh = {}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            fresh.update(zip(part, (array("i", x).tobytes() for x in self.model.encode([w.decode() for w in part], num_threads=1)), strict=True))
        ids = [memo[w] if w in memo else fresh[w] for w in words]
        if len(memo) + len(fresh) > self.MEMO_WORDS:
            memo.clear()
        memo.update((w, x) for w, x in fresh.items() if len(w) <= self.MEMO_BYTES)
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out=offsets[1:])
        return np.frombuffer(b"".join(ids), np.int32), offsets


def fertility(words: tv.Words, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: tokens, byte-fallback tokens, entropy of the token distribution in bits."""
    flat, starts = pieces.encode(words.words)
    lengths = np.diff(starts)
    per_word = lengths[words.codes]
    byte_words = tv.segments(pieces.is_byte[flat].astype(np.int64), starts) if len(flat) else np.zeros(len(lengths), np.int64)
    tokens = tv.segments(per_word, words.offsets)
    fallback = tv.segments(byte_words[words.codes], words.offsets)
    # the tokens of all texts, in order
    begin = starts[:-1][words.codes]
    ends = np.cumsum(per_word)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - per_word, per_word) + np.repeat(begin, per_word)
    owner = np.repeat(np.arange(len(tokens)), tokens)
    key = np.sort(owner * pieces.size + flat[at])
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    inner = np.bincount(key[new] // pieces.size, weights=count * np.log2(count), minlength=len(tokens)) if len(new) else np.zeros(len(tokens))
    n = np.maximum(tokens, 1)
    return tokens, fallback, np.maximum(np.log2(n) - inner / n, 0.0)


def repeated_words(words: tv.Words) -> np.ndarray:
    """Per text: words inside three-word windows that stand in it twice or more."""
    n, v = len(words.codes), len(words.words) + 1
    owner = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    if n < 3:
        return np.zeros(len(words.offsets) - 1, np.int64)
    inside = owner[2:] == owner[:-2]
    at = np.flatnonzero(inside)
    pair = np.unique(words.codes[at] * v + words.codes[at + 1], return_inverse=True)[1]
    triple = np.unique(pair * v + words.codes[at + 2], return_inverse=True)[1]
    key = owner[at] * (triple.max() + 1 if len(triple) else 1) + triple
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return tv.segments(hit, words.offsets)


def repeated_lines(column: pa.Array) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line."""
    lines = pc.split_pattern(column, "\n")
    offsets = lines.offsets.to_numpy().astype(np.int64)
    flat = lines.flatten()
    offsets = offsets - offsets[0]
    has = np.diff(tv.split_words(flat, lower=False).offsets) > 0
    coded = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = owner[has] * (len(flat) + 1) + coded[has]
    first = np.unique(key, return_index=True)[1]
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(owner[has][again], minlength=len(offsets) - 1).astype(np.int64)


def measured(column: pa.Array, pieces: Pieces) -> dict[str, np.ndarray]:
    """Counts and measures of texts."""
    data, offsets = tv.raw(column)
    words = tv.split_words(column, lower=False)
    white = tv.byte_table("space", False)[data] == 32
    chars = tv.segments(~white & ((data & 0xC0) != 0x80), offsets)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    n_words = np.diff(words.offsets)
    n_repeat = repeated_words(words)
    tokens, fallback, entropy = fertility(words, pieces)
    lead, none = classes(data), SCRIPTS.index("none")
    script = np.argmax(np.stack([tv.segments(lead == k, offsets) for k in range(none)]), axis=0)
    letters = tv.segments(lead < none, offsets)
    script = np.where((letters > 0) & (letters >= LEAST_LETTERS * chars), script, none)
    n = np.maximum(tokens, 1)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": tv.segments(symbol[data], offsets), "n_dup_lines": repeated_lines(column), "n_repeat_words": n_repeat,
        "base_failed": failed, "n_tokens": tokens, "chars_per_token": chars / n, "byte_share": fallback / n, "token_entropy": entropy, "script": np.array(SCRIPTS)[script],
    }


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, n_tokens bigint, chars_per_token double, byte_share double, token_entropy double, script string"


def with_measures(docs: DataFrame, text: str, vocabulary: str, *dropped: str) -> DataFrame:
    """docs with the measures of the texts in a column, without the columns dropped."""
    names = [f.split(" ")[0] for f in MEASURES.split(", ")]
    on = [c for c in docs.columns if c not in dropped]
    schema = docs.select(*on).schema
    for field in T.StructType.fromDDL(MEASURES):
        schema = schema.add(field)

    def run(batches):
        pieces = Pieces.of(tokenizer_path(vocabulary))
        for batch in tv.pieces(batches, text, most=2_000_000):
            found = measured(tv.texts(batch.column(text)), pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in on), *(pa.array(found[c]) for c in names)], names=[*on, *names])

    return docs.mapInArrow(run, schema)


def best_limits(clean: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """Deviations below the median, of both measures, that tell junk from clean best. clean, junk: rows of the two deviations."""
    best, found = -np.inf, None
    both = np.concatenate([clean, junk])
    steps = np.linspace(0, 1, 201)
    floors = [np.unique(np.append(np.quantile(both[:, k], steps), np.quantile(clean[:, k], np.linspace(0, 1 - LEAST_KEPT, 51)))) for k in (0, 1)]
    for chars in floors[0]:
        a, b = np.sort(clean[clean[:, 0] >= chars, 1]), np.sort(junk[junk[:, 0] >= chars, 1])
        kept = (len(a) - np.searchsorted(a, floors[1])) / len(clean)
        value = np.where(kept >= LEAST_KEPT, kept - (len(b) - np.searchsorted(b, floors[1])) / len(junk), -np.inf)
        if value.max() > best:
            best, found = value.max(), (float(chars), float(floors[1][value.argmax()]))
    return -np.array(found)


def drawn(limits: np.ndarray, clean: np.ndarray, junk: np.ndarray) -> np.ndarray:
    """limits, moved by labels as far as there are any of both kinds."""
    n = min(len(clean), len(junk))
    return (LABEL_SHRINK * limits + n * best_limits(clean, junk)) / (LABEL_SHRINK + n) if n else limits


def usable() -> Column:
    return ~F.col("base_failed") & (F.col("script") != "none") & (F.col("n_tokens") >= ENTROPY_TOKENS)


def doublings() -> Column:
    return F.least(F.greatest(F.log2(F.greatest("n_tokens", F.lit(1)).cast("double")), F.lit(FROM)), F.lit(TO)) - MIDDLE


def expected_entropy(found: DataFrame) -> Column:
    """Entropy over the number of tokens: one curve of second degree for each script, drawn to SLOPE where there are few texts."""
    x, y = doublings(), F.col("token_entropy") - SLOPE * doublings()
    sums = [F.sum(x**k).alias(f"x{k}") for k in range(5)] + [F.sum(y * x**k).alias(f"y{k}") for k in range(3)]
    curve = F.lit(0.0)
    for row in found.where(usable()).groupBy("script").agg(*sums).collect():  # at most one row for each of SCRIPTS
        left = np.array([[row[f"x{i + j}"] for j in range(3)] for i in range(3)]) + np.diag([0.0, SHRINK, SHRINK])
        a, b, c = np.linalg.solve(left, [row[f"y{k}"] for k in range(3)]).round(4).tolist()
        curve = F.when(F.col("script") == row["script"], a + (SLOPE + b) * x + c * x * x).otherwise(curve)
    return curve


def centres(found: DataFrame, curve: Column) -> DataFrame:
    """(script, lang, n, mid_chars, spread_chars, mid_entropy, spread_entropy) of each script (lang null) and of each language in it."""
    both = F.array(*[F.named_struct(F.lit("script"), F.col("script"), F.lit("lang"), lang, F.lit("whole"), F.lit(whole)) for lang, whole in ((F.lit(None).cast("string"), True), (F.col("lang"), False))])
    values = F.array(*[F.named_struct(F.lit("which"), F.lit(k), F.lit("bin"), F.floor(v * STEPS[k]).cast("int")) for k, v in enumerate((F.ln("chars_per_token"), F.col("token_entropy") - curve))])
    rows = found.where(usable()).select(F.explode(both).alias("g"), values.alias("values")).where("g.whole or g.lang is not null")
    counts = rows.select("g.script", "g.lang", F.explode("values").alias("v")).groupBy("script", "lang", "v.which", "v.bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("script", "lang", "which")
    middle = lambda by: F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col(by))).over(group)
    mid = counts.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bin"))}).withColumn("mid", middle("bin"))
    off = mid.withColumn("off", F.abs(F.col("bin") - F.col("mid"))).withColumn("upto", F.sum("n").over(group.orderBy("off"))).withColumn("dev", middle("off"))
    of = lambda k, c: F.max(F.when(F.col("which") == k, c))
    columns = [F.max("total").alias("n")]
    for k, name in enumerate(("chars", "entropy")):
        columns += [(of(k, F.col("mid")) / STEPS[k]).alias(f"mid_{name}"), F.greatest(1.4826 * of(k, F.col("dev")) / STEPS[k], F.lit(LEAST_SPREAD[k])).alias(f"spread_{name}")]
    return off.groupBy("script", "lang").agg(*columns)


MOST_GROUPS = 100_000


def joined(found: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """found with the columns of its language's or its script's group. Groups are broadcast up to MOST_GROUPS, else joined by shuffle (hot languages by AQE)."""
    named = groups.toDF(*[f"g_{c}" for c in groups.columns])
    return found.join(F.broadcast(named) if few else named, (F.col("script") == F.col("g_script")) & F.col("lang").eqNullSafe(F.col("g_lang")), "left")


def limits(found: DataFrame, groups: DataFrame, few: bool, curve: Column, labels: DataFrame, most_labels: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Deviations of the floors below the medians: in all, and by language. labels: doc_id, quality (1 clean, 0 junk); ids with both are left out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("quality"))
    ids = one.where(F.col("low") == F.col("quality")).drop("low").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most_labels)
    # rows of one id in found could be many: their number is bounded once more
    slim = found.where(usable()).select("doc_id", "script", "lang", "chars_per_token", "token_entropy", "n_tokens", curve.alias("curve")).join(F.broadcast(ids), "doc_id")
    marked = slim.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "lang", "chars_per_token", "token_entropy").limit(most_labels)
    deviations = [((F.ln("chars_per_token") - F.col("g_mid_chars")) / F.col("g_spread_chars")).alias("chars"), ((F.col("token_entropy") - F.col("curve") - F.col("g_mid_entropy")) / F.col("g_spread_entropy")).alias("entropy")]
    rows = joined(marked, groups, few).select("lang", "quality", *deviations).toPandas()
    parts = lambda x: [x.loc[x["quality"] == q, ["chars", "entropy"]].to_numpy() for q in (1, 0)]
    every = drawn(np.array(LIMITS), *parts(rows))
    return every, {lang: drawn(every, *parts(x)) for lang, x in rows.groupby("lang")}


def decided(found: DataFrame, labels: DataFrame | None = None, most_labels: int = MOST_LABELS) -> DataFrame:
    """found (doc_id, lang and measures) with chars_floor, entropy_floor and kept."""
    curve = expected_entropy(found)
    groups = stored(centres(found, curve))
    few = groups.count() <= MOST_GROUPS
    every, own = (np.array(LIMITS), {}) if labels is None else limits(found, groups, few, curve, labels, most_labels)
    spark = found.sparkSession
    # a row for each labelled language, so at most most_labels
    moved = spark.createDataFrame([(k, *v.tolist()) for k, v in own.items()], "l_lang string, l_chars double, l_entropy double")
    rows = joined(found, groups, few).join(F.broadcast(moved), F.col("lang") == F.col("l_lang"), "left")
    loose = lambda k: F.element_at(F.create_map(*[F.lit(x) for s, b in BANDS.items() for x in (s, float(b[k]))]), F.col("script"))
    n = F.coalesce("g_n", F.lit(0))
    own_floor = lambda name, k: F.coalesce(F.col(f"g_mid_{name}") - F.coalesce(f"l_{name}", F.lit(float(every[k]))) * F.col(f"g_spread_{name}"), F.lit(0.0))
    chars = F.exp((n * own_floor("chars", 0) + SHRINK * F.ln(loose(0))) / (n + SHRINK))
    # at most one row for each of SCRIPTS
    whole = groups.where("lang is null").select(F.col("script").alias("w_script"), F.col("n").alias("w_n"), (F.col("mid_entropy") - float(every[1]) * F.col("spread_entropy")).alias("w_floor"))
    rows = rows.join(F.broadcast(whole), F.col("script") == F.col("w_script"), "left")
    w = F.coalesce("w_n", F.lit(0))
    of_script = (w * (F.coalesce("w_floor", F.lit(0.0)) + curve) + SCRIPT_SHRINK * loose(3)) / (w + SCRIPT_SHRINK)
    entropy = (n * (own_floor("entropy", 1) + curve) + SHRINK * of_script) / (n + SHRINK)
    rows = rows.withColumns({"chars_floor": chars, "entropy_floor": entropy})
    within = (F.col("script") != "none") & F.col("chars_per_token").between(F.col("chars_floor"), loose(1)) & (F.col("byte_share") <= loose(2)) & ((F.col("token_entropy") >= F.col("entropy_floor")) | (F.col("n_tokens") < ENTROPY_TOKENS))
    return rows.withColumn("kept", ~F.col("base_failed") & within)


def measure(docs: DataFrame, labels: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, kept, the measures of fertility and the floors they were held against."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    found = stored(with_measures(slim, "text", vocabulary, "text"))
    counts = [f.split(" ")[0] for f in MEASURES.split(", ")]
    at = counts.index("n_tokens")
    return decided(found, labels).select("doc_id", *counts[:at], "kept", *counts[at:], "chars_floor", "entropy_floor")


def keep(docs: DataFrame, labels: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without the rejected documents; columns unchanged."""
    inner, at = by_place(docs), docs.columns.index("text")
    lang = at_place(docs, "lang") if "lang" in docs.columns else F.lit(None)
    ready = inner.withColumns({"doc_id": at_place(docs, "doc_id").cast("bigint"), "lang": lang.cast("string")})
    found = stored(with_measures(ready, f"c{at}", vocabulary))
    return named_again(decided(found, labels).where("kept"), docs)
