"""Vectorised text helpers over Arrow string columns.

Everything here works on one Arrow batch: the UTF-8 bytes of all its texts are one numpy
array, words become integer codes of a per-batch dictionary, and a document is a run of codes.
No Python object is made for a word unless it is new to the batch.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection of uint64 that spreads every input bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= M2
    h ^= h >> np.uint64(27)
    h *= M3
    h ^= h >> np.uint64(31)
    return h


def byte_table(split: str, lower: bool) -> np.ndarray:
    """A byte map: separators of ASCII become a space, A-Z lower case if asked, the rest stays.

    split: "space" for words [^\\x20\\x09-\\x0D]+, "alnum" for [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (after lower-casing).
    """
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    if split == "space":
        table[9:14] = 32
    else:
        c = table[:128]
        c[~(((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122)))] = 32
    return table


class Words(NamedTuple):
    """codes: a dictionary code per word of the batch; offsets: where each document's words begin (one more at the end);
    words: the dictionary, an Arrow binary array."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array


def texts(column) -> pa.Array:
    """One large_string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets that begin at 0."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def segments(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags over each segment; empty segments give 0."""
    sums = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bui" else np.float64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def split_words(column: pa.Array, split: str = "space", lower: bool = True) -> Words:
    data, offsets = raw(column)
    mapped = byte_table(split, lower)[data]
    inside = mapped != 32
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    starts = offsets[:-1][offsets[:-1] < len(mapped)]
    begin[starts] = inside[starts]  # a text's end ends a word
    values = mapped[inside]
    at = np.flatnonzero(begin)
    word_offsets = np.append(np.flatnonzero(begin[inside]), len(values)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(word_offsets), pa.py_buffer(values)])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(codes, np.searchsorted(at, offsets), coded.dictionary)


def trim() -> None:
    """Gives freed memory back: a worker that idles between stages should not hold on to what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches, column: str = "text", most: int = 3_000_000):
    """Record batches cut to about so many bytes of text each; a longer text is alone in its piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(texts(batch.column(column)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
        trim()


def distinct_per_text(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted by owner and value; owner must not decrease."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], owner[new]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each dictionary word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one run of word hashes; entry i is the window that begins at i.
    Windows that cross documents are made too; callers drop them."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * M1 + hashes[k : k + m] + np.uint64(k + 1))
    return out
