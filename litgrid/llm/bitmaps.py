"""Bloom bitmaps built in segments by the executors and gathered, within a stated bound, for broadcast.

A well-mixed 64-bit key lives in one segment (by its high bits) and sets `PROBES` bits there (double hashing). Segments are built where
their keys are dealt to; the driver only joins finished segments, never keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut
from .textvec import mix

PROBES = 6
SEGMENT_BITS = 1 << 19  # 64 kB


def segments_for(keys: int, bits_per_key: float, most_bytes: int) -> int:
    """Segments of a bitmap for so many keys: in proportion to them, within the bound."""
    return int(min(max(1, -(-int(keys * bits_per_key) // SEGMENT_BITS)), max(1, most_bytes * 8 // SEGMENT_BITS)))


def segment_of(keys: np.ndarray, n_segments: int) -> np.ndarray:
    """A key's segment, by its high bits: keys in order have segments in order."""
    return (((keys >> np.uint64(32)) * np.uint64(n_segments)) >> np.uint64(32)).astype(np.int64)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """A key's bit places in its segment, a row per probe."""
    g = mix(keys + np.uint64(0x5851F42D4C957F2D))
    step = (g >> np.uint64(32)) | np.uint64(1)
    return np.stack([(g + np.uint64(k) * step) & np.uint64(SEGMENT_BITS - 1) for k in range(PROBES)]).astype(np.int64)


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


class Bitmap:
    """A gathered bitmap; `in` for arrays of keys."""

    def __init__(self, data: np.ndarray, n_segments: int) -> None:
        self.data, self.n_segments = data, n_segments

    def has(self, homes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether each key is there; homes: the keys that say which segment."""
        found = np.zeros(len(keys), bool)
        base = segment_of(homes, self.n_segments) * (SEGMENT_BITS // 8)
        g = mix(keys + np.uint64(0x5851F42D4C957F2D))
        step = (g >> np.uint64(32)) | np.uint64(1)
        alive = np.arange(len(keys))
        for k in range(PROBES):
            b = ((g[alive] + np.uint64(k) * step[alive]) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)
            alive = alive[(self.data[base[alive] + (b >> 3)] >> (b & 7).astype(np.uint8)) & 1 == 1]
        found[alive] = True
        return found


def gather(rows: DataFrame, n_segments: int) -> Bitmap:
    """rows(seg int, bits binary), one per segment that has keys. They are made in parallel first, then fetched one partition after the other."""
    data = np.zeros(n_segments * (SEGMENT_BITS // 8), np.uint8)
    size = SEGMENT_BITS // 8
    for seg, bits in cut(rows).toLocalIterator():
        data[seg * size : (seg + 1) * size] |= np.frombuffer(bits, np.uint8)
    return Bitmap(data, n_segments)


def of_keys(keys: DataFrame, n_segments: int) -> Bitmap:
    """keys(k bigint): the bitmap of their mix()."""

    def deal(batches):
        for batch in batches:
            k = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            k = np.unique(mix(k))
            segment = segment_of(k, n_segments)
            new = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(k) else np.zeros(0, np.int64)
            ends = np.append(new[1:], len(k))
            yield pa.RecordBatch.from_arrays([pa.array(segment[new], pa.int32()), pa.array([k[a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())], names=["seg", "blob"])

    def build(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(seg, np.zeros(SEGMENT_BITS, bool))[bits_of(np.frombuffer(blob, np.uint64)).ravel()] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pack(b) for b in held.values()], pa.binary())], names=["seg", "bits"])

    dealt = keys.mapInArrow(deal, "seg int, blob binary").repartition(max(1, min(n_segments, 64)), "seg")
    return gather(dealt.mapInArrow(build, "seg int, bits binary"), n_segments)
