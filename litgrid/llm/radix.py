"""Dealing packed sorted keys into many groups in rounds.

A piece of text can't be cut into as many blobs as a large corpus needs groups: that number of blobs would grow with the square of the corpus.
So a round deals into at most `FAN` groups for each group of the round before; between rounds, blobs of a group are gathered into large
sorted runs again, by as many tasks as there are blobs to share. A group is a range of the keys' high bits throughout.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256
#: Keys gathered before they are dealt again.
RUN_KEYS = 2_000_000
MOST_TASKS = 20_000


def rounds(groups: int, fan: int = FAN) -> list[int]:
    """Numbers of groups of the rounds; the last is at least `groups`, each a multiple of the one before."""
    first, steps = max(1, groups), 0
    while first > fan:
        first, steps = -(-first // fan), steps + 1
    return [first * fan**k for k in range(steps + 1)]


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """A key's group by its high bits; sorted keys have sorted groups."""
    return (((keys >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)


def runs(keys: np.ndarray, groups: int) -> list[tuple[int, int, int]]:
    """(group, begin, end) of sorted keys."""
    grp = group_of(keys, groups)
    new = np.flatnonzero(np.append(True, grp[1:] != grp[:-1])) if len(grp) else np.zeros(0, np.int64)
    return list(zip(grp[new].tolist(), new.tolist(), [*new[1:].tolist(), len(grp)], strict=True))


def dealt(blobs: DataFrame, levels: list[int], again: Callable[[int], Callable], key_column: str = "keys") -> DataFrame:
    """blobs(grp, ...) of the first level's groups, dealt on to the last level and to the tasks that hold whole groups.

    again(groups) gives the Arrow function that gathers blobs and cuts them into that many groups."""
    before = levels[0]
    for groups in levels[1:]:
        # blobs of a group go to several tasks: gathering needs like keys, not all of them
        share = F.pmod(F.xxhash64(key_column), F.lit(16))
        blobs = blobs.repartition(int(min(16 * before, MOST_TASKS)), "grp", share).mapInArrow(again(groups), blobs.schema)
        before = groups
    return blobs.repartition(int(min(before, MOST_TASKS)), "grp")
