"""The identity of a walking topology: one 64-bit hash over all tiles and their neighbours, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The start and the factor of the 64-bit FNV-1a hash.
START, FACTOR = 14695981039346656037, 1099511628211


def fnv1a64(values: Iterator[int], state: int = START) -> int:
    """Hash of integers, each as eight bytes, low byte first (negative ones as their two's complement)."""
    for value in values:
        for byte in (value & (1 << 64) - 1).to_bytes(8, "little"):
            state = (state ^ byte) * FACTOR & (1 << 64) - 1
    return state


def walking_identity(tiles: DataFrame, steps: DataFrame) -> str:
    """``fnv1a64:`` and 16 hex digits over every tile in ascending order, followed by -1, its neighbours in order, and -2.

    Each byte's hash needs the one before, so the rows go through one task, as a sorted stream; neighbours are gathered side by side
    before. ``tiles(tile)`` and ``steps(s, d)`` between walkable tiles.
    """
    near = steps.groupBy(F.col("s").alias("tile")).agg(F.sort_array(F.collect_set("d")).alias("near"))  # at most eight
    rows = tiles.select("tile").distinct().join(near, "tile", "left").select("tile", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = START
        for frame in frames:
            for tile, around in zip(frame["tile"], frame["near"], strict=True):
                state = fnv1a64([int(tile), -1, *map(int, around), -2], state)
        yield pd.DataFrame({"identity": [f"fnv1a64:{state:016x}"]})

    return rows.coalesce(1).sortWithinPartitions("tile").mapInPandas(fold, "identity string").first()["identity"]
