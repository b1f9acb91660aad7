"""Ranges of about equal weight over a key of several parts, from a weighted sample of keys."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import ship

#: Sampled keys for each range; a range is off its share by about 1 / sqrt(this).
KEYS_PER_RANGE = 24
LEAST = -(2**63)


@dataclass(frozen=True)
class Splitters:
    """Upper ends, exclusive, of all ranges but the last: rows of a table with a column for each part of the key."""

    ends: np.ndarray

    def of(self, *key: np.ndarray) -> np.ndarray:
        """The number of the range of each key: how many splitters are at most the key."""
        return self.place(key, 0, len(self.ends), 0)

    def place(self, key: tuple[np.ndarray, ...], first: int, last: int, part: int) -> np.ndarray:
        """The same among the splitters first to last - 1, which agree in the parts before this one."""
        own = self.ends[first:last, part]
        low, high = np.searchsorted(own, key[part], "left"), np.searchsorted(own, key[part], "right")
        if part + 1 == self.ends.shape[1]:
            return high + first
        out = low + first
        for i in np.unique(low[low < high]):
            rows = np.flatnonzero((low == i) & (low < high))
            end = int(np.searchsorted(own, own[i], "right"))
            out[rows] = self.place(tuple(k[rows] for k in key), first + int(i), first + end, part + 1)
        return out


def sampled_splitters(df: DataFrame, key: list[str], weight: Column, total: float, n_ranges: int) -> Splitters:
    """Draw each row with a chance in proportion to its weight and cut the sorted sample at its weighted quantiles.

    key: long columns without nulls, of which the last tells apart rows that repeat the others. The draw is decided by a
    hash of the key, so a task that runs again draws the same rows. The driver gets about KEYS_PER_RANGE keys a range,
    whatever the size of df. A value of the first part that takes two splitters or more is a large group, which the other
    parts divide; any other splitter stands at the edge of its group.
    """
    n = n_ranges * KEYS_PER_RANGE
    share = F.greatest(weight.cast("double") / F.lit(float(max(total, 1e-9))), F.lit(1.0 / n))
    u = (F.pmod(F.xxhash64(*key, F.lit(20_11)), F.lit(1 << 30)).cast("double") + 0.5) / float(1 << 30)
    rows = df.select(*key, weight.cast("double").alias("w"), share.alias("s")).filter(u < F.col("w") / float(max(total, 1e-9)) * n).select(*key, "s").collect()
    if not rows:
        return Splitters(np.empty((0, len(key)), np.int64))
    keys = sorted(map(tuple, rows))
    at = np.cumsum([k[-1] for k in keys])
    cuts = sorted({keys[i][:-1] for i in np.minimum(np.searchsorted(at, at[-1] * np.arange(1, n_ranges) / n_ranges), len(keys) - 1)})
    ends = np.array(cuts, np.int64).reshape(len(cuts), len(key))
    alone = np.ones(len(ends), bool)
    alone[1:] &= ends[1:, 0] != ends[:-1, 0]
    alone[:-1] &= ends[:-1, 0] != ends[1:, 0]
    ends[alone, 1:] = LEAST
    return Splitters(ends)


def with_range(df: DataFrame, key: list[str], splitters: Splitters, name: str = "range_id") -> DataFrame:
    """df and the number of the range of each row."""
    ship(df.sparkSession)

    def add(batches):
        for b in batches:
            found = splitters.of(*(b.column(k).to_numpy(zero_copy_only=False) for k in key))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.astype(np.int32))], names=[*b.schema.names, name])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))
