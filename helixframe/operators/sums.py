"""Sums over rows where they lie: each partition adds up an array of numbers, and the arrays are added in two exchanges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Numbers of an array that one row holds, groups that partitions are dealt to in the first exchange, and rows worked on at a time.
CHUNK, LANES, ROWS = 1 << 15, 32, 512
PART = "at int, v binary"


def added(key: str):
    def go(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, "<f8") for v in rows.column("v").to_pylist()], axis=0)
        return pa.table({**{k: rows.column(k)[:1] for k in key.split()}, "v": pa.array([total.tobytes()], pa.binary())})

    return go


def summed(rows: DataFrame, contribution: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of the `size` numbers that contribution gives for some of them. No row gives zeros."""
    ship(rows.sparkSession)

    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                total += contribution(b.slice(at, ROWS))
        for at in range(0, size, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], names=["at", "v"])

    parts = rows.mapInArrow(partial, PART).withColumn("lane", F.spark_partition_id() % LANES)
    first = parts.groupBy("at", "lane").applyInArrow(added("at lane"), "at int, lane int, v binary")
    found = {r.at: r.v for r in first.select("at", "v").groupBy("at").applyInArrow(added("at"), PART).collect()}
    return np.concatenate([np.frombuffer(found[at], "<f8") if at in found else np.zeros(min(CHUNK, size - at)) for at in range(0, size, CHUNK)])
