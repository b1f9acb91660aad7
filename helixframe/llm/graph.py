"""Connected components of links between documents, without collecting links or components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, ship


#: Links up to this number (16 bytes each) are joined by one task; more take rounds.
ONE_TASK = 250_000


def union_find(batches):
    """Links of one partition, put as stars: each node with the smallest of those that it is joined to here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    stars = [(x, find(x)) for x in list(parent)]
    stars = np.array([s for s in stars if s[0] != s[1]], np.int64).reshape(-1, 2)
    for at in range(0, len(stars), 10_000):
        part = stars[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) to (doc_id, component): for each id in a link, the smallest id it can reach.

    Union-find joins what lies in one partition. If no more than ONE_TASK links are left, one task joins them all; else
    rounds of large-star and small-star do, with minima taken before the exchange, until nothing changes. The driver
    sees two numbers a round. A null id makes no link.
    """
    ship(links.sparkSession)
    schema = "u long, v long"
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v and u is not null and v is not null")
    now = cut(now.mapInArrow(union_find, schema))
    if now.count() <= ONE_TASK:
        now = cut(now.coalesce(1).mapInArrow(union_find, schema))
        return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        mark = seen
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        now = cut(small.union(least).mapInArrow(union_find, schema).distinct())
