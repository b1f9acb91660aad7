"""Clusters of features that are correlated with the first of their kind, in rounds of first features."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, discard, ship, written
from .ranks import numbered
from .structure import squared_correlations, thinned, unit_rows, values_of

#: Values of the features that a round starts with, which the driver and every task hold; and results kept apart at most.
CELLS, APART = 1 << 21, 16


def firsts(unit: np.ndarray, limit: float) -> list[int]:
    """The rows, in order, that no first row before them has r2 of limit or more with; one that doesn't vary is always one."""
    return thinned(unit, np.ones(len(unit), bool), np.nextafter(limit, -1.0))


def assigned(starts: np.ndarray, unit: np.ndarray, base: int, samples: int, limit: float):
    """Rows with the cluster of the first start that they are correlated with; g is dropped where there is one."""

    def go(batches):
        for b in batches:
            idx = b.column("idx").to_numpy()
            hits = (unit_rows(values_of(b.column("g"), samples))[0] @ unit.T) ** 2 >= limit
            hits |= idx[:, None] == starts[None, :]
            has, at = hits.any(axis=1), hits.argmax(axis=1)
            g = pa.array([None if h else v for h, v in zip(has, b.column("g"), strict=True)], b.column("g").type)
            cluster, start = pa.array(base + at, pa.int64(), mask=~has), pa.array(starts[at], pa.int64(), mask=~has)
            yield pa.RecordBatch.from_arrays([b.column("feature_id"), pa.array(idx), g, cluster, start], names=["feature_id", "idx", "g", "cluster", "start"])

    return go


def clusters_of_samples(rows: DataFrame, names: list[str], limit: float = 0.95) -> DataFrame:
    """linkage_clusters of features that lie in sample rows (dosage, an array by feature), named and ordered as in names.

    For many samples and few features: r2 comes from squared_correlations, so samples stay where they are and are read once.
    """
    spark = rows.sparkSession
    ship(spark)
    r2, starts, out = squared_correlations(rows), [], []
    for j in range(len(r2)):
        hit = [i for i, s in enumerate(starts) if r2[s, j] >= limit]
        if not hit:
            starts.append(j)
        cluster = hit[0] if hit else len(starts) - 1
        out.append((names[j], cluster, names[starts[cluster]]))
    return spark.createDataFrame(out, "feature_id string, cluster long, first string")


def linkage_clusters(features: DataFrame, *order: str, limit: float = 0.95) -> DataFrame:
    """feature_id, cluster (from 0) and first (feature_id) of features (feature_id, g array<double>), by a total order (feature_id if none is given).

    A feature joins the first of those that began a cluster and have r2 of limit or more with it, else it begins one; missing
    values are at the mean, and a feature that doesn't vary is alone. A round takes the earliest features left, as many
    as hold CELLS values, finds among them those that begin clusters, and holds all that are left against these, where they lie.
    So there are no pairs of features, and rounds grow with the number of clusters at most. No rows give none.
    """
    spark = features.sparkSession
    ship(spark)
    rows = features.select("feature_id", "g", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    table = written(numbered(rows, *([f"_o{i}" for i in range(len(order))] or ["feature_id"]), name="idx").select("feature_id", "idx", "g"))
    one = table.select(F.size("g")).first()
    samples = one[0] if one else 0
    some = max(CELLS // max(samples, 1), 1)
    kinds = T.StructType([table.schema["feature_id"], T.StructField("idx", T.LongType()), table.schema["g"], T.StructField("cluster", T.LongType()), T.StructField("start", T.LongType())])
    left, base, parts = table, 0, []
    while True:
        head = left.select("idx", "g").orderBy("idx").limit(some).toArrow().combine_chunks()
        if not head.num_rows:
            break
        unit = unit_rows(values_of(head.column("g").combine_chunks(), samples))[0]
        chosen = firsts(unit, limit)
        starts = head.column("idx").to_numpy()[chosen]
        found = written(left.select("feature_id", "idx", "g").mapInArrow(assigned(starts, unit[chosen], base, samples, limit), kinds))
        parts.append(cut(found.filter("cluster is not null").drop("g")))
        if len(parts) == APART:
            parts = [cut(reduce(DataFrame.unionAll, parts))]
        discard(table)
        table, left, base = found, found.filter("cluster is null"), base + len(chosen)
    discard(table)
    if not parts:
        return features.limit(0).select("feature_id", F.lit(0).cast("long").alias("cluster"), F.col("feature_id").alias("first"))
    done = reduce(DataFrame.unionAll, parts)
    began = done.filter("idx = start").select("cluster", F.col("feature_id").alias("first"))
    return done.join(began, "cluster").select("feature_id", "cluster", "first")
