"""Pruning of correlated variants along chromosomes, in blocks that overlap, so that no task holds a chromosome's dosages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import cut, discard, ship, written
from .structure import squared_correlations, unit_rows, values_of, walked

#: Dosages of a block without its halo, rows of a block at most, rows that meet those before them at a time, and rows of a run.
CELLS, BLOCK, TILE, RUN = 1 << 22, 1 << 14, 256, 1 << 15


def in_order(features: DataFrame) -> DataFrame:
    """features with idx, the place of each on its chromosome from 0, by pos, variant and what they hold; kept as a table.

    Rows are range-partitioned and sorted once; a chromosome that lies in several partitions is counted on from the ones before.
    """
    spark = features.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["chrom", "pos", "variant", "_tie"]
    rows = features.select("chrom", "pos", "variant", "dosage", F.xxhash64("dosage").alias("_tie"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_part", F.shiftright("_at", 33).cast("int")).drop("_tie"))
    held = rows.groupBy("chrom", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row a chromosome and partition
    before = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select(F.col("chrom").alias("_c"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    out = rows.join(bases, F.col("chrom").eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p"))).select("chrom", "pos", "variant", "dosage", (F.col("_at") + F.col("_base")).alias("idx"))
    out._written_at = rows._written_at
    return out


def with_halo(rows: DataFrame, size: int, reach: int) -> DataFrame:
    """rows by _block (idx over size), and the last `reach` of each block once more in the next one."""
    own = F.floor(F.col("idx") / size)
    blocks = F.when(F.col("idx") % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("_block", F.explode(blocks))


def correlated(size: int, reach: int, limit: float, samples: int):
    """Of one block: whether each of its rows varies, and the rows before it within reach whose r2 with it is above limit."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx = t.column("idx").to_numpy()
        first = int(np.searchsorted(idx, t.column("_block")[0].as_py() * size))  # what lies before is halo
        unit, varies = unit_rows(values_of(t.column("dosage").combine_chunks(), samples))
        lists, sizes = [], []
        for at in range(first, len(idx), TILE):
            low, end = max(at - reach, 0), min(at + TILE, len(idx))
            r2 = (unit[at:end] @ unit[low:end].T) ** 2
            gap = np.arange(at, end)[:, None] - np.arange(low, end)[None, :]
            row, column = np.nonzero((r2 > limit) & (gap > 0) & (gap <= reach))
            lists.append(idx[low + column])
            sizes.append(np.bincount(row, minlength=end - at))
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
        near = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists) if lists else [], pa.int64()))
        kept = t.select(["chrom", "pos", "variant", "idx"]).slice(first)
        state = [(None if n else True) if v else False for v, n in zip(varies[first:].tolist(), np.diff(offsets).tolist(), strict=True)]
        return kept.append_column("near", near).append_column("kept", pa.array(state, pa.bool_()))

    return go


def settled(run: int):
    """Of one run: rows as they are, decided where the rows that they depend on are."""

    def go(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        idx, kept = t.column("idx").to_pylist(), t.column("kept").to_pylist()
        known = dict(zip(idx, kept, strict=True))
        for i, state, near in zip(idx, kept, t.column("near").to_pylist(), strict=True):
            if state is None and i >= t.column("_block")[0].as_py() * run:
                said = [known[j] for j in near]
                known[i] = False if True in said else None if None in said else True
        first = int(np.searchsorted(np.array(idx), t.column("_block")[0].as_py() * run))
        out = t.select(["chrom", "pos", "variant", "idx", "near"]).slice(first)
        return out.append_column("kept", pa.array([known[i] for i in idx[first:]], pa.bool_()))

    return go


def ld_prune(features: DataFrame, reach: int = 50, limit: float = 0.2) -> DataFrame:
    """chrom, variant, pos of features (chrom, pos, variant, dosage array) kept on a walk along each chromosome.

    In the order of pos (then variant), a feature goes if its r2 with one kept among the `reach` before it is above limit,
    or if it doesn't vary; missing dosages are at the mean. Features meet those before them in blocks with a halo of reach, which
    hold CELLS dosages (reach features at least). Of the walk only places are left: runs of them are decided side by side,
    and what waits for an earlier run is decided in the next round, so rounds are at most the runs of the longest
    chromosome. Repeated rows are features each; a null chromosome is one of its own, a null pos comes first; no rows give none.
    """
    if reach < 1:
        raise ValueError("reach is a number of features, one or more")
    ship(features.sparkSession)
    rows = in_order(features)
    one = rows.select(F.size("dosage")).first()
    samples = one[0] if one else 0
    size, run = max(reach, min(CELLS // max(samples, 1), BLOCK)), max(reach, RUN)
    fields = [*(T.StructField(c, rows.schema[c].dataType) for c in ("chrom", "pos", "variant")), T.StructField("idx", T.LongType()), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("kept", T.BooleanType())]
    blocks = with_halo(rows, size, reach).groupBy("chrom", "_block")
    walk = cut(blocks.applyInArrow(correlated(size, reach, limit, samples), T.StructType(fields)))
    discard(rows)
    while not walk.filter("kept is null").isEmpty():
        walk = cut(with_halo(walk, run, reach).groupBy("chrom", "_block").applyInArrow(settled(run), T.StructType(fields)))
    return walk.filter("kept").select("chrom", "variant", "pos")


def prune_samples(rows: DataFrame, places: list[tuple], reach: int = 50, limit: float = 0.2) -> DataFrame:
    """ld_prune of features that lie in sample rows (dosage, an array by feature), whose (chrom, pos, variant) places gives.

    For many samples and few features: r2 comes from squared_correlations, so no task holds a feature's samples.
    """
    if reach < 1:
        raise ValueError("reach is a number of features, one or more")
    spark = rows.sparkSession
    ship(spark)
    r2, kept = squared_correlations(rows), []
    for chrom in sorted({p[0] for p in places}):
        order = sorted((j for j, p in enumerate(places) if p[0] == chrom), key=lambda j: places[j][1:])
        kept += [places[j] for j in walked(r2, order, limit, reach)]
    return spark.createDataFrame([(c, v, p) for c, p, v in kept], "chrom string, variant string, pos long")


def clump_samples(rows: DataFrame, places: list[tuple], limit: float = 0.1) -> DataFrame:
    """structure.ld_clump of features that lie in sample rows, whose (gene_id, p, variant) places gives."""
    spark = rows.sparkSession
    ship(spark)
    r2, kept = squared_correlations(rows), []
    for gene in sorted({p[0] for p in places}):
        order = sorted((j for j, p in enumerate(places) if p[0] == gene), key=lambda j: places[j][1:])
        kept += [(gene, places[j][2]) for j in walked(r2, order, limit)]
    return spark.createDataFrame(kept, "gene_id int, variant string")
