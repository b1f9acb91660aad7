"""Order over a whole table: numbers, ranks with ties, and adjustment of p-values for their number.

A window over a whole table is one task. Here rows are range-partitioned and sorted, each counts within its partition, and
the counts of the partitions before it, which are few, are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.dist import CHI2_1_MEDIAN, chi2_1_isf
from ..functions.scalar import neglog10p
from ..runtime import cut, ship


def numbered(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """df with the number of each row, from 1, in an order that must be total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranked = cut(ranked.withColumns({"_part": F.shiftright("_m", 33).cast("int"), "_m": F.col("_m").bitwiseAND((1 << 33) - 1)}))
    before, bases = 0, []
    for part, n in sorted(ranked.groupBy("_part").count().collect()):  # a row a partition
        bases.append((part, before))
        before += n
    base = F.broadcast(df.sparkSession.createDataFrame(bases, "_part int, _base long"))
    return ranked.join(base, "_part").withColumn(name, F.col("_m") + F.col("_base") + 1).drop("_m", "_part", "_base")


def adjusted(df: DataFrame, p: str, *ties: str) -> DataFrame:
    """df with bonferroni and fdr_bh (Benjamini-Hochberg) of column p; null p has neither and doesn't count.

    ties: columns that with p make the order total. q is the least of p * m / rank from a row on; within partitions of the
    order it is a window, and the least of each later partition is carried over.
    """
    given = df.withColumn(p, F.nanvl(p, F.lit(None).cast("double")))
    known = numbered(given.filter(F.col(p).isNotNull()), p, *ties, name="_rank")
    m = known.count()
    block = F.floor(F.col("_rank") / F.lit(max(m // 200, 10_000)))
    raw = cut(known.withColumns({"_block": block, "_raw": F.col(p) * m / F.col("_rank")}))
    later, carried = 1.0, []
    for number, least in sorted(raw.groupBy("_block").agg(F.min("_raw")).collect(), reverse=True):  # about 200 rows
        carried.append((number, later))
        later = min(later, least)
    within = Window.partitionBy("_block").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    q = F.least(F.min("_raw").over(within), F.col("_later"), F.lit(1.0))
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, "_block long, _later double"))
    done = raw.join(carry, "_block").withColumns({"bonferroni": F.least(F.col(p) * m, F.lit(1.0)), "fdr_bh": q}).drop("_block", "_raw", "_rank", "_later")
    none = F.lit(None).cast("double")
    return done.unionByName(given.filter(F.col(p).isNull()).withColumns({"bonferroni": none, "fdr_bh": none}))


def running(df: DataFrame, value: str, order: str, *within: str, name: str = "before") -> DataFrame:
    """df with the sum of column value over the rows before each, in groups of columns within, by an order that is total there.

    Rows are range-partitioned; a window sums within a partition, and one over the sums of partitions carries them on.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *within, order).withColumn("_part", F.spark_partition_id()))
    to_here = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy(*within, "_part").agg(F.sum(value).alias(value))
    carried = sums.select(*within, "_part", to_here((Window.partitionBy(*within) if within else Window.partitionBy()).orderBy("_part")).alias("_carried"))  # a row a group and partition
    inside = ranged.withColumn("_inside", to_here(Window.partitionBy(*within, "_part").orderBy(order)))
    return inside.join(carried, [*within, "_part"]).withColumn(name, F.col("_inside") + F.col("_carried")).drop("_inside", "_carried", "_part")


def running_many(df: DataFrame, values: list[str], order: str) -> DataFrame:
    """df with before_<value>: the sums of several columns over the rows before each, by an order that is total."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    to_here = lambda v, w: F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    carried = F.broadcast(sums.select("_part", *(to_here(v, Window.partitionBy().orderBy("_part")).alias(f"_c_{v}") for v in values)))  # a row a partition
    inside = ranged.withColumns({f"_i_{v}": to_here(v, Window.partitionBy("_part").orderBy(order)) for v in values})
    return inside.join(carried, "_part").select(*df.columns, *((F.col(f"_i_{v}") + F.col(f"_c_{v}")).alias(f"before_{v}") for v in values))


def with_average_rank(df: DataFrame, value: str, *within: str, name: str = "avg_rank") -> DataFrame:
    """df with the mean rank of equal values in groups of columns within; null where the value is.

    Ranks come from counts of distinct values, so a group of any size is spread over tasks and equal values cost one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*within, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, "_n", value, *within, name="_before").select(*within, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranked, [*within, value], "left")


def qq_points(df: DataFrame, p: str, *ties: str) -> DataFrame:
    """expected and observed -log10 p of each known p."""
    known = numbered(df.filter(F.col(p).isNotNull() & ~F.isnan(p)), p, *ties, name="_rank")
    m = known.count()
    return known.withColumns({"expected": -F.log10((F.col("_rank") - 0.5) / F.lit(float(max(m, 1)))), "observed": neglog10p(F.col(p))}).drop("_rank")


def chi_square(df: DataFrame, p: str, name: str = "chi2") -> DataFrame:
    """df with the chi-square (1 df) that each p stands for."""
    ship(df.sparkSession)

    def add(batches):
        for b in batches:
            x = b.column(p).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(np.isnan(x), np.nan, chi2_1_isf(x)), from_pandas=True)], names=[*b.schema.names, name])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def inflation(df: DataFrame, p: str, *groups: str) -> DataFrame:
    """lambda: the median chi-square over its expectation, of known p; null where there are none."""
    known = chi_square(df.select(*groups, p).filter(F.col(p).isNotNull() & ~F.isnan(p)), p)
    return known.groupBy(*groups).agg((F.median("chi2") / CHI2_1_MEDIAN).alias("lambda"))


def empirical_p(null: str, observed: str, tail: str = "greater") -> Column:
    """An aggregate: (1 + draws as extreme as the observed) / (1 + draws), null without either."""
    if tail not in ("greater", "less"):
        raise ValueError("tail is greater or less")
    beyond = F.col(null) >= F.col(observed) if tail == "greater" else F.col(null) <= F.col(observed)
    return F.when((F.count(null) > 0) & (F.count(observed) > 0), (1.0 + F.count_if(beyond)) / (1.0 + F.count(null)))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the receiver operating curve: ties count a half; null if a class is absent.

    Sums over distinct scores in order, by partition.
    """
    by = cut(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    sums = running(by, "neg", score, name="below").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return sums.select(F.try_divide("u", F.col("pos").cast("double") * F.col("neg")).alias("auc"), F.coalesce("pos", F.lit(0)).alias("n_pos"), F.coalesce("neg", F.lit(0)).alias("n_neg"))
