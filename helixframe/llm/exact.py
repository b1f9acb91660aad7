"""Exact duplicates: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import SPACES, cut, text_or_empty


#: Hash groups of several rows up to this number (16 bytes each) are broadcast to select their texts.
BROADCAST_GROUPS = 500_000


def normalised(text: str = "text") -> Column:
    """The text that is compared: every run of white space is one blank; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def content_hash(norm: Column) -> Column:
    """128 bits in 16 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_groups(docs: DataFrame, hash128: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Hash groups come from a narrow table of digests. The texts of groups with several rows are grouped once more, by hash
    and bytes, with sums made before the exchange, so a group of any size costs one row a task. A hash group with two
    texts in it (a collision) falls apart there. Where there are more such groups than may be broadcast, all texts are
    grouped by bytes before the groups are selected.

    Null text is empty; empty texts equal one another. A null doc_id is larger than any other, and stays only where
    its group has no other; rows that repeat an id and text are one kept row and dropped ones. Other columns of docs
    are not read, whatever their names. Empty input gives an empty result.
    """
    norm = normalised()
    digest = cut(docs.select("doc_id", hash128(norm).alias("h"), F.sha2(norm.cast("binary"), 256).alias("text_sha256")))
    groups = cut(digest.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
    texts = docs.select(hash128(norm).alias("h"), norm.alias("norm"), "doc_id")
    sums = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    if groups.count() <= BROADCAST_GROUPS:
        texts = texts.join(F.broadcast(groups), "h", "left_semi").groupBy("h", "norm").agg(*sums)
    else:
        texts = texts.groupBy("h", "norm").agg(*sums).join(groups, "h", "left_semi")
    texts = texts.select("h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    again = Window.partitionBy("text_sha256", "doc_id").orderBy("h")
    return (
        digest.join(texts, ["h", "text_sha256"], "left")
        .withColumn("again", F.row_number().over(again))
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("again").eqNullSafe(1) & (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))).alias("kept"),
            "text_sha256",
        )
    )
