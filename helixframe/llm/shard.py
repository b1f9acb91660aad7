"""Shards of near-equal size: weighted sampled splitters, range partitioning, and subdivision of overfull ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import LEAST, sampled_splitters, with_range
from .runtime import cut, text_or_empty

#: Ranges for each shard: each is a task of its own, and where a shard ends inside one, that range is divided.
RANGES_PER_SHARD = 64
#: A group of equal texts up to this part of a shard goes to one shard as a whole; larger groups are divided.
WHOLE_GROUP = 0.02
OVERHEAD = 8
#: Hash of the text, doc_id, and a number that tells rows apart that repeat both.
KEY = ["h", "k", "row"]


def assign_shards(docs: DataFrame, n_shards: int, law: str = "bytes", ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each row of docs goes.

    law "bytes": the sizes of shards are near equal (a row's size is the UTF-8 bytes of its text and 8); equal texts
    share a shard unless their group is large. law "rows": the counts are at most one apart. grown_shard is null in both.

    Rows are ordered by (hash of the text, doc_id). A sample with chances in proportion to size gives splitters of many
    more ranges than shards; exact totals of the ranges (one row a range) place them on the scale from 0 to the sum, and
    each row's place on that scale names its shard, so a range over the end of a shard is divided. A group of equal texts
    with a third of all rows takes many ranges, told apart by doc_id, and by row where rows repeat an id too. Law "bytes"
    divides no group of up to WHOLE_GROUP of a shard, and of larger ones only those that a shard ends in: n_shards - 1
    groups at most, whatever the number of groups.

    Null text counts as empty with size 8; a null doc_id sorts first. Rows repeated with one doc_id and text are all
    placed. Other columns are not read. Empty input gives an empty result.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"law is bytes or rows, not {law!r}")
    text = text_or_empty()
    digest = cut(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    rows, size = digest.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    mean = size / max(rows, 1)
    amount = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    whole = size if law == "bytes" else rows
    # Rows count as well as bytes, so that a range of very many empty texts is divided too.
    splitters = sampled_splitters(digest, KEY, F.col("size") + F.lit(mean), 2.0 * size, n_shards * ranges_per_shard)
    ranged = cut(with_range(digest, KEY, splitters))
    totals = sorted(ranged.groupBy("range_id").agg(F.sum(amount)).collect())  # a row a range
    before, starts = 0, []
    for range_id, total in totals:
        starts.append((range_id, before))
        before += total
    start = F.broadcast(digest.sparkSession.createDataFrame(starts, "range_id int, start long"))
    inside = Window.partitionBy("range_id").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range_id", "h")
    here = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    placed = ranged.withColumn("here", here)
    if law == "bytes":
        of_group = F.sum("size").over(group)
        middle = F.when(of_group <= WHOLE_GROUP * whole / n_shards, F.min("here").over(group) + of_group / 2).otherwise(F.col("here") + F.col("size") / 2)
    else:
        middle = F.col("here").cast("double")
    placed = placed.withColumn("middle", middle).join(start, "range_id")
    place = F.floor((F.col("start") + F.col("middle")) * n_shards / F.lit(float(max(whole, 1))))
    if law == "rows":
        place = F.floor((F.col("start") + F.col("here")) * n_shards / F.lit(max(whole, 1)))
    placed = placed.withColumn("shard", F.least(place, F.lit(n_shards - 1)).cast("int"))
    placed = cut(placed.withColumn("n", F.row_number().over(Window.partitionBy("range_id", "shard").orderBy(*KEY))).drop("here", "middle", "start"))
    counts = sorted(placed.groupBy("shard", "range_id").count().collect())
    bases, last, base = [], None, 0
    for shard, range_id, n in counts:
        base = 0 if shard != last else base
        bases.append((shard, range_id, base))
        last, base = shard, base + n
    base = F.broadcast(digest.sparkSession.createDataFrame(bases, "shard int, range_id int, base long"))
    return placed.join(base, ["shard", "range_id"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, n_shards: int, path: str, law: str = "bytes") -> None:
    """docs as one folder of Parquet files a shard, in the order of assign_shards. doc_id must be unique and not null."""
    where = assign_shards(docs, n_shards, law).select("doc_id", "shard", "slot")
    files = 4 * n_shards
    docs.join(where, "doc_id").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
