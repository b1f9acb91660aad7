"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import cut, text_or_empty

#: Parts that a line is cut into: one edit leaves all but one of them alone.
SEGMENTS = 3
#: Keys of 8 bytes, up to this number, are broadcast to select lines; more are joined by an exchange.
BROADCAST_KEYS = 2_000_000


def numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, n_chars, h1, h2: lines that are not blank."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    return rows.withColumns({"n_chars": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def bound(n: Column, j: int) -> Column:
    return F.floor(n * j / SEGMENTS).cast("int")


def part_keys(line: Column, n_chars: Column) -> Column:
    """What stands around each segment, as a line of its own length (extra 0) and as one that a shorter line gains a character to be (extra 1).

    Two lines within one edit agree in a key: all lies in one segment that they differ in, at the shorter one's bounds.
    """
    made = []
    for extra in (0, 1):
        n = n_chars - extra
        for j in range(SEGMENTS):
            head, tail = bound(n, j), n - bound(n, j + 1)
            around = F.xxhash64(n, F.lit(j), F.left(line, head), F.right(line, tail))
            made.append(F.struct(around.alias("key"), F.lit(extra).alias("extra"), (head + 1).alias("start"), (n_chars - head - tail).alias("size")))
    return F.array(*made)


def duplicate_lines(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """doc_id, line_no, n_chars, first_doc_id, first_line_no, match, kept: one row for each line that isn't blank.

    Lines stand between line feeds, are counted from 0, and are compared as they are. first_ is the earliest place, by
    (doc_id, line_no), of a line within max_edits (0 or 1) characters put in, taken out or replaced; match is "exact" if
    the text there is the same, "near" if not, null if it is the line's own place. kept says it is the own place.

    Equal lines become one by two 64-bit hashes. Of a line, its surroundings of each of SEGMENTS segments are hashed;
    only where two different lines share one are variants made: the segment as it is and with each character deleted,
    hashed with the surroundings. Lines whose variants are equal at one place differ in that character alone, so each is
    compared with the earliest of its group; a whole segment and a variant equal to it are an insertion, compared both
    ways with the earliest of the other side. Each comparison is confirmed by edit distance. A group of equal lines of
    any size takes part once, and no pairs are made within groups.

    Null text has no lines; a null doc_id sorts first. Rows that repeat a doc_id share its places. Other columns are not
    read. Empty input gives an empty result.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    lines = numbered_lines(docs.select("doc_id", "text"))
    place = F.struct("doc_id", "line_no", "h1", "h2")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    if max_edits:
        near = cut(near_lines(lines, place))
        firsts = firsts.join(near, ["h1", "h2"], "left")
        firsts = firsts.select("h1", "h2", F.coalesce(F.least("near", "first"), "first").alias("first"), (F.col("near") < F.col("first")).alias("is_near"))
    else:
        firsts = firsts.withColumn("is_near", F.lit(False))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    match = F.when(F.coalesce("is_near", F.lit(False)), "near").when(~own, "exact")
    return lines.select("doc_id", "line_no", "n_chars", "h1", "h2").join(firsts, ["h1", "h2"]).select(
        "doc_id", "line_no", "n_chars", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), match.alias("match"), own.alias("kept")
    )


def near_lines(lines: DataFrame, place: Column) -> DataFrame:
    """h1, h2, near: the earliest place of another line within one edit, where that is earlier than the line's own first."""
    keyed = lines.withColumn("k", F.explode(part_keys(F.col("line"), F.col("n_chars"))))
    shared = keyed.groupBy("k.key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    shared = cut(shared)
    few = shared.count() <= BROADCAST_KEYS
    near = keyed.withColumn("key", F.col("k.key")).join(F.broadcast(shared) if few else shared, "key", "left_semi")
    near = near.groupBy("key", "h1", "h2", "k.extra").agg(F.min(place).alias("first"), F.first("line").alias("line"), F.first("k.start").alias("start"), F.first("k.size").alias("size"))
    near = cut(near)
    middle = F.col("line").substr(F.col("start"), F.col("size"))

    def variant(i: Column) -> Column:
        return F.concat(F.left(middle, i - 1), F.right(middle, F.col("size") - i))

    at = F.when(F.col("size") > 0, F.sequence(F.lit(1), "size")).otherwise(F.array().cast("array<int>"))
    replaced = F.transform(at, lambda i: F.struct(F.lit(0).alias("side"), F.xxhash64("key", i, variant(i)).alias("v")))
    whole = F.array(F.struct(F.lit(1).alias("side"), F.xxhash64("key", F.lit("+"), middle).alias("v")))
    gained = F.transform(at, lambda i: F.struct(F.lit(2).alias("side"), F.xxhash64("key", F.lit("+"), variant(i)).alias("v")))
    variants = near.select("h1", "h2", "first", F.explode(F.when(F.col("extra") == 0, F.concat(replaced, whole)).otherwise(gained)).alias("x")).select("h1", "h2", "first", "x.*").distinct()
    group = Window.partitionBy("v")
    earliest = lambda side: F.min(F.when(F.col("side") == side, F.col("first"))).over(group)
    other = F.when(F.col("side") == 0, earliest(0)).when(F.col("side") == 1, earliest(2)).otherwise(earliest(1))
    pairs = variants.withColumn("other", other).filter((F.col("other") < F.col("first")) & ((F.col("other.h1") != F.col("h1")) | (F.col("other.h2") != F.col("h2"))))
    pairs = cut(pairs.select("h1", "h2", "other").distinct())
    texts = near.groupBy("h1", "h2").agg(F.first("line").alias("line"))
    both = pairs.join(texts, ["h1", "h2"]).withColumnsRenamed({"h1": "a1", "h2": "a2", "line": "a"}).withColumns({"h1": F.col("other.h1"), "h2": F.col("other.h2")}).join(texts, ["h1", "h2"])
    confirmed = both.filter(F.levenshtein("a", "line", 1).between(0, 1))
    return confirmed.groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.min(F.struct("other.doc_id", "other.line_no")).alias("near"))


def without_duplicate_lines(docs: DataFrame, max_edits: int = 1) -> DataFrame:
    """docs with only the kept lines of each text, and blank lines as they were. doc_id must be unique and not null."""
    gone = duplicate_lines(docs, max_edits).filter("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone_lines"))
    joined = docs.join(gone, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("gone_lines", i)), "\n")
    return joined.withColumn("text", F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(kept)).drop("gone_lines").select(*docs.columns)
