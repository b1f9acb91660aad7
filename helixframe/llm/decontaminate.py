"""Benchmark passages in documents: a prefix-filtered join of rare shingles, verified over item-sized windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut, ship, text_or_empty, written
from .textkernel import ALNUM, pieces, shingles, words

WINDOW = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: Bits of the filter of shingles that the benchmark has: at least BITS_EACH for each, within these powers of two.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 27

RUN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("run", T.StringType()), T.StructField("grams", T.ArrayType(T.LongType()))])


def benchmark_windows(window: int):
    """Each window of each item: its words, and the hashes of its shingles in order."""

    def scan(batches):
        for b in batches:
            ids = b.column("item_id")
            for p in pieces(b.column("text")):
                w = words(p, ALNUM)
                grams, doc = shingles(w, SHINGLE)
                where = np.searchsorted(doc, np.arange(len(p) + 1))
                out: list[tuple] = []
                for i in range(len(p)):
                    first, last = w.bounds[i], w.bounds[i + 1]
                    own = [p.data[a:e].tobytes().decode("utf-8", "replace") for a, e in zip(w.starts[first:last], w.ends[first:last], strict=True)]
                    hashes = grams[where[i] : where[i + 1]].view(np.int64).tolist()
                    n = min(len(own), window)
                    item = ids[p.first + i].as_py()
                    out += [(item, " ".join(own[s : s + n]), hashes[s : s + max(1, n - SHINGLE + 1)]) for s in range(len(own) - n + 1) if n]
                for at in range(0, len(out), 2000):
                    part = out[at : at + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.list_(pa.int64()))], names=["item", "window", "grams"])

    return scan


def matching_runs(bits: np.ndarray, least: dict[int, int]):
    """Of each document its number of words and the runs of words whose shingles may all be in the benchmark.

    least: for each number of words of a shingle, the shingles that its shortest window has; shorter runs hold no window.
    """
    mask = np.uint64(len(bits) * 64 - 1)

    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text")):
                w = words(p, ALNUM)
                runs: list[list[dict]] = [[] for _ in range(len(p))]
                for width, shortest in least.items():
                    grams, doc = shingles(w, width)
                    if not len(grams):
                        continue
                    at = grams & mask
                    found = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    hit = np.flatnonzero(found)
                    if not len(hit):
                        continue
                    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (doc[hit[1:]] != doc[hit[:-1]])])
                    firsts = np.flatnonzero(new)
                    for s, e in zip(firsts, [*firsts[1:], len(hit)], strict=True):
                        if e - s < shortest:
                            continue
                        i = int(doc[hit[s]])
                        start = int(hit[s]) - int(np.searchsorted(doc, i))
                        a = w.bounds[i] + start
                        z = min(a + (e - s) + width - 1, w.bounds[i + 1])
                        text = " ".join(p.data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.starts[a:z], w.ends[a:z], strict=True))
                        runs[i].append({"start": start, "run": text, "grams": grams[hit[s] : hit[s] + e - s].view(np.int64).tolist()})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("run", pa.string()), ("grams", pa.list_(pa.int64()))]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(p.first, len(p)), pa.array(w.counts), pa.array(runs, kind)], names=["doc_id", "n_words", "runs"])

    return scan


def shingle_filter(grams: DataFrame) -> np.ndarray:
    """A bit for each value that a shingle's hash ends in; its size is bounded by MOST_BITS, whatever the benchmark's."""
    n = grams.agg(F.approx_count_distinct("gram")).first()[0]
    size = min(max(int(np.ceil(np.log2(max(n, 1) * BITS_EACH))), LEAST_BITS), MOST_BITS)
    bit = F.col("gram").bitwiseAND((1 << size) - 1)
    slots = grams.select(F.shiftright(bit, 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit"))
    bits = np.zeros(1 << (size - 6), np.uint64)
    for slot, value in slots.toLocalIterator():
        bits[slot] = np.uint64(value & (2**64 - 1))
    return bits


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: benchmark windows found in each document.

    Words are of digits, letters and all that isn't ASCII, A-Z in lower case. A window is a run of window words of an
    item, or a whole item of fewer. A document word in any occurrence of a window is hit.

    One pass over the documents keeps the runs of words whose shingles are all in a bit filter of the benchmark and that
    are long enough for a window. Equal runs are then one. Shingles are ordered by how often they occur in the runs of
    all documents; of each window the rarest is its prefix (containment is whole, so one is necessary), and joins the
    runs. Candidates that would leave the run are dropped, the others are compared word by word. A passage in very many
    documents is verified once, and its rows meet the outcome in a join that Spark may split.

    Null text has no words; a null item_id counts for hits and not as an item. Repeated rows come back each; items
    repeated under one id are one. Other columns are not read. Empty tables: no rows, or no hits.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    windows = cut(items.mapInArrow(benchmark_windows(window), "item string, window string, grams array<long>").distinct())
    lengths = F.size(F.split("window", " "))
    least = {r[0]: r[1] for r in windows.groupBy(F.least(lengths, F.lit(SHINGLE)).alias("width")).agg(F.min(F.size("grams"))).collect()}
    bits = shingle_filter(windows.select(F.explode("grams").alias("gram")))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    schema = T.StructType([texts.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN))])
    scanned = written(texts.mapInArrow(matching_runs(bits, least), schema).withColumn("row", F.monotonically_increasing_id()))

    runs = scanned.select("row", F.explode("runs").alias("r")).select("row", "r.*")
    unique = cut(runs.groupBy("run", "grams").agg(F.count(F.lit(1)).alias("copies")))
    shingle = unique.select("run", "copies", F.posexplode("grams").alias("at", "gram"))
    often = shingle.groupBy("gram").agg(F.sum("copies").alias("copies"))
    distinct = windows.select("window", "grams").distinct()
    prefix = (
        distinct.select("window", F.posexplode("grams").alias("offset", "gram"))
        .join(often, "gram", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("copies", F.lit(0)).alias("copies"), "gram", "offset")).alias("p"))
        .filter("p.copies > 0")
        .select("window", "p.gram", "p.offset")
    )
    n = F.size(F.split("window", " "))
    found = (
        shingle.select("run", "at", "gram")
        .join(prefix, "gram")
        .withColumn("s", F.col("at") - F.col("offset"))
        .filter((F.col("s") >= 0) & (F.col("s") + n <= F.size(F.split("run", " "))))
        .filter(F.slice(F.split("run", " "), F.col("s") + 1, n) == F.split("window", " "))
        .select("run", "s", "window", n.alias("n"))
        .distinct()
    )
    found = cut(found)
    places = found.select("run", F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("place")).distinct().groupBy("run").agg(F.collect_list("place").alias("places"))
    named = found.join(windows.select("window", "item"), "window").select("run", "item").distinct().groupBy("run").agg(F.collect_list("item").alias("items"))
    of_run = places.join(named, "run")
    hits = (
        runs.select("row", "start", "run")
        .join(of_run, "run")
        .select("row", F.transform("places", lambda x: x + F.col("start")).alias("places"), "items")
        .groupBy("row")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(hits, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_hit"),
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
            F.col("places").isNotNull().alias("contaminated"),
        )
    )
