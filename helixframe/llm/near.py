"""Near duplicates: SuperMinHash signatures, bands, verified links, and groups by union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .runtime import cut, ship, text_or_empty, written
from .superminhash import band_keys, signatures
from .textkernel import SPACED, U, binaries, distinct, mix, pieces, shingles, words

BANDS, ROWS = 32, 4
#: Slots, of BANDS * ROWS, that must agree before two full sets are compared. At the threshold of 0.8 the count has a
#: mean of 102 and a standard deviation under 4.6, so a link is lost here with a chance under 1e-6.
AGREE = 79
#: Bytes of text signed at a time: of each shingle in them all ranks are held.
SIGNED_BYTES = 1 << 18
#: Bits of a set's parity map, which bounds what two sets have in common.
MAP_BITS = 512
#: Sets that one shingle's list holds; of longer lists each pair of parts is a list of its own.
LIST = 1024
#: Pairs of one list compared at a time.
AT_ONCE = 1 << 19
#: Candidate ids up to this number (8 bytes each) are broadcast to select texts; more are joined by an exchange.
BROADCAST_IDS = 1_000_000


def set_digests(width: int):
    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text"), SIGNED_BYTES):
                elements, counts = distinct(*shingles(words(p, SPACED), width), len(p))
                sig = signatures(elements, counts, BANDS * ROWS)
                at = np.concatenate([[0], np.cumsum(counts)])
                sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(elements * U(k)))]) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
                own = [(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums]
                keys = band_keys(sig, ROWS).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(p.first, len(p)),
                        pa.array(counts),
                        *map(pa.array, own),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))),
                        binaries((sig * U(0xD6E8FEB86659FD93) >> U(48)).astype(np.uint16).reshape(-1), np.full(len(p), BANDS * ROWS)),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "keys", "sig"],
                )

    return scan


def full_sets(width: int):
    """doc_id, members: the set of each text as bytes."""

    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text"), SIGNED_BYTES):
                elements, counts = distinct(*shingles(words(p, SPACED), width), len(p))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(p.first, len(p)), binaries(elements, counts)], names=["doc_id", "members"])

    return scan


def listed_sets(width: int):
    """doc_id, n, members, parity: the set of each text as numbers, its size, and a map of the parities of their remainders."""

    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text"), SIGNED_BYTES):
                elements, counts = distinct(*shingles(words(p, SPACED), width), len(p))
                at = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
                maps = [np.packbits(np.bincount((elements[i:j] % U(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(p.first, len(p)), pa.array(counts.astype(np.int32)), lists, pa.array(maps, pa.binary())], names=["doc_id", "n", "members", "parity"])

    return scan


def close_pairs(per: int, of: int):
    """Pairs (a, b) of one list, of different components, whose sizes, places in the list and parity maps allow a link.

    Rows come sorted by list. Two maps differ in at least one element for each bit in which they do, and a link allows so
    many: so what can't be linked is passed over here and never becomes a row.
    """

    def compare(t: pa.Table):
        doc, component, n, at, part, first, last = (t.column(c).to_numpy() for c in ("doc_id", "component", "n", "at", "part", "x", "y"))
        maps = np.frombuffer(b"".join(t.column("parity").to_pylist()), U).reshape(len(doc), -1)
        key = np.stack([t.column("shingle").to_numpy(), first.astype(np.int64), last.astype(np.int64)])
        ends = np.append(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, len(doc))
        after = ends[np.searchsorted(ends, np.arange(len(doc)), "right")] - np.arange(len(doc)) - 1  # rows of the list behind each
        total = np.concatenate([[0], np.cumsum(after)])
        i = 0
        while i < len(doc):
            j = max(i + 1, int(np.searchsorted(total, total[i] + AT_ONCE, "right")) - 1)
            x = np.repeat(np.arange(i, j), after[i:j])
            y = x + 1 + np.arange(len(x)) - (total[x] - total[i])
            ok = (component[x] != component[y]) & ((first[x] == last[x]) | (part[x] != part[y]))
            ok &= np.minimum(n[x] - at[x], n[y] - at[y]) * (of + per) >= (n[x] + n[y]) * per
            x, y = x[ok], y[ok]
            differ = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
            ok = (n[x] + n[y] - differ) * (of + per) >= 2 * (n[x] + n[y]) * per
            x, y = x[ok], y[ok]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[x], doc[y])), pa.array(np.minimum(doc[x], doc[y]))], names=["a", "b"])
            i = j

    def go(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            own = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("shingle", "x", "y")])
            begins = np.flatnonzero((own != own[:, -1:]).any(axis=0))
            whole = int(begins[-1]) + 1 if len(begins) else 0  # the list that the last row is of may go on in the next batch
            if held and (whole or [held[-1].column(c)[-1].as_py() for c in ("shingle", "x", "y")] != own[:, 0].tolist()):
                yield from compare(pa.Table.from_batches([*held, b.slice(0, whole)]).combine_chunks())
                held = []
            elif whole:
                yield from compare(pa.Table.from_batches([b.slice(0, whole)]))
            held.append(b.slice(whole))
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    return go


def agreeing(batches):
    """Pairs whose signatures agree in AGREE slots or more."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
        yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def linked(per: int, of: int):
    """Pairs with of * intersection >= per * union."""

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("members_a"), b.column("members_b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), U) for z in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(of * common >= per * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def verified(pairs: DataFrame, digests: DataFrame, docs: DataFrame, width: int, per: int, of: int) -> DataFrame:
    """Links (u, v) among pairs (a, b): signatures first, then the full sets of what is left."""
    sig = digests.select("doc_id", "sig")
    near = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").mapInArrow(agreeing, "a long, b long").distinct()
    near = cut(near)
    ids = cut(near.select("a").union(near.select("b")).distinct().toDF("doc_id"))
    members = written(selected(docs, ids).mapInArrow(full_sets(width), "doc_id long, members binary"))
    sets = near.join(members.toDF("a", "members_a"), "a").join(members.toDF("b", "members_b"), "b")
    return cut(sets.mapInArrow(linked(per, of), "a long, b long").toDF("u", "v").distinct())


def selected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in ids, which are cut already."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def prefix_pairs(left: DataFrame, docs: DataFrame, width: int, per: int, of: int) -> DataFrame:
    """Pairs (a, b) of different components in left (doc_id, component) that may be linked; every link is among them.

    Shingles are ordered by how few of these documents have them. Linked sets share a shingle so early in both that
    enough is left behind it for the overlap a link needs. The documents of each shingle of those prefixes are a list, in
    which pairs are compared where they lie (close_pairs), so only those that stay become rows. A list of more than LIST
    documents is dealt into parts, and each two parts are compared in a place of their own. A document whose rare
    shingles are its own alone meets nothing.
    """
    sets = selected(docs, left.select("doc_id").distinct()).mapInArrow(listed_sets(width), "doc_id long, n int, members array<long>, parity binary")
    sets = written(left.join(sets, "doc_id").dropDuplicates(["doc_id", "members"]).withColumn("set", F.monotonically_increasing_id()))
    rows = sets.select("set", "n", F.explode("members").alias("shingle"))
    ranked = rows.join(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")), "shingle")
    ranked = ranked.withColumn("at", (F.row_number().over(Window.partitionBy("set").orderBy("often", "shingle")) - 1).cast("long"))
    prefix = ranked.filter((F.col("often") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * per / of))).select("set", "shingle", "often", "at")
    parts = F.ceil(F.col("often") / LIST).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    listed = prefix.join(sets.select("set", "doc_id", "component", F.col("n").cast("long").alias("n"), "parity"), "set").withColumn("parts", parts).withColumn("part", part)
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    listed = listed.select("shingle", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "doc_id", "component", "n", "at", "parity")
    together = listed.repartition("shingle", "x", "y").sortWithinPartitions("shingle", "x", "y")
    return together.mapInArrow(close_pairs(per, of), "a long, b long").distinct()


def near_components(docs: DataFrame, width: int = 5, per: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents whose shingle sets overlap.

    Words lie between white space, A-Z in lower case. A set holds the distinct runs of width words, or the whole sequence
    where a text has fewer; without words it is empty and linked with nothing. Two documents are linked if
    of * |intersection| >= per * |union|. component_id is the smallest doc_id that links reach, kept says it is the own.

    Equal sets are joined by their hash first, so copies take part once. Each band of a signature puts the others into
    buckets; a pair at the threshold shares one with a chance above 1 - 1e-7. In a bucket all are compared with one
    member, that of most weight in all its buckets, as the middle of a group of near copies has. Documents of buckets
    that this leaves in different groups are compared across groups, where an exact filter (prefix_pairs) can't exclude a
    link: pairs within a group can't change the outcome. So no link between groups is missed among documents that share
    buckets, and a large group of near copies costs one pair a member.

    Null text is empty. A null doc_id is linked with nothing: its component is null, it is kept. Rows that repeat an id
    count as one document, and each comes back. Other columns are not read. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    digests = written(docs.mapInArrow(set_digests(width), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, sig binary"))
    own = digests.filter("n_shingles > 0 and doc_id is not null")
    classes = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep <> last")
    copies = cut(own.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    reps = own.select("doc_id", "n_shingles", "keys").join(copies.select(F.col("u").alias("doc_id")), "doc_id", "left_anti")
    rows = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    members = cut(rows.join(buckets.filter("first <> last").select("key", "size"), "key").distinct())
    weight = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("minus"))).alias("p")).select("key", (-F.col("p.minus")).alias("pivot"))
    to_pivot = members.join(pivots, "key").filter("doc_id <> pivot").select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b")).distinct()
    to_pivot = cut(to_pivot)
    links = copies.union(verified(to_pivot, digests, docs, width, per, of))
    groups = cut(components(links))

    placed = members.join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).filter("c <> d").select("key")
    left = cut(placed.join(mixed, "key", "left_semi").select("doc_id", "component").distinct())
    rest = prefix_pairs(left, docs, width, per, of).join(to_pivot, ["a", "b"], "left_anti")
    more = verified(cut(rest), digests, docs, width, per, of)
    groups = components(groups.filter("doc_id <> component").toDF("u", "v").union(more))

    joined = digests.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
