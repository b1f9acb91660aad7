"""Packing along a space-filling curve: documents in the order of a Hilbert key of their hashed vectors."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import LEAST, sampled_splitters, with_range
from .runtime import ship, text_or_empty, written
from .textkernel import U, binaries, mix, pieces
from .tokens import PIECE_BYTES, token_ids

LENGTH = 2048
END = 1
#: Place on the curve, doc_id, and a number that tells rows apart that repeat both.
KEY = ["key", "k", "row"]
#: Dimensions of the curve and bits of each: together under 63.
DIMS, BITS = 3, 16
#: A projected coordinate lies in [-1, 1]; those of real texts lie well inside this part of it.
SPREAD = 0.5
#: Tokens a range should have, and the most ranges: their totals and a sample of KEYS_PER_RANGE keys each are all that the driver holds.
RANGE_TOKENS, MOST_RANGES = 1 << 20, 50_000


def projected(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Each text's vector of hashed words and marks, projected at random to DIMS: the mean over them of a fixed random point."""
    counts = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    out = np.empty((n_docs, DIMS))
    for d in range(DIMS):
        point = (mix(hashes + U(d + 1)) >> U(11)).astype(np.float64) / 2.0**52 - 1
        out[:, d] = np.bincount(doc, weights=point, minlength=n_docs) / counts
    return out


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """The place on the Hilbert curve of each row of points, whole numbers below 2**BITS in DIMS columns (Skilling, 2004)."""
    x = points.astype(np.int64).T.copy()
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for d in range(DIMS):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] ^= np.where(high, p, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, DIMS):
        x[d] ^= x[d - 1]
    t, q = np.zeros_like(x[0]), 1 << (BITS - 1)
    while q > 1:
        t = np.where((x[DIMS - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for d in range(DIMS):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def curve_keys(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    at = np.clip(projected(hashes, doc, n_docs) / SPREAD, -1, 1)
    return hilbert_keys(np.floor((at + 1) / 2 * (2**BITS - 1) + 0.5))


def tokenised(definition: str, end: int):
    def scan(batches):
        tokenizer = token_ids(definition)
        for b in batches:
            for p in pieces(b.column("text"), PIECE_BYTES, lower=False):
                ids, counts, hashes, doc = tokenizer.piece(p)
                ids, n = np.insert(ids, np.cumsum(counts), end), counts + 1
                columns = [*(b.column(c).slice(p.first, len(p)) for c in ("doc_id", "k")), pa.array(curve_keys(hashes, doc, len(p))), pa.array(n), binaries(ids, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "key", "n", "ids"])

    return scan


def sequence_of(total: int, length: int):
    """The ends and numbers of the sequences that total tokens fill: full ones, then one for each power of two in the rest."""
    full, rest = divmod(total, length)
    ends = [full * length]
    for b in range(length.bit_length(), -1, -1):
        if rest >> b & 1:
            ends.append(ends[-1] + (1 << b))

    def at(pos: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds token pos."""
        if pos < full * length:
            i = pos // length
            return i, i * length, (i + 1) * length
        i = next(k for k in range(1, len(ends)) if pos < ends[k])
        return full + i - 1, ends[i - 1], ends[i]

    return at


def cut_pieces(starts: dict[int, int], total: int, length: int, kind: str, with_ids: bool):
    """Pieces of documents that come sorted within their ranges; starts: the tokens before each range."""

    def scan(batches):
        at, here, pos = sequence_of(total, length), None, 0
        for b in batches:
            rows: list[tuple] = []
            for doc, r, ids in zip(b.column("doc_id").to_pylist(), b.column("range_id").to_pylist(), b.column("ids"), strict=True):
                if r != here:
                    here, pos = r, starts[r]
                tokens = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                done = 0
                while done < len(tokens):
                    number, first, last = at(pos)
                    n = min(len(tokens) - done, last - pos)
                    own = tokens[done : done + n]
                    rows.append((doc, done, n, zlib.crc32(own.tobytes()), len(tokens), number, pos - first, *([own.tolist()] if with_ids else [])))
                    done, pos = done + n, pos + n
            for i in range(0, len(rows), 20_000):
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
                kinds = [b.schema.field("doc_id").type, *[pa.int64()] * 6, *([pa.list_(pa.int64())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000], strict=True), kinds, strict=True)], names=names)

    return scan


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for): one row a piece.

    tokenizer: the path of a tokenizers file, read by the driver. A document is its ids and end. Documents lie along the
    curve: their hashed vectors, projected to DIMS dimensions, give a Hilbert key, and rows are sorted by key, then
    doc_id. Sequences take the tokens along the curve, length each, cutting documents where a sequence ends; what is left
    at the end of the corpus goes into sequences of a power of two, so there is no padding at all.

    Sampled splitters weighted by tokens divide the curve into ranges, in each of which documents are streamed in order;
    the sums of tokens before each range are all that is shared. Copies have one key, and doc_id divides them, or the row
    where rows repeat an id too. Each range is a task, which spills what it sorts; past MOST_RANGES ranges grow.

    Null text is empty: one end token. A null doc_id sorts first. Repeated rows are packed each. Other columns are not
    read. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    definition = Path(tokenizer).read_text(encoding="utf-8")
    kind = token_ids(definition).kind.str
    given = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("k"), text_or_empty().alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    table = written(given.mapInArrow(tokenised(definition, end), f"doc_id {id_type}, k long, key long, n long, ids binary").withColumn("row", F.monotonically_increasing_id()))
    rows, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_ranges = int(min(max(total // RANGE_TOKENS, 1), MOST_RANGES))
    splitters = sampled_splitters(table, KEY, F.col("n") + F.lit(total / max(rows, 1)), 2.0 * total, n_ranges)
    totals = sorted(with_range(table.select(*KEY, "n"), KEY, splitters).groupBy("range_id").agg(F.sum("n")).collect())
    starts, before = {}, 0
    for range_id, n in totals:
        starts[range_id] = before
        before += n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_ranges)
    ordered = with_range(table, KEY, splitters).repartition(parts, "range_id").sortWithinPartitions("range_id", *KEY)
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    return ordered.mapInArrow(cut_pieces(starts, total, length, kind, with_ids), schema)
