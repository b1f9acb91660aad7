"""How the sources of a language differ in their terms: runs of sorted terms, counted as they pass by.

A task sorts the words of its documents by language, term, source and document; a scan over the runs of that order gives
each term of a source its documents and its occurrences, so what is exchanged has one row for each term and source of a
task, however often they occur. These rows are dealt by language and term and sorted by language, term and source; a
second scan adds up the runs of a term, whose documents decide whether the term is kept. The runs of kept terms are then
compared: each gives a part of every pair of sources and the terms that a source has more of than its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, ship, text_or_empty, written
from .textkernel import gathered, pieces, words

#: Documents of a language that a kept term is in at least, ranks of terms that are returned, and parts in one.
LEAST_DOCS, MOST_RANK, UNIT = 30, 50, 1_000_000_000
#: What is added to each count.
ADDED = 5
#: Bytes of text sorted at a time; runs that a task holds before it sends them; rows of kept terms compared in one group, and
#: cells of a table of terms by sources.
PIECE, HELD, GROUP, CELLS = 4 << 20, 1 << 20, 1 << 18, 1 << 20
#: Letters and all that isn't ASCII, in lower case: [^\x00-\x40\x5B-\x60\x7B-\x7F]+
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True

RUNS = "lang string, term string, source string, docs long, n long"
KEPT = "lang string, term string, source string, n long, total long, first boolean"
PARTS = "lang string, source string, part string, item string, value long"


def starts_of_runs(*columns) -> np.ndarray:
    """Where any of the columns, which are Arrow or numpy and sorted together, differs from the row before."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        differs = c[1:] != c[:-1] if isinstance(c, np.ndarray) else pc.not_equal(c[1:], c[: n - 1]).to_numpy(zero_copy_only=False)
        new[1:] |= differs
    return np.flatnonzero(new)


class Runs:
    """Runs of a task in order of group (language and source) and term: documents, occurrences, and the letters of each term."""

    def __init__(self, group, term, docs, n, data, starts, sizes) -> None:
        """Rows of equal group and term (a hash) are added up."""
        order = np.lexsort((term, group))
        group, term = group[order], term[order]
        at = starts_of_runs(group, term)
        self.group, self.term = group[at], term[at]
        self.docs, self.n = (np.add.reduceat(x[order], at) if len(at) else x for x in (docs, n))
        starts, self.sizes = starts[order][at], sizes[order][at]
        self.data = gathered(data, starts, self.sizes)

    def __len__(self) -> int:
        return len(self.group)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def joined(parts: list[Runs]) -> Runs:
    shift = np.cumsum([0, *(len(p.data) for p in parts)])
    columns = (np.concatenate([getattr(p, k) for p in parts]) for k in ("group", "term", "docs", "n", "data"))
    return Runs(*columns, np.concatenate([p.starts + s for p, s in zip(parts, shift, strict=False)]), np.concatenate([p.sizes for p in parts]))


def counted(data: np.ndarray, group: np.ndarray, w) -> Runs:
    """The words of a piece sorted by group, term and document, and the runs of that order; group is that of each text."""
    term, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    n_docs, n_terms = len(group), max(len(term), 1)
    groups, own = np.unique(group, return_inverse=True)
    order = np.sort((own[w.doc] * n_terms + back) * n_docs + w.doc)
    at = starts_of_runs(order)
    n, of = np.diff(np.append(at, len(order))), order[at] // n_docs
    starts, sizes = w.starts[first], (w.ends - w.starts)[first]
    return Runs(groups[of // n_terms], term[of % n_terms], np.ones(len(at), np.int64), n, data, starts[of % n_terms], sizes[of % n_terms])


def first_scan(batches):
    """One row for each term and source of what a task reads, or of a part of it that has HELD such rows."""
    names: list[tuple[str, str]] = []
    number: dict[tuple[str, str], int] = {}

    def rows(own: Runs):
        offsets = np.append(own.starts, len(own.data))
        terms = pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(own.data.tobytes())]).cast(pa.string())
        lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        at = pa.array(own.group)
        whole = pa.table({"lang": lang.take(at), "term": terms, "source": source.take(at), "docs": own.docs, "n": own.n})
        yield from whole.to_batches(max_chunksize=50_000)

    held, size = [], 0
    for b in batches:
        keys = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)
        group = np.array([number.setdefault(k, len(number)) for k in keys], np.int64)
        names += list(number)[len(names) :]
        for p in pieces(b.column("text"), PIECE):
            w = words(p, LETTERS)
            if len(w.hashes):
                held.append(counted(p.data, group[p.first : p.last], w))
                size += len(held[-1])
            if size >= HELD:
                held = [joined(held)]
                size = len(held[0])
                if size >= HELD // 2:
                    yield from rows(held[0])
                    held, size = [], 0
    if held:
        yield from rows(joined(held))


def second_scan(least: int):
    """Of rows sorted by language, term and source the sums of each run; terms in fewer than `least` documents go.

    total is the term's in its language, and first marks one row of each term. The last term of a batch waits for the
    next, with one row a source.
    """
    columns = ["lang", "term", "source", "docs", "n"]

    def summed(t: pa.Table) -> pa.Table:
        at = starts_of_runs(*(t.column(k).chunk(0) for k in columns[:3]))
        sums = {k: np.add.reduceat(t.column(k).to_numpy(), at) for k in ("docs", "n")}
        return pa.table({k: t.column(k).take(pa.array(at)) if k not in sums else sums[k] for k in columns}).combine_chunks()

    def rows(t: pa.Table):
        at = starts_of_runs(*(t.column(k).chunk(0) for k in columns[:2]))
        size = np.diff(np.append(at, len(t)))
        docs, total = (np.repeat(np.add.reduceat(t.column(k).to_numpy(), at), size) for k in ("docs", "n"))
        first = np.zeros(len(t), bool)
        first[at] = True
        out = pa.table({**{k: t.column(k) for k in ("lang", "term", "source", "n")}, "total": total, "first": first})
        yield from out.filter(pa.array(docs >= least)).to_batches()

    def go(batches):
        waits = None
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.table({k: b.column(k) for k in columns})
            own = summed((pa.concat_tables([waits, own]) if waits is not None else own).combine_chunks())
            last = starts_of_runs(*(own.column(k).chunk(0) for k in columns[:2]))[-1]
            if last:
                yield from rows(own.slice(0, last).combine_chunks())
            waits = own.slice(last).combine_chunks()
        if waits is not None:
            yield from rows(waits)

    return go


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + ADDED) / whole), by long division in tens, so that no product leaves 64 bits."""
    rest, out = (count + ADDED) % whole, (count + ADDED) // whole
    for _ in range(9):
        rest = rest * 10
        out, rest = out * 10 + rest // whole, rest % whole
    return out + 1


def compared(kept: pa.Table, groups: pa.Table) -> pa.Table:
    """Parts of pairs, and the highest terms of each source, from some of the kept terms of one language and all its sources."""
    groups = groups.sort_by("source").combine_chunks()
    sources, whole = groups.column("source").chunk(0), groups.column("whole").to_numpy()
    n_sources, out = len(sources), []
    pairs = np.zeros((n_sources, n_sources), np.int64)
    if len(kept):
        kept = kept.sort_by([("term", "ascending")]).combine_chunks()
        term, n = kept.column("term").chunk(0), kept.column("n").to_numpy()
        at = starts_of_runs(term)
        row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(term))))
        column = pc.index_in(kept.column("source").chunk(0), sources).to_numpy()
        p, nothing = share(n, whole[column]), share(np.zeros(n_sources, np.int64), whole)
        step = max(1, CELLS // n_sources)
        for a in range(0, len(at), step):
            own = slice(*np.searchsorted(row, (a, a + step)))
            table = np.tile(nothing, (min(step, len(at) - a), 1))
            table[row[own] - a, column[own]] = p[own]
            for i in range(n_sources):
                pairs[i] += np.abs(table - table[:, i : i + 1]).sum(0)
        value = p - share(kept.column("total").to_numpy(), np.full(len(p), groups.column("lang_whole")[0].as_py()))
        order = np.lexsort((row, -value, column))
        place = np.arange(len(order)) - np.searchsorted(column[order], column[order])
        order = order[(place < MOST_RANK) & (value[order] > 0)]
        out.append(pa.table({"source": sources.take(pa.array(column[order])), "part": pa.array(["term"] * len(order), pa.string()), "item": term.take(pa.array(order)), "value": value[order]}))
    one, other = np.nonzero(~np.eye(n_sources, dtype=bool))
    out.append(pa.table({"source": sources.take(pa.array(one)), "part": pa.array(["pair"] * len(one), pa.string()), "item": sources.take(pa.array(other)), "value": pairs[one, other]}))
    whole_out = pa.concat_tables(out)
    lang = groups.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(whole_out), pa.string()), **{k: whole_out.column(k) for k in ("source", "part", "item", "value")}})


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others and from the language.

    Terms are runs of letters and of characters that aren't ASCII, A-Z in lower case; a language keeps those in at least
    `least` of its documents. p of a term is 1 + floor(1e9 * (count + 5) / (N + 5 V)), for a source and for its language, V
    the kept terms of the language and N the sum of their counts. Part pair has every other source, with the sum over kept
    terms of the absolute differences of p (0 without terms); part term the MOST_RANK kept terms with the highest
    difference to the language, where a source has them and more of them. Ranks go by value, then by item in order of
    UTF-8 bytes. All numbers are exact, for counts up to 9e16.

    Null text, lang and source are ''. A source without words, or a language without kept terms, is there with its pairs;
    a language with one source has none. Rows that repeat one another are a document each. A very long text makes a
    piece of its own, held by one task. Other columns are not read. Empty input gives an empty result. Within a task words
    are told apart by 64 bits of hash, between tasks by their bytes.

    A term comes once a task and source to the exchange, whoever has it, so none is a hot key; a language with many kept
    terms is compared in several groups, by a hash of the term, each of which has all its sources. Pairs of sources grow
    with the square of a language's sources, as the result does.
    """
    ship(docs.sparkSession)
    given = docs.select(*(text_or_empty(k).alias(k) for k in ("lang", "source", "text")))
    runs = given.mapInArrow(first_scan, RUNS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = written(runs.mapInArrow(second_scan(least), KEPT))
    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("rows"))
    every = given.select("lang", "source").distinct()
    none = lambda k: F.coalesce(k, F.lit(0).cast("long"))
    groups = every.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    # Without kept terms nothing is divided by the sums; 1 stands in for them.
    wholes = [F.greatest(none(n) + ADDED * none("v"), F.lit(1)) for n in ("n", "n_lang")]
    parts = 1 + F.floor(none("rows") / GROUP)
    groups = groups.select("lang", "source", wholes[0].alias("whole"), wholes[1].alias("lang_whole"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("bucket"))
    shared = of_lang.select("lang", (1 + F.floor(F.col("rows") / GROUP)).alias("parts"))
    terms = kept.join(shared, "lang").select("lang", "term", "source", "n", "total", F.expr("pmod(xxhash64(term), parts)").alias("bucket"))
    found = written(terms.groupBy("lang", "bucket").cogroup(groups.groupBy("lang", "bucket")).applyInArrow(compared, PARTS))
    discard(kept)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= MOST_RANK)
    return pairs.withColumn("rank", rank).unionByName(best)
