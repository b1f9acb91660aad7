"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import cut, discard, freed_shuffles, id_bucket, ship, text_or_empty, written
from .textkernel import ALNUM, U, mix, pieces, span_hashes, words

EMBEDDING, WIDTHS, FILTERS = 12, (1, 2, 3), 16
PAD = max(WIDTHS) - 1
#: A word is embedded as the sum of rows for itself and for its first bytes, so many of each; each is found by a hash.
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)
#: Hashes that have a row: those in LEAST_DOCS labelled documents or more, at most VOCABULARY; in a table of SLOTS.
LEAST_DOCS, VOCABULARY, SLOTS = 3, 65_000, 1 << 20
#: Labelled documents, at most, that are fitted in the driver alone. Of more, half as many start the classifier and all go on teaching it where they lie.
MOST_LABELLED = 12_000
#: Documents of a part that teaches by itself in a round, rounds over all documents, numbers of the weights in a row, and labels that are broadcast.
SHARD, ROUNDS, CHUNK, MOST_BROADCAST = 4096, 4, 1 << 13, 1_000_000
#: Batches worked through, about, in whole epochs between the two limits.
STEPS, LEAST_EPOCHS, MOST_EPOCHS = 1500, 4, 30
BATCH, BATCH_WORDS, RATE, DECAY = 32, 50_000, 4e-3, 1e-4
#: The score at which a document counts as toxic where its language has too few toxic rows set aside for a threshold.
THRESHOLD, LEAST_TOXIC = 0.3, 10


def part_hashes(piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its first bytes (words, PARTS), and the words of each text."""
    w = words(piece, ALNUM)
    columns = [w.hashes]
    for n in PREFIXES:
        columns.append(mix(span_hashes(piece.data, w.starts, np.minimum(w.starts + n, w.ends)) + U(n)))
    return np.stack(columns, axis=1), w.counts


class Vocabulary:
    """Rows of hashes, by a slot and a tag; of two that fall into one slot the more frequent has it. Others have row 0, of zeros."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes, self.rows, self.tags = hashes, np.zeros(SLOTS, np.uint16), np.zeros(SLOTS, np.uint32)
        last = hashes[::-1]  # the most frequent last
        slots = (last & U(SLOTS - 1)).astype(np.int64)
        self.rows[slots], self.tags[slots] = np.arange(len(last), 0, -1), last >> U(32)
        self.size = len(hashes) + 1

    def __reduce__(self):  # the hashes alone are sent to tasks
        return Vocabulary, (self.hashes,)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & U(SLOTS - 1)).astype(np.int64)
        return np.where(self.tags[slot] == (hashes >> U(32)).astype(np.uint32), self.rows[slot], 0)


@dataclass
class Weights:
    """embedding (rows, EMBEDDING); conv[i] (width, EMBEDDING, FILTERS); bias[i]; out (features), out_bias."""

    embedding: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embedding, *self.conv, *self.bias, self.out, self.out_bias]


def initial(rows: int, rng: np.random.Generator) -> Weights:
    e = rng.normal(0, 0.1, (rows, EMBEDDING)).astype(np.float32)
    e[0] = 0
    conv = [rng.normal(0, 1 / np.sqrt(EMBEDDING * k), (k, EMBEDDING, FILTERS)).astype(np.float32) for k in WIDTHS]
    return Weights(e, conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(1, -1.9, np.float32))


def laid_out(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids with PAD zeros after each text, so that no filter sees two; and where each text starts. Each has a place or more."""
    places = np.maximum(counts, 1) + PAD
    starts = np.cumsum(places) - places
    out = np.zeros((int(places.sum()) + PAD, PARTS), np.int64)
    out[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    return out, starts


def maps(w: Weights, flat: np.ndarray):
    """The output of each filter at each place, width by width; the first place past the texts has one more row."""
    x = w.embedding[flat[:, 0]]
    for i in range(1, PARTS):
        x += w.embedding[flat[:, i]]
    n = len(flat) - PAD
    for k, conv in zip(WIDTHS, w.conv, strict=True):
        h = x[:n] @ conv[0]
        for i in range(1, k):
            h += x[i : i + n] @ conv[i]
        yield h


def forward(w: Weights, ids: np.ndarray, counts: np.ndarray):
    flat, starts = laid_out(ids, counts)
    pooled, where = [], []
    for h, bias in zip(maps(w, flat), w.bias, strict=True):
        at = np.empty((len(counts), FILTERS), np.int64)
        for d, (s, c) in enumerate(zip(starts, counts, strict=True)):
            at[d] = s + h[s : s + max(c, 1)].argmax(axis=0)
        pooled.append(np.take_along_axis(h, at, axis=0) + bias)
        where.append(at)
    features = np.maximum(np.concatenate(pooled, axis=1), 0)
    return flat, where, features, features @ w.out + w.out_bias[0]


def probabilities(w: Weights, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    flat, starts = laid_out(ids, counts)
    bounds = np.stack([starts, starts + np.maximum(counts, 1)], axis=1).ravel()
    features = []
    for h, bias in zip(maps(w, flat), w.bias, strict=True):
        h = np.concatenate([h, np.zeros((1, FILTERS), np.float32)])
        features.append(np.maximum(np.maximum.reduceat(h, bounds, axis=0)[::2] + bias, 0))
    z = np.concatenate(features, axis=1).astype(np.float64) @ w.out.astype(np.float64) + float(w.out_bias[0])
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gradients(w: Weights, flat, where, features, error) -> list[np.ndarray]:
    """Of the mean log loss; max pooling sends it to one place a text and filter, so most of the text needs none."""
    d_out = features.T @ error
    d_features = np.outer(error, w.out) * (features > 0)
    d_embedding: list[tuple[np.ndarray, np.ndarray]] = []
    d_conv, d_bias = [], []
    for j, (k, conv) in enumerate(zip(WIDTHS, w.conv, strict=True)):
        g = d_features[:, j * FILTERS : (j + 1) * FILTERS]
        d = np.empty_like(conv)
        for i in range(k):
            ids = flat[where[j] + i]
            d[i] = np.einsum("bfe,bf->ef", w.embedding[ids].sum(axis=2), g)
            back = (g[:, :, None] * conv[i].T[None]).reshape(-1, EMBEDDING)
            d_embedding += [(ids[:, :, part].ravel(), back) for part in range(PARTS)]
        d_conv.append(d)
        d_bias.append(g.sum(axis=0))
    ids = np.concatenate([a for a, _ in d_embedding])
    rows, at = np.unique(ids, return_inverse=True)
    total = np.zeros((len(rows), EMBEDDING), np.float32)
    np.add.at(total, at, np.concatenate([b for _, b in d_embedding]))
    total[rows == 0] = 0
    return [(rows, total), *d_conv, *d_bias, d_out, np.array([error.sum()], np.float32)]


def in_batches(order: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Runs of order of at most BATCH texts and, if more than one, BATCH_WORDS words."""
    out, first, total = [], 0, 0
    for i, text in enumerate(order):
        if i > first and (i - first == BATCH or total + len(texts[text]) > BATCH_WORDS):
            out.append(order[first:i])
            first, total = i, 0
        total += len(texts[text])
    return [*out, order[first:]] if first < len(order) else out


def run(w: Weights, texts: list[np.ndarray], rows: np.ndarray):
    counts = np.array([len(texts[i]) for i in rows], np.int64)
    return forward(w, np.concatenate([texts[i] for i in rows]), counts)


def epoch(w: Weights, state: list, step: int, texts: list[np.ndarray], labels: np.ndarray, order: np.ndarray, rng: np.random.Generator, pace: float = RATE) -> int:
    """One pass of Adam over the texts at the places in order, in batches of like length; w and state are changed. Returns the steps so far."""
    keyed = order[np.argsort([len(texts[i]) * rng.uniform(0.7, 1.4) for i in order])]
    batches = in_batches(keyed, texts)
    for b in rng.permutation(len(batches)):
        flat, where, features, z = run(w, texts, batches[b])
        error = ((1 / (1 + np.exp(-z)) - labels[batches[b]]) / len(batches[b])).astype(np.float32)
        step += 1
        rate = pace * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for a, (m, v), g in zip(w.arrays(), state, gradients(w, flat, where, features, error), strict=True):
            rows = slice(None)
            if isinstance(g, tuple):
                rows, g = g
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            a[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 1e-8) + (pace * DECAY * a[rows] if a.ndim > 1 else 0)
    return step


def of_arrays(arrays: list[np.ndarray]) -> Weights:
    k = len(WIDTHS)
    return Weights(arrays[0], list(arrays[1 : 1 + k]), list(arrays[1 + k : 1 + 2 * k]), arrays[-2], arrays[-1])


def fit(texts: list[np.ndarray], labels: np.ndarray, rows: int, seed: int = 7) -> tuple[Weights, np.ndarray]:
    """Adam over batches of texts of like length; the epoch that does best on a tenth set aside is kept. Also the places of that tenth."""
    rng = np.random.default_rng(seed)
    w, best, best_loss = initial(rows, rng), None, np.inf
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in w.arrays()]
    order = rng.permutation(len(texts))
    aside, order = order[: len(order) // 10], order[len(order) // 10 :]
    labels, step = labels.astype(np.float32), 0
    epochs = int(np.clip(STEPS * BATCH / max(len(order), 1), LEAST_EPOCHS, MOST_EPOCHS))
    for _ in range(epochs):
        step = epoch(w, state, step, texts, labels, order, rng)
        loss = 0.0
        for batch in in_batches(aside, texts):
            z = run(w, texts, batch)[3]
            loss += float(np.logaddexp(0, np.where(labels[batch] > 0, -z, z)).sum())
        if loss < best_loss or best is None:
            best, best_loss = [a.copy() for a in w.arrays()], loss
    return of_arrays(best) if best is not None else w, aside


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: Weights
    thresholds: dict[str, float]


def unpacked(size: int, ids: bytes) -> np.ndarray:
    """The rows of the vocabulary of one text, (words, PARTS)."""
    return np.frombuffer(pa.decompress(ids, size, "zstd", asbytes=True) if size else b"", "<u2").reshape(PARTS, -1).T


def begun(rows: DataFrame, size: int) -> tuple[Weights, pa.Table]:
    """What fit() has of the rows (toxic, lang, size, ids): the weights, and lang, toxic and score of the tenth set aside.

    No rows give weights that nothing has taught.
    """
    with freed_shuffles(rows.sparkSession):
        table = rows.select("toxic", "lang", "size", "ids").toArrow()  # at most `most` of train()
    found = sorted(zip(*(c.to_pylist() for c in table.columns), strict=True))
    del table
    texts, toxic, langs = [unpacked(r[2], r[3]) for r in found], np.array([r[0] for r in found], np.int32), [r[1] for r in found]
    del found
    w, aside = fit(texts, toxic.astype(np.int64), size) if texts else (initial(size, np.random.default_rng(7)), np.empty(0, np.int64))
    scores = [probabilities(w, texts[i], np.array([len(texts[i])]))[0] for i in aside]
    return w, pa.table({"lang": pa.array([langs[i] for i in aside], pa.string()), "toxic": pa.array(toxic[aside]), "score": pa.array(scores, pa.float64())})


def shaped_as(w: Weights, numbers: np.ndarray) -> Weights:
    """The numbers of all arrays in a row, as weights shaped like w."""
    ends = np.cumsum([a.size for a in w.arrays()])
    return of_arrays([part.reshape(a.shape).copy() for a, part in zip(w.arrays(), np.split(numbers, ends[:-1]), strict=True)])


def taught(rows: DataFrame, n: int, w: Weights, round_: int) -> Weights:
    """The mean of the weights that parts of the rows (toxic, size, ids, h) reach from w in one pass each, by their rows.

    A part has about SHARD rows by their hash, so it is the same however Spark divides the table, and no task or the driver holds them all.
    Weights are added up by runs of CHUNK numbers, a number from each part, in the order of the parts; their means come to the driver.
    """
    shards, shared = max(-(-n // SHARD), 1), rows.sparkSession.sparkContext.broadcast(w.arrays())

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("ids", "ascending")])
        own = of_arrays([a.copy() for a in shared.value])
        texts = [unpacked(s, i) for s, i in zip(t.column("size").to_pylist(), t.column("ids").to_pylist(), strict=True)]
        labels, shard = t.column("toxic").to_numpy().astype(np.float32), t.column("shard")[0].as_py()
        epoch(own, [(np.zeros_like(a), np.zeros_like(a)) for a in own.arrays()], 0, texts, labels, np.arange(len(texts)), np.random.default_rng([round_, shard]), RATE / 2 ** (round_ + 1))
        numbers = np.concatenate([a.ravel() for a in own.arrays()])
        at = list(range(0, len(numbers), CHUNK))
        return pa.table({"at": pa.array(at, pa.int32()), "shard": pa.array([shard] * len(at), pa.int32()), "n": pa.array([len(texts)] * len(at), pa.int64()), "v": pa.array([numbers[i : i + CHUNK].tobytes() for i in at], pa.binary())})

    def mean(t: pa.Table) -> pa.Table:
        t, total = t.sort_by("shard"), 0.0
        for v, k in zip(t.column("v"), t.column("n").to_pylist(), strict=True):
            total = total + np.frombuffer(v.as_py(), np.float32).astype(np.float64) * k
        total = (total / sum(t.column("n").to_pylist())).astype(np.float32)
        return pa.table({"at": t.column("at")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    with freed_shuffles(rows.sparkSession):
        parts = rows.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(learn, "at int, shard int, n long, v binary")
        found = parts.groupBy("at").applyInArrow(mean, "at int, v binary").toArrow().sort_by("at")  # numbers of the weights
    shared.destroy()
    return shaped_as(w, np.frombuffer(b"".join(found.column("v").to_pylist()), np.float32))


def rated_aside(rows: DataFrame, w: Weights) -> pa.Table:
    """lang, toxic and score of rows that no weight is fitted on: three values of each come to the driver, no texts."""
    def scan(batches):
        for b in batches:
            texts = [unpacked(s, i) for s, i in zip(b.column("size").to_pylist(), b.column("ids").to_pylist(), strict=True)]
            scores = [probabilities(w, t, np.array([len(t)]))[0] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(scores, pa.float64())], names=["lang", "toxic", "score"])

    return rows.select("lang", "toxic", "size", "ids").mapInArrow(scan, "lang string, toxic int, score double").toArrow()


def in_docs(batches):
    """Each hash once for each text that has it."""
    for b in batches:
        for p in pieces(b.column("text")):
            hashes, counts = part_hashes(p)
            at = np.concatenate([[0], np.cumsum(counts)])
            own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(p))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])


def encoded(vocabulary: Vocabulary):
    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text")):
                hashes, counts = part_hashes(p)
                ids, at = vocabulary(hashes).astype("<u2"), np.concatenate([[0], np.cumsum(counts)])
                raw = [ids[at[i] : at[i + 1]].T.tobytes() for i in range(len(p))]
                sizes, packed = [len(r) for r in raw], [pa.compress(r, "zstd", asbytes=True) if r else b"" for r in raw]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(p.first, len(p)) for c in ("toxic", "lang")), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), b.column("h").slice(p.first, len(p))], names=["toxic", "lang", "size", "ids", "h"])

    return scan


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of highest F1: the middle between the last score that counts as toxic and the next below it."""
    order = np.argsort(-scores, kind="stable")
    ranked = scores[order]
    f1 = 2 * np.cumsum(labels[order]) / (np.arange(1, len(order) + 1) + labels.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = 0  # a threshold can't part equal scores
    last = int(np.argmax(f1))
    return float((ranked[last] + (ranked[last + 1] if last + 1 < len(ranked) else 0.0)) / 2)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A classifier and a threshold for each language, from all labelled documents whose label may be learnt.

    Up to `most` of them are fitted in the driver. Of more, most / 2 (the first by a hash of their id) give weights to start from, and then
    all of them teach in ROUNDS passes where they lie, in parts whose weights are averaged; the round that does best on a
    tenth of those that the start didn't have is kept. The vocabulary is counted over all.
    The thresholds come from the tenth of them that no weight is fitted on.

    Rows with crc32(doc_id as text) mod 4 = 2 are never used. lang serves for the thresholds alone. An id labelled twice
    counts once, as toxic if any label says so; of documents that share an id the least text does; labels that are null or have no document are passed over. Without any
    labelled document all scores are one constant. At most `most` labelled rows come to the driver, as rows of the
    vocabulary, pressed.
    """
    ship(docs.sparkSession)
    own = labels.filter("doc_id is not null and toxic is not null").filter(id_bucket("doc_id", 4) != 2)
    chosen = cut(own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(6))))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", text_or_empty().alias("text"), lang.alias("lang")).join(F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen, "doc_id")
    rows = written(rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic", "h")).alias("r")).select("r.toxic", "r.lang", "r.text", "r.h"))
    often = rows.select("text").mapInArrow(in_docs, "h long").groupBy("h").count().filter(F.col("count") >= LEAST_DOCS)
    known = often.orderBy(F.desc("count"), "h").limit(VOCABULARY).select("h").toArrow().column("h")  # the first of all partitions meet in a task
    vocabulary = Vocabulary(known.to_numpy().astype(np.int64).view(U))
    table = written(rows.mapInArrow(encoded(vocabulary), "toxic int, lang string, size long, ids binary, h long"))
    discard(rows)
    n, start = table.count(), table
    if n > most:
        last = table.select("h").orderBy("h").limit(most // 2).agg(F.max("h")).first()[0]
        start = table.filter(F.col("h") <= last)
    weights, seen = begun(start, vocabulary.size)
    if n > most:
        tenth = (F.col("h") > last) & (F.pmod(F.xxhash64("h", F.lit(10)), F.lit(10)) == 0)
        teaching, best = table.filter(~tenth), np.inf
        w = weights
        for i in range(ROUNDS):
            w = taught(teaching, n, w, i)
            now = rated_aside(table.filter(tenth), w)
            own, scores = now.column("toxic").to_numpy(), np.clip(now.column("score").to_numpy(), 1e-12, 1 - 1e-12)
            loss = -float(np.log(np.where(own > 0, scores, 1 - scores)).sum())
            if loss < best:
                best, weights, seen = loss, w, now.set_column(2, "score", pa.array(scores))
    discard(table)
    langs, toxic, values, thresholds = np.array(seen.column("lang").to_pylist()), seen.column("toxic").to_numpy(), seen.column("score").to_numpy(), {}
    for one in sorted(set(langs.tolist())):
        mine = langs == one
        if toxic[mine].sum() >= LEAST_TOXIC:
            thresholds[one] = best_threshold(values[mine], toxic[mine])
    return Model(vocabulary, weights, thresholds)


def scored(model: Model):
    def scan(batches):
        for b in batches:
            for p in pieces(b.column("text")):
                hashes, counts = part_hashes(p)
                values = probabilities(model.weights, model.vocabulary(hashes), counts)
                others = [b.column(c).slice(p.first, len(p)) for c in ("row", "lang")]
                yield pa.RecordBatch.from_arrays([*others, pa.array(values)], names=["row", "lang", "score"])

    return scan


def rated(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), lang, score, threshold, toxic."""
    ship(docs.sparkSession)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lang.alias("lang"), text_or_empty().alias("text"))
    kinds = T.StructType([given.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    out = given.mapInArrow(scored(model), kinds)
    threshold = F.lit(THRESHOLD)
    for one, value in model.thresholds.items():
        threshold = F.when(F.col("lang") == one, value).otherwise(threshold)
    return out.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, threshold, toxic: the score of each whole text, and whether it reaches its language's threshold.

    Score is the classifier's probability, of the text alone; an empty or null text has that of no words. A language
    without threshold, or null, has THRESHOLD. Repeated rows come back each, a null id stays null, other columns are not
    read; empty input gives an empty result.
    """
    columns = ["doc_id", "text", *(["lang"] if "lang" in docs.columns else [])]
    return rated(docs.select(*columns), model).select("row.doc_id", "score", "threshold", "toxic")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic."""
    return rated(docs, model).filter("not toxic").select("row.*")
