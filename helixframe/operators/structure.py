"""Structure among samples and features: principal components, distances, linkage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship
from .association import SAMPLE_LIMIT, values_of
from .sums import summed

#: Samples that a dense matrix of all pairs may have.
DENSE_LIMIT = 5_000
#: Directions beyond those asked for, rounds at most, and the least residual of a component, as a part of the largest.
SPARE, ROUNDS, RESIDUAL = 10, 60, 1e-9


def jaccard(present: DataFrame, item: str, of: str) -> DataFrame:
    """a, b, distance of items (a < b) that share anything: 1 less shared over all. Pairs that share nothing are at 1."""
    own = present.select(F.col(item), F.col(of)).distinct()
    n = own.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    a, b = own.toDF("a", of), own.toDF("b", of)
    shared = a.join(b, of).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    sized = shared.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return sized.select("a", "b", (F.lit(1.0) - F.col("k") / (F.col("na") + F.col("nb") - F.col("k")).cast("double")).alias("distance"))


def signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[at, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def gram(features: DataFrame, n: int, scaled) -> tuple[np.ndarray, int]:
    """Sum over features of outer products of their scaled values, and the number of features used.

    Each partition adds up its own n by n matrix; the matrices are added by rows in one aggregation.
    """
    if n > DENSE_LIMIT:
        raise ValueError(f"a dense matrix of {n} samples; the limit is {DENSE_LIMIT}")
    ship(features.sparkSession)

    def partial(batches):
        total, used = np.zeros((n, n)), 0
        for b in batches:
            z = scaled(values_of(b.column(0), n))
            total += z.T @ z
            used += len(z)
        yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array([*total.tolist(), [float(used)] * n], pa.list_(pa.float64()))], names=["i", "v"])

    parts = features.mapInArrow(partial, "i int, v array<double>")
    summed = parts.select("i", F.posexplode("v").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((n + 1, n))
    out[summed.i, summed.j] = summed.x
    return out[:n], int(out[n, 0]) if n else 0


def genotype_scaled(g: np.ndarray) -> np.ndarray:
    """Dosages less their mean, over the deviation that their allele frequency lets expect; missing ones are at the mean; invariant features go."""
    with np.errstate(all="ignore"):
        p = np.nanmean(g, axis=1) / 2
    use = np.isfinite(p) & (p > 0) & (p < 1)
    p = p[use, None]
    return np.nan_to_num((g[use] - 2 * p) / np.sqrt(2 * p * (1 - p)))


def standardised(g: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(np.nanmean(g, axis=1))[:, None]
    x = np.where(np.isfinite(g), g, mean)
    x = x - x.mean(axis=1, keepdims=True)
    sd = x.std(axis=1, keepdims=True)
    return x / np.where(sd == 0, 1, sd)


def leading(product, n: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors (n by k) and residuals of the k largest components of a symmetric matrix that only product(x) knows.

    A Krylov space grown from random directions, a block a round, each made orthogonal to those before; the components are
    the best that it holds. It ends when all residuals are under RESIDUAL of the largest value, when the space is whole,
    or when it has ROUNDS blocks or SAMPLE_LIMIT numbers.
    """
    width = min(n, k + SPARE)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    space, image = np.empty((n, 0)), np.empty((n, 0))
    for _ in range(ROUNDS):
        space, image = np.hstack([space, x]), np.hstack([image, product(x)])
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        values, vectors = values[order], space @ turn[:, order]
        residual = np.linalg.norm(image @ turn[:, order] - vectors * values, axis=0)
        left = n - space.shape[1]
        if residual.max(initial=0) <= RESIDUAL * max(values.max(initial=0), 1e-300) or not left or 2 * n * (space.shape[1] + width) > SAMPLE_LIMIT:
            break
        x = image[:, -width:]
        for _ in range(2):
            x = x - space @ (space.T @ x)
        x, size, _ = np.linalg.svd(x, full_matrices=False)
        x = x[:, size > 1e-12 * max(size.max(initial=0), 1e-300)][:, :left]
        if not x.shape[1]:
            break
        width = x.shape[1]
    return values, vectors, residual


def times_gram(rows: DataFrame, scaled):
    """The product of a matrix with the sum over rows (an array each) of outer products of their scaled values.

    Each partition multiplies its own rows twice, so what travels is n by as many columns as the matrix has, never n by n.
    """

    def product(x: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(x)

        def own(b: pa.RecordBatch) -> np.ndarray:
            z = scaled(values_of(b.column(0), len(shared.value)))
            return (z.T @ (z @ shared.value)).ravel()

        out = summed(rows, own, x.size).reshape(x.shape)
        shared.unpersist()
        return out

    return product


def large_components(features: DataFrame, n: int, k: int = 10, scaled=genotype_scaled, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n samples their k components (n by k), the shares of variance, and the residuals, without a matrix of pairs.

    features: one column, array<double> by sample. The driver and each task hold n by a few columns, bounded by
    SAMPLE_LIMIT numbers; a round reads features once. Residuals say how far a component may be off, as a part of the
    largest value: flat spectra take more rounds than are made, and then say so.
    """
    if 2 * n * min(n, k + SPARE) > SAMPLE_LIMIT:
        raise ValueError(f"{n} samples by {k + SPARE} columns; the limit is {SAMPLE_LIMIT} numbers")
    totals = summed(features, lambda b: np.array([len(z := scaled(values_of(b.column(0), n))), (z * z).sum()], float), 2)
    used = int(totals[0])
    if not used:
        return np.empty((n, 0)), np.zeros(0), np.zeros(0)
    k = min(k, n - 1, used)
    values, vectors, residual = leading(times_gram(features, scaled), n, k, seed)
    kept = np.maximum(values, 0)
    return signed(vectors) * np.sqrt(kept), kept / max(totals[1], 1e-300), residual / max(kept.max(initial=0), 1e-300)


def principal_components(features: DataFrame, samples: list, k: int = 10, scaled=genotype_scaled) -> tuple[pd.DataFrame, np.ndarray]:
    """Components of samples (sample_id, PC1 to PCk) and their shares of variance. features: one column, array<double> by sample.

    Beyond DENSE_LIMIT samples they are those of large_components, refused where a residual is above 1e-4.
    """
    n = len(samples)
    if n > DENSE_LIMIT:
        pcs, share, residual = large_components(features, n, k, scaled)
        if residual.max(initial=0) > 1e-4:
            raise ValueError(f"the components of {n} samples are too much alike: residuals {residual.tolist()}")
        frame = pd.DataFrame(pcs, columns=[f"PC{i + 1}" for i in range(pcs.shape[1])])
        frame.insert(0, "sample_id", samples)
        return frame, share
    total, used = gram(features, n, scaled)
    if not used:
        return pd.DataFrame({"sample_id": samples}), np.zeros(0)
    values, vectors = np.linalg.eigh(total / used)
    order = np.argsort(values)[::-1][: min(k, n - 1, used)]
    kept = np.maximum(values[order], 0)
    pcs = signed(vectors[:, order]) * np.sqrt(kept * used)
    frame = pd.DataFrame(pcs, columns=[f"PC{i + 1}" for i in range(len(order))])
    frame.insert(0, "sample_id", samples)
    return frame, kept / max(np.maximum(values, 0).sum(), 1e-300)


def centre_and_scale(total: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which features vary, their means (0 for others) and what their values are divided by (infinite for others)."""
    with np.errstate(all="ignore"):
        mean = total / there
    use = np.isfinite(mean) & (mean > 0) & (mean < 2)
    mean = np.where(use, mean, 0.0)
    return use, mean, np.where(use, np.sqrt(mean * np.where(use, 1 - mean / 2, 1.0)), np.inf)


def dense_directions(rows: DataFrame, wide: int, k: int, halves) -> tuple:
    """Means, scales, number used, values, directions and sum of all values of few features, from their matrix of pairs."""
    def own(b: pa.RecordBatch) -> np.ndarray:
        x = np.hstack(halves(b))
        return np.append((x.T @ x).ravel(), float(len(x)))

    both = summed(rows, own, 4 * wide * wide + 1)
    n, both = int(both[-1]), both[:-1].reshape(2 * wide, 2 * wide)
    xx, xm, mm = both[:wide, :wide], both[:wide, wide:], both[wide:, wide:]
    use, mean, scale = centre_and_scale(np.diag(xm), np.diag(mm))
    used = int(use.sum())
    cross = (xx - xm * mean - (xm * mean).T + mm * np.outer(mean, mean)) / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(cross / max(used, 1))
    order = np.argsort(values)[::-1][: max(min(k, n - 1, used), 0)]
    return mean, scale, used, values[order], vectors[:, order], np.maximum(values, 0).sum()


def wide_directions(rows: DataFrame, wide: int, k: int, halves) -> tuple:
    """The same of many features, from products of their matrix of pairs with a few columns at a time."""
    sums = summed(rows, lambda b: np.concatenate([*(h.sum(axis=0) for h in halves(b)), [float(b.num_rows)]]), 2 * wide + 1)
    n = int(sums[-1])
    use, mean, scale = centre_and_scale(sums[:wide], sums[wide:-1])
    used = int(use.sum())

    def scaled(g: np.ndarray) -> np.ndarray:
        return np.where(np.isfinite(g), (g - mean) / scale, 0.0)

    whole = summed(rows, lambda b: np.array([(scaled(values_of(b.column(0), wide)) ** 2).sum()]), 1)[0]
    values, vectors, residual = leading(times_gram(rows, scaled), wide, max(min(k, n - 1, used), 0))
    if residual.max(initial=0) > 1e-4 * max(values.max(initial=0), 1e-300):
        raise ValueError(f"the components of {wide} features are too much alike: residuals {residual.tolist()}")
    return mean, scale, used, values / max(used, 1), vectors, whole / max(used, 1)


def projected_components(rows: DataFrame, k: int = 10) -> tuple[DataFrame, np.ndarray]:
    """Components as principal_components has them, of any number of samples, a row each.

    rows: sample_id and dosage, an array<double> by feature. Each partition adds up products of features and of what is
    there; with integer dosages these sums are exact, in whatever order. Their matrix of all pairs of features is small,
    and every sample is projected where its row lies. Beyond DENSE_LIMIT features there is no matrix of pairs: directions
    come from leading(), and are refused where a residual is above 1e-4.
    """
    first = rows.select(F.size("dosage")).first()
    wide = first[0] if first else 0
    ship(rows.sparkSession)

    def halves(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        g = values_of(b.column("dosage"), wide)
        there = np.isfinite(g)
        return np.where(there, g, 0.0), there.astype(float)

    if wide > DENSE_LIMIT:
        mean, scale, used, values, vectors, whole = wide_directions(rows.select("dosage"), wide, k, halves)
    else:
        mean, scale, used, values, vectors, whole = dense_directions(rows.select("dosage"), wide, k, halves)
    if not used:
        return rows.select("sample_id"), np.zeros(0)
    kept = np.maximum(values, 0)
    names = [f"PC{i + 1}" for i in range(len(kept))]
    weights = vectors / scale[:, None]

    def project(batches):
        for b in batches:
            x, there = halves(b)
            pcs = x @ weights - there @ (mean[:, None] * weights)
            yield pa.RecordBatch.from_arrays([b.column("sample_id"), *map(pa.array, pcs.T)], names=["sample_id", *names])

    kind = rows.schema["sample_id"].dataType.simpleString()
    pcs = cut(rows.select("sample_id", "dosage").mapInArrow(project, ", ".join([f"sample_id {kind}", *(f"{c} double" for c in names)])))
    if not names:
        return pcs, kept
    largest = pcs.agg(*[F.min(F.struct((-F.abs(c)).alias("size"), "sample_id", F.col(c).alias("x"))).alias(c) for c in names]).first()
    turned = [(F.col(c) * (-1.0 if largest[c].x < 0 else 1.0)).alias(c) for c in names]
    return pcs.select("sample_id", *turned), kept / max(whole, 1e-300)


def squared_correlations(rows: DataFrame) -> np.ndarray:
    """The r2 of all pairs of features, from sample rows: one column, dosage, an array<double> by feature; missing values at the mean.

    Each partition adds up products of features and of what is there, so no task holds a feature's samples: the sums are
    of the number of features squared, whatever the samples, and exact for integer dosages. A feature that doesn't vary has
    NaN on the diagonal and 0 elsewhere. Beyond DENSE_LIMIT features it is refused.
    """
    first = rows.select(F.size("dosage")).first()
    wide = first[0] if first else 0
    if wide > DENSE_LIMIT:
        raise ValueError(f"a dense matrix of {wide} features; the limit is {DENSE_LIMIT}")

    def own(b: pa.RecordBatch) -> np.ndarray:
        g = values_of(b.column("dosage"), wide)
        there = np.isfinite(g)
        x = np.hstack([np.where(there, g, 0.0), there])
        return (x.T @ x).ravel()

    both = summed(rows.select("dosage"), own, 4 * wide * wide).reshape(2 * wide, 2 * wide)
    xx, xm, mm = both[:wide, :wide], both[:wide, wide:], both[wide:, wide:]
    mean = np.diag(xm) / np.maximum(np.diag(mm), 1.0)
    cross = xx - xm * mean - (xm * mean).T + mm * np.outer(mean, mean)
    size = np.diag(cross)
    varies = size > 1e-12 * np.diag(xx)
    scale = np.where(varies, size, 1.0)
    r2 = np.where(np.outer(varies, varies), cross * cross / np.outer(scale, scale), 0.0)
    r2[np.diag_indices(wide)] = np.where(varies, 1.0, np.nan)
    return r2


def walked(r2: np.ndarray, order: list[int], limit: float, reach: int | None = None) -> list[int]:
    """Features kept on a walk in the order given: one goes if its r2 with one kept (among the last `reach`, if given) is above limit, or if it doesn't vary."""
    kept: list[int] = []
    places: list[int] = []
    varying = [j for j in order if not np.isnan(r2[j, j])]
    at = {j: i for i, j in enumerate(order)}
    for j in varying:
        near = [k for k, p in zip(kept, places, strict=True) if reach is None or at[j] - p <= reach]
        if not near or r2[near, j].max() <= limit:
            kept.append(j)
            places.append(at[j])
    return kept


def principal_coordinates(distance: np.ndarray, k: int = 5) -> np.ndarray:
    """Coordinates whose distances come nearest to those given; at most DENSE_LIMIT rows."""
    n = len(distance)
    if n > DENSE_LIMIT:
        raise ValueError(f"a dense matrix of {n} rows; the limit is {DENSE_LIMIT}")
    sq = distance**2
    centred = -0.5 * (sq - sq.mean(axis=0) - sq.mean(axis=1)[:, None] + sq.mean())
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(values)[::-1][:k]
    return signed(vectors[:, order]) * np.sqrt(np.maximum(values[order], 0))


def unit_rows(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features filled by their mean, centred and of length one; and which of them vary."""
    with np.errstate(all="ignore"):
        x = np.where(np.isfinite(g), g, np.nanmean(g, axis=1)[:, None])
    x = np.nan_to_num(x)
    x = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1))
    return x / np.where(size == 0, 1, size)[:, None], size > 0


def thinned(unit: np.ndarray, varies: np.ndarray, limit: float, reach: int | None = None) -> list[int]:
    """Indices kept on a walk in order: one goes if its r2 with one kept (among the last `reach` indices, if given) is above limit."""
    kept: list[int] = []
    for j in np.flatnonzero(varies):
        near = kept if reach is None else [i for i in kept if j - i <= reach]
        if not near or float(np.max((unit[near] @ unit[j]) ** 2)) <= limit:
            kept.append(int(j))
    return kept


def ld_clump(features: DataFrame, group: str, limit: float = 0.1) -> DataFrame:
    """group, variant kept of each group, the smallest p first (ties by variant)."""
    ship(features.sparkSession)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p", "variant"])
        unit, varies = unit_rows(np.array(pdf.dosage.tolist(), float))
        return pdf.iloc[thinned(unit, varies, limit)][[group, "variant"]]

    kind = features.schema[group].dataType.simpleString()
    return features.select(group, "variant", "p", "dosage").groupBy(group).applyInPandas(walk, f"{group} {kind}, variant string")


def linkage_clusters(g: np.ndarray, limit: float = 0.95) -> np.ndarray:
    """Cluster of each feature (row): that of the first feature whose r2 with it is limit or more and which began a cluster, else its own."""
    unit, _ = unit_rows(g)
    seeds, out = [], np.full(len(g), -1)
    for j in range(len(g)):
        if seeds and (hit := np.flatnonzero((unit[seeds] @ unit[j]) ** 2 >= limit)).size:
            out[j] = hit[0]
        else:
            out[j] = len(seeds)
            seeds.append(j)
    return out
