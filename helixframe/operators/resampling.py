"""Bootstrap and permutation of a cohort whose samples stay where they are: no draw needs all samples in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fisher_interval
from ..runtime import cut, discard, ship, written
from .association import values_of
from .blocks import PARTS, against_itself
from .ranks import numbered
from .sums import summed

#: Numbers that one round of bootstrap draws adds up, samples of a block, and half rounds of a permutation.
NUMBERS, BLOCK_SAMPLES, HALF_ROUNDS = 1 << 21, 1 << 15, 24
#: Bytes of measurements that one task may hold, samples of a block and draws that it looks up at a time.
HELD, AT_ONCE, DRAWS = 1 << 28, 1024, 64
PRIMARY = "mean per-gene Pearson r"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which like numbers come out unlike."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(seed: int, kind: int, draws: np.ndarray) -> np.ndarray:
    """A key for each draw, as a column."""
    return mixed(mixed(np.full(1, seed, np.uint64) * np.uint64(2) + np.uint64(kind)) + draws.astype(np.uint64))[:, None]


def poisson_counts(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each sample is in each draw (draws, samples): Poisson of mean one, by a hash of sample and draw."""
    chance = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(20.0), 1)))
    u = (mixed(mixed(at.astype(np.uint64)[None, :]) ^ keys) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(chance, u, side="right").astype(float)


def permuted(at: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Where each of the places `at` of n goes in each draw (draws, places): a permutation of all n, found place by place.

    A place is a pair of digits, and each half round shifts one digit by a hash of the other, which can be undone (fewer half rounds
    than HALF_ROUNDS are uneven for n under 12, by a chi-square test of pairs); a place
    that lands beyond n goes on until it lands below.
    """
    wide = int(np.ceil(np.sqrt(n)))
    high = -(-n // wide)
    salts = [mixed(keys + np.uint64(1 + i)) for i in range(HALF_ROUNDS)]

    def once(x: np.ndarray, rows) -> np.ndarray:
        a, b = np.divmod(x, wide)
        for i, salt in enumerate(salts):
            if i % 2 == 0:
                a = (a + (mixed(b.astype(np.uint64) ^ salt[rows]) % np.uint64(high)).astype(np.int64)) % high
            else:
                b = (b + (mixed(a.astype(np.uint64) ^ salt[rows]) % np.uint64(wide)).astype(np.int64)) % wide
        return a * wide + b

    out = once(np.repeat(np.asarray(at, np.int64)[None, :], len(keys), axis=0), slice(None))
    while (beyond := np.nonzero(out >= n))[0].size:
        out[beyond] = once(out[beyond][:, None], beyond[0])[:, 0]
    return out


def correlations(sums: np.ndarray, genes: int) -> np.ndarray:
    """Correlation of each gene from sums of 1, x, y, xx, yy, xy (..., 1 + 5 genes)."""
    n, (x, y, xx, yy, xy) = sums[..., :1], (sums[..., 1 + k * genes : 1 + (k + 1) * genes] for k in range(5))
    with np.errstate(all="ignore"):
        return (xy - x * y / n) / np.sqrt((xx - x * x / n) * (yy - y * y / n))


def score_evaluation(rows: DataFrame, genes: list[str], n_permutations: int = 1000, n_bootstrap: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A report of one row, gene_id with r, r2 and its interval, and draws (kind null or boot, i, value) of the mean r.

    rows: sample_id, score and measured, arrays by gene in the order of genes, a row a sample. A bootstrap draw counts
    each sample a Poisson number of times, and its correlations come from sums over partitions; a permutation pairs the scores of
    each sample with what was measured on another, the same one for all genes. Where a sample goes is found once for each
    part of the measurements (HELD bytes, so one part for most cohorts), which are read for each block of scores.
    Draws depend on seed and the order of sample_id, not on partitions.

    A gene whose score or measurement doesn't vary has r null and isn't counted; a draw in which one doesn't leaves it out.
    Missing numbers are refused, as are fewer than two samples; the interval needs four.
    """
    spark, wide = rows.sparkSession, len(genes)
    ship(spark)
    placed = written(numbered(rows.select("sample_id", "score", "measured"), "sample_id", name="idx").select((F.col("idx") - 1).alias("idx"), "score", "measured"))

    def both(b) -> np.ndarray:
        return np.hstack([values_of(b.column(c).combine_chunks() if isinstance(b, pa.Table) else b.column(c), wide) for c in ("score", "measured")])

    sums = summed(placed, lambda b: np.append(both(b).sum(axis=0), float(b.num_rows)), 2 * wide + 1)
    n, mean = int(sums[-1]), sums[:-1] / max(sums[-1], 1)
    if n < 2 or not np.isfinite(mean).all():
        raise ValueError("scores and measurements of two samples or more are needed, without missing values")
    spread = np.sqrt(summed(placed, lambda b: ((both(b) - mean) ** 2).sum(axis=0), 2 * wide) / (n - 1))
    varies = (spread > 1e-12 * np.abs(mean)).reshape(2, wide).all(axis=0)
    used = np.flatnonzero(varies)
    if not len(used):
        raise ValueError("no gene has a score and a measurement that vary")
    columns = np.concatenate([used, wide + used])
    centre, scale, k = mean[columns], spread[columns], len(used)

    def standard(b) -> tuple[np.ndarray, np.ndarray]:
        z = (both(b)[:, columns] - centre) / scale
        return z[:, :k], z[:, k:]

    def powers(b) -> np.ndarray:
        x, y = standard(b)
        return np.hstack([np.ones((len(x), 1)), x, y, x * x, y * y, x * y])

    width = 1 + 5 * k
    r = correlations(summed(placed, lambda b: powers(b).sum(axis=0), width), k)
    boot = []
    step = max(NUMBERS // width, 1)
    for low in range(0, n_bootstrap, step):  # rounds of bounded sums
        keys = keyed(seed, 1, np.arange(low, min(low + step, n_bootstrap)))
        total = summed(placed, lambda b, keys=keys: (poisson_counts(b.column("idx").to_numpy(), keys) @ powers(b)).ravel(), len(keys) * width)
        drawn = correlations(total.reshape(len(keys), width), k)
        there = np.isfinite(drawn)
        boot += np.where(there.any(axis=1), np.where(there, drawn, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1), np.nan).tolist()

    shuffles = keyed(seed, 0, np.arange(n_permutations))

    def paired(own: np.ndarray, x: np.ndarray, at: np.ndarray, y: np.ndarray, total: np.ndarray) -> None:
        """Adds to each draw the products of the scores x of samples `own` with the measurement that the draw gives them, if it is in y."""
        for i in range(0, len(own), AT_ONCE):
            for low in range(0, n_permutations, DRAWS):
                other = at[permuted(own[i : i + AT_ONCE], n, shuffles[low : low + DRAWS])]
                found = y[other]  # what isn't here is in the last row, of zeros
                total[low : low + DRAWS] += np.einsum("dsk,sk->d", found, x[i : i + AT_ONCE])

    def meet(pairs):
        total, own, x, others, at, y = np.zeros(n_permutations), None, None, [], None, None
        last = None

        def finish():
            nonlocal at, y
            if y is None:  # the same measurements for all blocks of scores that the task has
                at = np.full(n, -1, np.int64)
                idx = np.concatenate([i for i, _ in others])
                at[idx] = np.arange(len(idx))
                y = np.concatenate([v for _, v in others] + [np.zeros((1, k))])
                others.clear()
            paired(own, x, at, y, total)

        for a, b in pairs:
            if last is not a:
                if last is not None:
                    finish()
                last, own, x = a, a.column("idx").to_numpy(), standard(a)[0]
            if y is None:
                others.append((b.column("idx").to_numpy(), standard(b)[1]))
        if last is not None:
            finish()
            yield pa.table({"i": np.arange(n_permutations), "value": total / ((n - 1) * k)})

    block = min(BLOCK_SAMPLES, 1 + n // PARTS)
    parts = against_itself(placed, "idx", block, meet, "i long, value double", right_parts=1 + 8 * n * k // HELD)
    null = parts.groupBy("i").agg(F.sum("value").alias("value")).select(F.lit("null").alias("kind"), "i", "value")
    draws = cut(null.union(spark.createDataFrame([("boot", i, float(v)) for i, v in enumerate(boot)], "kind string, i long, value double")))
    discard(placed)

    shown = dict(zip(used.tolist(), r.tolist(), strict=True))
    table = spark.createDataFrame([(g, shown.get(i), n) for i, g in enumerate(genes)], "gene_id string, r double, n long")
    low, high = fisher_interval(F.col("r"), F.col("n"))
    per_gene = table.select("gene_id", "r", (F.col("r") * F.col("r")).alias("r2"), low.alias("r_ci_low"), high.alias("r_ci_high"))
    observed = float(r.mean())
    of = lambda kind: F.when((F.col("kind") == kind) & ~F.isnan("value"), F.col("value"))
    ends = lambda kind: F.array(F.percentile(of(kind), 0.025), F.percentile(of(kind), 0.975))
    report = draws.agg(
        F.lit(n).cast("long").alias("n_samples"), F.lit(k).cast("long").alias("n_genes_scored"), F.lit(PRIMARY).alias("primary_statistic"),
        F.lit(observed).alias("observed_mean_r"), F.lit(float(np.median(r))).alias("observed_median_r"), F.lit(float((r * r).mean())).alias("observed_mean_r2"),
        F.lit(float((r > 0).mean())).alias("fraction_genes_r_positive"), ends("boot").alias("bootstrap_ci95_mean_r"),
        F.lit(n_permutations).cast("long").alias("n_permutations"), F.lit(n_bootstrap).cast("long").alias("n_bootstrap"), F.lit(seed).cast("long").alias("seed"),
        F.avg(of("null")).alias("null_mean"), F.stddev_samp(of("null")).alias("null_sd"), ends("null").alias("null_ci95"), F.max(of("null")).alias("null_max"),
        ((1.0 + F.count_if(of("null") >= observed)) / (1.0 + F.count(of("null")))).alias("empirical_p_one_sided"),
    )
    return report, per_gene, draws
