"""Made data of known truth, for tests and demonstrations; always of scope synthetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def populations(n_each: int, n_variants: int, fst: float, k: int = 3, seed: int = 0) -> tuple[np.ndarray, list[str]]:
    """Dosages (variants, samples) of k populations whose frequencies spread by fst about shared ones, and labels."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.1, 0.9, (n_variants, 1))
    scale = (1 - fst) / fst
    own = rng.beta(p * scale, (1 - p) * scale, (n_variants, k))
    return np.concatenate([rng.binomial(2, own[:, [i]], (n_variants, n_each)) for i in range(k)], axis=1).astype(float), [f"pop{i}" for i in range(k) for _ in range(n_each)]


def genotype_table(spark: SparkSession, g: np.ndarray, chrom: str = "1", step: int = 1000) -> DataFrame:
    rows = [(chrom, (i + 1) * step, f"v{i}", "A", "G", [None if np.isnan(x) else float(x) for x in row]) for i, row in enumerate(g)]
    return spark.createDataFrame(rows, "chrom string, pos long, variant_id string, counted_allele string, other_allele string, dosage array<double>")


def assays(spark: SparkSession, n: int, planted: dict[str, float], n_features: int = 20, n_lineages: int = 8, low: float = -2.0, high: float = 2.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Features (feature_id, feature_type, g array) and samples with bounds on a value that planted features raise; values past low and high are censored."""
    rng = np.random.default_rng(seed)
    lineage = rng.integers(0, n_lineages, n)
    base = rng.random((n_lineages, n_features + len(planted)))
    g = (rng.random((n, base.shape[1])) < 0.15 + 0.7 * base[lineage]).astype(float)
    names = [*[f"bg{i}" for i in range(n_features)], *planted]
    value = np.round(rng.normal(0, 1, n) + g[:, n_features:] @ np.array(list(planted.values())))
    lo, hi = np.where(value <= low, -np.inf, np.minimum(value, high)), np.where(value >= high, np.inf, np.maximum(value, low))
    features = spark.createDataFrame([(name, "gene", g[:, j].tolist()) for j, name in enumerate(names)], "feature_id string, feature_type string, g array<double>")
    samples = spark.createDataFrame([(i, f"ST{lineage[i]}", float(lo[i]), float(hi[i]), "discovery") for i in range(n)], "sample_idx int, mlst string, log2_lower double, log2_upper double, cohort_tier string")
    return features, samples
