"""Criteria by which results count as validated, and comparisons with other results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import neglog10p

# Registered criteria.
MIN_BALANCED_ACCURACY, MIN_SEX, LAMBDA_WITHIN, MIN_SAME, MIN_PAIRS, FLIPPED = 0.90, 0.99, 0.10, 0.90, 100, 0.10
MAX_RELATIVE, MAX_LOG_P, LOG_P_COMPARED = 1e-4, 5e-3, 30.0


def differences(pairs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """max_rel: the largest difference relative to theirs; max_abs: of -log10 p, where theirs is under 30."""
    a, b = F.col(ours), F.col(theirs)
    rel = F.max(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12)))
    logs = F.max(F.when(neglog10p(b) < LOG_P_COMPARED, F.abs(neglog10p(a) - neglog10p(b))))
    return pairs.agg(rel.alias("max_rel"), logs.alias("max_abs"))


def benchmark(ours: DataFrame, theirs: DataFrame) -> dict:
    """Agreement of two scans (variant, effect, se, p): every variant in both, effects, errors and p within limits."""
    from .joins import compared

    a = ours.select("variant", F.col("effect").alias("effect_a"), F.col("se").alias("se_a"), F.col("p").alias("p_a"))
    b = theirs.select("variant", F.col("effect").alias("effect_b"), F.col("se").alias("se_b"), F.col("p").alias("p_b"))
    both = compared(a, b, "variant")
    rel = lambda x: F.max(F.abs(F.col(f"{x}_a") - F.col(f"{x}_b")) / F.greatest(F.abs(f"{x}_b"), F.lit(1e-12)))
    logs = F.max(F.when(neglog10p(F.col("p_b")) < LOG_P_COMPARED, F.abs(neglog10p(F.col("p_a")) - neglog10p(F.col("p_b")))))
    r = both.agg(F.count_if(F.col("side") == "both").alias("n"), F.count_if(F.col("side") != "both").alias("unmatched"), rel("effect").alias("effect"), rel("se").alias("se"), logs.alias("log_p")).first()
    ok = r.n > 0 and r.unmatched == 0 and r.effect <= MAX_RELATIVE and r.se <= MAX_RELATIVE and (r.log_p or 0) <= MAX_LOG_P
    return {"status": "PASS" if ok else "FAIL", "n_compared": r.n, "n_unmatched": r.unmatched, "max_rel_effect": r.effect, "max_rel_se": r.se, "max_abs_neglog10p": r.log_p}


def replicated_key(key: DataFrame, pairs: DataFrame) -> dict:
    """Directions of registered pairs (gene_id, snp_id, rho) among ours (gene_id, variant, effect, p); a flip is flagged, never undone."""
    k = key.dropDuplicates(["gene_id", "snp_id"]).select("gene_id", F.col("snp_id").alias("variant"), "rho")
    p = pairs.dropDuplicates(["gene_id", "variant"]).select("gene_id", "variant", "effect")
    same = (F.signum("rho") == F.signum("effect")).cast("double")
    n, rate = k.join(p, ["gene_id", "variant"]).agg(F.count(F.lit(1)), F.avg(same)).first()
    status = "FAIL" if n < MIN_PAIRS else "PASS" if rate >= MIN_SAME else "FAIL"
    return {"status": status, "n_pairs": n, "same_direction": rate, "possible_allele_flip": bool(n and rate <= FLIPPED)}


def calibrated(lambdas: DataFrame) -> DataFrame:
    """status by the median of lambda over permuted scans."""
    median = F.median("lambda")
    return lambdas.agg(median.alias("median_lambda"), F.when(F.abs(median - 1) <= LAMBDA_WITHIN, "PASS").otherwise("FAIL").alias("status"))


def status_of(registry: dict, tests: list[str]) -> dict[str, str]:
    """What isn't recorded was not run."""
    return {t: registry.get(t, {}).get("status", "NOT RUN") for t in tests}


def population_structure(points: DataFrame, k: int = 15, n_folds: int = 5) -> dict:
    """Whether labels follow from neighbours among components: points (id, label, v array of five components)."""
    from .classify import accuracy, neighbour_vote, silhouette, with_folds

    smallest = points.groupBy("label").count().agg(F.min("count")).first()[0]
    folds, k = min(n_folds, smallest), min(k, smallest - 1)
    if folds < 2 or k < 1:
        return {"status": "FAIL", "balanced_accuracy": None, "silhouette": None}
    r = accuracy(neighbour_vote(with_folds(points, folds), k)).first()
    s = silhouette(points).first()[0]
    return {"status": "PASS" if r.balanced_accuracy >= MIN_BALANCED_ACCURACY else "FAIL", "accuracy": r.accuracy, "balanced_accuracy": r.balanced_accuracy, "silhouette": s}


def sex_check(concordance: DataFrame) -> dict:
    n, rate = concordance.select("n_compared", "concordance").first()
    return {"status": "PASS" if n and rate >= MIN_SEX else "FAIL", "n_compared": n, "concordance": rate}


def score_checks(checks: dict[str, bool], empirical_p: float, ci_low: float, alpha: float = 0.05) -> dict:
    """The status speaks of the implementation alone; what the score shows is said beside it."""
    return {"status": "PASS" if checks and all(checks.values()) else "FAIL", "checks": checks, "biological_evidence": bool(empirical_p < alpha and ci_low > 0)}


def answer_key(results: DataFrame, clusters: DataFrame, key: DataFrame, auc: float | None, top: int = 20, max_q: float = 0.05, min_auc: float = 0.70) -> dict:
    """A registered determinant among the first clusters (C1) and with a rise (C2), and prediction of lineages held out (C3).

    results: feature_id, status, effect, p_value, q_value; clusters: feature_id, cluster; key: feature_id.
    """
    hits = results.filter((F.col("status") == "ok") & (F.col("q_value") < max_q)).join(clusters, "feature_id")
    first = hits.groupBy("cluster").agg(F.min("p_value").alias("best"))
    found = hits.join(key.select("feature_id").distinct(), "feature_id", "left_semi").orderBy("p_value", "feature_id").limit(1).collect()
    c1 = c2 = False
    rank = None
    if found:
        best = first.filter(F.col("cluster") == found[0].cluster).first().best
        rank = first.filter(F.col("best") < best).count() + 1
        c1, c2 = rank <= top, found[0].effect > 0
    c3 = None if auc is None else auc >= min_auc
    status = "INCOMPLETE" if c3 is None and c1 and c2 else "PASS" if c1 and c2 and c3 else "FAIL"
    return {"status": status, "criteria": {"C1": c1, "C2": c2, "C3": c3}, "cluster_rank": rank}


def overlap_counts(ours: DataFrame, theirs: DataFrame, tested: DataFrame) -> DataFrame:
    """n_ours, n_theirs, n_both and recall of theirs among the tested; each a table of gene_id."""
    a, b, t = (x.select("gene_id").distinct() for x in (ours, theirs, tested))
    sides = t.join(a.withColumn("_a", F.lit(1)), "gene_id", "left").join(b.withColumn("_b", F.lit(1)), "gene_id", "left")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return sides.agg(F.count("_a").alias("n_ours"), F.count("_b").alias("n_theirs"), both.alias("n_both"), F.try_divide(both.cast("double"), F.count("_b")).alias("recall"))
