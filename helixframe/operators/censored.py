"""Association of features with an outcome that is known exactly, or only to lie below or above a bound.

The Gaussian likelihood of such an outcome is concave in the coefficients over sigma and in 1 over sigma; the fit works
there by Newton steps, and gives coefficients and log sigma with their covariance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_1_sf, log_ndtr, mills, norm_isf, norm_sf
from ..runtime import ship
from .association import values_of
from .ranks import adjusted

MODEL = "interval_censored_gaussian_Wald"
STEPS, TOLERANCE = 100, 1e-8
# Limits of estimates, and of features that are tested.
MAX_COEFFICIENT, MAX_LOG_SIGMA = 50.0, 10.0
MIN_PRESENT, MIN_FREQUENCY, MAX_Q = 5, 0.01, 0.05
RESULT = "feature_id string, feature_type string, n long, n_present long, effect double, se double, ci_low double, ci_high double, z double, p_value double, p_lrt_diagnostic double, unadjusted_effect double, unadjusted_p double, sigma double, model string, status string"


@dataclass(frozen=True)
class Fit:
    beta: np.ndarray
    log_sigma: float
    loglik: float
    cov: np.ndarray
    status: str

    def wald(self) -> tuple[float, float, float]:
        """Estimate, error and z of the last coefficient."""
        k = len(self.beta) - 1
        v = self.cov[k, k]
        se = math.sqrt(v) if v > 0 else math.nan
        return float(self.beta[-1]), se, float(self.beta[-1]) / se if se > 0 else math.nan


class Outcome:
    """Bounds on each sample's value; equal bounds are an exact value."""

    def __init__(self, low, high) -> None:
        self.low, self.high = np.asarray(low, float), np.asarray(high, float)
        self.left, self.right = np.isneginf(self.low), np.isposinf(self.high)
        if (self.left & self.right).any():
            raise ValueError("a value without any bound says nothing")
        self.exact = ~self.left & ~self.right
        self.sign = np.where(self.left, 1.0, -1.0)  # of the bound in the argument of the distribution function
        self.at = np.where(self.left, self.high, self.low)

    def guess(self) -> np.ndarray:
        """Where a fit starts: a unit beyond each bound."""
        return self.at - np.where(self.exact, 0.0, self.sign)

    def derivatives(self, gamma: np.ndarray, theta: float, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and Hessian in (gamma, theta) = (beta, 1) / sigma, where residuals are theta * y - x @ gamma."""
        r = theta * self.at - x @ gamma
        e, s = self.exact, self.sign
        u = s * r
        ratio = mills(np.clip(u, -1e6, 37.0))
        value = math.log(theta) * e.sum() + np.where(e, -0.5 * r * r - 0.5 * math.log(2 * math.pi), log_ndtr(u)).sum()
        first = np.where(e, -r, s * ratio)
        second = np.where(e, -1.0, -ratio * (u + ratio))
        z = np.column_stack([-x, self.at])  # derivative of r
        grad, hess = z.T @ first, (z * second[:, None]).T @ z
        grad[-1] += e.sum() / theta
        hess[-1, -1] -= e.sum() / theta**2
        return float(value), grad, hess


def fit_censored(y: Outcome, x: np.ndarray, start: Fit | None = None) -> Fit:
    """Maximum likelihood of y ~ x; start: the fit of the same y without the last column of x."""
    k = x.shape[1]
    if start is None:
        guess = y.guess()
        beta = np.linalg.lstsq(x, guess, rcond=None)[0]
        search = censored_search(beta, max(float(np.std(guess - x @ beta)), 1e-3), len(x))
    else:
        search = censored_search(*started(start, k), len(x))
    point = next(search)
    while True:
        try:
            point = search.send(y.derivatives(point[:k], point[k], x))
        except StopIteration as end:
            return end.value


def started(start: Fit, k: int) -> tuple[np.ndarray, float]:
    """Where a fit of k coefficients starts from one of fewer."""
    return np.append(start.beta, np.zeros(k - len(start.beta))), math.exp(start.log_sigma)


def censored_search(beta: np.ndarray, sigma: float, n: int):
    """The Newton steps of a fit of n samples: gives points (gamma, theta), takes their value, gradient and Hessian, and ends with the Fit.

    It doesn't know the samples, so these may be one array or lie in many tasks.
    """
    k = len(beta)
    point = np.append(beta, 1.0) / sigma
    status, damping = "no_convergence", 0.0
    value, grad, hess = yield point
    for _ in range(STEPS):
        if np.abs(grad).max() < TOLERANCE * max(1.0, n):
            status = "ok"
            break
        try:
            step = np.linalg.solve(-hess + (damping + 1e-10) * np.eye(k + 1), grad)
        except np.linalg.LinAlgError:
            status = "degenerate"
            break
        if not np.isfinite(step).all():
            status = "degenerate"
            break
        size, moved = 1.0, False
        while size > 1e-6:
            new = point + size * step
            if new[k] > 0:
                value2, grad2, hess2 = yield new
                if np.isfinite(value2) and np.isfinite(grad2).all() and np.isfinite(hess2).all() and value2 >= value - 1e-12:
                    point, value, grad, hess, moved = new, value2, grad2, hess2, True
                    break
            size /= 2
        damping = damping / 10 if moved else max(1e-3, damping * 10)
        if damping > 1e6:
            break
    if status == "no_convergence" and np.abs(grad).max() <= 1e-3 * max(1.0, n) and damping <= 1e6 and np.abs(grad).max() < 1e-5 * n:
        status = "ok"
    sigma = 1 / point[k]
    beta, log_sigma = point[:k] * sigma, math.log(sigma)
    # d(gamma, theta) / d(beta, log sigma): at a maximum the Hessian is carried over by it.
    turn = np.zeros((k + 1, k + 1))
    turn[:k, :k] = np.eye(k) / sigma
    turn[:k, k], turn[k, k] = -beta / sigma, -1 / sigma
    cov = np.full((k + 1, k + 1), np.nan)
    try:
        cov = np.linalg.inv(-(turn.T @ hess @ turn))
        if status == "ok" and (not np.isfinite(cov).all() or (np.diag(cov) <= 0).any()):
            status = "degenerate"
    except np.linalg.LinAlgError:
        status = "degenerate" if status == "ok" else status
    if status == "ok" and (np.abs(beta).max() > MAX_COEFFICIENT or abs(log_sigma) > MAX_LOG_SIGMA):
        status = "separation_or_extreme"
    return Fit(beta, log_sigma, value, cov, status)


def reason_by_counts(present: Column, n: Column, min_present: int = MIN_PRESENT, min_frequency: float = MIN_FREQUENCY) -> Column:
    """Why a feature that `present` of n samples have isn't tested: constant or frequency_filter; null if it is."""
    fewer = F.least(present, n - present)
    return F.when(fewer == 0, "constant").when((fewer < min_present) | (fewer / n.cast("double") < min_frequency), "frequency_filter")


def filter_reason(values: str = "g", min_present: int = MIN_PRESENT, min_frequency: float = MIN_FREQUENCY) -> Column:
    """Why a feature (an array of numbers) isn't tested: missing_values, constant or frequency_filter; null if it is."""
    g = F.col(values)
    missing = F.exists(g, lambda v: v.isNull() | F.isnan(v))
    present = F.size(F.filter(g, lambda v: v != 0))
    binary = F.forall(g, lambda v: v.isin(0.0, 1.0))
    return F.when(missing, "missing_values").when(F.array_min(g) == F.array_max(g), "constant").when(binary, reason_by_counts(present, F.size(g), min_present, min_frequency))


def require_tier(pheno: DataFrame, tier: str, who: str) -> None:
    other = [r[0] for r in pheno.select("cohort_tier").distinct().limit(20).collect()]
    if other != [tier]:
        raise ValueError(f"{who} takes only tier {tier!r}, not {sorted(map(str, other))}")


def association(features: DataFrame, pheno: DataFrame, lineage: np.ndarray | None, answer_key_sha256: str) -> tuple[DataFrame, DataFrame]:
    """Results of tested features (in the order of p), and feature_id, reason of the others.

    features: feature_id, feature_type, g array<double>, in the order of sample_idx of pheno (sample_idx, log2_lower,
    log2_upper, cohort_tier), which must all be of the discovery tier. The hash of the answer key must be given, so that the
    key is known to be older than the scan; the scan doesn't use it.
    """
    if len(answer_key_sha256 or "") != 64:
        raise ValueError("the answer key is registered, by its sha256, before association")
    require_tier(pheno, "discovery", "association")
    samples = pheno.select("sample_idx", "log2_lower", "log2_upper").orderBy("sample_idx").toPandas()
    y, n = Outcome(samples.log2_lower, samples.log2_upper), len(samples)
    ones = np.ones((n, 1))
    base = ones if lineage is None else np.column_stack([ones, lineage])
    null, plain = fit_censored(y, base), fit_censored(y, ones)
    if null.status != "ok":
        raise RuntimeError(f"the model without features failed: {null.status}")
    ship(features.sparkSession)
    critical = float(norm_isf(0.025))

    def run(batches):
        for b in batches:
            g, out = values_of(b.column("g"), n), []
            for i, (name, kind) in enumerate(zip(b.column("feature_id").to_pylist(), b.column("feature_type").to_pylist(), strict=True)):
                f, u = (fit_censored(y, np.column_stack([x, g[i]]), start) for x, start in ((base, null), (ones, plain)))
                (effect, se, z), (raw, _, zu) = f.wald(), u.wald()
                p = [2 * float(norm_sf(abs(v))) if math.isfinite(v) else None for v in (z, zu)]
                lrt = float(chi2_1_sf(max(0.0, 2 * (f.loglik - null.loglik))))
                out.append((name, kind, n, int((g[i] != 0).sum()), effect, se, effect - critical * se, effect + critical * se, z, p[0], lrt, raw, p[1], math.exp(f.log_sigma), MODEL, f.status))
            if out:
                clean = [[None if isinstance(v, float) and math.isnan(v) else v for v in c] for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(clean, KINDS, strict=True)], names=NAMES)

    judged = features.withColumn("reason", filter_reason())
    found = judged.filter("reason is null").select("feature_id", "feature_type", "g").mapInArrow(run, RESULT)
    ok = F.when(F.col("status") == "ok", F.col("p_value"))
    out = adjusted(found.withColumn("_p", ok), "_p", "feature_id").withColumnsRenamed({"fdr_bh": "q_value", "bonferroni": "bonferroni_p"}).drop("_p")
    control = "lineage_fixed_effects" if lineage is not None else "none"
    out = out.withColumns({"lineage_adjusted": F.lit(lineage is not None), "structure_control": F.lit(control)})
    return out.orderBy(F.col("p_value").asc_nulls_last(), "feature_id"), judged.filter("reason is not null").select("feature_id", "reason")


NAMES = [c.split()[0] for c in RESULT.split(", ")]
KINDS = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in RESULT.split(", ")]


def replication(hits: DataFrame, features: DataFrame, pheno: DataFrame, lineage: np.ndarray | None, max_q: float = MAX_Q) -> DataFrame:
    """Each discovery hit (status ok, q_value under max_q) tested by the same model in the replication tier.

    A hit without usable feature there is not_testable. It is replicated if the fit is ok, the direction the same and p
    under 0.05 over the number of all hits.
    """
    require_tier(pheno, "replication", "replication")
    chosen = hits.filter((F.col("status") == "ok") & (F.col("q_value") < max_q)).select("feature_id", F.col("effect").alias("discovery_effect"), F.col("q_value").alias("discovery_q"))
    limit = 0.05 / max(chosen.count(), 1)
    tested = features.filter(~F.coalesce(filter_reason(min_present=0, min_frequency=0).isin("missing_values", "constant"), F.lit(False)))
    samples = pheno.select("sample_idx", "log2_lower", "log2_upper").orderBy("sample_idx").toPandas()
    y = Outcome(samples.log2_lower, samples.log2_upper)
    ones = np.ones((len(samples), 1))
    base = ones if lineage is None else np.column_stack([ones, lineage])
    null, critical = fit_censored(y, base), float(norm_isf(0.025))
    ship(features.sparkSession)

    def run(batches):
        for b in batches:
            g, out = values_of(b.column("g"), len(samples)), []
            for i, name in enumerate(b.column("feature_id").to_pylist()):
                f = fit_censored(y, np.column_stack([base, g[i]]), null)
                effect, se, z = f.wald()
                p = 2 * float(norm_sf(abs(z))) if math.isfinite(z) else None
                out.append((name, effect, se, effect - critical * se, effect + critical * se, z, p, int((g[i] != 0).sum()), f.status))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in zip(*out, strict=True)], names=["feature_id", "effect", "se", "ci_low", "ci_high", "z", "p_value", "n_present", "status"])

    fits = tested.join(chosen.select("feature_id"), "feature_id", "left_semi").select("feature_id", "g").mapInArrow(run, "feature_id string, effect double, se double, ci_low double, ci_high double, z double, p_value double, n_present long, status string")
    same = F.signum("effect") == F.signum("discovery_effect")
    out = chosen.join(fits, "feature_id", "left").withColumns({"same_direction": same, "status": F.coalesce("status", F.lit("not_testable"))})
    return out.withColumn("replicated", F.coalesce((F.col("status") == "ok") & same & (F.col("p_value") < limit), F.lit(False)))
