"""One-model association scans: effect, error, interval and p of each feature come from one fit.

Features are distributed rows with their values in the order of the samples; the sample side (outcome, covariates) is
small, goes to every task with the code, and is checked against SAMPLE_LIMIT.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import norm_isf, norm_sf, t_isf, t_two_sided
from ..functions.scalar import neglog10p
from ..runtime import ship
from .ranks import adjusted

ALPHA = 0.05
#: Samples times covariates that one design may have, in numbers of 8 bytes.
SAMPLE_LIMIT = 20_000_000
RESULT = "variant string, n long, effect double, se double, ci_low double, ci_high double, stat double, df double, p double, model string, status string, odds_ratio double, or_ci_low double, or_ci_high double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
# Limits of the logistic fit.
ETA, STEPS, TOLERANCE, FAR, TINY_WEIGHT, MAX_EFFECT, MAX_SE = 30.0, 50, 1e-10, 15.0, 1e-10, 12.0, 1e3


@dataclass(frozen=True)
class Design:
    """Outcome and covariates (with the constant first) of all samples, in one order."""

    y: np.ndarray
    base: np.ndarray
    #: How many samples each row stands for; one if not given.
    times: np.ndarray | None = None

    @classmethod
    def of(cls, y, covariates=None) -> Design:
        y = np.asarray(y, float)
        cov = np.empty((len(y), 0)) if covariates is None else np.asarray(covariates, float).reshape(len(y), -1)
        if not np.isfinite(cov).all():
            raise ValueError("covariates have missing values; leave out or impute those samples first")
        if len(y) * (cov.shape[1] + 2) > SAMPLE_LIMIT:
            raise ValueError("the sample side is too large to be sent to every task")
        return cls(y, np.column_stack([np.ones(len(y)), cov]))


def is_binary(y) -> bool:
    known = np.asarray(y, float)
    known = known[~np.isnan(known)]
    return len(known) > 0 and bool(np.isin(known, (0, 1)).all())


def ols_batch(g: np.ndarray, d: Design) -> tuple[np.ndarray, ...]:
    """n, effect, se, df, fitted of features without missing values, from what is left of them beside the covariates."""
    n, k = d.base.shape
    q = np.linalg.qr(d.base)[0]
    x = g - (g @ q) @ q.T
    y = d.y - q @ (q.T @ d.y)
    sxx, df = np.einsum("vn,vn->v", x, x), n - k - 1
    ok = (sxx > 1e-10 * max(n, 1)) & (df >= 1)
    with np.errstate(all="ignore"):
        effect = x @ y / sxx
        rest = np.maximum(y @ y - effect * (x @ y), 0)
        se = np.sqrt(rest / df / sxx)
    return np.full(len(g), n), effect, se, np.full(len(g), float(df)), ok


def logistic_batch(g: np.ndarray, d: Design) -> tuple[np.ndarray, ...]:
    """n, effect, se, df, status of features without missing values: Newton steps for all of them at once."""
    count, k = len(g), d.base.shape[1] + 1
    times = np.ones(len(d.y)) if d.times is None else d.times
    n = int(times.sum())
    status = np.full(count, "no_convergence", object)
    b, error = np.zeros((count, k)), np.full(count, np.nan)
    flat = np.ptp(g, axis=1) == 0 if n else np.ones(count, bool)
    if n < 5 or d.y.min() == d.y.max():
        flat[:] = True
    status[flat] = "degenerate"
    share = times @ d.y / n if n else 0
    b[:, 0] = np.log(share / (1 - share)) if 0 < share < 1 else 0
    before, live = np.full(count, np.inf), np.flatnonzero(~flat)
    for _ in range(STEPS):
        if not len(live):
            break
        own = g[live]
        means = lambda beta: 1 / (1 + np.exp(-np.clip(beta[:, :-1] @ d.base.T + beta[:, -1:] * own, -ETA, ETA)))  # noqa: B023, E731

        def information(w):
            h = np.empty((len(w), k, k))
            h[:, :-1, :-1] = np.einsum("vn,na,nb->vab", w, d.base, d.base, optimize=True)
            h[:, :-1, -1] = h[:, -1, :-1] = (w * own) @ d.base  # noqa: B023
            h[:, -1, -1] = (w * own * own).sum(axis=1)  # noqa: B023
            return h

        mu = means(b[live])
        w = mu * (1 - mu)
        apart = (w < TINY_WEIGHT).any(axis=1) & (np.abs(b[live]).max(axis=1) > FAR)
        h = information(w * times)
        apart |= ~np.isfinite(h).all(axis=(1, 2)) | (np.linalg.matrix_rank(np.nan_to_num(h)) < k)
        status[live[apart]] = "separation"
        live, own, h, mu = live[~apart], own[~apart], h[~apart], mu[~apart]
        if not len(live):
            break
        rest = (d.y - mu) * times
        slope = np.column_stack([rest @ d.base, (rest * own).sum(axis=1)])
        b[live] += np.linalg.solve(h, slope[:, :, None])[:, :, 0]
        mu = np.clip(means(b[live]), 1e-15, 1 - 1e-15)
        deviance = -2 * (np.log(mu) @ (times * d.y) + np.log(1 - mu) @ (times * (1 - d.y)))
        done = np.abs(before[live] - deviance) < TOLERANCE * (np.abs(deviance) + 0.1)
        before[live] = deviance
        if done.any():
            error[live[done]] = np.sqrt(np.linalg.pinv(information(mu * (1 - mu) * times)[done])[:, -1, -1])
            status[live[done]] = "ok"
            live = live[~done]
    effect = b[:, -1]
    with np.errstate(invalid="ignore"):
        status[(status == "ok") & ((np.abs(effect) > MAX_EFFECT) | (error > MAX_SE))] = "separation"
    return np.full(count, n), effect, error, np.full(count, np.nan), status


def rows(variant, n, effect, se, df, status, model: str, alpha: float) -> pa.RecordBatch:
    """All that is reported follows from effect, error and degrees of freedom."""
    status = np.asarray(status, object)
    with np.errstate(all="ignore"):
        fit = (status == "ok") & np.isfinite(effect) & np.isfinite(se) & (se > 0)
        status[(status == "ok") & ~fit] = "degenerate"
        effect, se = np.where(fit, effect, np.nan), np.where(fit, se, np.nan)
        stat = effect / se
        if model == "OLS":
            critical = {x: t_isf(alpha / 2, x) for x in set(df[fit].tolist())}
            half = np.array([critical.get(x, np.nan) for x in df.tolist()]) * se
            p = t_two_sided(stat, df) if len(stat) else stat
            odds = [np.full(len(stat), np.nan)] * 3
        else:
            half = float(norm_isf(alpha / 2)) * se
            p = 2 * norm_sf(np.abs(stat))
            odds = [np.exp(x) for x in (effect, effect - half, effect + half)]
    numbers = [effect, se, effect - half, effect + half, stat, df, p]
    column = lambda x: pa.array(np.asarray(x, float), from_pandas=True)
    return pa.RecordBatch.from_arrays([pa.array(variant, pa.string()), pa.array(np.asarray(n, np.int64)), *map(column, numbers), pa.array([model] * len(stat)), pa.array(status.tolist(), pa.string()), *map(column, odds)], names=NAMES)


def values_of(column: pa.Array, n: int) -> np.ndarray:
    """A batch of feature rows as a matrix; missing values are NaN."""
    flat = column.flatten()
    if len(flat) != len(column) * n:
        raise ValueError(f"each feature needs {n} values, one a sample")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), n)


def fitted(variant: list, g: np.ndarray, d: Design, model: str, alpha: float) -> list[pa.RecordBatch]:
    """Features without missing values together; each of the others on the samples that it has."""
    whole = np.isfinite(g).all(axis=1)
    fit = ols_batch if model == "linear" else logistic_batch
    name = "OLS" if model == "linear" else "logistic-Wald"

    def one(at: np.ndarray, x: np.ndarray, design: Design) -> pa.RecordBatch:
        n, effect, se, df, ok = fit(x, design)
        status = np.where(ok, "ok", "degenerate").astype(object) if model == "linear" else ok
        return rows([variant[i] for i in at], n, effect, se, df, status, name, alpha)

    out = [one(np.flatnonzero(whole), g[whole], d)] if whole.any() else []
    for i in np.flatnonzero(~whole):
        has = np.isfinite(g[i])
        out.append(one(np.array([i]), g[i : i + 1, has], Design(d.y[has], d.base[has])))
    return out


def scan(features: DataFrame, y, covariates=None, model: str = "auto", alpha: float = ALPHA) -> DataFrame:
    """features (variant string, dosage array<double>) to one row each, with neglog10p, bonferroni and fdr_bh.

    model: linear, logistic, or auto, which is logistic where y has only 0 and 1. Features with missing values are fitted
    on the samples that have them. What can't be fitted has a status and no statistics; nothing is dropped.
    """
    if model == "auto":
        model = "logistic" if is_binary(y) else "linear"
    if model not in ("linear", "logistic"):
        raise ValueError(f"unknown model {model!r}")
    d = Design.of(y, covariates)
    if not np.isfinite(d.y).all():
        raise ValueError("the outcome has missing values; leave out those samples first")
    if model == "logistic" and not is_binary(d.y):
        raise ValueError("a logistic outcome is coded 0 and 1")
    ship(features.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield from fitted(part.column("variant").to_pylist(), values_of(part.column("dosage"), len(d.y)), d, model, alpha)

    found = features.select(F.col("variant").cast("string").alias("variant"), F.col("dosage").cast("array<double>").alias("dosage")).mapInArrow(run, RESULT)
    return adjusted(found, "p", "variant").withColumn("neglog10p", neglog10p(F.col("p"))).select(*NAMES, "neglog10p", "bonferroni", "fdr_bh")


def scan_by_sums(cells: DataFrame, samples: DataFrame, outcome: str, covariates: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """The linear scan() of genotypes in long form: cells (variant, sample_id, dosage) and samples (sample_id and the columns named).

    Each variant's sums of products are aggregated, partly before the exchange, so neither a row nor a task holds all
    samples, and the sample side isn't collected; the model is solved from these sums. A variant is fitted on the samples
    whose dosage, outcome and covariates are all there; one without any such cell is there if it has a cell at all, with a
    status. Samples must not repeat.
    """
    ship(cells.sparkSession)
    names = [outcome, *covariates]
    means = samples.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in names)).first()
    # About their means, which leaves effects as they are and keeps sums of squares from cancelling.
    z = [(F.col(c).cast("double") - F.lit(float(means[c] or 0.0))).alias(f"_z{i}") for i, c in enumerate(names)]
    joined = cells.select(F.col("variant").cast("string").alias("variant"), "sample_id", F.col("dosage").cast("double").alias("_x")).join(samples.select("sample_id", *z), "sample_id", "left")
    # 1, covariates, dosage, outcome: products of all pairs.
    columns = [F.lit(1.0), *(F.col(f"_z{i}") for i in range(1, len(names))), F.col("_x"), F.col("_z0")]
    whole = F.lit(True)
    for c in columns:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    width = len(columns)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    sums = joined.groupBy("variant").agg(F.array(*(F.coalesce(F.sum(F.when(whole, columns[i] * columns[j])), F.lit(0.0)) for i, j in pairs)).alias("sums"))

    def solve(batches):
        for b in batches:
            flat = values_of(b.column("sums"), len(pairs))
            m = np.zeros((len(flat), width, width))
            for at, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = flat[:, at]
            k = width - 2
            n, inverse = np.rint(m[:, 0, 0]), np.linalg.pinv(m[:, :k, :k], hermitian=True)
            # What is left of dosage and outcome beside the constant and the covariates.
            left = m[:, k:, k:] - m[:, k:, :k] @ inverse @ m[:, :k, k:]
            sxx, sxy, syy, df = left[:, 0, 0], left[:, 0, 1], left[:, 1, 1], n - k - 1
            ok = (sxx > 1e-10 * np.maximum(n, 1)) & (df >= 1)
            with np.errstate(all="ignore"):
                effect = sxy / sxx
                se = np.sqrt(np.maximum(syy - effect * sxy, 0) / df / sxx)
            yield rows(b.column("variant").to_pylist(), n, effect, se, df, np.where(ok, "ok", "degenerate").astype(object), "OLS", alpha)

    found = sums.mapInArrow(solve, RESULT)
    return adjusted(found, "p", "variant").withColumn("neglog10p", neglog10p(F.col("p"))).select(*NAMES, "neglog10p", "bonferroni", "fdr_bh")


def scan_by_counts(cells: DataFrame, samples: DataFrame, outcome: str, covariates: tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """The logistic scan() of genotypes in long form: cells (variant, sample_id, dosage) and samples (sample_id and the columns named).

    Samples of a variant that are alike in dosage, outcome and covariates count as one row of so many, and the fit takes
    these rows: exact, and where covariates have few values a task holds few rows however many samples there are. A variant is
    fitted on the samples whose values are all there; one without any has a status. Samples must not repeat; the outcome is 0 or 1.
    """
    ship(cells.sparkSession)
    names = [outcome, *covariates]
    side = samples.select("sample_id", *(F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(names)))
    if not side.filter(~F.col("_z0").isin(0.0, 1.0)).isEmpty():
        raise ValueError("a logistic outcome is coded 0 and 1")
    joined = cells.select(F.col("variant").cast("string").alias("variant"), "sample_id", F.col("dosage").cast("double").alias("_x")).join(side, "sample_id", "left")
    columns = ["_x", *(f"_z{i}" for i in range(len(names)))]
    alike = joined.groupBy("variant", *columns).agg(F.count(F.lit(1)).cast("double").alias("_n"))

    def fit(t: pa.Table) -> pa.Table:
        x, y, *z, n = (t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*columns, "_n"))
        has = np.isfinite(np.column_stack([x, y, *z])).all(axis=1)
        d = Design(y[has], np.column_stack([np.ones(has.sum()), *(c[has] for c in z)]), n[has])
        return pa.Table.from_batches([rows([t.column("variant")[0].as_py()], *logistic_batch(x[None, has], d), "logistic-Wald", alpha)])

    found = alike.groupBy("variant").applyInArrow(fit, RESULT)
    return adjusted(found, "p", "variant").withColumn("neglog10p", neglog10p(F.col("p"))).select(*NAMES, "neglog10p", "bonferroni", "fdr_bh")


def simple_regression(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Regression of y on x alone for each key, from sums: n, effect, se, stat, df, status. Pairs with a null are left out."""
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(key).agg(F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    ok = (F.col("sxx") > 1e-10 * F.greatest("n", F.lit(1))) & (F.col("n") > 2)
    effect = F.when(ok, F.col("sxy") / F.col("sxx"))
    se = F.when(ok, F.sqrt(F.greatest(F.col("syy") - effect * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx")))
    return sums.select(key, "n", effect.alias("effect"), se.alias("se"), F.when(ok & (se > 0), effect / se).alias("stat"), (F.col("n") - 2).alias("df"), F.when(ok & (se > 0), "ok").otherwise("degenerate").alias("status"))


def with_metadata(results: DataFrame, meta: DataFrame | None) -> DataFrame:
    """results with what meta says of each variant; chrom is NA and pos the place in the order of variants where meta has no such column."""
    from .ranks import numbered

    out = results if meta is None else results.join(meta, "variant", "left")
    if "chrom" not in out.columns:
        out = out.withColumn("chrom", F.lit("NA"))
    return out if "pos" in out.columns else numbered(out, "variant", name="pos").withColumn("pos", F.col("pos") - 1)


def close(a: Column, b: Column, rtol: float, atol: float = 1e-12) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def inconsistencies(results: DataFrame, alpha: float = ALPHA, rtol: float = 1e-8) -> DataFrame:
    """variant, problem: what doesn't follow from effect, error and degrees of freedom in rows of status ok."""
    ship(results.sparkSession)

    def derive(batches):
        for b in batches:
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            ols = np.array([m == "OLS" for m in b.column("model").to_pylist()], bool)
            stat, df = get("effect") / get("se"), get("df")
            critical = {x: t_isf(alpha / 2, x) for x in set(df[ols].tolist())}
            p = np.where(ols, t_two_sided(stat, np.where(ols, df, 1.0)), 2 * norm_sf(np.abs(stat)))
            c = np.array([critical[x] if o else float(norm_isf(alpha / 2)) for x, o in zip(df.tolist(), ols, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(c)], names=[*b.schema.names, "want_p", "critical"])

    used = results.filter("status = 'ok'").select("variant", "effect", "se", "ci_low", "ci_high", "stat", "df", "p", "model", "odds_ratio")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in used.schema)
    d = used.mapInArrow(derive, kinds + ", want_p double, critical double")
    half = F.col("critical") * F.col("se")
    wrong = lambda ok, text: F.when(~F.coalesce(ok, F.lit(False)), text)
    problems = F.array(
        wrong(close(F.col("stat"), F.col("effect") / F.col("se"), rtol), "stat != effect/se"),
        wrong(close(F.col("p"), F.col("want_p"), rtol, 1e-300), "p-value not derived from effect/se/df"),
        wrong(close(F.col("ci_low"), F.col("effect") - half, rtol) & close(F.col("ci_high"), F.col("effect") + half, rtol), "CI not derived from effect/se/df"),
        F.when(F.col("model").startswith("logistic"), wrong(close(F.col("odds_ratio"), F.exp("effect"), rtol), "OR != exp(effect)")),
    )
    return d.select("variant", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
