"""Queries that SQL can't say, held against plain computations on the same tables."""

import math
import os

import numpy as np
import pytest

import helixframe.plans.relational  # noqa: F401
from helixframe.operators import prediction as P
from helixframe.operators.censored import Outcome
from helixframe.plans import queries as Q
from helixframe.plans import views as V

SMALLEST = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")


@pytest.fixture(scope="module")
def tables(spark):
    """Samples in order, and a matrix of dosages by sample and variant, NaN where missing."""
    samples = V.pheno(spark, SMALLEST).orderBy("sample_id").toPandas()
    place = {s: i for i, s in enumerate(samples.sample_id)}
    g = np.full((len(samples), V.N_VARIANTS), np.nan)
    for r in V.geno(spark, SMALLEST).collect():
        g[place[r.sample_id], r.variant_id] = r.dosage
    return samples, g


def bounds(samples):
    v, k = samples.y.to_numpy() / 3000, samples.sample_id.to_numpy() % 3
    return np.where(k == 1, -np.inf, v), np.where(k == 2, np.inf, v)


def likelihood(p, x, low, high):
    """By the definition: densities of exact values, and probabilities of the rest, one sample after another."""
    *b, log_sigma = p
    s, total = math.exp(log_sigma), 0.0
    for row, a, z in zip(x, low, high, strict=True):
        m = float(np.dot(b, row))
        if math.isinf(a):
            total += math.log(0.5 * math.erfc(-(z - m) / s / math.sqrt(2)))
        elif math.isinf(z):
            total += math.log(0.5 * math.erfc((a - m) / s / math.sqrt(2)))
        else:
            total += -0.5 * ((a - m) / s) ** 2 - log_sigma - 0.5 * math.log(2 * math.pi)
    return total


def slopes(f, p, h=1e-4):
    """Gradient and Hessian by differences."""
    n, e = len(p), np.eye(len(p)) * h
    grad = np.array([(f(p + e[i]) - f(p - e[i])) / (2 * h) for i in range(n)])
    hess = np.array([[(f(p + e[i] + e[j]) - f(p + e[i] - e[j]) - f(p - e[i] + e[j]) + f(p - e[i] - e[j])) / (4 * h * h) for j in range(n)] for i in range(n)])
    return grad, hess


def climbed(f, p):
    for _ in range(30):
        grad, hess = slopes(f, p)
        step = np.linalg.solve(hess, -grad)
        p = p + step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return p, slopes(f, p)[1]


def test_censored_association_and_replication(spark, tables):
    samples, g = tables
    low, high = bounds(samples)
    found = {r.feature_id: r for r in Q.QUERIES["m7_censored_association"](spark, SMALLEST).collect()}
    again = {r.feature_id: r for r in Q.QUERIES["m8_replication"](spark, SMALLEST).collect()}
    assert found and set(again) == {k for k, r in found.items() if r.status == "ok"} and again["7"].status == "not_testable"
    for name in sorted(found)[:4]:
        x = np.column_stack([np.ones(len(g)), np.where(g[:, int(name)] == 2, 1.0, 0.0)])
        p, hess = climbed(lambda q: likelihood(q, x, low, high), np.array([low[np.isfinite(low)].mean(), 0.0, 0.0]))  # noqa: B023
        r = found[name]
        assert r.effect == pytest.approx(p[1], abs=1e-5) and r.sigma == pytest.approx(math.exp(p[2]), abs=1e-5)
        assert r.se == pytest.approx(math.sqrt(np.linalg.inv(-hess)[1, 1]), rel=1e-4)
        assert r.p_value == pytest.approx(math.erfc(abs(r.effect / r.se) / math.sqrt(2)), rel=1e-8)
        if name != "7":
            assert again[name].effect == pytest.approx(p[1], abs=1e-5) and again[name].same_direction


def test_logistic_scan(spark, tables):
    samples, g = tables
    y, found = samples.case_flag.to_numpy(float), {r.variant: r for r in Q.QUERIES["m3_logistic_scan"](spark, SMALLEST).collect()}
    assert len(found) == V.N_VARIANTS and sum(r.status == "ok" for r in found.values()) > 40
    for name, r in found.items():
        if r.status != "ok":
            continue
        has = np.isfinite(g[:, int(name)])
        x, b = np.column_stack([np.ones(has.sum()), samples.nation[has], g[has, int(name)]]), np.zeros(3)
        for _ in range(60):  # reweighted least squares
            p = 1 / (1 + np.exp(-x @ b))
            w = p * (1 - p)
            b = np.linalg.solve((x * w[:, None]).T @ x, x.T @ (w * (x @ b) + y[has] - p))
        se = math.sqrt(np.linalg.inv((x * w[:, None]).T @ x)[2, 2])
        assert r.n == has.sum() and r.effect == pytest.approx(b[2], abs=1e-6) and r.se == pytest.approx(se, rel=1e-5)
        assert r.p == pytest.approx(math.erfc(abs(b[2] / se) / math.sqrt(2)), rel=1e-4)


def test_cis_scan(spark):
    from helixframe.operators.eqtl import seed_of

    e, genes, variants = Q.expression(spark, SMALLEST)
    e, genes, variants = (df.toPandas() for df in (e, genes, variants))
    found = {r.gene_id: r for r in Q.QUERIES["m22_cis_scan"](spark, SMALLEST).collect()}
    ys = {k: np.array(y, float) for k, y in zip(e.gene_id, e.y, strict=True)}
    checked = 0
    for gene in genes.itertuples():
        near = [v for v in variants.itertuples() if v.chrom == gene.chrom and abs(v.pos - gene.tss) <= 20_000]
        near.sort(key=lambda v: (v.pos, v.variant_id))
        if gene.gene_id not in ys or not near:
            assert gene.gene_id not in found
            continue
        y, g = ys[gene.gene_id], np.array([v.dosage for v in near], float)
        with np.errstate(all="ignore"):
            r = np.array([np.corrcoef(x, y)[0, 1] for x in g])
        if not np.isfinite(r).any():
            continue
        hit, n = found[gene.gene_id], len(y)
        t = r * np.sqrt((n - 2) / (1 - r * r))
        best = int(np.nanargmax(np.abs(t)))
        assert hit.best_variant == str(near[best].variant_id) and hit.effect / hit.se == pytest.approx(t[best], rel=1e-6)
        rng, use = seed_of(gene.gene_id, 0), np.isfinite(r)
        most = [max(abs(np.corrcoef(x, y[order])[0, 1]) for x in g[use]) for order in (rng.permutation(n) for _ in range(200))]
        assert hit.empirical_p == pytest.approx((1 + sum(m >= np.abs(r[use]).max() - 1e-12 for m in most)) / 201, abs=1.5 / 201)
        checked += 1
    assert checked == len(found) > 0


def test_random_folds(spark):
    rows = Q.QUERIES["w12_random_folds"](spark, SMALLEST)
    by_hash = [r.sample_id for r in rows.selectExpr("sample_id", "xxhash64(sample_id, 0) AS h").orderBy("h", "sample_id").collect()]
    fold = {r.sample_id: r.fold for r in rows.collect()}
    assert [fold[s] for s in by_hash] == [i % 5 for i in range(len(by_hash))] and len(by_hash) == V.pheno(spark, SMALLEST).count()


def test_ridge_tobit(spark, tables):
    samples, g = tables
    y = Outcome(*bounds(samples))
    a = np.column_stack([np.ones(len(g)), np.where(g == 2, 1.0, 0.0)])
    model = np.array([r.value for r in Q.QUERIES["m10_ridge_tobit"](spark, SMALLEST).collect()])
    value, grad, hess = P.tobit_penalised(model, y.derivatives(*P.tobit_scaled(model), a), 10.0)
    assert np.abs(grad).max() < 1e-6 * len(g) and np.linalg.eigvalsh(hess).max() < 0
    assert value == pytest.approx(likelihood(model, a, y.low, y.high) - 5 * float(model[1:-1] @ model[1:-1]), rel=1e-9)


def test_elastic_net(spark, tables):
    samples, g = tables
    low, high = bounds(samples)
    y = np.where(np.isneginf(low) & (high < Q.CUTS[0]), 0.0, np.where(np.isposinf(high) & (low > Q.CUTS[1]), 1.0, np.nan))
    known = ~np.isnan(y)
    a = np.column_stack([np.ones(known.sum()), np.where(g[known] == 2, 1.0, 0.0)])
    rows = Q.QUERIES["m11_elastic_net"](spark, SMALLEST).collect()
    assert len(rows) == 3 * (V.N_VARIANTS + 1) and 0 < y[known].mean() < 1
    for c in (0.01, 0.1, 1.0):
        b = np.array([r.value for r in rows if r.setting == c])
        w = c * np.where(y[known] == 1, *P.class_weights((y == 0).sum(), (y == 1).sum())[::-1])
        assert P.net_residual(b, P.net_loss(a, y[known], w, b)[1], P.L1_RATIO) < 1e-6


def test_nested_validation(spark, tables):
    samples, g = tables
    low, high = bounds(samples)
    cohort = P.Cohort(np.where(g == 2, 1.0, 0.0), low, high, samples.y.to_numpy() / 3000, samples.nation.to_numpy())
    want = {r.fold: r for r in P.cross_validated(spark, cohort).collect()}
    for r in Q.QUERIES["m12_nested_blocked_cv"](spark, SMALLEST).collect():
        for k in r.asDict():
            assert r[k] == (pytest.approx(want[r.fold][k], abs=1e-5, nan_ok=True) if isinstance(r[k], float) else want[r.fold][k]), (r.fold, k)
