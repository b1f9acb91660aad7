import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import dist
from helixframe.operators import association as A
from helixframe.operators import censored as C
from helixframe.operators import qc, ranks


def test_distributions_against_known_values():
    assert np.allclose(dist.norm_isf([0.025, 1e-10, 0.5, 0.9]), [1.959963984540054, 6.361340902404056, 0, -1.2815515655446004])
    assert np.allclose(dist.t_two_sided([2.0, 12.706204736432095, 0.0], [10, 1, 5]), [0.07338803477074039, 0.05, 1.0], rtol=1e-10)
    assert abs(dist.t_isf(0.025, 1) - 12.706204736432095) < 1e-9 and abs(dist.t_isf(0.025, 1e6) - 1.9599663) < 1e-5
    assert math.isclose(float(dist.chi2_1_isf(0.05)), 3.841458820694124) and math.isclose(float(dist.chi2_1_sf(3.841458820694124)), 0.05)
    x = np.array([-60.0, -10.001, -9.999, -1, 0, 3])
    want = [-1805.0135607, None, None, math.log(0.15865525393145707), math.log(0.5), math.log1p(-0.0013498980316301035)]
    got = dist.log_ndtr(x)
    assert all(w is None or abs(g - w) < 1e-6 for g, w in zip(got, want, strict=True)) and abs(got[1] - got[2]) < 0.03
    assert np.allclose(dist.mills(np.array([0.0, -40.0])), [math.sqrt(2 / math.pi), 40.02496887], rtol=1e-6)


def direct(y, x, base):
    full = np.column_stack([base, x])
    beta, *_ = np.linalg.lstsq(full, y, rcond=None)
    rest = y - full @ beta
    df = len(y) - full.shape[1]
    return beta[-1], math.sqrt(rest @ rest / df * np.linalg.inv(full.T @ full)[-1, -1]), df


@pytest.fixture(scope="module")
def study():
    r = np.random.default_rng(1)
    n = 250
    g = r.binomial(2, 0.3, (8, n)).astype(float)
    cov = r.normal(size=(n, 3))
    y = 0.4 * g[0] + cov @ [0.5, -0.2, 0.3] + r.normal(size=n)
    g[2, 5], g[5, [1, 2, 9, 200]], g[7] = np.nan, np.nan, 1.0
    return g, cov, y


def frame(spark, g):
    rows = [(f"v{i}", [None if math.isnan(x) else float(x) for x in row]) for i, row in enumerate(g)]
    return spark.createDataFrame(rows, "variant string, dosage array<double>")


def test_linear_scan_equals_single_fits(spark, study):
    g, cov, y = study
    got = {r.variant: r for r in A.scan(frame(spark, g), y, cov).collect()}
    assert len(got) == 8 and got["v7"].status == "degenerate" and got["v7"].p is None
    for i in range(7):
        has = np.isfinite(g[i])
        effect, se, df = direct(y[has], g[i, has], np.column_stack([np.ones(has.sum()), cov[has]]))
        r = got[f"v{i}"]
        assert np.allclose([r.effect, r.se, r.df, r.n], [effect, se, df, has.sum()], rtol=1e-9)
        assert np.isclose(r.p, float(dist.t_two_sided(effect / se, df)), rtol=1e-9)
    assert A.inconsistencies(A.scan(frame(spark, g), y, cov)).isEmpty()
    bent = A.scan(frame(spark, g), y, cov).withColumn("p", F.col("p") * 1.01)
    assert {r.problem for r in A.inconsistencies(bent).collect()} == {"p-value not derived from effect/se/df"}
    with pytest.raises(ValueError):
        A.scan(frame(spark, g), np.where(np.arange(250) == 3, np.nan, y), cov)
    with pytest.raises(ValueError):
        A.scan(frame(spark, g), y, np.full((250, 1), np.nan))


def test_logistic_scan(spark, study):
    g, cov, y = study
    case = (y > np.median(y)).astype(float)
    g = g.copy()
    g[6] = case
    got = {r.variant: r for r in A.scan(frame(spark, g), case, cov, "auto").collect()}
    full = np.column_stack([np.ones(250), cov, g[0]])
    b = np.zeros(5)
    for _ in range(60):
        mu = 1 / (1 + np.exp(-full @ b))
        h = full.T @ (full * (mu * (1 - mu))[:, None])
        b += np.linalg.solve(h, full.T @ (case - mu))
    r = got["v0"]
    assert np.allclose([r.effect, r.se], [b[-1], math.sqrt(np.linalg.inv(h)[-1, -1])], rtol=1e-6)
    assert np.isclose(r.odds_ratio, math.exp(r.effect)) and r.model == "logistic-Wald"
    assert got["v6"].status == "separation" and got["v6"].effect is None and got["v7"].status == "degenerate"


def test_censored_fit_without_censoring_is_least_squares_and_derivatives_hold():
    r = np.random.default_rng(3)
    x = np.column_stack([np.ones(120), r.normal(size=(120, 2))])
    y = x @ [1.0, 0.5, -1.0] + r.normal(size=120)
    f = C.fit_censored(C.Outcome(y, y), x)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    assert f.status == "ok" and np.allclose(f.beta, beta, atol=1e-6) and np.isclose(math.exp(f.log_sigma), math.sqrt(rest @ rest / 120), rtol=1e-6)
    assert np.allclose(np.sqrt(np.diag(f.cov)[:3]), np.sqrt(rest @ rest / 120 * np.diag(np.linalg.inv(x.T @ x))), rtol=1e-5)
    low, high = np.where(y < 0, -np.inf, y), np.where(y < 0, 0.0, np.where(y > 2, np.inf, y))
    low = np.where(y > 2, 2.0, low)
    o = C.Outcome(low, high)
    point = np.array([0.7, 0.3, -0.6, 0.9])
    value, grad, hess = o.derivatives(point[:3], point[3], x)
    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        up, down = o.derivatives(*(lambda p: (p[:3], p[3]))(point + step), x), o.derivatives(*(lambda p: (p[:3], p[3]))(point - step), x)
        assert abs((up[0] - down[0]) / 2e-5 - grad[i]) < 1e-3 and np.allclose((up[1] - down[1]) / 2e-5, hess[i], atol=1e-2)
    f = C.fit_censored(o, x)
    assert f.status == "ok" and np.abs(f.beta - [1.0, 0.5, -1.0]).max() < 0.35
    with pytest.raises(ValueError):
        C.Outcome([-np.inf], [np.inf])


def test_censored_association_and_replication(spark):
    r = np.random.default_rng(5)
    n = 200
    g = r.binomial(1, 0.4, (12, n)).astype(float)
    y = 2.0 * g[0] + r.normal(size=n)
    g[1], g[2] = 0.0, 0.0
    g[2, :2], g[3, 0] = 1.0, np.nan
    low = np.where(y < -0.5, -np.inf, np.where(y > 2, 2.0, y))
    high = np.where(y < -0.5, -0.5, np.where(y > 2, np.inf, y))
    features = spark.createDataFrame([(f"f{i}", "gene", [None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(g)], "feature_id string, feature_type string, g array<double>")
    pheno = spark.createDataFrame([(i, float(a), float(b), "discovery") for i, (a, b) in enumerate(zip(low, high, strict=True))], "sample_idx int, log2_lower double, log2_upper double, cohort_tier string")
    found, filtered = C.association(features, pheno, None, "a" * 64)
    rows = found.collect()
    assert rows[0].feature_id == "f0" and 1.5 < rows[0].effect < 2.6 and rows[0].q_value < 1e-6
    assert dict(map(tuple, filtered.collect())) == {"f1": "constant", "f2": "frequency_filter", "f3": "missing_values"}
    for x in rows:
        assert np.isclose(x.z, x.effect / x.se) and np.isclose(x.p_value, 2 * float(dist.norm_sf(abs(x.z)))) and x.ci_low < x.effect < x.ci_high
    with pytest.raises(ValueError):
        C.association(features, pheno, None, "short")
    with pytest.raises(ValueError):
        C.association(features, pheno.withColumn("cohort_tier", F.lit("replication")), None, "a" * 64)
    again = pheno.withColumn("cohort_tier", F.lit("replication"))
    out = {x.feature_id: x for x in C.replication(found, features.filter("feature_id <> 'f9'"), again, None, max_q=1.1).collect()}
    assert out["f0"].replicated and out["f9"].status == "not_testable" and not out["f9"].replicated


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 1)), min_size=1, max_size=40))
def test_adjusted_p_values(spark, p):
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r.i: r for r in ranks.adjusted(df, "p", "i").collect()}
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    m, least, want = len(known), 1.0, {}
    for k in range(m, 0, -1):
        least = min(least, known[k - 1][0] * m / k)
        want[known[k - 1][1]] = least
    for i, v in enumerate(p):
        assert (got[i].fdr_bh is None) == (v is None)
        if v is not None:
            assert math.isclose(got[i].fdr_bh, want[i], abs_tol=1e-12) and math.isclose(got[i].bonferroni, min(v * m, 1), abs_tol=1e-12)


def test_hwe_by_enumeration():
    for n0, n1, n2 in [(10, 20, 10), (25, 0, 25), (50, 10, 1), (3, 4, 2), (100, 50, 8), (0, 0, 5), (7, 1, 0)]:
        n, a = n0 + n1 + n2, 2 * n0 + n1
        weight = {h: math.factorial(n) // (math.factorial((a - h) // 2) * math.factorial(h) * math.factorial(n - h - (a - h) // 2)) * 2**h for h in range(a % 2, min(a, 2 * n - a) + 1, 2)}
        want = sum(w for w in weight.values() if w <= weight[n1]) / sum(weight.values())
        assert math.isclose(qc.hwe_exact(n0, n1, n2), want, rel_tol=1e-9)


def test_kinship_of_a_family(spark):
    r = np.random.default_rng(2)
    p = r.uniform(0.1, 0.9, 3000)
    hap = lambda: (r.random(3000) < p).astype(int)
    m, f = (hap(), hap()), (hap(), hap())
    pick = lambda x: np.where(r.random(3000) < 0.5, x[0], x[1])
    people = {1: sum(m), 2: sum(f), 3: pick(m) + pick(f), 5: hap() + hap()}
    people[4] = people[3]
    cells = spark.createDataFrame([(s, v, int(g)) for s, x in people.items() for v, g in enumerate(x)], "sample_id int, variant_id int, dosage int")
    got = {(x.id1, x.id2): x.kinship for x in qc.king_robust(cells).collect()}
    assert math.isclose(got[3, 4], 0.5) and abs(got[1, 3] - 0.25) < 0.04 and abs(got[1, 2]) < 0.05 and abs(got[1, 5]) < 0.05
    assert {(x.id1, x.id2): x.degree for x in qc.related_pairs(cells).collect()} == {(1, 3): "1st degree", (1, 4): "1st degree", (2, 3): "1st degree", (2, 4): "1st degree", (3, 4): "duplicate/MZ twin"}
