import numpy as np
import pytest

from helixframe.operators import eqtl, resampling

GENES = ["a", "b", "c", "flat"]


def cohort(n=150, seed=2, strength=(0.6, 0.2, 0.0)):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(5, 2, (n, 3)), np.full(n, 3.0)])
    y = rng.normal(size=(n, 4))
    y[:, :3] += x[:, :3] * np.array(strength) / 2
    return x, y


def table(spark, x, y, parts=4):
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    return spark.createDataFrame(rows[::-1], "sample_id long, score array<double>, measured array<double>").repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 97, 100, 1000])
def test_places_are_permuted(n):
    keys = resampling.keyed(5, 0, np.arange(30))
    out = resampling.permuted(np.arange(n), n, keys)
    assert (np.sort(out, axis=1) == np.arange(n)).all()
    assert (resampling.permuted(np.arange(n)[::2], n, keys) == out[:, ::2]).all()


def test_permutations_and_counts_are_even():
    n, draws = 6, 24_000
    out = resampling.permuted(np.arange(n), n, resampling.keyed(0, 0, np.arange(draws)))
    for i in range(n):
        assert np.abs(np.bincount(out[:, i], minlength=n) / draws - 1 / n).max() < 0.012
    pairs = np.bincount(out[:, 0] * n + out[:, 1], minlength=n * n)
    assert np.abs(pairs[pairs > 0] / draws - 1 / 30).max() < 0.006 and (pairs > 0).sum() == 30
    counts = resampling.poisson_counts(np.arange(500), resampling.keyed(0, 1, np.arange(400)))
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02
    assert np.abs(np.corrcoef(counts[:20])[np.triu_indices(20, 1)]).max() < 0.25


def test_report_against_plain_computations(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK_SAMPLES", 40)
    monkeypatch.setattr(resampling, "NUMBERS", 900)
    x, y = cohort()
    report, per_gene, draws = resampling.score_evaluation(table(spark, x, y), GENES, 400, 400, seed=3)
    assert len(report.columns) == 16
    got, n = report.first(), len(x)
    r = np.array([np.corrcoef(x[:, g], y[:, g])[0, 1] for g in range(3)])
    assert np.allclose([got.observed_mean_r, got.observed_median_r, got.observed_mean_r2, got.fraction_genes_r_positive], [r.mean(), np.median(r), (r**2).mean(), (r > 0).mean()])
    assert (got.n_samples, got.n_genes_scored, got.n_permutations, got.n_bootstrap, got.seed) == (n, 3, 400, 400, 3)
    genes = {g.gene_id: g for g in per_gene.collect()}
    assert np.allclose([genes[g].r for g in GENES[:3]], r) and genes["flat"].r is None and genes["a"].r_ci_low < r[0] < genes["a"].r_ci_high
    # Each null value is that of its own permutation, and a Poisson draw is the weighted correlation.
    values = {(d.kind, d.i): d.value for d in draws.collect()}
    goes = resampling.permuted(np.arange(n), n, resampling.keyed(3, 0, np.arange(400)))
    weights = resampling.poisson_counts(np.arange(n), resampling.keyed(3, 1, np.arange(400)))
    for d in (0, 63, 64, 399):
        assert values["null", d] == pytest.approx(np.mean([np.corrcoef(x[:, g], y[goes[d], g])[0, 1] for g in range(3)]))
        again = np.repeat(np.arange(n), weights[d].astype(int))
        assert values["boot", d] == pytest.approx(np.mean([np.corrcoef(x[again, g], y[again, g])[0, 1] for g in range(3)]))
    # Moments of the null over all permutations, and the bootstrap of samples drawn with replacement.
    z = lambda m: (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    k = z(x[:, :3]) @ z(y[:, :3]).T / ((n - 1) * 3)
    sd = np.sqrt((k**2).sum() / (n - 1))
    assert abs(got.null_mean) < 4 * sd / 20 and abs(got.null_sd / sd - 1) < 0.15 and got.empirical_p_one_sided == 1 / 401
    plain = eqtl.resampled(spark, eqtl.mean_correlation(x[:, :3], y[:, :3]), n, 1, 400).filter("kind = 'boot'").toPandas().value
    assert abs(np.std([v for (kind, _), v in values.items() if kind == "boot"]) / plain.std() - 1) < 0.2
    assert np.allclose(got.bootstrap_ci95_mean_r, np.percentile(plain, [2.5, 97.5]), atol=0.03)


def test_draws_do_not_depend_on_partitions(spark, monkeypatch):
    x, y = cohort(60, strength=(0, 0, 0))
    found = []
    for parts, block in ((1, 1000), (6, 13)):
        monkeypatch.setattr(resampling, "BLOCK_SAMPLES", block)
        draws = resampling.score_evaluation(table(spark, x, y, parts), GENES, 20, 20)[2]
        found.append([d.value for d in draws.orderBy("kind", "i").collect()])
    assert np.allclose(*found) and len(found[0]) == 40


def test_what_is_refused(spark):
    x, y = cohort(5)
    with pytest.raises(ValueError, match="two samples"):
        resampling.score_evaluation(table(spark, x[:1], y[:1]), GENES, 1, 1)
    with pytest.raises(ValueError, match="vary"):
        resampling.score_evaluation(table(spark, x[:, 3:], y[:, 3:]), ["flat"], 1, 1)
    x[2, 1] = np.nan
    with pytest.raises(ValueError, match="missing"):
        resampling.score_evaluation(table(spark, x, y), GENES, 1, 1)


def test_query_on_every_sample(spark):
    from helixframe.plans.queries import QUERIES, scored_samples

    path = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{path}/customer.parquet").count()
    got, rows = QUERIES["m26_score_evaluation"](spark, path).first(), scored_samples(spark, path).toPandas()
    x, y = np.array(rows.score.tolist()), np.array(rows.measured.tolist())
    r = np.array([np.corrcoef(x[:, g], y[:, g])[0, 1] for g in range(x.shape[1])])
    assert got.n_samples == n and got.observed_mean_r == pytest.approx(r.mean()) and got.n_permutations == got.n_bootstrap == 1000
    z = lambda m: (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    k = z(x) @ z(y).T / ((n - 1) * x.shape[1])
    assert abs(got.null_mean) < 0.2 * got.null_sd and abs(got.null_sd / np.sqrt((k**2).sum() / (n - 1)) - 1) < 0.1
