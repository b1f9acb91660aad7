import numpy as np
import pytest

from helixframe.operators import structure
from helixframe.operators.sums import summed


def cohort(n, m, groups=6, seed=1):
    """Dosages of m variants by n samples of several populations, a few missing."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, groups, n)
    p = np.clip(rng.beta(2, 2, (m, 1)) + rng.normal(0, 0.12, (m, groups)), 0.02, 0.98)
    g = rng.binomial(2, p[:, at]).astype(float)
    g[rng.random((m, n)) < 0.01] = np.nan
    return g


def frame(spark, g, parts=4):
    return spark.createDataFrame([([None if np.isnan(x) else x for x in row],) for row in g.tolist()], "dosage array<double>").repartition(parts)


def test_components_without_pairs_equal_the_dense_ones(spark):
    g = cohort(150, 50)
    features = frame(spark, g)
    dense, share = structure.principal_components(features, list(range(150)), 5)
    pcs, large_share, residual = structure.large_components(features, 150, 5)
    # PCs of the dense form are over the features used; both have the same length and direction.
    assert np.allclose(pcs, dense[[f"PC{i + 1}" for i in range(5)]].to_numpy(), atol=1e-6) and np.allclose(large_share, share, atol=1e-9) and residual.max() < 1e-8


def test_more_samples_than_a_dense_matrix_takes(spark):
    n, m = structure.DENSE_LIMIT + 500, 300
    g = cohort(n, m)
    pcs, share = structure.principal_components(frame(spark, g), list(range(n)), 4)
    z = structure.genotype_scaled(g)
    left, size, right = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(share, size[:4] ** 2 / (size**2).sum(), atol=1e-8)
    assert np.allclose(pcs.iloc[:, 1:].to_numpy(), structure.signed(right[:4].T) * size[:4], atol=1e-4 * size[0])


def test_projection_of_more_features_than_a_dense_matrix_takes(spark, monkeypatch):
    g = cohort(90, 60).T
    rows = spark.createDataFrame([(i, [None if np.isnan(x) else x for x in v]) for i, v in enumerate(g.tolist())], "sample_id long, dosage array<double>").repartition(3)
    found = []
    for limit in (5000, 10):
        monkeypatch.setattr(structure, "DENSE_LIMIT", limit)
        pcs, share = structure.projected_components(rows, 4)
        found.append((np.array([tuple(r)[1:] for r in pcs.orderBy("sample_id").collect()]), share))
    assert np.allclose(found[0][0], found[1][0], atol=1e-6) and np.allclose(found[0][1], found[1][1], atol=1e-9) and found[0][0].shape == (90, 4)


@pytest.mark.parametrize("n, m, k", [(40, 3, 5), (4, 30, 10), (30, 30, 29)])
def test_few_features_or_samples(spark, n, m, k):
    g = cohort(n, m, 2)
    pcs, share, _ = structure.large_components(frame(spark, g), n, k)
    size = np.linalg.svd(structure.genotype_scaled(g), compute_uv=False) ** 2
    assert np.allclose(share, (size / size.sum())[: len(share)], atol=1e-9) and pcs.shape == (n, len(share))


def test_no_usable_feature(spark):
    flat = spark.createDataFrame([([1.0, 1.0],), ([0.0, 0.0],)], "dosage array<double>").filter("dosage[0] = 0")
    assert structure.large_components(flat, 2, 1)[0].shape == (2, 0)
    with pytest.raises(ValueError, match="limit"):
        structure.large_components(flat, 3_000_000, 10)


def test_sums_in_chunks_and_lanes(spark, monkeypatch):
    from helixframe.operators import sums

    monkeypatch.setattr(sums, "LANES", 3)
    size = sums.CHUNK * 2 + 5
    rows = spark.range(1000).repartition(7)
    found = summed(rows, lambda b: np.bincount(b.column(0).to_numpy() * 65, minlength=size).astype(float), size)
    assert found.sum() == 1000 and found[::65][:1000].all() and len(found) == size
    assert (summed(rows.filter("id < 0"), lambda b: np.ones(3), 3) == 0).all()
