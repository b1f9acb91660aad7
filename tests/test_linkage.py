import numpy as np
import pytest

from helixframe.operators import linkage, structure


def groups(n_groups, each, n, seed):
    """Presence of features in n samples: near copies of a few, in mixed order, two that are everywhere, some values missing."""
    rng = np.random.default_rng(seed)
    base = rng.binomial(1, 0.5, (n_groups, n)).astype(float)
    g = np.repeat(base, each, axis=0)
    flip = rng.random(g.shape) < 0.01
    g = np.where(flip, 1 - g, g)[rng.permutation(len(g))]
    g[[3, 8]] = 1
    g[rng.random(g.shape) < 0.005] = np.nan
    return g


def table(spark, g, parts=4):
    rows = [(f"f{j:04d}", [None if np.isnan(x) else float(x) for x in v]) for j, v in enumerate(g)]
    return spark.createDataFrame(rows[::-1], "feature_id string, g array<double>").repartition(parts)


@pytest.mark.parametrize("cells, apart", [(1, 2), (7 * 60, 16), (1 << 21, 16)])
def test_rounds_give_the_walk(spark, monkeypatch, cells, apart):
    monkeypatch.setattr(linkage, "CELLS", cells)
    monkeypatch.setattr(linkage, "APART", apart)
    g = groups(5, 7, 60, 1)
    expected = structure.linkage_clusters(g, 0.8)
    found = sorted((r.feature_id, r.cluster, r.first) for r in linkage.linkage_clusters(table(spark, g), limit=0.8).collect())
    assert [c for _, c, _ in found] == expected.tolist() and 5 <= expected.max() < len(g) - 1
    assert [f for _, _, f in found] == [f"f{np.flatnonzero(expected == c)[0]:04d}" for c in expected]


def test_edges_of_the_input(spark):
    assert linkage.linkage_clusters(table(spark, np.ones((1, 3))).limit(0)).isEmpty()
    rows = [("a", 2, [1.0, 0.0, 1.0]), ("b", 1, [0.0, 1.0, 0.0]), (None, 3, [1.0, 0.0, None]), ("a", 4, [1.0, 1.0, 1.0])]
    found = linkage.linkage_clusters(spark.createDataFrame(rows, "feature_id string, place int, g array<double>").selectExpr("*", "7 AS idx", "8 AS cluster"), "place", limit=0.99)
    assert sorted((str(r.feature_id), r.cluster, r.first) for r in found.collect()) == [("None", 1, None), ("a", 0, "b"), ("a", 2, "a"), ("b", 0, "b")]
