import numpy as np
import pytest

from helixframe.operators import pruning, structure

SCHEMA = "chrom string, pos long, variant string, dosage array<double>"


def linked(m, n, seed, change=0.12):
    """Dosages of m variants by n samples, each much like the one before; some missing, some without variation."""
    rng = np.random.default_rng(seed)
    g = np.empty((m, n))
    g[0] = rng.binomial(2, 0.4, n)
    for j in range(1, m):
        new = rng.random(n) < (0.8 if j % 11 == 0 else change)
        g[j] = np.where(new, rng.binomial(2, 0.4, n), g[j - 1])
    g[5::17] = 1
    g[rng.random(g.shape) < 0.02] = np.nan
    return g


def table(spark, chromosomes, parts=5):
    rows = [(c, 10 * j, f"{c}:{j}", [None if np.isnan(x) else float(x) for x in v]) for c, g in chromosomes.items() for j, v in enumerate(g)]
    return spark.createDataFrame([rows[i] for i in np.random.default_rng(3).permutation(len(rows))], SCHEMA).repartition(parts)


def sequential(chromosomes, reach, limit):
    return {f"{c}:{j}" for c, g in chromosomes.items() for j in structure.thinned(*structure.unit_rows(g), limit, reach)}


@pytest.mark.parametrize("reach, cells, tile, run", [(7, 1, 4, 9), (7, 40 * 25, 256, 1 << 15), (1, 1, 1, 1), (50, 1 << 22, 256, 60)])
def test_blocks_and_runs_give_the_walk(spark, monkeypatch, reach, cells, tile, run):
    for name, value in (("CELLS", cells), ("TILE", tile), ("RUN", run)):
        monkeypatch.setattr(pruning, name, value)
    chromosomes = {"1": linked(140, 40, 1), "2": linked(33, 40, 2), "X": linked(1, 40, 4)}
    found = [r.variant for r in pruning.ld_prune(table(spark, chromosomes), reach, 0.3).collect()]
    assert len(found) == len(set(found)) and set(found) == sequential(chromosomes, reach, 0.3)


def test_a_chain_through_all_runs(spark, monkeypatch):
    """Each variant is correlated with the one before it alone, so each decision waits for the one before."""
    monkeypatch.setattr(pruning, "RUN", 8)
    n = 64
    base = np.random.default_rng(0).normal(size=(n + 1, 4000))
    g = {"c": base[:-1] + base[1:]}
    found = {r.variant for r in pruning.ld_prune(table(spark, g), 3, 0.15).collect()}
    assert found == sequential(g, 3, 0.15) == {f"c:{j}" for j in range(0, n, 2)}


def test_edges_of_the_input(spark):
    one = [1.0, 2.0, 0.0]
    rows = [(None, 1, "a", one), (None, 1, "a", one), ("1", None, "b", one), ("1", 5, "c", [2.0, 0.0, None]), ("1", 6, None, one), ("2", 1, "d", [None, None, None])]
    found = sorted(tuple(r) for r in pruning.ld_prune(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS idx", "2 AS _block")).fillna("-").collect())
    assert found[0][:2] == ("-", "a") and [r[1] for r in found] == ["a", "b"]
    assert pruning.ld_prune(spark.createDataFrame([], SCHEMA)).isEmpty()
    with pytest.raises(ValueError, match="reach"):
        pruning.ld_prune(spark.createDataFrame(rows, SCHEMA), 0)
