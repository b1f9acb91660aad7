"""Features that lie in sample rows give what they give as arrays of samples, and steps are done once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.scalar import parse_mic
from helixframe.operators import assays, association, censored, evidence, linkage, pruning, rowwise, structure
from helixframe.plans import queries as Q

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dosages():
    """Dosages of 40 features by 120 samples, each much like the one before; some missing, two without variation, one never there."""
    rng = np.random.default_rng(5)
    g = rng.binomial(2, 0.4, (40, 120)).astype(float)
    for j in range(1, 40):
        g[j] = np.where(rng.random(120) < 0.3, g[j], g[j - 1])
    g[rng.random(g.shape) < 0.03] = np.nan
    g[7], g[19], g[23] = 1, 2, np.nan
    return g


def sample_rows(spark, g, **more):
    rows = [(i, [None if np.isnan(x) else float(x) for x in v], *(c[i] for c in more.values())) for i, v in enumerate(g.T)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>" + "".join(f", {k} {'string' if isinstance(c[0], str) else 'double'}" for k, c in more.items())).repartition(5)


def test_pruning_clumping_and_clusters(spark, dosages):
    rows = sample_rows(spark, dosages).withColumnRenamed("x", "dosage")
    unit, varies = structure.unit_rows(dosages)
    assert not varies[[7, 19, 23]].any()
    for reach in (2, 50):
        found = pruning.prune_samples(rows, [("1", j, f"v{j:02d}") for j in range(40)], reach, 0.2).collect()
        assert [r.pos for r in found] == structure.thinned(unit, varies, 0.2, reach)
    with pytest.raises(ValueError, match="reach"):
        pruning.prune_samples(rows, [], 0)
    p = [j * 7 % 11 for j in range(40)]
    arrays = spark.createDataFrame([(j % 3, f"v{j:02d}", float(p[j]), [None if np.isnan(x) else float(x) for x in dosages[j]]) for j in range(40)], "gene_id int, variant string, p double, dosage array<double>")
    want = {tuple(r) for r in structure.ld_clump(arrays, "gene_id", 0.2).collect()}
    assert {tuple(r) for r in pruning.clump_samples(rows, [(j % 3, p[j], f"v{j:02d}") for j in range(40)], 0.2).collect()} == want
    clusters = structure.linkage_clusters(dosages, 0.3)
    assert [r.cluster for r in linkage.clusters_of_samples(rows, [f"v{j:02d}" for j in range(40)], 0.3).collect()] == clusters.tolist()


def test_logistic_scan_by_counts(spark, dosages):
    rng = np.random.default_rng(1)
    z = rng.integers(0, 4, 120).astype(float)
    y = (rng.random(120) < 1 / (1 + np.exp(-(np.nan_to_num(dosages[3]) - 1 + z / 4)))).astype(float)
    arrays = spark.createDataFrame([(str(j), [None if np.isnan(x) else float(x) for x in v]) for j, v in enumerate(dosages)], "variant string, dosage array<double>")
    cells = spark.createDataFrame([(str(j), i, None if np.isnan(x) else float(x)) for j, v in enumerate(dosages) for i, x in enumerate(v)], "variant string, sample_id long, dosage double")
    samples = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, z, strict=True))], "sample_id long, y double, z double")
    want = {r.variant: r for r in association.scan(arrays, y, z[:, None]).collect()}
    found = {r.variant: r for r in association.scan_by_counts(cells, samples, "y", ("z",)).collect()}
    assert set(found) == set(want) and found["23"].status == "degenerate" and found["3"].status == "ok"
    for k, r in found.items():
        for c, v in r.asDict().items():
            assert want[k][c] == (pytest.approx(v, rel=1e-6) if isinstance(v, float) else v), (k, c)
    with pytest.raises(ValueError, match="0 and 1"):
        association.scan_by_counts(cells, samples.withColumn("y", F.col("y") * 2), "y")


@pytest.mark.parametrize("adjusted", [False, True])
def test_censored_association_and_replication(spark, dosages, adjusted):
    rng = np.random.default_rng(2)
    g = np.where(np.isnan(dosages), np.nan, dosages == 2)
    g[30:] = np.nan_to_num(g[30:])
    lineage = rng.integers(0, 2, 120).astype(float)
    y = np.nan_to_num(g[35]) + lineage + rng.normal(size=120)
    low, high = np.where(np.arange(120) % 3 == 1, -np.inf, y), np.where(np.arange(120) % 3 == 2, np.inf, y)
    names = [(f"v{j}", "gene") for j in range(40)]
    arrays = spark.createDataFrame([(*names[j], [None if np.isnan(x) else float(x) for x in g[j]]) for j in range(40)], "feature_id string, feature_type string, g array<double>")
    for tier in ("discovery", "replication"):
        pheno = spark.createDataFrame([(i, float(low[i]), float(high[i]), tier) for i in range(120)], "sample_idx long, log2_lower double, log2_upper double, cohort_tier string")
        rows = sample_rows(spark, np.vstack([g, lineage]), low=low.tolist(), high=high.tolist(), cohort_tier=[tier] * 120)
        column, place = (lineage[:, None], (40,)) if adjusted else (None, ())
        if tier == "discovery":
            want, others = censored.association(arrays, pheno, column, "0" * 64)
            found, left = rowwise.association_rows(rows, names, "0" * 64, place)
            assert {tuple(r) for r in left.collect()} == {tuple(r) for r in others.collect()}
            hits = found.select("feature_id", "status", "effect", "q_value")
        else:
            want = censored.replication(hits, arrays.filter("feature_id <> 'v35'"), pheno, column, 1.1)
            found = rowwise.replication_rows(hits, rows, {n: j for j, (n, _) in enumerate(names) if n != "v35"}, place, 1.1)
            assert {r.feature_id: r.status for r in found.collect()}["v35"] == "not_testable"
        want, found = ({r.feature_id: r.asDict() for r in df.collect()} for df in (want, found))
        assert set(found) == set(want) and len(found) >= 10
        for k, r in found.items():
            for c, v in want[k].items():
                assert r[c] == (pytest.approx(v, rel=1e-4, abs=1e-6) if isinstance(v, float) else v), (k, c)


def test_samples_of_one_partition_are_added_up_there(spark):
    plan = Q.by_sample(spark, SMALLEST)._jdf.queryExecution().toString()
    assert "variant_id" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(sample_id" in x and "variant_id" in x.split("]")[0].split("ENSURE")[0].split("hashpartitioning")[1].split(")")[0]]


def test_a_measurement_is_parsed_once(spark):
    df = spark.createDataFrame([("<=1",)], "measurement string")
    plan = assays.extreme_contrast(assays.parsed(df)).select("extreme_contrast")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1
    assert df.select(parse_mic(F.col("measurement")).alias("m")).select("m.*")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1


def test_rules_are_asked_of_each_kind_of_card(spark, monkeypatch):
    asked = []
    problems = evidence.problems
    monkeypatch.setattr(evidence, "problems", lambda cards: asked.append(cards) or problems(cards))
    hits = spark.range(200).select(F.col("id").alias("feature_id"), F.col("id").cast("double").alias("effect"), F.lit(1.0).alias("se"), F.lit(0.1).alias("p"), (F.col("id") % 2 / 10.0).alias("q_value"), F.lit(1.0).alias("z"), F.lit(True).alias("lineage_adjusted"), F.lit(1).alias("n_present"), F.lit(2).alias("n"))
    context = {"scope": "real", "cohort_tier": "discovery", "breakpoint_status": "UNVERIFIED"}
    assert evidence.build_cards(hits, context).count() == 200 and len(asked) == 1 and asked[0].count() == 2
    wrong = evidence.build_cards(hits, context).withColumn("scope", F.when(F.col("card_id") == "7", "other").otherwise(F.col("scope")))
    with pytest.raises(evidence.EvidenceCardError, match="1 problems.*7: schema: scope"):
        evidence.require_valid(wrong.unionByName(wrong.limit(0)))


def test_the_release_adds_up_genotypes_once(spark, tmp_path, monkeypatch):
    from jobs import association_release as job
    from jobs.common import settings

    seen = []
    metrics = job.qc.sample_metrics
    monkeypatch.setattr(job.qc, "sample_metrics", lambda cells, *rest: seen.append(cells.inputFiles()) or metrics(cells, *rest))
    job.release(spark, SMALLEST, str(tmp_path), settings("association_release"))
    assert seen and seen[0] and all("/tables/" in f and "lineitem" not in f for f in seen[0])
