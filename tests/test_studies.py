import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import assays, evidence, studies
from helixframe.operators.prediction import Cohort
from helixframe.sources import readers


def test_covariates_refuse_samples_without(spark):
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    parts = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.2, 0.3), (3, 0.0, 0.0)], "sample_id long, PC1 double, PC2 double")
    assert sorted(map(tuple, studies.covariates(samples, parts, 2).collect())) == [(1, 0.5, 0.1), (2, 0.2, 0.3)]
    with pytest.raises(ValueError, match="PC3"):
        studies.covariates(samples, parts, 3)
    with pytest.raises(ValueError, match="samples such as"):
        studies.covariates(samples, parts, 1, spark.createDataFrame([(1, 1)], "sample_id long, imputed int"))


def test_breakpoint_scan_needs_a_verified_breakpoint(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 2, 300).astype(float)
    value = np.where(g + rng.normal(0, 0.7, 300) > 0.5, 64, 2)
    records = assays.parsed(spark.createDataFrame([(i, "discovery", str(int(v))) for i, v in enumerate(value)] + [(300, "discovery", "8")], "sample_idx long, cohort_tier string, measurement string"))
    features = spark.createDataFrame([("a", [*g.tolist(), 1.0]), ("b", [*rng.integers(0, 2, 300).astype(float).tolist(), 0.0])], "variant string, dosage array<double>")
    point = {"status": "VERIFIED", "susceptible_max_mg_l": 4, "resistant_min_mg_l": 32, "verified_by": "x", "source_excerpt": "x"}
    got = {r.variant: r for r in studies.at_breakpoint(features, records, point).collect()}
    assert got["a"].p < 1e-6 < got["b"].p and got["a"].n == 300 and got["a"].effect > 0
    with pytest.raises(assays.BreakpointUnverified):
        studies.at_breakpoint(features, records, point | {"status": "UNVERIFIED"})
    with pytest.raises(Exception, match="replication"):
        studies.at_breakpoint(features, records.withColumn("cohort_tier", F.lit("replication")), point)


def cohort(seed, columns):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (120, len(columns))).astype(float)
    value = 2 * x[:, columns.index("f1")] + rng.normal(0, 0.5, 120)
    low, high = np.where(value < 0.3, -np.inf, np.minimum(value, 1.8)), np.where(value > 1.8, np.inf, np.maximum(value, 0.3))
    return Cohort(x, low, high, value, np.array([f"l{i % 6}" for i in range(120)]))


def test_external_validation_uses_common_features():
    ours, theirs = ["f0", "f1", "f2", "f3"], ["f3", "f9", "f1", "f0"]
    out = studies.external_validation(cohort(1, ours), ours, cohort(2, theirs), theirs)
    assert out["n_features_common"] == 3 and out["n_features_discovery_only"] == 1 and out["cv_strategy"] == "discovery_to_replication" and out["interval_mae"] < 0.6
    with pytest.raises(ValueError):
        studies.external_validation(cohort(1, ours), ours, cohort(2, ["f1"]), ["zz"])
    assert studies.leakage_gap(0.6, 0.8)["gap"] == pytest.approx(0.2)


def test_polygenic_scores_and_their_report(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (90, 5)).astype(float)
    g[rng.random(g.shape) < 0.1] = np.nan
    weight = np.array([0.5, -0.2, 0.1, 0.0, 1.0])
    cells = spark.createDataFrame([(i, str(j), float(v)) for (i, j), v in np.ndenumerate(g) if np.isfinite(v)], "sample_id long, variant string, dosage double")
    samples = spark.range(90).toDF("sample_id")
    weights = studies.chosen_weights(spark.createDataFrame([(str(j), float(w), 0.01 if j != 3 else 0.9, "ok") for j, w in enumerate(weight)], "variant string, effect double, p double, status string"), 0.05)
    got = {r.sample_id: r.score for r in studies.polygenic_scores(cells, samples, weights).collect()}
    want = np.where(np.isfinite(g), g, np.nanmean(g, axis=0)) @ weight
    assert np.allclose([got[i] for i in range(90)], want)
    scored = spark.createDataFrame([(i, float(w)) for i, w in enumerate(want)], "sample_id long, score double")
    truth = spark.createDataFrame([(i, float(w + rng.normal(0, 0.3))) for i, w in enumerate(want)], "sample_id long, y double")
    report = studies.score_report(spark.createDataFrame([(1000,)], "sample_id long"), scored, truth, 50, 50)
    assert report.count() == 1
    with pytest.raises(ValueError, match="leak"):
        studies.score_report(samples, scored, truth)


def test_reports(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1)], "label int, predicted int")
    got = {r["class"]: r for r in studies.class_report(rows).collect()}
    assert got[0].recall == 0.5 and got[1].precision == 0.5 and got[2].f1 == 0 and got[0].accuracy == 0.6 and got[1].balanced_accuracy == pytest.approx(0.5)
    text = studies.methods_report({"V1": "PASS"}, {"scan": ("validated", "V1"), "score": ("experimental", "V9"), "plots": ("none", None)}, {"t": "abc"})
    assert "| scan | validated | V1 | PASS |" in text and "| score | experimental | V9 | NOT RUN |" in text and "manifest t: abc" in text


def test_sources_that_land(spark, tmp_path):
    asked = []

    def get(ids):
        asked.append(ids)
        return [{"genome_id": i, "genome_length": 5} for i in ids]

    ids = [f"562.{i}" for i in range(5)] + ["562.1"]
    files = readers.fetch_metadata(ids, str(tmp_path / "m"), get, batch=2)
    assert len(files) == 3 and [len(x) for x in asked] == [2, 2, 1] and readers.fetch_metadata(ids, str(tmp_path / "m"), None, batch=2) == files
    assert readers.read_pages(spark, str(tmp_path / "m"), {}).count() == 5
    with pytest.raises(readers.PrepError):
        readers.fetch_metadata(["1"], str(tmp_path / "other"))
    with pytest.raises(readers.PrepError):
        readers.fetch_pages(lambda at, n: [{}] * n, str(tmp_path / "p"), 3, most=4)
    (tmp_path / "i.txt").write_text("s1 1\ns2,0\ns3\t1\n")
    assert sorted(map(tuple, readers.read_imputation(spark, str(tmp_path / "i.txt")).collect())) == [("s1", 1), ("s2", 0), ("s3", 1)]
    (tmp_path / "j.txt").write_text("s1 yes\n")
    with pytest.raises(readers.PrepError):
        readers.read_imputation(spark, str(tmp_path / "j.txt"))


def test_nested_keys_and_all_problems(spark):
    assert evidence.nested_keys({"a": {"b": 1}, "c": [{"total_score": 2}, 3]}) == ["a", "a.b", "c", "c[0].total_score"]
    with pytest.raises(evidence.EvidenceCardError) as found:
        row = ("real", "not_established", False, True, True, "none", "discovery", "VERIFIED", [], ["It causes this"], ["nothing"], [])
        evidence.require_valid(spark.createDataFrame([(str(i), *row) for i in range(40)], evidence.CARD))
    assert len(found.value.problems) == 80 + 0


def test_a_built_card_with_a_composite_grade_is_refused(spark):
    hits = spark.createDataFrame([("f", 1.0, 0.1, 1e-9, 1e-8, 10.0, True, 5, 50)], "feature_id string, effect double, se double, p double, q_value double, z double, lineage_adjusted boolean, n_present long, n long")
    context = {"scope": "real", "cohort_tier": "discovery", "breakpoint_status": "UNVERIFIED", "literature": ["a study"]}
    good = spark.createDataFrame([("f", (1, [(2.0,)]))], "feature_id string, assay struct<plate:int,wells:array<struct<rank:double>>>")
    card = evidence.build_cards(hits, context, more=good).first()
    assert card.more.assay.plate == 1 and card.literature_evidence == ["a study"] and "more.assay.wells.rank" in card.extra_keys
    assert card.uncertainty.low == pytest.approx(1 - 0.196) and card.population_adjusted_evidence.significant
    bad = spark.createDataFrame([("f", (1, [(2.0,)]))], "feature_id string, assay struct<plate:int,wells:array<struct<overall_rank:double>>>")
    with pytest.raises(evidence.EvidenceCardError) as found:
        evidence.build_cards(hits, context, more=bad)
    assert found.value.problems == ["f: a composite score or rank"]


def test_synthetic_cards_say_nothing(spark):
    hits = spark.createDataFrame([("f", 1.0, 0.1, 1e-9, 1e-8, 10.0, True, 5, 50)], "feature_id string, effect double, se double, p double, q_value double, z double, lineage_adjusted boolean, n_present long, n long")
    made = evidence.build_cards(hits, {"scope": "synthetic", "cohort_tier": "discovery", "breakpoint_status": "VERIFIED"}).first()
    assert made.allowed_claims == [evidence.DISCLAIMER] and made.frequency == 0.1 and json.loads(json.dumps(made.evidence_missing)) == ["independent replication", "experiment"]


def test_permuted_inflation_equals_one_computed_apart(spark):
    from helixframe.functions.dist import CHI2_1_MEDIAN, chi2_1_isf, t_two_sided
    from helixframe.operators import eqtl

    rng, n = np.random.default_rng(3), 60
    y, g = rng.normal(size=(3, n)), rng.integers(0, 3, (5, n)).astype(float)
    expression = spark.createDataFrame([(f"g{i}", v.tolist()) for i, v in enumerate(y)], "gene_id string, y array<double>")
    genes = spark.createDataFrame([(f"g{i}", "1", 1000) for i in range(3)], "gene_id string, chrom string, tss long")
    variants = spark.createDataFrame([(f"v{i}", "1", 1000 + i, v.tolist()) for i, v in enumerate(g)], "variant_id string, chrom string, pos long, dosage array<double>")
    places = spark.createDataFrame([(list(map(float, range(n))),), (list(map(float, range(n))),)], "y array<double>")
    orders = []
    for draw in range(2):
        alike = [r[0] for r in places.select(eqtl.shuffled("y", 0, draw)).collect()]
        assert alike[0] == alike[1] and sorted(alike[0]) == list(range(n))
        orders.append(np.array(alike[0], int))
    assert (orders[0] != orders[1]).any() and (orders[0] != np.arange(n)).any()
    found = {r["permutation"]: r["lambda"] for r in eqtl.permuted_inflation(expression, genes, variants, n=2).collect()}
    for draw, order in enumerate(orders):
        r = np.array([np.corrcoef(a[order], b)[0, 1] for a in y for b in g])
        p = t_two_sided(r * np.sqrt((n - 2) / (1 - r * r)), n - 2)
        assert found[draw] == pytest.approx(np.median(chi2_1_isf(p)) / CHI2_1_MEDIAN, rel=1e-6)
