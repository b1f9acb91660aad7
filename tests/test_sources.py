import math

import numpy as np
import pytest

from helixframe.functions import udfs
from helixframe.operators import censored, classify, validation
from helixframe.sources import config, synthetic


def test_functions_in_sql(spark):
    udfs.register(spark)
    r = spark.sql("select p_t(2.0D, 10.0D) a, p_norm(-1.959963984540054D) b, chi2_isf1(0.05D) c, hwe_exact(3, 4, 2) d, p_norm(cast(null as double)) e").first()
    assert np.allclose([r.a, r.b, r.c], [0.07338803477074039, 0.05, 3.841458820694124]) and 0 < r.d <= 1 and (r.e is None or math.isnan(r.e))


def test_settings_say_where_they_come_from(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("thresholds:\n  a:\n    x: {value: 3, provenance: pre_registered, date: '2026-01-01', rationale: why}\n    y: {value: [1, 2], provenance: source_derived, citation: paper}\n")
    c = config.load(str(path))
    assert config.threshold(c, "a.x") == 3 and config.provenance(spark, c).count() == 2
    with pytest.raises(config.ConfigError):
        config.threshold(c, "a.z")
    path.write_text("thresholds:\n  a: {value: 3, provenance: guess}\n  b: 4\n")
    with pytest.raises(config.ConfigError):
        config.load(str(path))
    with pytest.raises(config.ConfigError):
        config.verified({"status": "UNVERIFIED"})


def test_planted_features_are_found_and_populations_told_apart(spark):
    features, samples = synthetic.assays(spark, 300, {"hit": 1.5}, seed=2)
    found, _ = censored.association(features, samples, None, "b" * 64)
    assert found.first().feature_id == "hit"
    g, labels = synthetic.populations(20, 600, 0.15)
    from helixframe.operators.structure import principal_components

    table = synthetic.genotype_table(spark, g)
    pcs, _ = principal_components(table.select("dosage"), list(range(60)), 5)
    points = spark.createDataFrame([(int(r[0]), labels[int(r[0])], [float(x) for x in r[1:]]) for r in pcs.to_numpy()], "id long, label string, v array<double>")
    out = validation.population_structure(points, k=9)
    assert out["status"] == "PASS" and out["silhouette"] > 0.2
    assert classify.accuracy(points.selectExpr("id", "label", "label as predicted")).first().accuracy == 1.0


def test_forest_finds_the_feature_that_matters(spark):
    r = np.random.default_rng(1)
    rows = [(i, int(a > 0), float(a), float(b), None if i % 9 == 0 else float(c)) for i, (a, b, c) in enumerate(r.normal(size=(160, 3)))]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double, c double")
    importance, auc = classify.forest_importance(df, ["a", "b", "c"], trees=20, repeats=2)
    got = {x.feature: x.importance_mean for x in importance.collect()}
    assert auc > 0.9 and got["a"] > 0.2 > max(got["b"], got["c"])
