import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.scalar import parse_mic, shown
from helixframe.operators import assays, cohorts, eqtl, evidence, joins, prediction, structure, validation
from helixframe.sources import artifacts, readers


@pytest.mark.parametrize(
    ("raw", "op", "value", "kind"),
    [("<=0.25", "<=", 0.25, "left"), ("<0.25", "<", 0.25, "left"), (">4", ">", 4, "right"), (">=4", ">=", 4, "right"), ("1", "=", 1, "exact"), ("=2", "=", 2, "exact"), ("≤0.25", "<=", 0.25, "left"), ("≥4", ">=", 4, "right"), (" <= 0.25 ", "<=", 0.25, "left"), ("=<8", "<=", 8, "left")]
    + [(x, None, None, "invalid") for x in ("abc", "", None, "<=-1", "0", "<=", "1/2", "nan", "inf", "0,25", "1.", "+1")],
)
def test_parse_mic(spark, raw, op, value, kind):
    r = spark.createDataFrame([(raw,)], "m string").select(parse_mic(F.col("m")).alias("x")).first().x
    assert (r.mic_operator, r.mic_boundary_mg_l, r.censoring) == (op, value, kind)
    if kind == "exact":
        assert r.log2_mic_exact == r.log2_lower == r.log2_upper == math.log2(value) and r.log2_boundary is None
    if kind == "left":
        assert r.log2_lower == -math.inf and r.log2_upper == r.log2_boundary == math.log2(value) and r.log2_mic_exact is None
    assert r.mic_parse_ok == (kind != "invalid") and (r.mic_parse_note == "") == r.mic_parse_ok


def test_two_representations_must_agree(spark):
    rows = [("<=1", "<=", "1", True), ("1", None, "1", True), ("<=1", None, "1", False), (None, ">", "8", True), ("2", "", "x", False)]
    df = spark.createDataFrame(rows, "m string, s string, v string, ok boolean").select("ok", parse_mic(F.col("m"), F.col("s"), F.col("v")).alias("x"))
    assert all(r.ok == r.x.mic_parse_ok for r in df.collect())


def test_ordinal_codes_and_guarded_classes(spark):
    df = assays.parsed(spark.createDataFrame([(x,) for x in ["1", "<=1", ">1", "2", "bad", "<=0.5"]], "measurement string"))
    got = {r.measurement: r.ordinal_code for r in assays.with_ordinal(df).collect()}
    assert got == {"<=0.5": 0, "<=1": 1, "1": 2, ">1": 3, "2": 4, "bad": -1}
    with pytest.raises(assays.BreakpointUnverified):
        assays.interval_class(df, {"status": "UNVERIFIED"})


def test_cohort_guards(spark):
    kept = spark.createDataFrame([("a", "1", "discovery"), ("b", "2", "replication")], "genome_id string, study_pmid string, cohort_tier string")
    cohorts.require_separation(kept, {"1": "discovery", "2": "replication"})
    with pytest.raises(cohorts.CohortSeparationError):
        cohorts.require_separation(kept.union(kept))
    with pytest.raises(cohorts.CohortSeparationError):
        cohorts.require_separation(kept, {"1": "replication", "2": "replication"})
    with pytest.raises(ValueError):
        joins.disjoint_or_refuse(kept, kept, "genome_id")


def test_window_join_has_no_nested_loop(spark):
    genes = spark.createDataFrame([("g1", "chr1", 500), ("g2", "1", 5000)], "gene_id string, chrom string, tss long")
    variants = spark.createDataFrame([(i, "1", i * 100) for i in range(100)], "variant long, chrom string, pos long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = joins.cis_pairs(genes, variants, 300)
        plan = pairs._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.gene_id, r.pos) for r in pairs.collect()) == [("g1", x) for x in range(200, 801, 100)] + [("g2", x) for x in range(4700, 5301, 100)]


def test_components_of_structured_samples(spark):
    r = np.random.default_rng(1)
    p = np.clip(r.uniform(0.1, 0.9, (400, 1)) + r.normal(0, 0.15, (400, 3)), 0.02, 0.98)
    g = np.concatenate([r.binomial(2, p[:, [k]], (400, 30)) for k in range(3)], axis=1).astype(float)
    g[3, 4] = np.nan
    df = spark.createDataFrame([([None if math.isnan(x) else float(x) for x in row],) for row in g], "dosage array<double>")
    pcs, share = structure.principal_components(df, list(range(90)), 4)
    z = structure.genotype_scaled(g)
    u, s, _ = np.linalg.svd(z.T, full_matrices=False)
    assert np.allclose(np.abs(pcs[["PC1", "PC2"]].to_numpy()), np.abs(u[:, :2] * s[:2]), atol=1e-6) and share[0] > share[1] > share[2] * 1.5
    d = np.sqrt(((pcs.to_numpy()[:, None, 1:] - pcs.to_numpy()[None, :, 1:]) ** 2).sum(axis=2))
    back = structure.principal_coordinates(d, 4)
    assert np.allclose(np.sqrt(((back[:, None] - back[None]) ** 2).sum(axis=2)), d, atol=1e-6)


def test_projected_components_are_those_of_all_samples(spark):
    r = np.random.default_rng(5)
    g = r.binomial(2, r.uniform(0.1, 0.9, (12, 1)), (12, 60)).astype(float)
    g[r.random(g.shape) < 0.2] = np.nan
    g[4], g[:, 7] = 2, np.nan
    null = lambda row: [None if math.isnan(x) else float(x) for x in row]
    whole, share = structure.principal_components(spark.createDataFrame([(null(row),) for row in g], "dosage array<double>"), list(range(60)), 4)
    rows = spark.createDataFrame([(i, null(g[:, i])) for i in range(60)], "sample_id long, dosage array<double>").repartition(5)
    found, part = structure.projected_components(rows, 4)
    assert np.allclose(found.toPandas().sort_values("sample_id").to_numpy(), whole.to_numpy()) and np.allclose(part, share)


def test_pruning_and_clusters():
    g = np.array([[0, 1, 2, 0, 1, 2], [0, 1, 2, 0, 1, 2], [2, 2, 0, 1, 0, 0], [1, 1, 1, 1, 1, 1], [0, 1, 2, 0, 1, 1]], float)
    unit, varies = structure.unit_rows(g)
    assert structure.thinned(unit, varies, 0.5) == [0, 2]
    assert structure.thinned(unit, varies, 0.5, reach=1) == [0, 2, 4]
    assert structure.linkage_clusters(g, 0.95).tolist() == [0, 0, 1, 2, 3]


def test_cis_scan_finds_a_planted_effect(spark):
    r = np.random.default_rng(4)
    n, m = 120, 30
    g = r.binomial(2, 0.4, (m, n)).astype(float)
    y = 1.2 * g[10] + r.normal(size=n)
    genotypes = spark.createDataFrame([("22", i * 1000, f"v{i}", row.tolist()) for i, row in enumerate(g)], "chrom string, pos long, variant_id string, dosage array<double>")
    genes = spark.createDataFrame([("g", "chr22", 12_000), ("none", "22", 15_000)], "gene_id string, chrom string, tss long")
    expression = spark.createDataFrame([("g", y.tolist()), ("none", r.normal(size=n).tolist())], "gene_id string, y array<double>")
    pairs = eqtl.cis_scan(expression, genes, genotypes, window=8_000, n_perm=99)
    best = {x.gene_id: x for x in eqtl.best_hits(pairs, adjust=True).collect()}
    assert best["g"].best_variant == "v10" and best["g"].n_variants == 17 and best["g"].tss_distance == -2000 and best["g"].empirical_p == 0.01
    assert best["none"].empirical_p > 0.01
    with pytest.raises(Exception, match="missing dosages"):
        eqtl.cis_scan(expression, genes, genotypes.withColumn("dosage", F.transform("dosage", lambda x, i: F.when(i > 0, x)))).collect()


def test_scores_align_alleles_and_predict(spark):
    r = np.random.default_rng(6)
    g = r.binomial(2, 0.4, (5, 80)).astype(float)
    target = spark.createDataFrame([(f"v{i}", "AACTG"[i], "GCTAC"[i], i * 10, row.tolist()) for i, row in enumerate(g)], "variant_id string, counted_allele string, other_allele string, pos long, dosage array<double>")
    w = [("g", "v0", 1e-9, 2.0, "a", "G"), ("g", "v1", 1e-8, 1.0, "C", "A"), ("g", "v2", 1e-7, 1.0, "G", "A"), ("g", "v3", 1e-7, 1.0, "T", "A"), ("g", "v4", 1e-7, 1.0, "G", "C"), ("g", "gone", 1e-9, 1.0, "A", "G"), ("g", "v0", 0.5, 9.0, "A", "G")]
    weights = spark.createDataFrame(w, "gene_id string, variant_id string, pvalue double, zscore double, assessed_allele string, other_allele string")
    report = eqtl.alignment_report(eqtl.aligned_weights(weights, target), 1e-4).first().asDict()
    assert report == {"n_input": 7, "dropped_not_in_target": 1, "dropped_palindromic": 2, "dropped_allele_mismatch": 1, "n_aligned": 3, "n_after_p_threshold": 2}
    genes = spark.createDataFrame([("g", 0)], "gene_id string, tss long")
    got = eqtl.predicted_expression(weights, target, genes, r2=0.9).first()
    assert got.n_snps_in_score == 2 and np.allclose(got.score, 2 * g[0] - g[1])
    draws = eqtl.resampled(spark, eqtl.score_metric(np.array(got.score), np.array(got.score) + r.normal(size=80)), 80, 50, 50)
    out = eqtl.evaluation(draws, 0.8).first()
    assert out.empirical_p == 1 / 51 and out.ci_low < out.ci_high and out.null_high < 0.5


def test_folds_keep_lineages_whole_and_leakage_shows(spark):
    r = np.random.default_rng(7)
    lineages = np.repeat([f"L{i}" for i in range(24)], 15)
    clone = r.binomial(1, 0.5, (24, 40))
    x = clone[np.repeat(np.arange(24), 15)].astype(float)
    level = r.normal(size=24)[np.repeat(np.arange(24), 15)] * 2 + r.normal(0, 0.2, 360)
    low, high = np.where(level < -1, -np.inf, np.where(level > 1, 1.0, level)), np.where(level < -1, -1.0, np.where(level > 1, np.inf, level))
    c = prediction.Cohort(x, low, high, level, lineages)
    blocked = prediction.cross_validated(spark, c, n_folds=4).toPandas()
    random = prediction.cross_validated(spark, c, blocked=False, n_folds=4).toPandas()
    assert (blocked.lineage_overlap_train_test == 0).all() and (random.lineage_overlap_train_test > 0).all()
    assert random.tobit_extreme_auc.mean() > 0.95 > blocked.tobit_extreme_auc.mean()
    ranked = prediction.importance(prediction.cross_validated(spark, c, n_folds=4), [f"f{i}" for i in range(40)]).collect()
    assert [x.rank_in_model for x in ranked] == list(range(1, len(ranked) + 1))
    groups = spark.createDataFrame([(x,) for x in "aaabbccd"], "lineage string")
    assert dict(map(tuple, prediction.blocked_folds(groups, "lineage", 2).collect())) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        prediction.blocked_folds(groups, "lineage", 5)


def test_elastic_net_meets_its_optimality_conditions():
    r = np.random.default_rng(8)
    x = r.normal(size=(200, 6))
    y = (x[:, 0] - x[:, 1] + r.normal(size=200) > 0.3).astype(float)
    b0, w = prediction.elastic_net(x, y, 0.1)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (1 - y).sum()))
    slope = 0.1 * (x.T @ (weight * (1 / (1 + np.exp(-(b0 + x @ w))) - y))) + 0.5 * w
    assert np.allclose(slope[w != 0], -0.5 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(slope[w == 0]) <= 0.5 + 1e-4).all()


def test_benchmark_comparison_can_fail(spark):
    a = spark.createDataFrame([("v1", 1.0, 0.1, 1e-5), ("v2", -2.0, 0.2, 0.5)], "variant string, effect double, se double, p double")
    assert validation.benchmark(a, a)["status"] == "PASS"
    assert validation.benchmark(a, a.withColumn("effect", F.col("effect") * 1.01))["status"] == "FAIL"
    assert validation.benchmark(a, a.limit(1))["n_unmatched"] == 1
    assert validation.status_of({"V1": {"status": "PASS"}}, ["V1", "V2"]) == {"V1": "PASS", "V2": "NOT RUN"}


def test_readers(spark, tmp_path):
    (tmp_path / "x.raw").write_text("FID IID PAT MAT SEX PHENOTYPE rs_1_A rs2_G\nf s1 0 0 1 -9 0 NA\nf s2 0 0 2 -9 2 1\n")
    got = {(r.sample_id, r.variant_id): (r.counted_allele, r.dosage) for r in readers.read_raw(spark, str(tmp_path / "x.raw")).collect()}
    assert got == {("s1", "rs_1"): ("A", 0.0), ("s1", "rs2"): ("G", None), ("s2", "rs_1"): ("A", 2.0), ("s2", "rs2"): ("G", 1.0)}
    (tmp_path / "x.vcf").write_text("##v\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT\t0|1\t1/1\nchr1\t5\t.\tA\tG\t.\t.\t.\tGT\t0|0\t0/0\nchr1\t9\t.\tA\tGT\t.\t.\t.\tGT\t0|1\t.\nchr1\t7\t.\tC\tT\t.\t.\t.\tGT:DP\t./.:3\t0|1:2\n")
    got = {r.variant_id: r.dosage for r in readers.read_vcf(spark, str(tmp_path / "x.vcf")).collect()}
    assert set(got) == {"1:5:A:G", "1:7:C:T"} and got["1:7:C:T"] == [None, 1.0]
    (tmp_path / "key.txt").write_text("gene  SNP pvalue rho\nENSG1.5 rs1 1e-5 0.3\n")
    assert readers.read_aliased(spark, str(tmp_path / "key.txt"), "key").first().asDict() == {"gene_id": "ENSG1", "snp_id": "rs1", "pvalue": 1e-5, "rho": 0.3}
    with pytest.raises(readers.PrepError):
        readers.resolve_columns(["gene", "gene_id"], {"gene_id": ("gene_id", "gene")})
    (tmp_path / "e.tsv").write_text("TargetID\tChr\tCoord\ts1\ts2\nENSG1.2\tchr3\t77\t0.5\t1\n")
    values, meta = readers.read_expression(spark, str(tmp_path / "e.tsv"))
    assert values.count() == 2 and meta.first().asDict() == {"gene_id": "ENSG1", "chrom": "3", "tss": 77}
    pages = [[{"genome_id": f"562.{i}0"} for i in range(3)], [{"genome_id": "1.10"}]]
    calls = []

    def get(offset, size):
        calls.append(offset)
        return pages[offset // size]

    log = readers.fetch_pages(get, str(tmp_path / "pages"), 3)
    assert [x["rows"] for x in log] == [3, 1] and readers.fetch_pages(get, str(tmp_path / "pages"), 3) == log and calls == [0, 3]
    assert {r[0] for r in readers.read_pages(spark, str(tmp_path / "pages"), {}).select("genome_id").collect()} == {"562.00", "562.10", "562.20", "1.10"}
    contigs = spark.createDataFrame([("c", "acgt" * 25)], "name string, sequence string")
    assert readers.fasta(contigs).first().value == ">c\n" + "ACGT" * 20 + "\n" + "ACGT" * 5
    assert readers.chromosomes("1-3,X") == ["1", "2", "3", "X"]


def test_artifacts_are_refused_when_changed(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(10)
    artifacts.write_table(df, path, "t", "synthetic")
    assert artifacts.read_table(spark, path)[2] == "ok"
    spark.range(11).write.mode("overwrite").parquet(path)
    assert artifacts.read_table(spark, path, strict=False)[2] == "content differs from the manifest"
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_table(spark, str(tmp_path / "gone"))
    registry = artifacts.StatusRegistry(str(tmp_path / "status.json"))
    registry.set("V1", "PASS")
    assert registry.status("V1") == "PASS" and registry.status("V2") == "NOT RUN"


def card(**more):
    base = {"card_id": "c", "scope": "real", "causal_status": "association_only", "in_answer_key": False, "lineage_adjusted": True, "adjusted_significant": True, "cv_strategy": "nested_lineage_blocked", "cohort_tier": "discovery", "breakpoint_status": "UNVERIFIED", "experimental_evidence": [], "allowed_claims": ["Associated with higher values"], "forbidden_claims": ["Causal claims", "Calls of resistant or susceptible"], "extra_keys": []}
    return tuple((base | more).values())


def test_evidence_rules(spark):
    bad = {
        "a": {"causal_status": "experimentally_supported"}, "b": {"allowed_claims": ["This gene causes resistance"]}, "c": {"scope": "synthetic"}, "d": {"allowed_claims": ["a novel determinant"]}, "e": {"extra_keys": ["evidence_score"]},
        "f": {"adjusted_significant": False, "allowed_claims": ["Associated after lineage adjustment"]}, "g": {"cv_strategy": "random_demo", "allowed_claims": ["Predicts values"]}, "h": {"cohort_tier": "replication"}, "i": {"forbidden_claims": []},
    }
    rows = [card(card_id="ok"), *[card(card_id=k, **v) for k, v in bad.items()], card(card_id="demo", scope="synthetic", allowed_claims=[evidence.DISCLAIMER])]
    found = {r.card_id: r.problems for r in evidence.problems(spark.createDataFrame(rows, evidence.CARD)).collect()}
    assert found.pop("ok") == found.pop("demo") == [] and all(found.values()) and len(found["i"]) == 2
    with pytest.raises(evidence.EvidenceCardError):
        evidence.require_valid(spark.createDataFrame(rows, evidence.CARD))


def test_streamed_pages(spark, tmp_path):
    from helixframe.streaming.pages import append, assay_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"genome_id": "562.10", "measurement": "<=1"}]')
    append(assay_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    append(assay_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [(r.genome_id, r.censoring) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("562.10", "left")]


def test_shown(spark):
    assert [r[0] for r in spark.createDataFrame([(0.123456,), (None,), (float("nan"),)], "x double").select(shown(F.col("x"))).collect()] == ["0.1235", "NA", "NA"]


def test_sex_check_leaves_out_pseudo_autosomal_calls(spark):
    from helixframe.operators.qc import sex_check, x_variants

    places = [(0, "X", 60000), (1, "chrX", 60001), (2, "23", 2699520), (3, "x", 2699521), (4, "1", 5_000_000), (5, "X", 155_000_000), (6, None, 5_000_000), (7, "X", None)]
    variants = spark.createDataFrame(places, "variant_id long, chrom string, pos long")
    assert sorted(r.variant_id for r in x_variants(variants).collect()) == [0, 3]
    assert sorted(r.variant_id for r in x_variants(variants, "b38").collect()) == [5]
    # Sample 1 is heterozygous inside the regions alone, sample 2 outside, sample 3 isn't called on X.
    calls = [(1, 0, 0), (1, 3, 2), (1, 1, 1), (1, 2, 1), (1, 5, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (3, 0, None)]
    cells = spark.createDataFrame(calls, "sample_id long, variant_id long, dosage long")
    samples = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "sample_id long, recorded_sex int")
    found = {r.sample_id: r for r in sex_check(cells, variants.union(variants), samples, 0.5).collect()}
    assert [(found[i].n_x, found[i].x_het_rate, found[i].inferred_sex, found[i].status) for i in (1, 2, 3, 4)] == [(2, 0.0, 1, "ok"), (2, 1.0, 2, "problem"), (0, None, 1, "unknown"), (0, None, 1, "unknown")]
    # Frequencies 1/4 and 3/4 over two samples: 2 * 3/16 * 4/3 each, so one heterozygote is expected of both.
    assert found[1].x_inbreeding == 1 and found[2].x_inbreeding == pytest.approx(-1.0) and found[3].x_inbreeding is None
    assert sex_check(cells.limit(0), variants, samples, 0.5).count() == 4 and sex_check(cells, variants, samples.limit(0), 0.5).isEmpty()


def test_reasons_by_counts_and_by_values_agree(spark):
    from helixframe.functions.scalar import all_binary
    from helixframe.operators.censored import filter_reason, reason_by_counts

    rows = [(k, 40, [1.0] * k + [0.0] * (40 - k)) for k in (0, 3, 5, 20, 36, 40)] + [(20, 40, [None] + [0.5] * 39)]
    df = spark.createDataFrame(rows, "k int, n int, g array<double>")
    both = df.select(filter_reason("g", 5, 0.2).alias("a"), reason_by_counts(F.col("k"), F.col("n"), 5, 0.2).alias("b")).collect()
    assert [r.a for r in both[:6]] == [r.b for r in both[:6]] == ["constant", "frequency_filter", "frequency_filter", None, "frequency_filter", "constant"] and both[6].a == "missing_values"
    sums = df.select("k", F.explode("g").alias("v")).groupBy("k").agg(all_binary(F.col("v")).alias("x")).collect()
    assert {r.k for r in sums if not r.x} == {20}
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").agg(all_binary(F.col("v"))).first()[0] is False
