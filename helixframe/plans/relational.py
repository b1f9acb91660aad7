"""Queries for the relational operators of the inventory: joins, sets, guards, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import cohorts, evidence, joins, ranks
from . import views as V
from .queries import ORACLES, QUERIES, query, rounded
from .views import with_views


@query("j1_inner_join", with_views("geno pheno", " SELECT g.sample_id, variant_id, dosage, y FROM geno g JOIN pheno p ON g.sample_id = p.sample_id WHERE case_flag"))
def j1(spark, d):
    return V.geno(spark, d).join(V.pheno(spark, d).filter("case_flag"), "sample_id").select("sample_id", "variant_id", "dosage", "y")


@query("j2_multi_key_join", "WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity < 5), b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_quantity > 45) SELECT a.s AS gene_id, a.p AS snp_id FROM a JOIN b ON a.s = b.s AND a.p = b.p")
def j2(spark, d):
    pairs = lambda cond: V.read(spark, d, "lineitem").filter(cond).select(F.col("l_suppkey").alias("gene_id"), F.col("l_partkey").alias("snp_id")).dropDuplicates()
    return pairs("l_quantity < 5").join(pairs("l_quantity > 45"), ["gene_id", "snp_id"])


@query("j3_variant_metadata", with_views("pvals variant_meta", " SELECT p.variant, p, m.chrom, coalesce(m.pos, -1) AS pos FROM pvals p LEFT JOIN (SELECT * FROM variant_meta WHERE variant % 3 = 0) m USING (variant)"))
def j3(spark, d):
    from ..operators.association import with_metadata

    return with_metadata(V.pvals(spark, d).select("variant", "p"), V.variant_meta(spark, d).filter("variant % 3 = 0")).select("variant", "p", "chrom", F.coalesce("pos", F.lit(-1)).alias("pos"))


@query("j3_metadata_absent", with_views("pvals", " SELECT variant, 'NA' AS chrom, row_number() OVER (ORDER BY variant) - 1 AS pos FROM pvals"))
def j3_absent(spark, d):
    from ..operators.association import with_metadata

    return with_metadata(V.pvals(spark, d).select("variant"), None)


@query("j4_left_join_keeps_unlabelled", "SELECT c_custkey AS sample_id, n_name AS label FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def j4(spark, d):
    nation = V.read(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("label"))
    return V.read(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("k"), "left").select(F.col("c_custkey").alias("sample_id"), "label")  # nations are a fixed few


@query("j10_semi_join", with_views("geno pheno", " SELECT sample_id FROM pheno WHERE sample_id IN (SELECT sample_id FROM geno WHERE variant_id = 3 AND dosage = 2)"))
def j10(spark, d):
    return V.pheno(spark, d).select("sample_id").join(V.geno(spark, d).filter("variant_id = 3 and dosage = 2"), "sample_id", "left_semi")


@query("j11_anti_join", with_views("geno pheno", " SELECT sample_id FROM pheno WHERE sample_id NOT IN (SELECT sample_id FROM geno WHERE variant_id = 3)"))
def j11(spark, d):
    return V.pheno(spark, d).select("sample_id").join(V.geno(spark, d).filter("variant_id = 3"), "sample_id", "left_anti")


def refuses(guard, *given) -> bool:
    try:
        guard(*given)
    except (ValueError, RuntimeError):
        return True
    return False


@query("j15_leakage_guard", with_views("pheno", """ SELECT 'cases and others' AS cohorts, count(*) > 0 AS refused FROM (SELECT sample_id FROM pheno WHERE case_flag INTERSECT SELECT sample_id FROM pheno WHERE NOT case_flag)
    UNION ALL SELECT 'cases and nation 4', count(*) > 0 FROM (SELECT sample_id FROM pheno WHERE case_flag INTERSECT SELECT sample_id FROM pheno WHERE nation = 4)"""))
def j15(spark, d):
    p = V.pheno(spark, d)
    rows = [(name, refuses(joins.disjoint_or_refuse, p.filter("case_flag"), p.filter(other), "sample_id")) for name, other in (("cases and others", "not case_flag"), ("cases and nation 4", "nation = 4"))]
    return spark.createDataFrame(rows, "cohorts string, refused boolean")


@query("j16_common_features", with_views("geno pheno", " SELECT variant_id FROM geno JOIN pheno USING (sample_id) WHERE case_flag AND dosage = 2 INTERSECT SELECT variant_id FROM geno JOIN pheno USING (sample_id) WHERE NOT case_flag AND dosage = 2"))
def j16(spark, d):
    cells = V.geno(spark, d).filter("dosage = 2").join(V.pheno(spark, d).select("sample_id", "case_flag"), "sample_id")
    return cells.filter("case_flag").select("variant_id").intersect(cells.filter("not case_flag").select("variant_id"))


@query("j18_lookup_map", with_views("population", " SELECT sample_id, CASE pop WHEN 'EUROPE' THEN 'EUR' WHEN 'AFRICA' THEN 'YRI' END AS grp FROM population"))
def j18(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("EUROPE", "EUR", "AFRICA", "YRI")])
    return V.population(spark, d).select("sample_id", F.element_at(names, F.col("pop")).alias("grp"))


@query("f1_subset_samples", with_views("geno pheno", " SELECT sample_id, variant_id, dosage FROM geno WHERE sample_id IN (SELECT sample_id FROM pheno WHERE nation = 4)"))
def f1(spark, d):
    return V.geno(spark, d).join(V.pheno(spark, d).filter("nation = 4").select("sample_id"), "sample_id", "left_semi")


@query("f2_subset_variants", with_views("geno", " SELECT sample_id, variant_id, dosage FROM geno WHERE variant_id BETWEEN 10 AND 14"))
def f2(spark, d):
    return V.geno(spark, d).filter(F.col("variant_id").between(10, 14))


@query("f18_biallelic_snps", "SELECT p_partkey AS variant, a, b FROM (SELECT p_partkey, repeat('A', CAST(p_size % 3 AS INTEGER)) AS a, repeat('G', CAST(p_size % 2 AS INTEGER) + 1) AS b FROM part) WHERE length(a) = 1 AND length(b) = 1")
def f18(spark, d):
    n = F.col("p_size").cast("int")
    rows = V.read(spark, d, "part").select(F.col("p_partkey").alias("variant"), F.repeat(F.lit("A"), n % 3).alias("a"), F.repeat(F.lit("G"), n % 2 + 1).alias("b"))
    return rows.filter("length(a) = 1 and length(b) = 1")


@query("a25_groups_with_null_keys", "SELECT CASE WHEN c_nationkey < 5 THEN NULL ELSE c_mktsegment END AS lineage, count(*) AS n FROM customer GROUP BY 1")
def a25(spark, d):
    return V.read(spark, d, "customer").groupBy(F.when(F.col("c_nationkey") >= 5, F.col("c_mktsegment")).alias("lineage")).agg(F.count(F.lit(1)).alias("n"))


@query("a26_mean_ignoring_nan", with_views("pheno", " SELECT nation, round(avg(CASE WHEN sample_id % 4 = 0 THEN NULL ELSE y END), 6) AS mean FROM pheno GROUP BY 1"))
def a26(spark, d):
    value = F.when(F.col("sample_id") % 4 == 0, float("nan")).otherwise(F.col("y"))
    known = V.pheno(spark, d).select("nation", F.nanvl(value, F.lit(None).cast("double")).alias("v"))
    return known.groupBy("nation").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("a27_variant_summary", with_views("geno pheno", ", v AS (SELECT variant_id, sum(dosage) / (2.0 * count(*)) AS af, 1 - count(*) / (SELECT count(*) FROM pheno)::DOUBLE AS missing FROM geno GROUP BY 1) SELECT round(median(least(af, 1 - af)), 6) AS median_maf, round(max(missing), 6) AS max_missing, count(*) AS n FROM v"))
def a27(spark, d):
    from .queries import variant_table

    return rounded(variant_table(spark, d).agg(F.median("maf").alias("median_maf"), F.max("missing_rate").alias("max_missing"), F.count(F.lit(1)).alias("n")), "median_maf", "max_missing")


@query("w7_cluster_best", with_views("pvals", ", b AS (SELECT chrom, variant, p, row_number() OVER (PARTITION BY chrom ORDER BY p, variant) AS rn FROM pvals) SELECT chrom, variant, dense_rank() OVER (ORDER BY p, variant) AS cluster_rank FROM b WHERE rn = 1"))
def w7(spark, d):
    best = V.pvals(spark, d).groupBy("chrom").agg(F.min(F.struct("p", "variant")).alias("b")).select("chrom", F.col("b.p").alias("p"), F.col("b.variant").alias("variant"))
    return ranks.numbered(best, "p", "variant", name="cluster_rank").select("chrom", "variant", "cluster_rank")


@query("w9_importance_rank", with_views("pvals", " SELECT variant, row_number() OVER (ORDER BY n DESC, p DESC, variant) AS rank_in_model FROM (SELECT variant, variant % 6 AS n, p FROM pvals)"))
def w9(spark, d):
    rows = V.pvals(spark, d).select("variant", (-(F.col("variant") % 6)).alias("n"), (-F.col("p")).alias("q"))
    return ranks.numbered(rows, "n", "q", "variant", name="rank_in_model").select("variant", "rank_in_model")


@query("e8_tier_lookup", with_views("cohort_records", " SELECT event_id, CASE study WHEN 'purchase' THEN 'discovery' WHEN 'signup' THEN 'replication' ELSE 'exploratory' END AS tier FROM cohort_records"))
def e8(spark, d):
    tiers = {"purchase": "discovery", "signup": "replication"}
    return V.cohort_records(spark, d).select("event_id", cohorts.tier_of(F.col("study"), tiers, "exploratory").alias("tier"))


@query("e10_residue_check", "SELECT p_partkey AS variant, coalesce(upper(substr(p_name, CAST(p_size AS INTEGER), 1)) = 'E', false) AND length(p_name) >= p_size AS is_e FROM part")
def e10(spark, d):
    return V.read(spark, d, "part").select(F.col("p_partkey").alias("variant"), S.residue_is(F.col("p_name"), F.col("p_size").cast("int"), F.lit("e")).alias("is_e"))


@query("e11_odds_ratio", with_views("pvals", " SELECT variant, round(exp(p), 6) AS odds_ratio, round(exp(p - 1.959963984540054 * 0.1), 6) AS low, round(exp(p + 1.959963984540054 * 0.1), 6) AS high FROM pvals"))
def e11(spark, d):
    half = S.Z_975 * 0.1
    return rounded(V.pvals(spark, d).select("variant", F.exp("p").alias("odds_ratio"), F.exp(F.col("p") - half).alias("low"), F.exp(F.col("p") + half).alias("high")), "odds_ratio", "low", "high")


@query("e20_is_binary", with_views("geno", " SELECT variant_id, count(v) > 0 AND bool_and(v IN (0, 1)) AS binary FROM (SELECT variant_id, CASE WHEN variant_id % 2 = 0 THEN dosage % 2 ELSE dosage END AS v FROM geno) GROUP BY 1"))
def e20(spark, d):
    v = F.when(F.col("variant_id") % 2 == 0, F.col("dosage") % 2).otherwise(F.col("dosage"))
    return V.geno(spark, d).select("variant_id", v.alias("v")).groupBy("variant_id").agg(S.all_binary(F.col("v")).alias("binary"))


@query("e24_mean_imputation", with_views("geno pheno", ", m AS (SELECT variant_id, avg(dosage) AS mean FROM geno GROUP BY 1) SELECT p.sample_id, m.variant_id, round(coalesce(g.dosage, mean), 6) AS dosage FROM pheno p CROSS JOIN m LEFT JOIN geno g ON g.sample_id = p.sample_id AND g.variant_id = m.variant_id"))
def e24(spark, d):
    cells = V.geno(spark, d)
    means = cells.groupBy("variant_id").agg(F.avg("dosage").alias("mean"))
    grid = V.pheno(spark, d).select("sample_id").crossJoin(F.broadcast(means))  # a row a variant: every cell is asked for
    return grid.join(cells, ["sample_id", "variant_id"], "left").select("sample_id", "variant_id", F.round(F.coalesce(F.col("dosage").cast("double"), "mean"), 6).alias("dosage"))


@query("e25_sorted_positions", with_views("variant_meta", " SELECT chrom, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, min(gap) > 0 AS increasing FROM (SELECT chrom, pos, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos), 1) AS gap FROM variant_meta) GROUP BY 1"))
def e25(spark, d):
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(Window.partitionBy("chrom").orderBy("pos")), F.lit(1))
    return V.variant_meta(spark, d).withColumn("gap", gap).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), (F.min("gap") > 0).alias("increasing"))


#: Claims of which some break a rule, by remainder.
CLAIMS = (
    "Associated with higher values", "This gene causes resistance", "A new marker of the phenotype", "It is associated and predictive", "The effect is driven by this feature", "Kept by a predictive model",
    "Annotation of a pathway", "Proven in the laboratory", "Used for therapy", "Associated after lineage adjustment", "Plausible and therefore associated", "Nothing is established",
)
_TEXT = f"(SELECT p_partkey AS claim, [{', '.join(repr(c) for c in CLAIMS)}][CAST(p_partkey % {len(CLAIMS)} AS INTEGER) + 1] AS t FROM part)"


@query(
    "e27_claim_wording",
    f"SELECT claim, regexp_matches(t, '{evidence.CAUSAL}') AS causal, regexp_matches(t, '{evidence.NOVEL}') AS novel, regexp_matches(t, '{evidence.ADJUSTED}') AS adjusted, "
    + " + ".join(f"CAST(regexp_matches(t, '{p}') AS INTEGER)" for p in evidence.KINDS.values())
    + f" AS kinds FROM {_TEXT}",
)
def e27(spark, d):
    k = F.col("p_partkey")
    t = F.get(F.array(*[F.lit(c) for c in CLAIMS]), (k % len(CLAIMS)).cast("int"))
    return V.read(spark, d, "part").select(k.alias("claim"), t.rlike(evidence.CAUSAL).alias("causal"), t.rlike(evidence.NOVEL).alias("novel"), t.rlike(evidence.ADJUSTED).alias("adjusted"), evidence.kinds_in(t).alias("kinds"))


@query("set_union_of_lists", with_views("geno pheno", " SELECT variant_id FROM geno JOIN pheno USING (sample_id) WHERE case_flag UNION SELECT variant_id FROM geno JOIN pheno USING (sample_id) WHERE NOT case_flag"))
def set_union(spark, d):
    cells = V.geno(spark, d).join(V.pheno(spark, d).select("sample_id", "case_flag"), "sample_id")
    return cells.filter("case_flag").select("variant_id").union(cells.filter("not case_flag").select("variant_id")).distinct()


@query("set_intersection", with_views("pvals genes", " SELECT variant AS id FROM pvals WHERE p < 0.5 INTERSECT SELECT gene_id FROM genes"))
def set_intersection(spark, d):
    return V.pvals(spark, d).filter("p < 0.5").select(F.col("variant").alias("id")).intersect(V.genes(spark, d).select("gene_id"))


@query("set_exclusions", with_views("cohort_records", " SELECT event_id, 'non_mic_method' AS reason FROM cohort_records WHERE method <> 'MIC' UNION ALL SELECT event_id, 'right_censored' FROM cohort_records WHERE measurement LIKE '>%'"))
def set_exclusions(spark, d):
    records = V.cohort_records(spark, d)
    first = records.filter("method <> 'MIC'").select("event_id", F.lit("non_mic_method").alias("reason"))
    return first.unionByName(records.filter("measurement like '>%'").select("event_id", F.lit("right_censored").alias("reason")), allowMissingColumns=True)


@query("sort_limit_top_k", with_views("pvals", " SELECT variant, chrom, p FROM pvals ORDER BY p DESC, variant LIMIT 30"))
def top_k(spark, d):
    return V.pvals(spark, d).orderBy(F.desc("p"), "variant").limit(30).select("variant", "chrom", "p")


@query("v3_null_calibration", "SELECT round(median(l), 6) AS median_lambda, CASE WHEN abs(median(l) - 1) <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT 0.9 + s_suppkey % 20 / 100.0 AS l FROM supplier)")
def v3(spark, d):
    from ..operators.validation import calibrated

    lambdas = V.read(spark, d, "supplier").select((F.col("s_suppkey") % 20 / 100.0 + 0.9).alias("lambda"))
    return rounded(calibrated(lambdas), "median_lambda")


@query("v4_answer_key_direction", with_views("pvals", " SELECT count(*) AS n_pairs, round(avg(CAST(sign(p - 0.5) = sign(p - 0.45) AS DOUBLE)), 6) AS same_direction, CASE WHEN count(*) >= 100 AND avg(CAST(sign(p - 0.5) = sign(p - 0.45) AS DOUBLE)) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status, count(*) > 0 AND avg(CAST(sign(p - 0.5) = sign(p - 0.45) AS DOUBLE)) <= 0.1 AS possible_allele_flip FROM pvals WHERE variant % 2 = 0"))
def v4(spark, d):
    from ..operators.validation import replicated_key

    p = V.pvals(spark, d)
    key = p.filter("variant % 2 = 0").select(F.col("chrom").alias("gene_id"), F.col("variant").alias("snp_id"), (F.col("p") - 0.5).alias("rho"))
    out = replicated_key(key, p.select(F.col("chrom").alias("gene_id"), "variant", (F.col("p") - 0.45).alias("effect")))
    kept = ["n_pairs", "same_direction", "status", "possible_allele_flip"]
    return rounded(spark.createDataFrame([tuple(out[k] for k in kept)], "n_pairs long, same_direction double, status string, possible_allele_flip boolean"), "same_direction")


@query("v2_sex_check", f"SELECT CASE WHEN n > 0 AND ok / n::DOUBLE >= 0.99 THEN 'PASS' ELSE 'FAIL' END AS status, n AS n_compared, round(ok / nullif(n, 0)::DOUBLE, 6) AS concordance FROM (SELECT count(*) FILTER (recorded_sex IN (1, 2)) AS n, count(*) FILTER (recorded_sex IN (1, 2) AND inferred_sex = recorded_sex) AS ok FROM ({ORACLES['x8_sex_check']}))")
def v2(spark, d):
    from ..operators.qc import sex_concordance
    from ..operators.validation import sex_check

    out = sex_check(sex_concordance(QUERIES["x8_sex_check"](spark, d), "inferred_sex", "recorded_sex"))
    return rounded(spark.createDataFrame([(out["status"], out["n_compared"], out["concordance"])], "status string, n_compared long, concordance double"), "concordance")


#: What the scan of v5 is compared with: itself, a scan without some variants, and one whose effects are off by a thousandth.
OTHERS = {"same": "true", "without some": "variant % 50 <> 0", "effects off": "true"}


@query("v5_benchmark", with_views("pvals", """, a AS (SELECT variant, p - 0.7 AS effect, 0.1 + p AS se, p FROM pvals), o AS (SELECT unnest(['same', 'without some', 'effects off']) AS given),
    b AS (SELECT given, variant, effect * CASE WHEN given = 'effects off' THEN 1.001 ELSE 1 END AS effect, se, p FROM o, a WHERE given <> 'without some' OR variant % 50 <> 0),
    c AS (SELECT o.given, a.variant, abs(a.effect - b.effect) / greatest(abs(b.effect), 1e-12) AS effect, abs(a.se - b.se) / greatest(abs(b.se), 1e-12) AS se, abs(log10(greatest(a.p, 1e-300)) - log10(greatest(b.p, 1e-300))) AS l, b.variant IS NOT NULL AS there, -log10(greatest(b.p, 1e-300)) AS far FROM o CROSS JOIN a LEFT JOIN b ON b.given = o.given AND b.variant = a.variant),
    r AS (SELECT given, count(*) FILTER (there) AS n, count(*) FILTER (NOT there) AS u, max(effect) AS effect, max(se) AS se, max(l) FILTER (there AND far < 30) AS l FROM c GROUP BY 1)
    SELECT given, CASE WHEN n > 0 AND u = 0 AND effect <= 1e-4 AND se <= 1e-4 AND l <= 5e-3 THEN 'PASS' ELSE 'FAIL' END AS status, n AS n_compared, u AS n_unmatched, round(effect, 6) AS max_rel_effect, round(se, 6) AS max_rel_se, round(l, 6) AS max_abs_neglog10p FROM r"""))
def v5(spark, d):
    from ..operators.validation import benchmark

    ours = V.pvals(spark, d).select("variant", (F.col("p") - 0.7).alias("effect"), (F.col("p") + 0.1).alias("se"), "p")
    kept = ["status", "n_compared", "n_unmatched", "max_rel_effect", "max_rel_se", "max_abs_neglog10p"]
    found = []
    for given, rows in OTHERS.items():
        theirs = ours.filter(rows).withColumn("effect", F.col("effect") * (1.001 if given == "effects off" else 1.0))
        out = benchmark(ours, theirs)
        found.append((given, *(out[k] for k in kept)))
    made = spark.createDataFrame(found, "given string, status string, n_compared long, n_unmatched long, max_rel_effect double, max_rel_se double, max_abs_neglog10p double")
    return rounded(made, "max_rel_effect", "max_rel_se", "max_abs_neglog10p")


@query("v7_answer_key", with_views("pvals", """, h AS (SELECT variant, variant % 40 AS c, variant % 4 - 1 AS effect, p FROM pvals WHERE variant % 13 <> 0 AND p / 2 < 0.05),
    b AS (SELECT c, min(p) AS best FROM h GROUP BY 1), f AS (SELECT c, effect FROM h WHERE variant % 7 = 3 ORDER BY p, variant LIMIT 1),
    r AS (SELECT (SELECT count(*) FROM b WHERE best < x.best) + 1 AS k, effect > 0 AS c2 FROM f JOIN b x USING (c)),
    a AS (SELECT unnest([0.75, 0.6, NULL]) AS auc), o AS (SELECT auc, k AS cluster_rank, coalesce(k <= 20, false) AS c1, coalesce(c2, false) AS c2, auc >= 0.7 AS c3 FROM a LEFT JOIN r ON true)
    SELECT CAST(auc AS DOUBLE) AS auc, CASE WHEN c3 IS NULL AND c1 AND c2 THEN 'INCOMPLETE' WHEN c1 AND c2 AND c3 THEN 'PASS' ELSE 'FAIL' END AS status, c1, c2, c3, cluster_rank FROM o"""))
def v7(spark, d):
    from ..operators.validation import answer_key

    p, v = V.pvals(spark, d), F.col("variant")
    results = p.select(v.alias("feature_id"), F.when(v % 13 != 0, "ok").otherwise("degenerate").alias("status"), (v % 4 - 1).alias("effect"), F.col("p").alias("p_value"), (F.col("p") / 2).alias("q_value"))
    clusters, key = p.select(v.alias("feature_id"), (v % 40).alias("cluster")), p.filter("variant % 7 = 3").select(v.alias("feature_id"))
    found = []
    for auc in (0.75, 0.6, None):
        out = answer_key(results, clusters, key, auc)
        found.append((auc, out["status"], *out["criteria"].values(), out["cluster_rank"]))
    return spark.createDataFrame(found, "auc double, status string, c1 boolean, c2 boolean, c3 boolean, cluster_rank long")


@query("v10_separation_guard", with_views("cohort_records", """, g AS (SELECT genome_id, count(*) AS n, min(CASE record_tier WHEN 'discovery' THEN 1 WHEN 'replication' THEN 2 ELSE 3 END) AS t FROM cohort_records GROUP BY 1)
    SELECT 'a row a genome' AS given, false AS refused UNION ALL SELECT 'all records', max(n) > 1 FROM g UNION ALL SELECT 'all in discovery', count(*) FILTER (t <> 1) > 0 FROM g"""))
def v10(spark, d):
    tier = lambda t: F.get(F.array(*[F.lit(x) for x in cohorts.TIERS]), (F.col(t) - 1).cast("int"))
    records = V.cohort_records(spark, d).select("genome_id", F.lit("1").alias("study_pmid"), cohorts.tier_rank(F.col("record_tier")).alias("t"))
    kept = records.groupBy("genome_id", "study_pmid").agg(F.min("t").alias("t")).withColumn("cohort_tier", tier("t"))
    given = {"a row a genome": (kept,), "all records": (records.withColumn("cohort_tier", tier("t")),), "all in discovery": (kept, {"1": "discovery"})}
    return spark.createDataFrame([(name, refuses(cohorts.require_separation, *x)) for name, x in given.items()], "given string, refused boolean")


#: For each remainder what is wrong with the card, and the problems that this gives.
WRONG: list[tuple[dict, str]] = [
    ({}, ""),
    ({"causal_status": "experimentally_supported"}, "causal_status and experimental_evidence disagree"),
    ({"extra_keys": ["final_priority_score"]}, "a composite score or rank"),
    ({"scope": "synthetic"}, "synthetic data allow the disclaimer alone"),
    ({"allowed_claims": ["Proven in the laboratory"]}, "causal or clinical words without experiment"),
    ({"allowed_claims": ["A new marker of the phenotype"]}, "a novel determinant"),
    ({"allowed_claims": ["A determinant"]}, "determinant said of a feature that isn't in the answer key"),
    ({"allowed_claims": ["A plausible feature that is associated"]}, "two kinds of evidence in one claim"),
    ({"allowed_claims": ["A lineage-adjusted effect"], "adjusted_significant": False}, "adjustment claimed that wasn't made or didn't hold"),
    ({"allowed_claims": ["Importance in a model"], "cv_strategy": "random_split"}, "prediction claimed without blocked validation"),
    ({"cohort_tier": "replication"}, "association claimed outside discovery"),
    ({"forbidden_claims": ["S/I/R calls"]}, "causal claims aren't forbidden"),
    ({"forbidden_claims": ["Causal claims"]}, "class claims aren't forbidden"),
    ({"cohort_tier": "other"}, "schema: cohort_tier has an unknown value"),
    ({"allowed_claims": None}, "schema: allowed_claims is missing"),
    ({"forbidden_claims": [], "cohort_tier": "replication"}, "association claimed outside discovery;causal claims aren't forbidden;class claims aren't forbidden"),
    ({"scope": "synthetic", "allowed_claims": [evidence.DISCLAIMER]}, ""),
]
GOOD = {
    "scope": "real", "causal_status": "not_established", "in_answer_key": False, "lineage_adjusted": True, "adjusted_significant": True, "cv_strategy": "nested_lineage_blocked", "cohort_tier": "discovery",
    "breakpoint_status": "UNVERIFIED", "experimental_evidence": [], "allowed_claims": ["Associated with higher values"], "forbidden_claims": ["Causal claims", "S/I/R calls"], "extra_keys": [],
}


@query("v13_evidence_rules", "SELECT CAST(p_partkey AS VARCHAR) AS card_id, [" + ", ".join("'" + p.replace("'", "''") + "'" for _, p in WRONG) + f"][CAST(p_partkey % {len(WRONG)} AS INTEGER) + 1] AS problems FROM part")
def v13(spark, d):
    kinds = dict(c.split(" ") for c in evidence.CARD.split(", "))
    made = spark.createDataFrame([(i, *(GOOD | wrong).values()) for i, (wrong, _) in enumerate(WRONG)], "at int, " + ", ".join(f"{c} {kinds[c]}" for c in GOOD))
    cards = V.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("card_id"), (F.col("p_partkey") % len(WRONG)).cast("int").alias("at")).join(F.broadcast(made), "at")  # a row a kind of card
    return evidence.problems(cards).select("card_id", F.concat_ws(";", "problems").alias("problems"))


@query(
    "v13_built_cards",
    with_views("pvals", """ SELECT CAST(variant AS VARCHAR) AS card_id, p <= 0.05 AND variant % 2 = 0 AS adjusted_significant, CASE variant % 5 WHEN 0 THEN 'target_site_mutation' WHEN 1 THEN 'horizontal_gene' ELSE 'unknown' END AS plausible_role,
        1 + CAST(variant % 3 = 0 AND p <= 0.05 AND variant % 2 = 0 AS INTEGER) + CAST(variant % 4 = 0 AS INTEGER) + CAST(variant % 5 < 2 AS INTEGER) AS n_allowed, 2 + CAST(variant % 5 <> 0 AS INTEGER) AS n_forbidden, 2 + CAST(variant % 3 <> 0 AS INTEGER) AS n_missing FROM pvals"""),
)
def v13_built(spark, d):
    """A card for each variant, of which all have passed the rules."""
    k = F.col("variant")
    hits = V.pvals(spark, d).select(k.alias("feature_id"), F.lit(0.5).alias("effect"), F.lit(0.1).alias("se"), "p", F.col("p").alias("q_value"), F.lit(5.0).alias("z"), (k % 2 == 0).alias("lineage_adjusted"), F.lit(10).alias("n_present"), F.lit(100).alias("n"))
    of = F.col("feature_id")
    noted = hits.filter(of % 5 < 2).select("feature_id", F.when(of % 5 == 0, "target").otherwise("gene").alias("role"), (of % 5 == 0).alias("in_answer_key"))
    modelled = hits.select("feature_id", F.when(of % 4 == 0, "nested_lineage_blocked").otherwise("random_split").alias("cv_strategy"), F.lit(0.8).alias("auc"))
    again = hits.filter(of % 3 == 0).select("feature_id", F.lit(True).alias("replicated"))
    cards = evidence.build_cards(hits.withColumn("q_value", F.when(F.col("p") <= 0.05, 0.01).otherwise(0.5)), {"scope": "real", "cohort_tier": "discovery", "breakpoint_status": "UNVERIFIED"}, noted, modelled, again)
    return cards.select("card_id", "adjusted_significant", F.col("biological_plausibility.plausible_role").alias("plausible_role"), F.size("allowed_claims").alias("n_allowed"), F.size("forbidden_claims").alias("n_forbidden"), F.size("evidence_missing").alias("n_missing"))


@query("m24_covariates", with_views("pheno", " SELECT sample_id, y AS PC1, nation * 1.0::DOUBLE AS PC2, CAST(nation % 2 AS DOUBLE) AS imputed FROM pheno WHERE case_flag"))
def m24(spark, d):
    from ..operators.studies import covariates

    p = V.pheno(spark, d)
    parts = p.select("sample_id", F.col("y").alias("PC1"), F.col("nation").cast("double").alias("PC2"), F.lit(0.0).alias("PC3"))
    return covariates(p.filter("case_flag"), parts, 2, p.select("sample_id", (F.col("nation") % 2).alias("imputed")))


@query("m27_polygenic_score", with_views("geno pheno", """, m AS (SELECT variant_id, avg(dosage) AS mean FROM geno GROUP BY 1), w AS (SELECT variant_id, mean, (variant_id % 7 - 3) / 10.0::DOUBLE AS weight FROM m WHERE variant_id % 3 <> 0)
    SELECT p.sample_id, round(sum(weight * coalesce(g.dosage, mean)), 6) AS score FROM pheno p CROSS JOIN w LEFT JOIN geno g ON g.sample_id = p.sample_id AND g.variant_id = w.variant_id GROUP BY 1"""))
def m27(spark, d):
    from ..operators.studies import chosen_weights, polygenic_scores

    k = F.col("variant")
    results = V.geno(spark, d).select(F.col("variant_id").alias("variant")).distinct().select("variant", ((k % 7 - 3) / 10.0).alias("effect"), F.when(k % 3 == 0, 0.5).otherwise(0.01).alias("p"), F.lit("ok").alias("status"))
    return rounded(polygenic_scores(V.geno(spark, d).withColumnRenamed("variant_id", "variant"), V.pheno(spark, d), chosen_weights(results, 0.05)), "score")


@query("a23_class_report", with_views("pheno", """, c AS (SELECT CAST(case_flag AS INTEGER) AS t, CAST(y > 4500 AS INTEGER) AS p FROM pheno), k AS (SELECT DISTINCT unnest([t, p]) AS class FROM c),
    r AS (SELECT class, count(*) FILTER (t = class) AS support, count(*) FILTER (p = class) AS said, count(*) FILTER (t = class AND p = class) AS hit FROM c, k GROUP BY 1)
    SELECT class, round(hit / said::DOUBLE, 6) AS precision, round(hit / support::DOUBLE, 6) AS recall, round(2.0 * hit / (said + support), 6)::DOUBLE AS f1, support, round((SELECT avg(CAST(t = p AS DOUBLE)) FROM c), 6) AS accuracy, round((SELECT avg(hit / support::DOUBLE) FROM r), 6) AS balanced_accuracy FROM r"""))
def a23_report(spark, d):
    from ..operators.studies import class_report

    rows = V.pheno(spark, d).select(F.col("case_flag").cast("int").alias("label"), (F.col("y") > 4500).cast("int").alias("predicted"))
    return rounded(class_report(rows), "precision", "recall", "f1", "accuracy", "balanced_accuracy")


@query("x10_alt_counted", "SELECT 'as exported' AS given, false AS refused UNION ALL SELECT 'some count REF', count(*) FILTER (p_size = 7) > 0 FROM part")
def x10(spark, d):
    from ..sources.readers import alt_counted

    rows = V.read(spark, d, "part").select(F.col("p_partkey").alias("variant"), "p_size", F.lit("A").alias("ref"), F.lit("G").alias("alt"))
    given = {"as exported": F.lit("G"), "some count REF": F.when(F.col("p_size") == 7, "A").otherwise("G")}
    return spark.createDataFrame([(name, refuses(alt_counted, rows.select("variant", allele.alias("counted_allele")), rows)) for name, allele in given.items()], "given string, refused boolean")
