"""The jobs as queries: each run twice into a new folder of the cluster's shared one, and its output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.plans.queries import R, REGRESSION, SAMPLES
from helixframe.plans.views import SQL
from helixframe.runtime import shared_dir

from .association_release import release
from .common import settings
from .notes_screening import CLAIMS, IDENTIFIERS, NO_LANG, SENTENCE_END, screen


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/jobs/{uuid.uuid4().hex}"


def job1_association_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark)
    for _ in range(2):
        release(spark, sf_dir, out, settings("association_release"))
    found = spark.read.parquet(f"{out}/variants")
    return found.select("chrom", "variant", "pos", "n_called", *(F.round(c, R).alias(c) for c in ("missing_rate", "maf")), "status", "n", *(F.round(c, 4).alias(c) for c in ("effect", "se")), *(F.round(c, R).alias(c) for c in ("stat", "p", "fdr_bh")))


def job2_notes_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark)
    for _ in range(2):
        screen(spark, f"{sf_dir}/documents.parquet", f"{out}/output", f"{out}/checkpoint", settings("notes_screening"))
    counts = [f"n_{k}" for k in IDENTIFIERS]
    notes = spark.read.parquet(f"{out}/output/notes").select(F.lit("note").alias("part"), "lang", "source", "doc_id", "text", F.array_join("claims", ",").alias("claims"), F.lit(1).cast("long").alias("notes"), F.col("held").cast("long").alias("held"), *(F.col(c).cast("long").alias(c) for c in counts))
    report = spark.read.parquet(f"{out}/output/report")
    return notes.unionByName(report.select(F.lit("report").alias("part"), "lang", "source", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("claims"), "notes", "held", *counts))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_association_release, job2_notes_screening)}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    c, n = settings("association_release"), settings("notes_screening")
    steps, before = [], "d"
    for k, p in IDENTIFIERS.items():
        steps.append(f"m_{k} AS (SELECT * REPLACE (regexp_replace(text, {quoted(p)}, {quoted(n['mask'])}, 'g') AS text), CAST(len(regexp_extract_all(text, {quoted(p)})) AS BIGINT) AS n_{k} FROM {before})")
        before = f"m_{k}"
    counts = ", ".join(f"n_{k}" for k in IDENTIFIERS)
    sums = ", ".join(f"CAST(sum(n_{k}) AS BIGINT) AS n_{k}" for k in IDENTIFIERS)
    said = ", ".join(f"CASE WHEN len(list_filter(string_split_regex(text, {quoted(SENTENCE_END)}), lambda s: regexp_matches(s, {quoted(p)}))) > 0 THEN {quoted(k)} END" for k, p in CLAIMS.items())
    return {
        "job1_association_release": f"""{SAMPLES},
            limits AS (SELECT avg(het_rate) AS mu, stddev_samp(het_rate) AS sd FROM m),
            good AS (SELECT sample_id FROM m, limits WHERE coalesce(call_rate >= {c['min_call_rate']} AND (coalesce(sd, 0) <= 0 OR abs(het_rate - mu) <= {c['max_het_sd']} * sd), false)),
            kept AS (SELECT geno.* FROM geno JOIN good USING (sample_id)),
            met AS (SELECT variant_id, count(dosage) AS n_called, 1.0::DOUBLE - count(dosage) / (SELECT count(*) FROM good)::DOUBLE AS missing_rate, sum(dosage) / (2.0 * count(dosage))::DOUBLE AS af FROM kept GROUP BY 1),
            judged AS (SELECT v.variant_id, coalesce(n_called, 0) AS n_called, coalesce(missing_rate, 1) AS missing_rate, least(af, 1 - af) AS maf, coalesce(missing_rate <= {c['max_missing']} AND least(af, 1 - af) >= {c['min_maf']}, false) AS pass
                       FROM (SELECT DISTINCT variant_id FROM geno) v LEFT JOIN met USING (variant_id)),
            passing AS (SELECT kept.* FROM kept JOIN judged USING (variant_id) WHERE pass){REGRESSION.replace("FROM geno JOIN pheno", "FROM passing JOIN pheno")},
            ranked AS (SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY p) AS rn FROM r),
            q AS (SELECT *, least(1.0, min(p * tests / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr_bh FROM ranked),
            meta AS ({SQL['variant_meta']})
            SELECT coalesce(chrom, 'NA') AS chrom, CAST(g.variant_id AS VARCHAR) AS variant, pos, n_called, round(missing_rate, {R}) AS missing_rate, round(maf, {R}) AS maf, CASE WHEN q.variant_id IS NULL THEN 'qc_fail' ELSE 'ok' END AS status, q.n,
                   round(effect, 4) AS effect, round(se, 4) AS se, round(stat, {R}) AS stat, round(p, {R}) AS p, round(fdr_bh, {R}) AS fdr_bh
            FROM judged g LEFT JOIN q USING (variant_id) LEFT JOIN meta ON meta.variant = g.variant_id""",
        "job2_notes_screening": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, coalesce(nullif(lang, ''), '{NO_LANG}') AS lang FROM documents), {", ".join(steps)},
            s AS (SELECT *, list_filter([{said}], lambda x: x IS NOT NULL) AS claims FROM {before}),
            h AS (SELECT *, CAST(len(claims) >= {n['hold_at']} AS BIGINT) AS held FROM s)
            SELECT 'note' AS part, lang, source, doc_id, text, array_to_string(claims, ',') AS claims, CAST(1 AS BIGINT) AS notes, held, {counts} FROM h
            UNION ALL SELECT 'report', lang, source, NULL, NULL, NULL, count(*), CAST(sum(held) AS BIGINT), {sums} FROM h GROUP BY lang, source""",
    }
