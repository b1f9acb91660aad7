"""A release of association results: samples and variants by quality, then a regression on each variant that passes.

Reads the tables of a cohort and writes two: `variants`, a row for every variant by chromosome with its quality and, if it
passes, effect, error, p and false discovery rate; and `samples`, every sample with its quality, by whether it passes. Both
are written whole in place of what was there, so a run that is repeated, or that was ended half-way, gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import qc
from helixframe.operators.association import scan_by_sums
from helixframe.plans import views
from helixframe.runtime import discard, written

from .common import log, main, write


def placed(variants: DataFrame, meta: DataFrame) -> DataFrame:
    """variants with chromosome and place, NA and null where meta has no such variant."""
    own = meta.groupBy(F.col("variant").cast("string").alias("variant")).agg(F.min("chrom").alias("chrom"), F.min("pos").alias("pos"))
    return variants.join(own, "variant", "left").withColumn("chrom", F.coalesce("chrom", F.lit("NA")))


def release(spark: SparkSession, tables: str, output: str, config: dict) -> dict[str, int]:
    """Writes output/variants and output/samples from the tables of a folder; returns rows read and written.

    A sample without genotypes fails, as does a variant that no passing sample has; both are written. Rates of variants
    are over the passing samples. No sample or an empty table gives empty or failing rows, not an error.
    """
    samples, cells = views.pheno(spark, tables), written(views.geno(spark, tables, whole_samples=True))  # joined and added up once; each step reads it
    n_cells, n_variants = cells.agg(F.count(F.lit(1)), F.count_distinct("variant_id")).first()
    log.info("read %s genotypes of %s variants from %s", n_cells, n_variants, tables)
    judged = qc.sample_pass(qc.sample_metrics(cells, samples, views.N_VARIANTS), config["min_call_rate"], config["max_het_sd"])
    n_samples = write(judged, f"{output}/samples", "qc_pass")
    judged = spark.read.schema(judged.schema).parquet(f"{output}/samples")

    good = samples.join(judged.filter("qc_pass").select("sample_id"), "sample_id")
    kept = cells.join(good.select("sample_id"), "sample_id")
    every = cells.select("variant_id").distinct()
    metrics = every.join(qc.variant_metrics(kept, max(good.count(), 1)), "variant_id", "left")
    metrics = metrics.withColumns({"n_called": F.coalesce("n_called", F.lit(0).cast("long")), "missing_rate": F.coalesce("missing_rate", F.lit(1.0)), "qc_pass": qc.variant_pass(config["max_missing"], config["min_maf"])})
    passing = kept.join(metrics.filter("qc_pass").select("variant_id"), "variant_id").withColumnRenamed("variant_id", "variant")
    found = scan_by_sums(passing, good, config["outcome"], tuple(config["covariates"])).select("variant", "status", "n", "effect", "se", "stat", "p", "fdr_bh")
    out = metrics.select(F.col("variant_id").cast("string").alias("variant"), "n_called", "missing_rate", "maf", "qc_pass").join(found, "variant", "left")
    out = placed(out, views.variant_meta(spark, tables)).withColumn("status", F.coalesce("status", F.lit("qc_fail")))
    names = ["variant", "pos", "n_called", "missing_rate", "maf", "status", "n", "effect", "se", "stat", "p", "fdr_bh", "chrom"]
    n_out = write(out.select(names), f"{output}/variants", "chrom")
    discard(cells)
    return {"genotypes": n_cells, "samples": n_samples, "variants": n_out}


if __name__ == "__main__":
    main("association_release", release, {"tables": "folder of the cohort's tables", "output": "folder of the release"})
