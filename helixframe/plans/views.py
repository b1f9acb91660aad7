"""Tables of this domain made from a general star schema, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_VARIANTS = 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str, whole_samples: bool = False) -> DataFrame:
    """sample_id, variant_id, dosage: cells that are there; the others are missing. whole_samples: all cells of a sample lie in one partition."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % N_VARIANTS).cast("long").alias("variant_id"), "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("sample_id"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if whole_samples:
        joined = joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sample_id")
    return joined.groupBy("sample_id", "variant_id").agg((F.sum("l_quantity").cast("long") % 3).cast("long").alias("dosage"))


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("long").alias("sample_id"), F.col("c_acctbal").cast("double").alias("y"), (F.col("c_mktsegment") == "BUILDING").alias("case_flag"), F.col("c_nationkey").cast("long").alias("nation")
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    small = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("pop")))  # nations and regions: a fixed few
    return pheno(spark, sf_dir).join(small, "nation").select("sample_id", "pop")


def variant_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    return read(spark, sf_dir, "part").select(p.alias("variant"), F.col("p_brand").alias("chrom"), (p * 1000).alias("pos"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return read(spark, sf_dir, "supplier").select(k.alias("gene_id"), F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("chrom"), (k * 20000).alias("tss"))


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("double")
    text = F.when(value < 1, "<=1").when(value > 100, ">100").otherwise(F.pow(F.lit(2.0), F.round(F.log2(value))).cast("long").cast("string"))
    return read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.expr("event_id div 2").cast("long").alias("genome_id"), text.alias("measurement"), "event_type")


def cohort_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record; records are in the order of event_id."""
    kind = F.col("event_type")
    tier = F.when(kind == "purchase", "discovery").when(kind == "signup", "replication").otherwise("exploratory")
    return assay(spark, sf_dir).select(
        "event_id", "genome_id", kind.alias("study"), tier.alias("record_tier"), F.when(kind == "error", "Disk diffusion").otherwise("MIC").alias("method"), "measurement"
    )


def feature_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geno(spark, sf_dir).select(F.col("sample_id"), F.col("variant_id").alias("feature_id"))


def pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return read(spark, sf_dir, "part").select(k.alias("variant"), F.col("p_brand").alias("chrom"), (((k * 7919) % 100003).cast("double") / 100003.0).alias("p"))


def null_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("gene_id"), F.col("l_extendedprice").cast("double").alias("draw"))
    return lines


SQL = {
    "geno": f"SELECT o_custkey AS sample_id, CAST(l_partkey % {N_VARIANTS} AS BIGINT) AS variant_id, CAST(CAST(sum(l_quantity) AS BIGINT) % 3 AS BIGINT) AS dosage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "pheno": "SELECT c_custkey AS sample_id, CAST(c_acctbal AS DOUBLE) AS y, c_mktsegment = 'BUILDING' AS case_flag, CAST(c_nationkey AS BIGINT) AS nation FROM customer",
    "population": "SELECT c_custkey AS sample_id, r_name AS pop FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "variant_meta": "SELECT p_partkey AS variant, p_brand AS chrom, p_partkey * 1000 AS pos FROM part",
    "genes": "SELECT s_suppkey AS gene_id, 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS chrom, s_suppkey * 20000 AS tss FROM supplier",
    "assay": "SELECT event_id, event_id // 2 AS genome_id, CASE WHEN value < 1 THEN '<=1' WHEN value > 100 THEN '>100' ELSE CAST(CAST(pow(2, round(log2(value))) AS BIGINT) AS VARCHAR) END AS measurement, event_type FROM events",
    "cohort_records": "SELECT event_id, genome_id, event_type AS study, CASE event_type WHEN 'purchase' THEN 'discovery' WHEN 'signup' THEN 'replication' ELSE 'exploratory' END AS record_tier, CASE WHEN event_type = 'error' THEN 'Disk diffusion' ELSE 'MIC' END AS method, measurement FROM assay",
    "feature_pa": "SELECT sample_id, variant_id AS feature_id FROM geno",
    "pvals": "SELECT p_partkey AS variant, p_brand AS chrom, CAST((p_partkey * 7919) % 100003 AS DOUBLE) / 100003.0::DOUBLE AS p FROM part",
    "null_draws": "SELECT l_suppkey AS gene_id, CAST(l_extendedprice AS DOUBLE) AS draw FROM lineitem",
}
NEEDS = {"cohort_records": ["assay"], "feature_pa": ["geno"]}


def with_views(names: str, body: str) -> str:
    """body after the definitions of the views named."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + ("" if body.lstrip().startswith(",") else " ") + body
