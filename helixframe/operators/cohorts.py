"""Cohort tiers, one reason for each record left out, and guards that keep cohorts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import clean_study_id

TIERS = ("discovery", "replication", "exploratory")


class CohortSeparationError(RuntimeError):
    pass


def tier_of(study: Column, tiers: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in tiers.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), study) if pairs else F.lit(None).cast("string"), F.lit(default))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def with_tiers(records: DataFrame, tiers: dict[str, str], default: str = "exploratory") -> DataFrame:
    study = "study_pmid" if "study_pmid" in records.columns else "pmid"
    out = records.withColumns({"genome_id": F.trim(F.col("genome_id").cast("string")), "study_pmid": clean_study_id(F.col(study))})
    return out.withColumn("record_tier", tier_of(F.col("study_pmid"), tiers, default))


def resolve(records: DataFrame, order: str, study: str = "study_pmid", superset: tuple[tuple[str, str], ...] = (), method: str = "MIC") -> DataFrame:
    """records, cohort_tier and reason: null for the one record kept of a genome, else the first reason that drops it.

    Reasons in order: superset_duplicate (for pairs (keep, drop) of studies), lower_tier_duplicate_genome,
    non_mic_method, invalid_mic, conflicting_duplicate_mic (the genome goes), exact_duplicate_record (but the first by
    order). Each is judged among records that no reason before has dropped. Needs genome_id, record_tier, and method,
    mic_parse_ok, mic_operator, mic_boundary_mg_l where there are such columns.
    """
    genome = Window.partitionBy("genome_id")
    out = records.withColumn("reason", F.lit(None).cast("string"))
    for keep, drop in superset:
        kept_here = F.max(F.when(F.col("reason").isNull(), F.col(study) == keep)).over(genome)
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col(study) == drop) & F.coalesce(kept_here, F.lit(False)), "superset_duplicate").otherwise(F.col("reason")))
    best = F.min(F.when(F.col("reason").isNull(), tier_rank(F.col("record_tier")))).over(genome)
    out = out.withColumn("cohort_tier", F.get(F.array(*[F.lit(t) for t in TIERS]), (best - 1).cast("int")))

    def dropped(frame: DataFrame, when: Column, reason: str) -> DataFrame:
        return frame.withColumn("reason", F.when(F.col("reason").isNull() & F.coalesce(when, F.lit(False)), reason).otherwise(F.col("reason")))

    out = dropped(out, F.col("record_tier") != F.col("cohort_tier"), "lower_tier_duplicate_genome")
    if "method" in records.columns:
        out = dropped(out, F.upper("method") != method.upper(), "non_mic_method")
    if "mic_parse_ok" in records.columns:
        out = dropped(out, ~F.col("mic_parse_ok"), "invalid_mic")
    value = F.concat_ws("|", "mic_operator", F.col("mic_boundary_mg_l").cast("string"))
    left = F.when(F.col("reason").isNull(), value)
    out = dropped(out, F.min(left).over(genome) != F.max(left).over(genome), "conflicting_duplicate_mic")
    first = F.min(F.when(F.col("reason").isNull(), F.col(order))).over(genome)
    return dropped(out, F.col(order) != first, "exact_duplicate_record")


def kept_and_excluded(resolved: DataFrame, study: str = "study_pmid") -> tuple[DataFrame, DataFrame]:
    return resolved.filter("reason is null").drop("reason"), resolved.filter("reason is not null").select("genome_id", study, "record_tier", "reason")


def require_separation(kept: DataFrame, tiers: dict[str, str] | None = None) -> None:
    """Refuse a genome with two rows, or a study outside its tier. Looks for one counterexample of each."""
    twice = kept.groupBy("genome_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise CohortSeparationError(f"genomes with more than one row: {[r[0] for r in twice]}")
    for study, tier in (tiers or {}).items():
        if not kept.filter((F.col("study_pmid") == study) & (F.col("cohort_tier") != tier)).isEmpty():
            raise CohortSeparationError(f"study {study} has rows outside tier {tier}")
    if tiers is not None and not kept.filter(F.col("cohort_tier").isin("discovery", "replication") & ~F.col("study_pmid").isin(list(tiers))).isEmpty():
        raise CohortSeparationError("a study without registered tier is among discovery or replication")


def overlap(records: DataFrame, study: str = "study_pmid") -> DataFrame:
    """study_a, study_b, shared: genomes in both (a <= b); of a study with itself, its genomes."""
    own = records.select("genome_id", study).distinct()
    a, b = own.withColumnRenamed(study, "study_a"), own.withColumnRenamed(study, "study_b")
    return a.join(b, "genome_id").filter("study_a <= study_b").groupBy("study_a", "study_b").agg(F.count(F.lit(1)).alias("shared"))


def tier_counts(kept: DataFrame) -> DataFrame:
    """tier, n for every tier, 0 included."""
    tiers = kept.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    n = kept.groupBy(F.col("cohort_tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(tiers).join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def lineage_groups(frame: DataFrame, lineage: str, least: int = 10, most: int = 30) -> DataFrame:
    """frame and lineage_group: the lineage itself for the `most` largest of at least `least` rows (ties by name), else other_small; null is unknown."""
    named = F.coalesce(F.col(lineage).cast("string"), F.lit("unknown"))
    sizes = frame.groupBy(named.alias("_name")).count().filter(F.col("count") >= least).orderBy(F.desc("count"), "_name").limit(most).select("_name")
    out = frame.withColumn("_name", named).join(F.broadcast(sizes.withColumn("_kept", F.lit(True))), "_name", "left")  # at most `most` rows
    return out.withColumn("lineage_group", F.when(F.col("_kept"), F.col("_name")).otherwise("other_small")).drop("_name", "_kept")


def lineage_dummies(grouped: DataFrame, group: str = "lineage_group") -> tuple[DataFrame, list[str]]:
    """grouped and a column of 0 and 1 for each group but the largest (ties by name), and the names of those columns."""
    levels = [r[0] for r in grouped.groupBy(group).count().orderBy(F.desc("count"), group).collect()]  # groups are few by lineage_groups
    names = {f"lineage[{g}]": (F.col(group) == g).cast("double") for g in levels[1:]}
    return grouped.withColumns(names) if names else grouped, list(names)


def structure_report(frame: DataFrame, lineage: str) -> DataFrame:
    """n_isolates, n_lineages, largest_lineage, largest_lineage_fraction, n_singletons."""
    c = frame.groupBy(F.coalesce(F.col(lineage).cast("string"), F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    sums = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_isolates"), F.count(F.lit(1)).alias("n_lineages"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    top = c.orderBy(F.desc("n"), "name").limit(1).select(F.col("name").alias("largest_lineage"))
    return sums.join(F.broadcast(top), how="left").select("n_isolates", "n_lineages", "largest_lineage", F.try_divide(F.col("most").cast("double"), F.col("n_isolates")).alias("largest_lineage_fraction"), "n_singletons")
