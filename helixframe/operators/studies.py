"""Steps of a study between its operators: covariates, classes at a verified breakpoint, scores of a new cohort, reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assays import interval_class
from .association import scan
from .censored import require_tier
from .eqtl import evaluation, resampled, score_metric
from .joins import disjoint_or_refuse
from .prediction import Cohort, evaluate

CAVEAT = "extreme classes are defined within each cohort, and the limits of their assays may differ"


def covariates(samples: DataFrame, components: DataFrame, n: int, imputed: DataFrame | None = None) -> DataFrame:
    """sample_id, PC1 to PCn and, if given, imputed (0 or 1), for each of samples; refuses samples that lack any of them.

    components: sample_id, PC1, ...; imputed: sample_id, imputed.
    """
    names = [f"PC{i + 1}" for i in range(n)]
    lacking = [c for c in names if c not in components.columns]
    if lacking:
        raise ValueError(f"components lack {lacking}")
    out = samples.select("sample_id").join(components.select("sample_id", *names), "sample_id", "left")
    if imputed is not None:
        out = out.join(imputed.select("sample_id", F.col("imputed").cast("double").alias("imputed")), "sample_id", "left")
    without = F.array_contains(F.array(*[F.col(c).isNull() for c in out.columns[1:]]), True) if len(out.columns) > 1 else F.lit(False)
    bad = out.filter(without).orderBy("sample_id").limit(3).collect()
    if bad:
        raise ValueError(f"no covariates for samples such as {[r[0] for r in bad]}")
    return out


def at_breakpoint(features: DataFrame, records: DataFrame, breakpoint: dict, lineage: np.ndarray | None = None) -> DataFrame:
    """Logistic scan of resistant against susceptible records at a breakpoint, which must be VERIFIED.

    features: variant, dosage (an array in the order of records by sample_idx); records: sample_idx, cohort_tier and parsed
    assay values, all of the discovery tier. Records between the bounds, or that bounds leave open, take no part.
    """
    require_tier(records, "discovery", "at_breakpoint")
    labelled = interval_class(records, breakpoint).orderBy("sample_idx").select("binary_from_verified_breakpoint").toPandas().iloc[:, 0]  # the sample side
    keep = np.flatnonzero(labelled.isin(["susceptible", "resistant"]))
    y = (labelled.iloc[keep] == "resistant").to_numpy(float)
    chosen = F.array(*[F.lit(int(i)) for i in keep]) if len(keep) < 1000 else F.from_json(F.lit("[" + ",".join(map(str, keep)) + "]"), "array<int>")
    part = features.select("variant", F.transform(chosen, lambda i: F.get("dosage", i)).alias("dosage"))
    return scan(part, y, None if lineage is None else np.asarray(lineage, float)[keep], "logistic").withColumn("censoring_handling", F.lit("binary_verified_breakpoint"))


def external_validation(discovery: Cohort, found: list[str], replication: Cohort, tested: list[str]) -> dict:
    """Figures on the replication cohort of models whose settings and fit come from discovery alone, over common features.

    found, tested: the features of each cohort's columns; the number that replication lacks is told, and a caveat.
    """
    place = {f: i for i, f in enumerate(tested)}
    common = [i for i, f in enumerate(found) if f in place]
    if not common:
        raise ValueError("the cohorts have no feature in common")
    ours, theirs = (Cohort(x, c.low, c.high, c.code, c.lineage) for x, c in ((discovery.x[:, common], discovery), (replication.x[:, [place[found[i]] for i in common]], replication)))
    figures = evaluate(ours, theirs, blocked=True)[0]
    return figures | {"cv_strategy": "discovery_to_replication", "n_features_common": len(common), "n_features_discovery_only": len(found) - len(common), "caveat": CAVEAT}


def leakage_gap(blocked: float, at_random: float) -> dict:
    """What random splits add to the area under the curve over blocked ones."""
    return {"lineage_blocked_auc": blocked, "random_split_auc": at_random, "gap": at_random - blocked, "note": "the value of random splits shows leakage and is no performance"}


def chosen_weights(results: DataFrame, max_p: float, most: int | None = None) -> DataFrame:
    """variant, weight: results of status ok up to a p fixed beforehand, the smallest first (ties by variant); at most `most`."""
    ranked = results.filter((F.col("status") == "ok") & (F.col("p") <= max_p)).select("variant", F.col("effect").alias("weight"), "p")
    return (ranked if most is None else ranked.orderBy("p", "variant").limit(most)).select("variant", "weight")


def polygenic_scores(cells: DataFrame, samples: DataFrame, weights: DataFrame) -> DataFrame:
    """sample_id, score: the weighted sum of dosages (sample_id, variant, dosage) of each sample; missing ones at their mean over samples.

    A sum a sample of what differs from the mean, so absent cells cost nothing. A variant that nobody has called counts nowhere.
    """
    known = cells.filter(F.col("dosage").isNotNull()).join(weights, "variant")
    means = known.groupBy("variant").agg(F.avg("dosage").alias("mean"), F.first("weight").alias("weight"))
    base = means.agg(F.coalesce(F.sum(F.col("mean") * F.col("weight")), F.lit(0.0)).alias("base"))
    off = known.join(means.select("variant", "mean"), "variant").groupBy("sample_id").agg(F.sum(F.col("weight") * (F.col("dosage") - F.col("mean"))).alias("off"))
    return samples.select("sample_id").join(off, "sample_id", "left").crossJoin(F.broadcast(base)).select("sample_id", (F.col("base") + F.coalesce("off", F.lit(0.0))).alias("score"))  # base is one row


def score_report(discovery: DataFrame, scored: DataFrame, phenotype: DataFrame, n_permutations: int = 1000, n_bootstrap: int = 500, seed: int = 0) -> DataFrame:
    """The score of a target cohort against its phenotype (sample_id, y), with an interval and a permutation null.

    Refuses cohorts that share samples. Scores and phenotypes of the target, one number a sample each, come to the driver.
    """
    disjoint_or_refuse(discovery, scored, "sample_id")
    both = scored.join(phenotype, "sample_id").orderBy("sample_id").select("score", "y").toPandas()
    metric, every = score_metric(both.score.to_numpy(float), both.y.to_numpy(float)), np.arange(len(both))
    return evaluation(resampled(scored.sparkSession, metric, len(both), n_permutations, n_bootstrap, seed), metric(every, every))


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """class, precision, recall, f1, support, accuracy, balanced_accuracy: a row for each class that is there or predicted."""
    cells = predictions.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("t").alias("class"), F.col("n").alias("is"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("right"))
    sides = sides.union(cells.select("p", F.lit(0), "n", F.lit(0)))
    by = sides.groupBy("class").agg(F.sum("is").alias("support"), F.sum("said").alias("said"), F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(0.0)
    by = by.withColumns({"precision": ratio("right", "said"), "recall": ratio("right", "support")})
    whole = by.agg((F.sum("right").cast("double") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return by.crossJoin(F.broadcast(whole)).select("class", "precision", "recall", f1.alias("f1"), "support", "accuracy", "balanced_accuracy")  # whole is one row


def methods_report(statuses: dict[str, str], capabilities: dict[str, tuple[str, str | None]], manifests: dict | None = None) -> str:
    """What can be done, by tier, and which validations ran: Markdown. What has no status is NOT RUN."""
    state = lambda v: statuses.get(v, "NOT RUN")
    lines = ["# Methods and validation", "", "| capability | tier | validation | status |", "|-|-|-|-|"]
    lines += [f"| {name} | {tier} | {check or '-'} | {state(check) if check else '-'} |" for name, (tier, check) in sorted(capabilities.items())]
    lines += ["", *(f"* manifest {name}: {value}" for name, value in sorted((manifests or {}).items())), "", "An association is no evidence of cause, and a prediction none of a mechanism."]
    return "\n".join(lines)
