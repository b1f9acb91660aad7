"""Tables of censored assay values: parsed columns, ordinal codes, summaries, classes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import off_grid, parse_mic
from ..runtime import cut


class BreakpointUnverified(RuntimeError):
    pass


def parsed(records: DataFrame, raw: str = "measurement", sign: str | None = None, value: str | None = None, grid: float = 0.10) -> DataFrame:
    """records with the columns of parse_mic, in place of any of the same names, and off_grid."""
    one = parse_mic(F.col(raw), F.col(sign) if sign else None, F.col(value) if value else None)
    out = records.withColumn("_mic", one)
    fields = out.schema["_mic"].dataType.names
    return out.drop(*fields).select("*", "_mic.*").drop("_mic").withColumn("off_grid", F.col("mic_parse_ok") & off_grid(F.col("mic_boundary_mg_l"), grid))


def with_ordinal(records: DataFrame) -> DataFrame:
    """records and ordinal_code: places of values in order of bound, then left, exact, right; -1 if invalid.

    Distinct values are few, as assays use dilution steps, so they are numbered and joined back.
    """
    side = F.when(F.col("censoring") == "left", -1).when(F.col("censoring") == "right", 1).otherwise(0)
    level = F.when(F.col("mic_parse_ok"), F.struct(F.bround(F.log2("mic_boundary_mg_l"), 6).alias("b"), side.alias("s")))
    keyed = records.withColumn("_level", level)
    levels = keyed.filter(F.col("_level").isNotNull()).select("_level").distinct()
    codes = levels.agg(F.array_sort(F.collect_set("_level")).alias("levels")).select(F.posexplode("levels").alias("ordinal_code", "_level"))
    return keyed.join(codes, "_level", "left").withColumn("ordinal_code", F.coalesce("ordinal_code", F.lit(-1))).drop("_level")


def censoring_summary(records: DataFrame) -> DataFrame:
    n = lambda kind: F.count_if(F.col("censoring") == kind)
    sums = [F.count(F.lit(1)).alias("n"), *[n(k).alias(k) for k in ("exact", "left", "right", "invalid")], F.try_divide((n("left") + n("right")).cast("double"), F.count(F.lit(1))).alias("fraction_censored"), F.count_if("off_grid").alias("off_grid")]
    return records.agg(*sums)


def distribution(records: DataFrame) -> DataFrame:
    """mic_operator, mic_boundary_mg_l, n of valid values as reported."""
    return records.filter("mic_parse_ok").groupBy("mic_operator", "mic_boundary_mg_l").agg(F.count(F.lit(1)).alias("n"))


def extreme_contrast(records: DataFrame) -> DataFrame:
    """records and extreme_contrast: 0 for upper bounds under all lower bounds, 1 for lower bounds over all of those, else null.

    The bounds that occur are few, as assays use dilution steps, so they are found in one pass, and the limits among them.
    """
    left, right = F.col("mic_parse_ok") & (F.col("censoring") == "left"), F.col("mic_parse_ok") & (F.col("censoring") == "right")
    bounds = cut(records.select("mic_parse_ok", "censoring", "log2_boundary").distinct())
    lowest = bounds.agg(F.min(F.when(right, F.col("log2_boundary"))).alias("_least_right"))
    out = records.crossJoin(F.broadcast(lowest))  # one row
    highest = bounds.crossJoin(F.broadcast(lowest)).agg(F.max(F.when(left & (F.col("log2_boundary") < F.col("_least_right")), F.col("log2_boundary"))).alias("_most_low"))
    out = out.crossJoin(F.broadcast(highest))  # one row
    low, high = left & (F.col("log2_boundary") < F.col("_least_right")), right & (F.col("log2_boundary") > F.col("_most_low"))
    return out.withColumn("extreme_contrast", F.when(F.col("_most_low").isNotNull() & low, 0.0).when(high, 1.0)).drop("_least_right", "_most_low")


def interval_class(records: DataFrame, breakpoint: dict) -> DataFrame:
    """records and the class that the interval allows at a breakpoint, which must be verified; else indeterminate, or invalid."""
    needed = ("susceptible_max_mg_l", "resistant_min_mg_l", "verified_by", "source_excerpt")
    if breakpoint.get("status") != "VERIFIED" or any(not breakpoint.get(k) for k in needed):
        raise BreakpointUnverified("classes need a verified breakpoint")
    s, r = math.log2(breakpoint["susceptible_max_mg_l"]), math.log2(breakpoint["resistant_min_mg_l"])
    low, high = F.col("log2_lower"), F.col("log2_upper")
    label = F.when(~F.col("mic_parse_ok"), "invalid").when((low > s) & (high < r), "intermediate").when(low >= r, "resistant").when(high <= s, "susceptible").otherwise("indeterminate")
    return records.withColumn("binary_from_verified_breakpoint", label)
