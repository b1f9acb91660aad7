"""Distribution functions for SQL: p_t(t, df), p_norm(z), chi2_isf1(p), hwe_exact(n0, n1, n2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..runtime import ship
from . import dist


def known(values, *given: pd.Series) -> pd.Series:
    """Null where any argument is."""
    return pd.Series(np.where(np.any([pd.isna(g) for g in given], axis=0), np.nan, values))


@pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return known(dist.t_two_sided(t.to_numpy(float), df.to_numpy(float)), t, df)


@pandas_udf(DoubleType())
def p_norm(z: pd.Series) -> pd.Series:
    return known(2 * dist.norm_sf(np.abs(z.to_numpy(float))), z)


@pandas_udf(DoubleType())
def chi2_isf1(p: pd.Series) -> pd.Series:
    return known(dist.chi2_1_isf(p.fillna(1).to_numpy(float)), p)


@pandas_udf(DoubleType())
def hwe_exact(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    from ..operators.qc import hwe_exact as test

    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else test(int(a), int(b), int(c)) for a, b, c in zip(n0, n1, n2, strict=True)], dtype=float)


def register(spark: SparkSession) -> None:
    ship(spark)
    for f in (p_t, p_norm, chi2_isf1, hwe_exact):
        spark.udf.register(f.__name__, f)
