"""Feature scaling with whole-table parameters (ML1-ML4).

Parameters are one-row aggregates used as scalar subqueries (the quantiles of
the robust scaler are three numbers); nothing that grows is collected and no join against a one-row frame is planned.  Fitted
parameters can be written as a small Parquet table and applied later (ML4).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import exact_quantiles


def _parameters(df: DataFrame, cols: Sequence[str], functions: dict) -> Column:
    """All parameters of all columns from one aggregate: a struct-valued scalar
    subquery with fields ``<name>_<column>``, planned once and reused."""
    return df.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in functions.items()])).scalar()


def standard_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> DataFrame:
    """(x - mean) / population sd; a zero sd divides by 1 (ML1)."""
    p = _parameters(df, cols, {"mu": F.avg, "sd": F.stddev_pop})
    out = {}
    for c in cols:
        mu, sd = p[f"mu_{c}"], p[f"sd_{c}"]
        out[c + suffix] = (F.col(c) - mu) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns(out)


def robust_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_robust") -> DataFrame:
    """(x - median) / (q75 - q25) with exact, interpolated quantiles (ML2), found by selection over counted
    bins, so no task holds the distinct values."""
    out = {}
    for c in cols:
        row = exact_quantiles(df, c, [0.25, 0.5, 0.75]).first()
        q25, med, q75 = row["q"] if row else (0.0, None, 0.0)
        out[c + suffix] = (F.col(c) - F.lit(med).cast("double")) / ((q75 - q25) or 1.0)
    return df.withColumns(out)


def minmax_scale(df: DataFrame, cols: Sequence[str], suffix: str = "_mm") -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; a constant column maps to 0 (ML3)."""
    p = _parameters(df, cols, {"lo": F.min, "hi": F.max})
    out = {}
    for c in cols:
        lo, hi = p[f"lo_{c}"], p[f"hi_{c}"]
        out[c + suffix] = (F.col(c) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    return df.withColumns(out)


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fitted min/max per column as a long parameter table (ML3/ML4)."""
    rows = [df.agg(F.lit(c).alias("column"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
            for c in cols]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def save_params(params: DataFrame, path: str) -> str:
    params.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_minmax(df: DataFrame, params: DataFrame, col: str, out: str, inverse: bool = False) -> DataFrame:
    """Apply (or invert) a saved min/max scaler; the parameters enter as
    scalar subqueries over the saved table."""
    p = params.filter(F.col("column") == col).select(F.struct("min", "max")).scalar()
    lo, hi = p["min"], p["max"]
    span = F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)
    v = F.col(col) * span + lo if inverse else (F.col(col) - lo) / span
    return df.withColumn(out, v)
