"""Projections, filters and cleaning steps (PRJ rows)."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles


def replace_sentinel(df: DataFrame, sentinel: str = "N/A", cols: Sequence[str] | None = None) -> DataFrame:
    """Sentinel text -> null in every (or the given) string column (PRJ1)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def exact_median(df: DataFrame, col: str) -> Column:
    """Exact global median (linear interpolation) as a literal; null without values.  Found by selection over
    counted bins (:mod:`quantiles`), so no task holds the distinct values."""
    row = exact_quantiles(df, col, [0.5]).first()
    return F.lit(row["q"][0] if row else None).cast("double")


def fill_with_median(df: DataFrame, col: str) -> DataFrame:
    """Null -> global median of the column (PRJ2)."""
    return df.withColumn(col, F.coalesce(F.col(col), exact_median(df, col)))


def whole_days_between(end, start) -> Column:
    """Whole days between two dates or timestamps, floored (PRJ4)."""
    end = F.col(end) if isinstance(end, str) else end
    start = F.col(start) if isinstance(start, str) else start
    secs = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(secs / F.lit(86_400_000_000)).cast("bigint")


def strict_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Keep ``lo < col < hi`` (PRJ5)."""
    return df.filter((F.col(col) > lo) & (F.col(col) < hi))


def remove_outliers(df: DataFrame, keys: Sequence[str], col: str, n_std: float = 3.0) -> DataFrame:
    """Keep rows within mean +- n_std * sample sd of their series, inclusive (PRJ6).

    Per-series statistics are an aggregate joined back on the key, so the
    statistics shuffle is one row per series.
    """
    stats = df.groupBy(*keys).agg(F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd"))
    j = df.join(stats, list(keys))
    ok = F.abs(F.col(col) - F.col("_mu")) <= F.lit(n_std) * F.col("_sd")
    # a single-row series has sd null: nothing can be an outlier there
    return j.filter(ok | F.col("_sd").isNull()).drop("_mu", "_sd")


def rename_columns(df: DataFrame, fn: Callable[[str], str] = str.lower, mapping: dict | None = None) -> DataFrame:
    """Rename by function and explicit mapping (PRJ7)."""
    m = {c: fn(c) for c in df.columns}
    m.update(mapping or {})
    return df.withColumnsRenamed({k: v for k, v in m.items() if k != v})


def add_constants(df: DataFrame, **values) -> DataFrame:
    """Constant columns such as ``cap`` and ``floor`` (PRJ8)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def compose_filters(conds: dict[str, Column | None]) -> Column:
    """AND of the given optional predicates; ``None`` means 'no filter' (PRJ12)."""
    out = F.lit(True)
    for c in conds.values():
        if c is not None:
            out = out & c
    return out


def search_filter(df: DataFrame, status=None, origin=None, destination=None, created_after=None,
                  created_before=None, carrier=None, cols: dict | None = None) -> DataFrame:
    """Shipment search with optional criteria; each is a pushed-down predicate."""
    c = {"status": "status", "origin": "origin", "destination": "destination",
         "created": "created", "carrier": "carrier"}
    c.update(cols or {})
    conds = {
        "status": F.col(c["status"]) == status if status is not None else None,
        "origin": F.col(c["origin"]) == origin if origin is not None else None,
        "destination": F.col(c["destination"]) == destination if destination is not None else None,
        "after": F.col(c["created"]) >= F.lit(created_after) if created_after is not None else None,
        "before": F.col(c["created"]) <= F.lit(created_before) if created_before is not None else None,
        "carrier": F.col(c["carrier"]) == carrier if carrier is not None else None,
    }
    return df.filter(compose_filters(conds))


def retention(df: DataFrame, ts_col: str, as_of: str, days: int) -> DataFrame:
    """Keep rows newer than ``as_of - days`` (PRJ22; at least 30 days)."""
    if days < 30:
        raise ValueError("data_retention_days must be >= 30")
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(ts_col).cast("timestamp") >= cutoff)


def title_from_snake(col) -> Column:
    """``'cold_storage'`` -> ``'Cold Storage'`` (FN16)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.initcap(F.regexp_replace(c, "_", " "))
