"""Ordered per-series features (lags, rolling frames, fills, interpolation, sequences, splits).

All windows partition by the series key and order by time with a total
tie-break.  The series here are daily aggregates, so one partition holds at
most one row per calendar day whatever the raw data volume.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def add_lags(df: DataFrame, keys, order, col: str, lags: Sequence[int], prefix: str | None = None) -> DataFrame:
    """``lag(col, k)`` for every k in one window (WN1, WN4)."""
    w = _w(keys, order)
    p = prefix or col
    return df.withColumns({f"{p}_lag{k}": F.lag(col, k).over(w) for k in lags})


def rolling_mean(df: DataFrame, keys, order, col: str, n: int, name: str | None = None) -> DataFrame:
    """Mean over the last ``n`` rows, null until ``n`` rows exist (WN2)."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name or f"{col}_roll{n}",
                         F.when(F.count(F.lit(1)).over(w) == n, F.avg(col).over(w)))


def rolling_stddev(df: DataFrame, keys, order, col: str, n: int, name: str | None = None) -> DataFrame:
    """Sample standard deviation over the last ``n`` rows, null until ``n`` rows (WN5)."""
    w = _w(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name or f"{col}_std{n}",
                         F.when(F.count(F.lit(1)).over(w) == n, F.stddev_samp(col).over(w)))


def days_since_previous(df: DataFrame, keys, date_col: str, name: str = "days_since_prev",
                        tiebreak: Sequence[str] = ()) -> DataFrame:
    """Whole days from the previous row's date (WN3)."""
    w = _w(keys, [date_col, *tiebreak])
    return df.withColumn(name, F.datediff(F.col(date_col), F.lag(date_col).over(w)))


def _desc(order):
    return [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order]


def forward_back_fill(df: DataFrame, keys, order, cols: Sequence[str]) -> DataFrame:
    """Forward fill, then back fill the leading nulls (WN6).

    Both directions use running frames (the backward one over the reversed
    order): Spark evaluates a growing frame incrementally, whereas a frame
    ending at UNBOUNDED FOLLOWING is recomputed per row."""
    back = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(keys, _desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.last(c, True).over(ahead)) for c in cols})


def time_interpolate(df: DataFrame, keys, ts_col: str, col: str, name: str | None = None) -> DataFrame:
    """Linear interpolation weighted by time between the neighbouring known
    values; leading/trailing gaps are held flat (WN7)."""
    back = _w(keys, [ts_col]).rowsBetween(Window.unboundedPreceding, 0)
    ahead = _w(keys, _desc([ts_col])).rowsBetween(Window.unboundedPreceding, 0)
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    known = F.when(F.col(col).isNotNull(), F.struct(t.alias("t"), F.col(col).alias("v")))
    prev = F.last(known, True).over(back)
    nxt = F.last(known, True).over(ahead)
    span = (nxt["t"] - prev["t"]).cast("double")
    lin = prev["v"] + (nxt["v"] - prev["v"]) * F.when(span > 0, (t - prev["t"]) / span).otherwise(F.lit(0.0))
    val = (F.when(F.col(col).isNotNull(), F.col(col))
            .when(prev.isNull(), nxt["v"]).when(nxt.isNull(), prev["v"]).otherwise(lin))
    return df.withColumn(name or col, val)


def sliding_sequences(df: DataFrame, keys, order, col: str, lookback: int, horizon: int) -> DataFrame:
    """Per anchor row: the last ``lookback`` values and the next ``horizon`` values;
    only complete windows are kept, giving n - L - H + 1 rows per series (WN8)."""
    w = _w(keys, order)
    past = F.collect_list(col).over(w.rowsBetween(-(lookback - 1), 0))
    fut = F.collect_list(col).over(w.rowsBetween(1, horizon))
    return (df.withColumn("x", past).withColumn("y_future", fut)
              .filter((F.size("x") == lookback) & (F.size("y_future") == horizon)))


def chronological_split(df: DataFrame, keys, order, test_fraction: float = 0.2) -> DataFrame:
    """Mark the first floor(n*(1-p)) rows of each series as train (WN10)."""
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    return df.withColumn("is_train", rn <= F.floor(n * (1 - test_fraction)))


def expanding_folds(df: DataFrame, keys, order, k: int = 5) -> DataFrame:
    """Expanding-window time-series folds: test size floor(n/(k+1)); fold f
    trains on rows before its test block.  Output: one row per (row, fold)
    with ``role`` train/test; rows never used by any fold are dropped (WN11)."""
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = (df.withColumn("_rn", F.row_number().over(w) - 1)
           .withColumn("_ts", F.floor(n / (k + 1)))
           .withColumn("_start", n - F.lit(k) * F.col("_ts")))
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    d = d.withColumn("fold", F.explode(folds))
    test_lo = F.col("_start") + F.col("fold") * F.col("_ts")
    role = (F.when(F.col("_rn") < test_lo, F.lit("train"))
             .when(F.col("_rn") < test_lo + F.col("_ts"), F.lit("test")))
    return (d.withColumn("role", role).filter(F.col("role").isNotNull())
             .drop("_ts", "_start").withColumnRenamed("_rn", "row_idx"))


def running_sum(df: DataFrame, keys, order, col: str, name: str) -> DataFrame:
    """Cumulative sum along an ordered key (WN13)."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(col).over(w))


def mean_abs_step(arr: Column) -> Column:
    """Mean absolute step change of an array (WN9)."""
    steps = F.zip_with(F.slice(arr, 2, 1 << 30), F.slice(arr, 1, F.size(arr) - 1), lambda a, b: F.abs(a - b))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(steps), F.lit(1))
