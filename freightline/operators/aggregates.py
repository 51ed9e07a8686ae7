"""Aggregations and reshaping (AG rows).

Aggregates are declared with ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before the shuffle.  Whole-table scalars (medians,
totals) are computed as scalar subqueries (``DataFrame.scalar()``), never
as a window over the whole table or a join against a one-row frame.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightline.session import stored


def calendar(df: DataFrame, keys: Sequence[str], date_col: str, step: str = "1 day") -> DataFrame:
    """Complete per-series calendar from each series' first to last date.

    Only the per-series bounds are aggregated; the grid is generated in
    parallel with ``sequence`` + ``explode``.
    """
    b = df.groupBy(*keys).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    return b.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"INTERVAL {step}"))).alias(date_col))


def period_grid(df: DataFrame, keys: Sequence[str], ds: str, freq: str) -> DataFrame:
    """Every date of a frequency between each series' first and last date (FC1): ``D`` days, ``W`` Sundays,
    ``M`` month ends."""
    b = df.groupBy(*keys).agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    if freq == "D":
        dates = F.sequence("_lo", "_hi")
    elif freq == "W":
        first = F.date_add("_lo", (6 - F.weekday("_lo")).cast("int"))
        dates = F.when(first <= F.col("_hi"), F.sequence(first, F.greatest(first, F.col("_hi")), F.expr("INTERVAL 7 DAYS")))
    elif freq == "M":
        months = F.sequence(F.trunc("_lo", "month"), F.trunc("_hi", "month"), F.expr("INTERVAL 1 MONTH"))
        dates = F.filter(F.transform(months, lambda m: F.last_day(m)), lambda d: d <= F.col("_hi"))
    else:
        raise ValueError(f"unknown frequency {freq!r}")
    return b.select(*keys, F.explode(dates).alias(ds))


def daily_resample_sum(df: DataFrame, keys: Sequence[str], ts_col: str, value_col: str,
                       out_date: str = "ds", out_value: str = "y") -> DataFrame:
    """Daily sums per series with empty days filled by 0 (AG1)."""
    daily = (df.groupBy(*keys, F.to_date(ts_col).alias(out_date))
               .agg(F.sum(value_col).alias(out_value)))
    cal = calendar(daily, keys, out_date)
    return (cal.join(daily, [*keys, out_date], "left")
               .withColumn(out_value, F.coalesce(F.col(out_value), F.lit(0).cast(daily.schema[out_value].dataType))))


def pivot_exact(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Long -> wide without aggregation (AG3).  The caller checks duplicates
    first with :func:`freightline.operators.quality.duplicate_keys`; ``first``
    is then exact."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.first(value))


def pivot_mean(df: DataFrame, index: Sequence[str], column: str, value: str, values: Sequence[str]) -> DataFrame:
    """Pivot table with mean (AG4)."""
    return df.groupBy(*index).pivot(column, list(values)).agg(F.avg(value))


def relative_frequency(df: DataFrame, col: str, name: str = "pct") -> DataFrame:
    """Percent of rows per category (AG5); the total is a scalar subquery."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .withColumn(name, F.col("n") * 100.0 / total))


def forecast_accuracy(df: DataFrame, keys: Sequence[str], y: str = "y", yhat: str = "yhat",
                      lo: str | None = "yhat_lower", hi: str | None = "yhat_upper") -> DataFrame:
    """MAE, RMSE, MAPE (fraction, denominator floored at machine epsilon) and
    interval coverage (AG6)."""
    e = F.col(y) - F.col(yhat)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
            F.count(F.lit(1)).alias("n")]
    if lo and hi:
        aggs.append(F.avg(F.when((F.col(y) >= F.col(lo)) & (F.col(y) <= F.col(hi)), 1.0).otherwise(0.0)).alias("coverage"))
    return df.groupBy(*keys).agg(*aggs)


def pinball_loss(df: DataFrame, keys: Sequence[str], y: str, quantile_cols: dict) -> DataFrame:
    """Mean quantile loss per quantile column: ``{q: column}`` (AG7)."""
    aggs = []
    for q, c in quantile_cols.items():
        err = F.col(y) - F.col(c)
        aggs.append(F.avg(F.greatest(err * q, err * (q - 1))).alias(f"pinball_{int(round(q * 100)):02d}"))
    return df.groupBy(*keys).agg(*aggs)


def array_sum(arr: Column, field: str | None = None) -> Column:
    """Sum of an array (or one struct field of it), nulls count as 0 (AG10, AG13)."""
    if field is None:
        return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.coalesce(x[field].cast("double"), F.lit(0.0)))


def distributed_running_sum(df: DataFrame, order_col: str, value_cols: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Running sums over a global order without a single-partition window.

    Rows are range-partitioned on ``order_col``; each partition's totals (one
    row per partition) give the offsets, and a running window per partition
    adds them.  Adds ``<c>_before`` (sum over rows with a smaller order value,
    i.e. strictly preceding) for every value column.  ``order_col`` must be
    unique (aggregate ties first)."""
    from pyspark.sql import Window
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: a range partitioning drawn anew could place rows otherwise than the totals say
    p = stored(df.repartitionByRange(n, order_col).withColumn("_pid", F.spark_partition_id()), "running-sum")
    tot = p.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    wpid = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wpid), F.lit(0)).alias(f"_o_{c}") for c in value_cols])
    j = p.join(F.broadcast(offs), "_pid")
    w = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return j.select(*df.columns, *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_before")
                                   for c in value_cols])


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC with average ranks for tied scores (ML6).  Scores are first
    reduced to (score, positives, negatives) counts; the running count of
    negatives below each score comes from :func:`distributed_running_sum`
    (global) -- so no task ever holds all rows."""
    if keys:
        raise NotImplementedError("grouped AUC: call per group key")
    c = df.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                              F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    r = distributed_running_sum(c, score, ["neg"])
    num = F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg")))
    return r.agg((num / (F.sum("pos") * F.sum("neg"))).alias("auc"))
