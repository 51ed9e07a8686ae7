"""Sort, top-k, paging and set operations (TK, ST rows).

Global orderings are only used with a limit (``TakeOrderedAndProject``:
per-partition top-k, then a merge of k rows per partition), never as a
window without a partition key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    start: int = 1, rank_col: str = "rank") -> DataFrame:
    """Rows ranked ``start..start+k-1`` within each group (TK3, TK4).  Spark
    plans a per-partition group limit before the shuffle for rank filters."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(
        (F.col(rank_col) >= start) & (F.col(rank_col) < start + k))


def page(df: DataFrame, order: Sequence[Column], page_no: int = 1, page_size: int = 50) -> DataFrame:
    """One page of a stable total order (TK5): page >= 1, size 10..100."""
    if page_no < 1 or not 10 <= page_size <= 100:
        raise ValueError("page must be >= 1 and page_size in 10..100")
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def latest_n(df: DataFrame, ts: str, n: int = 1000, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows (TK6 history bound)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tiebreak]).limit(n)


def newer_than(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows strictly newer than ``as_of - days`` (TK6 history window)."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(ts).cast("timestamp") > cutoff)


def argmin_by(value: str, key: Sequence[str]) -> Column:
    """``min_by`` on a struct key: first listed wins ties when a position is part of the key (TK2)."""
    return F.min_by(F.col(value), F.struct(*[F.col(k) for k in key]))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name, missing columns as null (ST1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns absent from the schema (ST2): schema metadata only."""
    have = set(df.columns)
    return [c for c in required if c not in have]
