"""Exact quantiles of any number of rows, groups and distinct values, without a task that holds them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightline.session import discard, stored

#: Bins of a pass; a (group, rank) has at most so many rows after the map-side aggregation.
BINS = 1024


def order_statistics(values: DataFrame, wanted: DataFrame, keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """The value of every wanted rank: (keys, rank, value).  ``values``: keys and a double ``v``, no nulls;
    ``wanted``: keys and ``rank`` from 0, below the group's size.

    Each pass counts the values of a rank's range in bins and keeps the bin that holds the rank, narrowed to
    the least and greatest value in it, until both are equal.  The range shrinks to one of ``bins`` parts of
    what the values span, so a few passes do; only counts are shuffled."""
    by = [*keys, "rank"]
    span = values.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = stored(wanted.join(span, list(keys)).withColumn("below", F.lit(0).cast("long")), "ranks")
    found = []
    while True:
        found.append(state.filter("lo = hi").select(*by, F.col("lo").alias("value")))
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            break
        rows = values.join(open_, list(keys)).filter("v BETWEEN lo AND hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: no overflow
        # the greatest value keeps a bin of its own, so a pass always parts the range
        place = F.when(F.col("v") == F.col("hi"), bins).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")
        counts = rows.groupBy(*by, "below", place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))
        at = counts.withColumn("upto", F.col("below") + upto)
        at = at.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = stored(at.select(*by, "lo", "hi", (F.col("upto") - F.col("n")).alias("below")), "ranks")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def exact_quantiles(df: DataFrame, col: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, q): array of the linearly interpolated quantiles of ``col`` per group, nulls and NaN left out; a
    group without values is absent.  Without ``keys`` one row."""
    by = list(keys) or ["_all"]
    v = df.select(*keys, *([] if keys else [F.lit(0).alias("_all")]), F.col(col).cast("double").alias("v"))
    v = stored(v.filter("v IS NOT NULL AND NOT isnan(v)"), "quantile-values")
    sizes = v.groupBy(*by).agg(F.count("*").alias("n"))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in probabilities]
    asked = sizes.select(*by, F.explode(F.array_distinct(F.flatten(F.array(
        *[F.array(F.floor(x).cast("long"), F.ceil(x).cast("long")) for x in place])))).alias("rank"))
    found = order_statistics(v, asked, by)
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))  # two per probability

    def interpolated(x):
        low, high = (F.element_at("m", f(x).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (x - F.floor(x))

    out = stored(held.join(sizes, by).select(*keys, F.array(*[interpolated(x) for x in place]).alias("q")), "quantiles")
    discard(v)
    return out
