"""Deterministic rounding for reported values.

Reports round through ``DECIMAL(38,8)`` first, so a binary double that sits
just below a decimal half (e.g. 174118.07875 stored as ...0787499999) is
rounded the same way by every engine that reads the report.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c, digits: int = 4) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(38,8)"), digits).cast("double")


def round_half_up_sql(expr: str, digits: int = 4) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def round_significant(c, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (for values that can be huge,
    e.g. a MAPE over zero actuals): scale by a power of ten, round, unscale."""
    c = F.col(c) if isinstance(c, str) else c
    e = F.floor(F.log10(F.abs(c)))
    scaled = F.round((c / F.pow(F.lit(10.0), e)).cast("decimal(38,18)"), digits).cast("double")
    return F.when(c == 0, F.lit(0.0)).otherwise(scaled * F.pow(F.lit(10.0), e))


def round_significant_sql(expr: str, digits: int = 9) -> str:
    e = f"floor(log10(abs({expr})))"
    return (f"CASE WHEN {expr} = 0 THEN 0.0 ELSE CAST(round(CAST({expr} / pow(10.0, {e}) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"
            f" * pow(10.0, {e}) END")
