"""Calendar helpers as column expressions (FN1-FN7) and a generated holiday table (FN3)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The custom supply-chain holidays (month, day).
CUSTOM_HOLIDAYS = [(1, 1), (12, 25), (10, 20)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def datetime_parts(ts) -> dict[str, Column]:
    """hour, day of week (Monday = 0), quarter, day of year, month (FN1)."""
    ts = _c(ts)
    return {
        "hour": F.hour(ts), "day_of_week": F.weekday(ts), "quarter": F.quarter(ts),
        "day_of_year": F.dayofyear(ts), "month": F.month(ts),
    }


def is_custom_holiday(d) -> Column:
    """1 Jan, 25 Dec or 20 Oct, compared on dates (FN2)."""
    d = F.to_date(_c(d))
    out = F.lit(False)
    for m, day in CUSTOM_HOLIDAYS:
        out = out | ((F.month(d) == m) & (F.dayofmonth(d) == day))
    return out


def period_end_flags(d) -> dict[str, Column]:
    """Month-end and quarter-end flags (FN4)."""
    d = F.to_date(_c(d))
    me = d == F.last_day(d)
    return {"is_month_end": me, "is_quarter_end": me & (F.month(d) % 3 == 0)}


def fourier_terms(d, period: float, orders=(1, 2), include_zero: bool = False, prefix: str | None = None) -> dict[str, Column]:
    """sin/cos(2*i*pi*doy/period) (FN5); the weekly term also uses day of year."""
    doy = F.dayofyear(_c(d)).cast("double")
    p = prefix or f"p{period:g}".replace(".", "_")
    out = {}
    for i in ([0] if include_zero else []) + list(orders):
        arg = doy * (2.0 * i * math.pi / period)
        out[f"{p}_sin{i}"] = F.sin(arg)
        out[f"{p}_cos{i}"] = F.cos(arg)
    return out


def _fiscal_end(fy: Column, start_month: int) -> Column:
    """The 30th of the month before ``start_month`` (in the next year unless the
    fiscal year starts in January), or that month's last day when shorter."""
    prev = 12 if start_month == 1 else start_month - 1
    y = fy if start_month == 1 else fy + 1
    first = F.make_date(y, F.lit(prev), F.lit(1))
    return F.least(F.date_add(first, 29), F.last_day(first))


def fiscal_week(d, start_month: int = 4) -> Column:
    """Fiscal week number (1-based) counted in Sundays from the first Sunday on or
    after the 1st of ``start_month`` up to the fiscal year end (FN6).  Null for
    days outside that span."""
    d = F.to_date(_c(d))
    fy = F.when(F.month(d) >= start_month, F.year(d)).otherwise(F.year(d) - 1)
    start = F.make_date(fy, F.lit(start_month), F.lit(1))
    # dayofweek: Sunday = 1 ... Saturday = 7
    first_sunday = F.date_add(start, ((F.lit(8) - F.dayofweek(start)) % 7).cast("int"))
    diff = F.datediff(d, first_sunday)
    return F.when((diff >= 0) & (d <= _fiscal_end(fy, start_month)), F.floor(diff / 7) + 1)


def fiscal_weeks(spark: SparkSession, year: int, start_month: int = 4) -> DataFrame:
    """All Sundays of one fiscal year with their week number (FN6)."""
    start = F.make_date(F.lit(year), F.lit(start_month), F.lit(1))
    end = _fiscal_end(F.lit(year), start_month)
    days = spark.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    sundays = days.filter(F.dayofweek("date") == 1)
    return sundays.select("date", fiscal_week("date", start_month).alias("fiscal_week"))


def _busday_index(d: Column) -> Column:
    u = F.unix_date(d) + 3  # 1970-01-01 was a Thursday: shift so Monday = 0
    return F.lit(5) * F.floor(u / 7) + F.least(F.lit(5), F.pmod(u, F.lit(7)))


def business_days(start, end) -> Column:
    """Business days (Mon-Fri) in [start, end); for start > end the negative
    count of business days in (end, start], matching numpy ``busday_count`` (FN7)."""
    a, b = F.to_date(_c(start)), F.to_date(_c(end))
    fwd = _busday_index(b) - _busday_index(a)
    back = -(_busday_index(F.date_add(a, 1)) - _busday_index(F.date_add(b, 1)))
    return F.when(a <= b, fwd).otherwise(back).cast("bigint")


def _nth_weekday(year: Column, month: int, weekday_sun1: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    off = (F.lit(weekday_sun1) - F.dayofweek(first) + 7) % 7
    return F.date_add(first, (off + 7 * (n - 1)).cast("int"))


def _last_weekday(year: Column, month: int, weekday_sun1: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    off = (F.dayofweek(last) - F.lit(weekday_sun1) + 7) % 7
    return F.date_sub(last, off.cast("int"))


def _observed(d: Column) -> Column:
    """Saturday -> Friday, Sunday -> Monday."""
    return (F.when(F.dayofweek(d) == 7, F.date_sub(d, 1))
             .when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d))


def us_holidays(spark: SparkSession, first_year: int = 2010, last_year: int = 2030,
                include_inventory_days: bool = True) -> DataFrame:
    """Generated holiday table ``(ds, holiday)``: US federal holidays by rule
    (fixed dates with observed shifts, nth/last weekday rules) plus quarter-end
    ``inventory_day`` events (FN3).  Size: ~15 rows per year."""
    return holidays_of_years(spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y")), include_inventory_days)


def holidays_of_years(y: DataFrame, include_inventory_days: bool = True) -> DataFrame:
    """The table of :func:`us_holidays` for the years in column ``y``."""
    rules = _holiday_rules(F.col("y"), include_inventory_days)
    arr = F.array(*[F.struct(F.lit(n).alias("holiday"), d.alias("ds")) for n, d in rules])
    return y.select(F.explode(arr).alias("h")).select("h.ds", "h.holiday").filter(F.col("ds").isNotNull())


def us_holiday_name(d) -> Column:
    """Holiday name of a date by the same rules as :func:`us_holidays`, for any year and without a
    table or join; null on other days, the first name in alphabetical order where two meet.  The
    observed New Year's Day of the following year may fall on 31 December."""
    d = F.to_date(_c(d))
    y = F.year(d)
    rules = _holiday_rules(y) + _holiday_rules(y + 1)[:1]
    return F.least(*[F.when(d == day, F.lit(name)) for name, day in rules])


def _holiday_rules(yc: Column, include_inventory_days: bool = True) -> list[tuple[str, Column]]:
    """(name, date) of each holiday of the year ``yc``, New Year's Day first."""
    rules = [
        ("New Year's Day", _observed(F.make_date(yc, F.lit(1), F.lit(1)))),
        ("Martin Luther King Jr. Day", _nth_weekday(yc, 1, 2, 3)),
        ("Washington's Birthday", _nth_weekday(yc, 2, 2, 3)),
        ("Memorial Day", _last_weekday(yc, 5, 2)),
        ("Juneteenth National Independence Day",
         F.when(yc >= 2021, _observed(F.make_date(yc, F.lit(6), F.lit(19))))),
        ("Independence Day", _observed(F.make_date(yc, F.lit(7), F.lit(4)))),
        ("Labor Day", _nth_weekday(yc, 9, 2, 1)),
        ("Columbus Day", _nth_weekday(yc, 10, 2, 2)),
        ("Veterans Day", _observed(F.make_date(yc, F.lit(11), F.lit(11)))),
        ("Thanksgiving", _nth_weekday(yc, 11, 5, 4)),
        ("Christmas Day", _observed(F.make_date(yc, F.lit(12), F.lit(25)))),
    ]
    if include_inventory_days:
        for q in (3, 6, 9, 12):
            rules.append(("inventory_day", F.last_day(F.make_date(yc, F.lit(q), F.lit(1)))))
    return rules
