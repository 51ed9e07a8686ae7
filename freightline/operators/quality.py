"""Data-quality rules (DQ rows).

Rules are boolean columns; :func:`rule_report` turns a dict of rules into an
array of failed rule names per row, and :func:`bulk_summary` into the
success/error counts of a bulk operation -- in one pass, no per-rule job.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Validation patterns and lists used by the reference models.
EMAIL_PATTERN = r"^[\w\.-]+@[\w\.-]+\.\w+$"
PHONE_PATTERN = r"^\+?[1-9]\d{1,14}$"
SHA256_PATTERN = r"^[a-f0-9]{64}$"
HS_CODE_PATTERN = r"^\d{6,10}$"
SHIPMENT_ID_PATTERN = r"^EIN-\d{4}-\d{4}-\d{4}$"
INCOTERMS = ["EXW", "FCA", "FAS", "FOB", "CFR", "CIF", "CPT", "CIP", "DAT", "DAP", "DDP"]
ROUTING_VEHICLE_TYPES = ["truck", "van", "refrigerated_truck", "construction", "tanker", "car"]
SENSOR_UNITS = {"TEMPERATURE": "°C", "HUMIDITY": "%", "SHOCK": "g", "LIGHT_EXPOSURE": "lux", "TILT": "degrees"}
TEMPERATURE_RANGE_C = (-50.0, 100.0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count (DQ2, AG3 precheck)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def contract_report(df: DataFrame, required: Sequence[str], date_cols: Sequence[str] = (),
                    numeric_cols: Sequence[str] = ()) -> DataFrame:
    """Dataset contract (DQ1, ST2): missing columns come from the schema (driver
    metadata only); unparseable dates and non-numeric values are counted in
    one distributed aggregate.  One row per check: ``check, column, failures``."""
    spark = df.sparkSession
    names = set(df.columns)
    missing = [c for c in required if c not in names]
    rows = [("required_column", c, 1) for c in missing]
    num_types = (T.NumericType,)
    for c in numeric_cols:
        if c in names and not isinstance(df.schema[c].dataType, num_types):
            rows.append(("numeric_type", c, 1))
    schema = "check STRING, column STRING, failures BIGINT"
    static = spark.createDataFrame(rows, schema)
    present = [c for c in date_cols if c in names]
    if not present:
        return static
    aggs = []
    for c in present:
        parsed = F.try_to_timestamp(F.col(c).cast("string"))
        aggs.append(F.count_if(F.col(c).isNotNull() & parsed.isNull()).alias(c))
    counts = df.agg(*aggs)
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit("date_parse").alias("check"), F.lit(c).alias("column"), F.col(c).cast("bigint").alias("failures"))
        for c in present])).alias("r")).select("r.*")
    return static.unionByName(stacked)


def valid_email(col) -> Column:
    return _c(col).rlike(EMAIL_PATTERN)


def valid_phone(col) -> Column:
    return _c(col).rlike(PHONE_PATTERN)


def max_length(col, n: int) -> Column:
    return F.length(_c(col)) <= n


def valid_coordinates(lat, lon) -> Column:
    return _c(lat).between(-90, 90) & _c(lon).between(-180, 180)


def valid_item(sku, quantity, weight, value, tmin=None, tmax=None) -> Column:
    ok = (F.length(_c(sku)).between(4, 20) & (_c(quantity) > 0) & (_c(weight) > 0) & (_c(value) >= 0))
    if tmin is not None:
        ok = ok & (_c(tmin).isNull() | _c(tmax).isNull() | (_c(tmin) < _c(tmax)))
    return ok


def unit_matches(sensor_type, unit, location_needs_unit: bool = True) -> Column:
    """Unit must equal the unit of the sensor type.  A type outside the map
    (LOCATION) is rejected by the reference whatever its unit; with
    ``location_needs_unit=False`` it is accepted instead."""
    pairs = []
    for k, v in SENSOR_UNITS.items():
        pairs += [F.lit(k), F.lit(v)]
    expected = F.element_at(F.create_map(*pairs), _c(sensor_type))
    ok = F.coalesce(expected == _c(unit), F.lit(False))
    if not location_needs_unit:
        ok = ok | (_c(sensor_type) == "LOCATION")
    return ok


def arrival_after_departure(arrival, departure) -> Column:
    return _c(arrival) > _c(departure)


def hazardous_declared(items) -> Column:
    """No item is hazardous without a hazard class (DQ8)."""
    return ~F.exists(_c(items), lambda i: i["hazardous"] & i["hazard_class"].isNull())


def valid_incoterm(col) -> Column:
    return _c(col).isin(INCOTERMS)


def valid_sha256(col) -> Column:
    return _c(col).rlike(SHA256_PATTERN)


def valid_hs_code(col) -> Column:
    return _c(col).rlike(HS_CODE_PATTERN)


def valid_document_id(col) -> Column:
    return F.length(_c(col)) >= 10


def valid_shipment_id(col) -> Column:
    return _c(col).rlike(SHIPMENT_ID_PATTERN)


def temperatures_in_range(readings) -> Column:
    lo, hi = TEMPERATURE_RANGE_C
    return F.forall(_c(readings), lambda t: t.between(lo, hi))


def ledger_shipment_valid(shipment_id, items, coverage) -> Column:
    """DQ13: id non-empty, at least one item, all quantities > 0, coverage >= 0."""
    return ((F.coalesce(F.length(_c(shipment_id)), F.lit(0)) > 0) & (F.size(_c(items)) >= 1)
            & F.forall(_c(items), lambda i: i["quantity"] > 0) & (F.coalesce(_c(coverage), F.lit(0.0)) >= 0))


def valid_routing_request(vehicle_type, waypoints) -> Column:
    return _c(vehicle_type).isin(ROUTING_VEHICLE_TYPES) & (F.size(_c(waypoints)) >= 2)


def factor_table_valid(df: DataFrame) -> DataFrame:
    """DQ16 on an emission-factor table: factors >= 0, load efficiency in [0,1], max load > 0."""
    ok = F.col("factor") >= 0
    if "load_efficiency" in df.columns:
        ok = ok & F.coalesce(F.col("load_efficiency").between(0, 1), F.lit(True))
    if "max_load_kg" in df.columns:
        ok = ok & F.coalesce(F.col("max_load_kg") > 0, F.lit(True))
    return df.withColumn("valid", ok)


def rule_report(df: DataFrame, rules: dict[str, Column], name: str = "failed_rules") -> DataFrame:
    """Array of the names of the failed rules per row (null rule = failed)."""
    flags = [F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*flags)))


def bulk_summary(report: DataFrame, name: str = "failed_rules", per_rule: Sequence[str] = ()) -> DataFrame:
    """Success count, error count and per-rule error counts (DQ14), one aggregate."""
    ok = F.size(name) == 0
    return report.agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"),
                      *[F.count_if(F.array_contains(name, r)).alias(f"{r}_errors") for r in per_rule])


def latest_valid_checks(checks: DataFrame, subject: str, check_type: str, checked_at: str,
                        passed: str, valid_until: str, as_of: str) -> DataFrame:
    """Latest check per (subject, type) and whether it certifies at ``as_of`` (DQ17)."""
    latest = (checks.groupBy(subject, check_type)
                    .agg(F.max_by(F.struct(passed, valid_until, checked_at), F.col(checked_at)).alias("_l")))
    return latest.select(subject, check_type, F.col(f"_l.{checked_at}").alias(checked_at),
                         F.col(f"_l.{passed}").alias(passed), F.col(f"_l.{valid_until}").alias(valid_until),
                         (F.col(f"_l.{passed}") & (F.col(f"_l.{valid_until}") >= F.lit(as_of).cast("timestamp")))
                         .alias("certified"))


def normalise_name(col) -> Column:
    return F.regexp_replace(F.upper(F.trim(_c(col))), r"[^A-Z0-9]", "")


def screen_parties(parties: DataFrame, entity: str, party: str, sanctions: DataFrame, list_name: str) -> DataFrame:
    """Any party on the sanctions list (DQ18): normalised-name equi join, then
    ``bool_or`` per entity; matches are kept as a sorted array."""
    p = parties.withColumn("_k", normalise_name(party))
    s = sanctions.select(normalise_name(list_name).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    j = p.join(s, "_k", "left")
    return (j.groupBy(entity).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("match_found"),
                                  F.array_sort(F.collect_set(F.when(F.col("_hit"), F.col(party)))).alias("matches")))
