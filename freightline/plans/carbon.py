"""Carbon, emissions and transport cost as column expressions (CB rows).

Every calculation is a pure JVM expression over per-leg columns; the
factor tables are literal maps (a handful of entries), so no join or
broadcast is needed and each leg is priced where it is read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

# Emission factors (kg CO2 per tonne-km) by vehicle type.
EMISSION_FACTORS = {
    "diesel_truck": 0.162, "electric_truck": 0.045, "cargo_ship": 0.010, "air_freight": 0.805,
    "rail": 0.024, "drone": 0.150, "hydrogen_truck": 0.100,
}
# Regional adjustment of the emission factor (default 1.0).
REGION_ADJUSTMENT = {"EU": 1.0, "NA": 1.1, "AS": 1.2, "SA": 1.15, "AF": 1.3, "OC": 1.05}
# Electricity carbon intensity, kg CO2 per kWh (default 0.3).
ELECTRICITY_MIX = {"EU": 0.276, "NA": 0.385}
ELECTRICITY_DEFAULT = 0.3
# Fuel carbon content, kg CO2 per litre.
FUEL_CARBON = {"diesel": 2.68, "hydrogen": 0.0, "jet_fuel": 2.53}
WELL_TO_TANK = 1.15
HYDROGEN_PRODUCTION_PER_LITRE = 9.3
# Carbon prices and annual limits per regulation.
CARBON_PRICE = {"EU_ETS": 85.0, "CBP": 28.0}
REGULATION_LIMIT_KG = {"EU_ETS": 10000.0, "CBP": 25000.0}
KG_CO2_PER_TREE = 21.77
# Fleet cost per km by vehicle (default 0.3).
COST_PER_KM = {"diesel_truck": 0.35, "electric_truck": 0.28, "rail": 0.15}
COST_PER_KM_DEFAULT = 0.3
# Ledger emission factors by transport mode.
LEDGER_FACTORS = {"truck": 0.206, "ship": 0.010, "air": 0.500}
# Routing-profile impact constants.
ROUTE_G_PER_KM = {"truck": 150.0, "van": 120.0, "car": 100.0}
ROUTE_G_PER_KM_DEFAULT = 150.0
FUEL_L_PER_KM, ENERGY_KWH_PER_KM, NOISE_PER_KM = 0.35, 0.8, 1.2
# Transport cost constants (fuel $/gallon, km per mile, mpg, average kph, maintenance per km).
FUEL_PRICE_PER_GALLON = 3.50
KM_PER_MILE = 1.60934
MPG = {"truck": 6.5, "van": 12.0, "car": 30.0}
MPG_DEFAULT = 8.0
AVERAGE_KPH = 80.0
MAINTENANCE_PER_KM = 0.15
# Route compliance thresholds (California Air Resources Board).
CARB_CO2_G_PER_KM, CARB_NOISE_LIMIT = 150.0, 75.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))


def lit_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def emission_factor(vehicle, region) -> Column:
    """Region-adjusted factor; unknown vehicle -> null, unknown region -> x1.0."""
    return F.element_at(lit_map(EMISSION_FACTORS), _c(vehicle)) * F.coalesce(
        F.element_at(lit_map(REGION_ADJUSTMENT), _c(region)), F.lit(1.0))


def co2(distance_km, vehicle, load_kg=1000.0, empty_return=False, region=None, fuel_efficiency=None,
        spec_max_load=None, spec_efficiency=None, spec_load_efficiency=None,
        well_to_tank: bool = True) -> dict[str, Column]:
    """Emissions of one leg (CB1-CB4): ``{"co2_kg": value, "error": message}``.

    * specs given (max load not null): load = min(load, max_load) * load_efficiency (CB2)
    * ``fuel_efficiency`` and a diesel/hydrogen truck: fuel branch, unrounded (CB3)
    * electric truck: (km / spec efficiency) * tonnes * grid intensity, unrounded;
      no spec efficiency -> null value and an error message (CB4)
    * otherwise factor * km * tonnes (* 1.15 well-to-tank), rounded to 2 places (CB1)
    """
    v = _c(vehicle)
    region = F.lit("EU") if region is None else region
    load = _c(load_kg).cast("double")
    has_specs = _c(spec_max_load).isNotNull() if spec_max_load is not None else F.lit(False)
    if spec_max_load is not None:
        load = F.when(has_specs, F.least(load, _c(spec_max_load)) * F.coalesce(_c(spec_load_efficiency), F.lit(1.0))).otherwise(load)
    tons = load / 1000.0
    dist = _c(distance_km) * F.when(_c(empty_return), F.lit(2.0)).otherwise(F.lit(1.0))
    factor = emission_factor(v, region)
    standard = factor * dist * tons
    if well_to_tank:
        standard = standard * WELL_TO_TANK
    standard = round_half_up(standard, 2)
    value = standard
    error = F.when(factor.isNull(), F.concat(F.lit("Unknown vehicle type "), v))
    # electric branch
    eff = _c(spec_efficiency) if spec_efficiency is not None else F.lit(None).cast("double")
    intensity = F.coalesce(F.element_at(lit_map(ELECTRICITY_MIX), _c(region)), F.lit(ELECTRICITY_DEFAULT))
    electric_ok = eff.isNotNull() & (eff != 0)
    electric = F.when(electric_ok, dist / eff * tons * intensity)
    value = F.when(v == "electric_truck", electric).otherwise(value)
    error = F.when((v == "electric_truck") & ~electric_ok,
                   F.lit("Electric vehicles require fuel_efficiency specification")).otherwise(error)
    # fuel branch takes precedence for diesel/hydrogen trucks with an efficiency override
    if fuel_efficiency is not None:
        fe = _c(fuel_efficiency)
        fuel_ok = fe.isNotNull() & (fe != 0) & v.isin("diesel_truck", "hydrogen_truck")
        litres = dist / fe
        per_l = F.when(v == "diesel_truck", F.lit(FUEL_CARBON["diesel"])).otherwise(F.lit(FUEL_CARBON["hydrogen"]))
        fuel = litres * per_l * tons
        if well_to_tank:
            fuel = fuel + F.when(v == "hydrogen_truck", litres * HYDROGEN_PRODUCTION_PER_LITRE).otherwise(F.lit(0.0))
        value = F.when(fuel_ok, fuel).otherwise(value)
        error = F.when(fuel_ok, F.lit(None).cast("string")).otherwise(error)
    return {"co2_kg": value, "error": error}


def carbon_price(regulations: Sequence[str]) -> float:
    """Highest configured price; unknown regulation counts 0 (CB8)."""
    return max(CARBON_PRICE.get(r, 0.0) for r in regulations)


def compliance(df: DataFrame, emissions: str, regulations: Sequence[str] = ("EU_ETS",)) -> DataFrame:
    """One row per (input row, regulation): compliant (strictly below the limit),
    allowed limit (inf if unknown) and excess (CB7).  The regulation list is a
    literal array exploded per row -- no join."""
    regs = F.array(*[F.struct(F.lit(r).alias("regulation"),
                              F.lit(REGULATION_LIMIT_KG.get(r, float("inf"))).alias("allowed")) for r in regulations])
    x = df.withColumn("_r", F.explode(regs)).select("*", "_r.regulation", "_r.allowed").drop("_r")
    return x.withColumns({
        "compliant": F.col(emissions) < F.col("allowed"),
        "excess": F.greatest(F.lit(0.0), F.col(emissions) - F.col("allowed")),
    })


def cost_per_km(vehicle) -> Column:
    return F.coalesce(F.element_at(lit_map(COST_PER_KM), _c(vehicle)), F.lit(COST_PER_KM_DEFAULT))


def ledger_footprint(distance_km, weight_kg, mode) -> dict[str, Column]:
    """km x tonnes x factor by mode (truck/ship/air); unknown mode -> error (CB9)."""
    f = F.element_at(lit_map(LEDGER_FACTORS), _c(mode))
    return {"co2_kg": _c(distance_km) * (_c(weight_kg) / 1000.0) * f,
            "error": F.when(f.isNull(), F.concat(F.lit("unknown transport mode: "), _c(mode)))}


def route_impact(distance_m, vehicle_type) -> Column:
    """Environmental impact of a routed path (CB10) as a struct."""
    km = _c(distance_m) / 1000.0
    g = F.coalesce(F.element_at(lit_map(ROUTE_G_PER_KM), _c(vehicle_type)), F.lit(ROUTE_G_PER_KM_DEFAULT))
    co2_kg = g * km / 1000.0
    return F.struct(co2_kg.alias("co2_kg"), (km * FUEL_L_PER_KM).alias("fuel_liters"),
                    (km * ENERGY_KWH_PER_KM).alias("energy_kwh"), (km * NOISE_PER_KM).alias("noise_impact"),
                    F.greatest(F.lit(0.0), 100 - co2_kg * 10).alias("eco_score"))


def route_compliance(co2_kg, noise, distance_m) -> dict[str, Column]:
    """CO2 per km above 150 g or noise above 75 -> issues (CB11); distance is an argument."""
    # a zero-length route has no per-km figure (null) rather than failing the job
    per_km = F.try_divide(_c(co2_kg) * 1000.0, _c(distance_m) / 1000.0)
    issues = F.array_compact(F.array(
        F.when(per_km > CARB_CO2_G_PER_KM, F.format_string("CO2 emissions %.1fg/km exceeds limit", per_km)),
        F.when(_c(noise) > CARB_NOISE_LIMIT, F.format_string("Noise level %.1fdB exceeds limit", _c(noise)))))
    return {"passed": F.size(issues) == 0, "issues": issues}


def transport_cost(distance_km, vehicle_type, tolls, labor_rate) -> dict[str, Column]:
    """Fuel, tolls, labour, maintenance; the total leaves maintenance out, as in the reference (CB12)."""
    mpg = F.coalesce(F.element_at(lit_map(MPG), _c(vehicle_type)), F.lit(MPG_DEFAULT))
    fuel = (_c(distance_km) / KM_PER_MILE) / mpg * FUEL_PRICE_PER_GALLON
    labor = (_c(distance_km) / AVERAGE_KPH) * _c(labor_rate)
    return {"fuel": fuel, "tolls": _c(tolls), "labor": labor, "maintenance": _c(distance_km) * MAINTENANCE_PER_KM,
            "total": fuel + _c(tolls) + labor}


def trees_equivalent(kg) -> Column:
    return F.round(_c(kg) / KG_CO2_PER_TREE, 0).cast("bigint")


def latest_factors(versions: DataFrame, keys: Sequence[str] = ("vehicle_type", "region")) -> DataFrame:
    """Newest factor row per key by ``last_updated`` (CB16)."""
    return versions.groupBy(*keys).agg(
        F.max_by(F.struct("factor", "source", "last_updated"), F.col("last_updated")).alias("_f")
    ).select(*keys, "_f.factor", "_f.source", "_f.last_updated")
