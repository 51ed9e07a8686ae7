"""Carbon and cost queries (CB rows, AG9, AG10, JN10, TK2)."""
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..plans import carbon as cb
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register

# Test binding: vehicle specifications per vehicle type (max load kg, km per L or kWh, load efficiency).
VEHICLE_SPECS = {"diesel_truck": (18000.0, 3.2, 0.85), "electric_truck": (20000.0, 1.5, 0.9)}


def _case(d: dict, key: str, default="NULL") -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items()) + f" ELSE {default} END"


def R(expr: str, d: int = 4) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {d}) AS DOUBLE)"


def legs_with_specs(spark, sf):
    lg = view(spark, sf, "legs")
    spec = {k: F.element_at(cb.lit_map({v: s[i] for v, s in VEHICLE_SPECS.items()}), F.col("vehicle_type"))
            for i, k in enumerate(("spec_max_load", "spec_efficiency", "spec_load_eff"))}
    return lg.withColumns(spec)


_SPEC_SQL = view_sql("legs") + f""",
ls AS (SELECT *, {_case({k: v[0] for k, v in VEHICLE_SPECS.items()}, 'vehicle_type')} AS spec_max_load,
              {_case({k: v[1] for k, v in VEHICLE_SPECS.items()}, 'vehicle_type')} AS spec_efficiency,
              {_case({k: v[2] for k, v in VEHICLE_SPECS.items()}, 'vehicle_type')} AS spec_load_eff FROM legs),
lt AS (SELECT *, CASE WHEN spec_max_load IS NOT NULL THEN (CASE WHEN load_kg < spec_max_load THEN load_kg ELSE spec_max_load END) * spec_load_eff
                      ELSE load_kg END / 1000.0 AS tons,
              distance_km * CASE WHEN empty_return THEN 2.0 ELSE 1.0 END AS dist,
              {_case(cb.EMISSION_FACTORS, 'vehicle_type')} * {_case(cb.REGION_ADJUSTMENT, 'region', '1.0')} AS factor,
              {_case(cb.ELECTRICITY_MIX, 'region', repr(cb.ELECTRICITY_DEFAULT))} AS intensity FROM ls),
em AS (SELECT *, CASE WHEN vehicle_type = 'electric_truck' THEN dist / spec_efficiency * tons * intensity
                      ELSE {R('factor * dist * tons * 1.15', 2)} END AS co2_kg FROM lt)
"""


def leg_emissions(spark, sf, **kw):
    lg = legs_with_specs(spark, sf)
    r = cb.co2("distance_km", "vehicle_type", "load_kg", "empty_return", F.col("region"),
               spec_max_load=F.col("spec_max_load"), spec_efficiency=F.col("spec_efficiency"),
               spec_load_efficiency=F.col("spec_load_eff"), **kw)
    return lg.withColumns(r)


@register("cb1_cb2_cb4_leg_emissions", _SPEC_SQL + f"SELECT order_key, line_no, {R('co2_kg')} AS co2_kg FROM em")
def q_cb1(spark, sf):
    e = leg_emissions(spark, sf)
    return e.select("order_key", "line_no", round_half_up("co2_kg", 4).alias("co2_kg"))


@register("cb3_fuel_based_emissions", _SPEC_SQL + f"""
SELECT order_key, line_no, {R("CASE WHEN vehicle_type IN ('diesel_truck','hydrogen_truck') THEN "
                              "dist / 3.2 * CASE vehicle_type WHEN 'diesel_truck' THEN 2.68 ELSE 0.0 END * tons "
                              "+ CASE WHEN vehicle_type = 'hydrogen_truck' THEN dist / 3.2 * 9.3 ELSE 0.0 END ELSE co2_kg END")} AS co2_kg
FROM em""")
def q_cb3(spark, sf):
    e = leg_emissions(spark, sf, fuel_efficiency=F.lit(3.2))
    return e.select("order_key", "line_no", round_half_up("co2_kg", 4).alias("co2_kg"))


_SCENARIOS = [("as_planned", False, "region"), ("with_empty_return", True, "region"), ("eu_factors", False, "'EU'")]


@register("cb5_scenario_comparison", view_sql("legs") + f""",
sc AS (SELECT l.*, s.name, s.force_return, CASE WHEN s.eu THEN 'EU' ELSE l.region END AS reg FROM legs l,
       (VALUES ('as_planned', false, false), ('with_empty_return', true, false), ('eu_factors', false, true)) s(name, force_return, eu)),
calc AS (SELECT order_key, line_no, name, vehicle_type, load_kg / 1000.0 AS tons,
         distance_km * CASE WHEN empty_return OR force_return THEN 2.0 ELSE 1.0 END AS dist,
         {_case(cb.EMISSION_FACTORS, 'vehicle_type')} * {_case(cb.REGION_ADJUSTMENT, 'reg', '1.0')} AS factor FROM sc)
SELECT order_key, line_no, name AS scenario,
  CASE WHEN vehicle_type = 'electric_truck' THEN NULL ELSE {R(R('factor * dist * tons * 1.15', 2))} END AS value,
  CASE WHEN vehicle_type = 'electric_truck' THEN 'Electric vehicles require fuel_efficiency specification' END AS error
FROM calc""")
def q_cb5(spark, sf):
    """Each leg under three scenarios; a failing scenario returns its message
    while the others still produce values.  Scenarios are a literal array
    exploded per leg (no join)."""
    lg = view(spark, sf, "legs")
    sc = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("force_return"), F.lit(eu).alias("eu"))
                   for n, r, eu in [("as_planned", False, False), ("with_empty_return", True, False), ("eu_factors", False, True)]])
    x = lg.withColumn("_s", F.explode(sc)).select("*", "_s.*").drop("_s")
    r = cb.co2("distance_km", "vehicle_type", "load_kg", F.col("empty_return") | F.col("force_return"),
               F.when(F.col("eu"), F.lit("EU")).otherwise(F.col("region")))
    return x.select("order_key", "line_no", "scenario", round_half_up(r["co2_kg"], 4).alias("value"), r["error"].alias("error"))


_ALLOWED = ["diesel_truck", "electric_truck", "rail"]


_CB6_SQL = view_sql("legs") + f""",
lr AS (SELECT *, row_number() OVER () AS rid FROM legs),
opt AS (SELECT l.rid, l.order_key, l.line_no, l.distance_km,
        CASE WHEN l.vehicle_type IN ('diesel_truck','electric_truck','rail') THEN l.vehicle_type ELSE 'diesel_truck' END AS cur,
        v.vehicle, v.pos,
        CASE WHEN v.vehicle = 'electric_truck' THEN NULL
             ELSE {R(f"{_case(cb.EMISSION_FACTORS, 'v.vehicle')} * l.distance_km * CASE WHEN l.empty_return THEN 2.0 ELSE 1.0 END * l.load_kg / 1000.0 * 1.15", 2)} END AS em
        FROM lr l, (VALUES ('diesel_truck', 0), ('electric_truck', 1), ('rail', 2)) v(vehicle, pos)),
best AS (SELECT order_key, line_no, distance_km, cur,
        arg_min(vehicle, (em, pos)) FILTER (WHERE em IS NOT NULL) AS recommended_vehicle,
        min(em) AS best_em, max(CASE WHEN vehicle = cur THEN em END) AS cur_em
        FROM opt GROUP BY rid, order_key, line_no, distance_km, cur)"""


@register("cb6_tk2_fleet_mix", _CB6_SQL + f"""
SELECT order_key, line_no, recommended_vehicle, {R('cur_em - best_em')} AS emissions_savings,
  {R(f"({_case(cb.COST_PER_KM, 'recommended_vehicle', '0.3')} - 0.40) * distance_km")} AS cost_impact
FROM best""")
def q_cb6(spark, sf):
    """Per leg: the allowed vehicle with least emissions (first listed wins
    ties; options that cannot be computed are skipped), savings against the
    current vehicle and the cost impact at 0.40 per km today."""
    cur = F.when(F.col("vehicle_type").isin(_ALLOWED), F.col("vehicle_type")).otherwise(F.lit("diesel_truck"))
    co2 = lambda v: cb.co2("distance_km", v, "load_kg", "empty_return", F.lit("EU"))["co2_kg"]
    opts = F.array(*(F.struct(co2(F.lit(v)).alias("em"), F.lit(i).alias("pos"), F.lit(v).alias("vehicle"))
                     for i, v in enumerate(_ALLOWED)))
    g = view(spark, sf, "legs").withColumns({"current_vehicle": cur, "opts": opts})
    best = F.array_min(F.filter("opts", lambda o: o["em"].isNotNull()))
    g = g.withColumn("best", best).select(
        "order_key", "line_no", "distance_km", F.col("best.vehicle").alias("recommended_vehicle"), F.col("best.em").alias("best_em"),
        F.filter("opts", lambda o: o["vehicle"] == F.col("current_vehicle"))[0]["em"].alias("current_em"))
    return g.select("order_key", "line_no", "recommended_vehicle",
                    round_half_up(F.col("current_em") - F.col("best_em"), 4).alias("emissions_savings"),
                    round_half_up((cb.cost_per_km("recommended_vehicle") - 0.40) * F.col("distance_km"), 4).alias("cost_impact"))


@register("cb6_total_savings", _CB6_SQL + """
SELECT recommended_vehicle, CAST(count(*) AS BIGINT) AS n_legs, round(sum(cur_em - best_em), 2) AS total_savings FROM best GROUP BY ROLLUP (recommended_vehicle)""")
def q_cb6_total(spark, sf):
    """Total emissions saved by the fleet mix, per recommended vehicle and over all (null)."""
    r = q_cb6(spark, sf).rollup("recommended_vehicle").agg(F.count(F.lit(1)).alias("n_legs"), F.sum("emissions_savings").alias("s"))
    return r.select("recommended_vehicle", "n_legs", F.round("s", 2).alias("total_savings"))


@register("cb7_compliance_per_regulation", _SPEC_SQL + f""",
tot AS (SELECT order_key, sum(co2_kg) AS total FROM em GROUP BY 1)
SELECT order_key, r.regulation, r.allowed, {R('total')} AS total_kg, total < r.allowed AS compliant,
       {R('greatest(0.0, total - r.allowed)')} AS excess
FROM tot, (VALUES ('EU_ETS', 10000.0), ('CBP', 25000.0)) r(regulation, allowed)""")
def q_cb7(spark, sf):
    e = leg_emissions(spark, sf)
    tot = e.groupBy("order_key").agg(F.sum("co2_kg").alias("total_kg"))
    c = cb.compliance(tot, "total_kg", ["EU_ETS", "CBP"])
    return c.select("order_key", "regulation", "allowed", round_half_up("total_kg", 4).alias("total_kg"), "compliant",
                    round_half_up("excess", 4).alias("excess"))


@register("ag9_cb8_supply_chain_totals", _SPEC_SQL + f""",
per AS (SELECT order_key, sum(co2_kg) AS total FROM em WHERE vehicle_type <> 'electric_truck' GROUP BY 1),
allr AS (SELECT order_key, total FROM per UNION ALL SELECT NULL, sum(total) FROM per)
SELECT order_key, {R('total', 2)} AS total_kg_co2, CAST(round(total / 21.77) AS BIGINT) AS equivalent_trees,
       {R('total * 85.0')} AS cost_estimate, {R('total * 85.0 / 1000.0')} AS cost_estimate_per_ton FROM allr""")
def q_ag9(spark, sf):
    """Route (order) totals plus a grand total row via ``rollup``; electric legs
    without a usable spec are excluded as the reference would fail on them."""
    e = leg_emissions(spark, sf).filter(F.col("vehicle_type") != "electric_truck")
    price = cb.carbon_price(["EU_ETS", "CBP"])
    g = e.rollup("order_key").agg(F.sum("co2_kg").alias("total"))
    return g.select("order_key", round_half_up("total", 2).alias("total_kg_co2"),
                    cb.trees_equivalent("total").alias("equivalent_trees"),
                    round_half_up(F.col("total") * price, 4).alias("cost_estimate"),
                    round_half_up(F.col("total") * price / 1000.0, 4).alias("cost_estimate_per_ton"))


_MODE_BY_PRIORITY = {"1-URGENT": "air", "2-HIGH": "truck", "3-MEDIUM": "ship", "4-NOT SPECIFIED": "truck", "5-LOW": "rail"}


@register("cb9_ledger_carbon_footprint", view_sql("legs") + f""",
w AS (SELECT l.l_orderkey, sum(p.p_size * l.l_quantity) AS kg FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1),
d AS (SELECT order_key, sum(distance_km) AS km FROM legs GROUP BY 1)
SELECT o.o_orderkey AS order_key, {R(f"d.km * w.kg / 1000.0 * {_case(cb.LEDGER_FACTORS, _case(_MODE_BY_PRIORITY, 'o.o_orderpriority'))}")} AS co2_kg,
  CASE WHEN {_case(cb.LEDGER_FACTORS, _case(_MODE_BY_PRIORITY, 'o.o_orderpriority'))} IS NULL
       THEN 'unknown transport mode: ' || {_case(_MODE_BY_PRIORITY, 'o.o_orderpriority')} END AS error
FROM orders o JOIN w ON o.o_orderkey = w.l_orderkey JOIN d ON o.o_orderkey = d.order_key""")
def q_cb9(spark, sf):
    lg = view(spark, sf, "legs")
    d = lg.groupBy("order_key").agg(F.sum("distance_km").alias("km"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    w = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.sum(F.col("p_size") * F.col("l_quantity")).alias("kg"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderpriority")
    j = o.join(w, "order_key").join(d, "order_key")
    r = cb.ledger_footprint("km", "kg", cb.lit_map(_MODE_BY_PRIORITY)[F.col("o_orderpriority")])
    return j.select("order_key", round_half_up(r["co2_kg"], 4).alias("co2_kg"), r["error"].alias("error"))


_PROFILE_BY_SEGMENT = {"AUTOMOBILE": "car", "FURNITURE": "van", "MACHINERY": "truck", "BUILDING": "truck", "HOUSEHOLD": "van"}


@register("cb10_cb11_cb12_route_impact_and_cost", view_sql("legs") + f""",
r AS (SELECT order_key, line_no, distance_km * 1000 AS distance_m, {_case(_PROFILE_BY_SEGMENT, 'segment')} AS profile FROM legs),
i AS (SELECT *, {_case(cb.ROUTE_G_PER_KM, 'profile', '150.0')} * distance_m / 1000.0 / 1000.0 AS co2_kg,
             distance_m / 1000.0 * 1.2 AS noise FROM r)
SELECT order_key, line_no, {R('co2_kg')} AS co2_kg, {R('distance_m / 1000.0 * 0.35')} AS fuel_liters,
  {R('greatest(0.0, 100 - co2_kg * 10)')} AS eco_score,
  NOT coalesce(distance_m > 0 AND co2_kg * 1000.0 / (distance_m / 1000.0) > 150 OR noise > 75, false) AS compliant,
  {R(f"(distance_m / 1000.0 / 1.60934) / {_case(cb.MPG, 'profile', '8.0')} * 3.5 + 0.0 + distance_m / 1000.0 / 80.0 * 25.0")} AS total_cost
FROM i""")
def q_cb10(spark, sf):
    j = view(spark, sf, "legs")
    prof = cb.lit_map(_PROFILE_BY_SEGMENT)[F.col("segment")]
    x = j.select("order_key", "line_no", (F.col("distance_km") * 1000).alias("distance_m"), prof.alias("profile"))
    x = x.withColumn("imp", cb.route_impact("distance_m", "profile"))
    comp = cb.route_compliance(F.col("imp.co2_kg"), F.col("imp.noise_impact"), F.col("distance_m"))
    cost = cb.transport_cost(F.col("distance_m") / 1000.0, F.col("profile"), F.lit(0.0), F.lit(25.0))
    return x.select("order_key", "line_no", round_half_up("imp.co2_kg", 4).alias("co2_kg"),
                    round_half_up("imp.fuel_liters", 4).alias("fuel_liters"), round_half_up("imp.eco_score", 4).alias("eco_score"),
                    comp["passed"].alias("compliant"), round_half_up(cost["total"], 4).alias("total_cost"))


_MODES = [("truck", "diesel_truck"), ("train", "rail"), ("ship", "cargo_ship")]


@register("cb14_mode_comparison_table", view_sql("legs") + f""",
od AS (SELECT origin_nation, dest_nation, any_value(distance_km) AS km, sum(load_kg) AS kg FROM legs GROUP BY 1, 2)
SELECT origin_nation, dest_nation, m.mode, {R('km')} AS distance_km,
  {R(R(f"{_case(cb.EMISSION_FACTORS, 'm.vehicle')} * km * kg / 1000.0 * 1.15", 2))} AS emissions_kg,
  {R(f"{_case(cb.COST_PER_KM, 'm.vehicle', '0.3')} * km")} AS cost
FROM od, (VALUES ('truck', 'diesel_truck'), ('train', 'rail'), ('ship', 'cargo_ship')) m(mode, vehicle)""")
def q_cb14(spark, sf):
    lg = view(spark, sf, "legs")
    od = lg.groupBy("origin_nation", "dest_nation").agg(F.first("distance_km").alias("km"), F.sum("load_kg").alias("kg"))
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(v).alias("vehicle")) for m, v in _MODES])
    x = od.withColumn("_m", F.explode(modes)).select("*", "_m.*").drop("_m")
    em = cb.co2("km", "vehicle", "kg", False, F.lit("EU"))["co2_kg"]
    return x.select("origin_nation", "dest_nation", "mode", round_half_up("km", 4).alias("distance_km"),
                    round_half_up(em, 4).alias("emissions_kg"), round_half_up(cb.cost_per_km("vehicle") * F.col("km"), 4).alias("cost"))


@register("cb15_sustainability_report", _SPEC_SQL + f"""
SELECT order_key, {R('sum(co2_kg * 1000.0) / 1000.0')} AS total_kg, array_to_string(list_sort(list_distinct(list(vehicle_type))), ',') AS modes
FROM em WHERE co2_kg IS NOT NULL GROUP BY 1""")
def q_cb15(spark, sf):
    # no error <=> a value; filtering on the flag keeps the large emission
    # expression out of pushed-down join conditions
    e = leg_emissions(spark, sf).filter(F.col("error").isNull())
    # the set of modes is a bitmask over the fixed vehicle list: a codegen'd
    # bit_or instead of a per-group hash set
    names = sorted(cb.EMISSION_FACTORS)
    idx = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("vehicle_type")) - 1
    g = e.groupBy("order_key").agg((F.sum(F.col("co2_kg") * 1000.0) / 1000.0).alias("total_kg"),
                                   F.bit_or(F.pow(F.lit(2), idx).cast("long")).alias("mask"))
    modes = F.filter(F.array(*[F.lit(n) for n in names]),
                     lambda x, i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) > 0)
    return g.select("order_key", round_half_up("total_kg", 4).alias("total_kg"), F.array_join(modes, ",").alias("modes"))


@register("jn10_factor_lookup_with_default", view_sql("legs") + f"""
SELECT order_key, line_no, {_case(cb.EMISSION_FACTORS, 'vehicle_type')} AS base_factor,
       {_case(cb.REGION_ADJUSTMENT, 'region', '1.0')} AS adjustment FROM legs""")
def q_jn10(spark, sf):
    """Lookup joins against the constant factor tables (broadcast: fixed size)."""
    from ..operators.joins import lookup
    lg = view(spark, sf, "legs").select("order_key", "line_no", "vehicle_type", "region")
    fac = spark.createDataFrame(list(cb.EMISSION_FACTORS.items()), "vehicle_type string, base_factor double")
    adj = spark.createDataFrame(list(cb.REGION_ADJUSTMENT.items()), "region string, adjustment double")
    x = lookup(lg, fac, ["vehicle_type"], "base_factor")
    x = lookup(x, adj, ["region"], "adjustment", default=1.0)
    return x.select("order_key", "line_no", "base_factor", "adjustment")
