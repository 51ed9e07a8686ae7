"""Disruption and supplier models (ML5-ML13, AG14 not here)."""
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import aggregates as ag
from ..operators import joins as jn
from ..plans import disruption as dz
from ..session import scratch_path, stored
from ..sources.tables import table
from ..sources.views import places, view, view_sql
from . import register
from .joins import supplier_points


def disruption_frame(spark, sf):
    """Purchases as shipments with as-of damage, nearest-conflict risk, and the
    label 'an error for the same user within the next two days'."""
    ev = table(spark, sf, "events")
    pur = ev.filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").alias("zip_code"), "ts", F.col("value").alias("fuel_price"),
        F.get_json_object("props", "$.k").cast("double").alias("shipment_weight"))
    pur = pur.withColumn("carrier_type", F.concat(F.lit("C"), (F.col("shipment_weight") % 3).cast("int").cast("string")))
    dmg = view(spark, sf, "damage").withColumn("day", F.col("day").cast("timestamp_ntz"))
    x = jn.asof_join(pur, dmg, ["zip_code"], "ts", "day", 3 * 86400, ["daily_damage"])
    x = x.withColumn("daily_damage", F.coalesce("daily_damage", F.lit(0.0))).drop("matched_day")
    # user locations and nearest conflict (suppliers with negative balance)
    users = ev.select(F.col("user_id").alias("zip_code")).distinct()
    pl = F.broadcast(places(spark, sf).select("place_id", "lat", "lon"))
    upts = users.join(pl, (users.zip_code % 25) == pl.place_id).select(
        "zip_code", (F.col("lat") + (F.col("zip_code") % 11) / 10.0).alias("lat"), "lon")
    conf = supplier_points(spark, sf).filter(F.col("s_acctbal") < 0)
    near = jn.nearest_neighbor(upts, conf, "zip_code", "lat", "lon", "s_suppkey", "lat", "lon", metric="planar")
    # no conflict anywhere -> the largest planar distance on the globe
    x = x.join(near.select("zip_code", F.col("distance").alias("conflict_risk")), "zip_code", "left") \
         .withColumn("conflict_risk", F.coalesce("conflict_risk", F.lit(360.0)))
    # label: an error for this user on either of the next two days
    nxt = x.select("event_id", "zip_code", F.explode(F.array(F.date_add(F.to_date("ts"), 1), F.date_add(F.to_date("ts"), 2))).alias("d"))
    hit = nxt.join(dmg.select("zip_code", F.to_date("day").alias("d")), ["zip_code", "d"]).select("event_id").distinct() \
             .withColumn("label", F.lit(1.0))
    x = x.join(hit, "event_id", "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
    return x.withColumn("day_of_week", F.weekday("ts").cast("double"))


@register("ml5_disruption_gbt_time_folds")
def q_ml5(spark, sf):
    return dz.cross_validate(stored(disruption_frame(spark, sf), "disruption"), "ts", "event_id", k=5, max_iter=5)


_AUC_FRAME_SQL = view_sql("damage") + """,
pur AS (SELECT event_id, user_id AS zip_code, ts FROM events WHERE event_type = 'purchase'),
aj AS (SELECT p.event_id, p.zip_code, p.ts, CASE WHEN p.ts - d.day <= INTERVAL 3 DAY THEN d.daily_damage ELSE 0 END AS daily_damage
         FROM pur p ASOF LEFT JOIN damage d ON p.zip_code = d.zip_code AND p.ts >= d.day),
lab AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM damage d WHERE d.zip_code = a.zip_code
          AND CAST(d.day AS DATE) IN (CAST(a.ts AS DATE) + 1, CAST(a.ts AS DATE) + 2)) THEN 1 ELSE 0 END AS label FROM aj a),
s AS (SELECT coalesce(daily_damage, 0) AS score, label FROM lab),
rk AS (SELECT score, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
"""


@register("ml6_roc_auc_average_ranks", _AUC_FRAME_SQL + """
SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM rk""")
def q_ml6(spark, sf):
    ev = table(spark, sf, "events")
    pur = ev.filter(F.col("event_type") == "purchase").select("event_id", F.col("user_id").alias("zip_code"), "ts")
    dmg = view(spark, sf, "damage").withColumn("day", F.col("day").cast("timestamp_ntz"))
    x = jn.asof_join(pur, dmg, ["zip_code"], "ts", "day", 3 * 86400, ["daily_damage"])
    nxt = x.select("event_id", "zip_code", F.explode(F.array(F.date_add(F.to_date("ts"), 1), F.date_add(F.to_date("ts"), 2))).alias("d"))
    hit = nxt.join(dmg.select("zip_code", F.to_date("day").alias("d")), ["zip_code", "d"]).select("event_id").distinct().withColumn("label", F.lit(1))
    x = x.join(hit, "event_id", "left").select(F.coalesce("daily_damage", F.lit(0.0)).alias("score"),
                                               F.coalesce("label", F.lit(0)).alias("label"))
    return ag.roc_auc(x, "score", "label").select(F.round("auc", 6).alias("auc"))


def _trained(spark, sf):
    d = stored(disruption_frame(spark, sf), "disruption")  # the joins run once, not once per pass of the fit
    return dz.disruption_pipeline(max_iter=5).fit(d), d


@register("ml7_ml11_alert_scoring")
def q_ml7(spark, sf):
    model, d = _trained(spark, sf)
    s = dz.score(model, d)
    return s.select("event_id", "zip_code", "risk_probability", "alert", "risk_level")


@register("ml8_ml10_importance_and_recommendations")
def q_ml8(spark, sf):
    model, _ = _trained(spark, sf)
    imp = dz.feature_importance(model, spark)
    rec = dz.recommendations(imp)
    return imp.join(rec.select("feature", "recommendation", "priority"), "feature", "left")


@register("ml9_permutation_importance")
def q_ml9(spark, sf):
    model, d = _trained(spark, sf)
    return dz.permutation_importance(model, d, dz.NUMERIC_FEATURES + dz.CATEGORICAL_FEATURES)


@register("ml13_pipeline_save_load")
def q_ml13(spark, sf):
    """Save the fitted pipeline (with its feature list) to the shared folder,
    load it back and score."""
    model, d = _trained(spark, sf)
    path = scratch_path(spark, "disruption-model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    return dz.score(loaded, d).select("event_id", "risk_probability", "alert")


@register("ml12_supplier_risk_score", view_sql("shipments") + """,
b AS (SELECT *, ship_date - order_date AS lead, CASE WHEN ship_date - order_date > 30 THEN 1 ELSE 0 END AS late,
             CASE WHEN return_flag = 'R' THEN 1 ELSE 0 END AS ret FROM shipments),
per AS (SELECT supp_key, avg(late) AS late_rate, stddev_samp(lead) AS lead_time_sd, avg(ret) AS return_rate, sum(value) AS v FROM b GROUP BY 1),
cu AS (SELECT supp_key, cust_key, sum(value) AS vc FROM b GROUP BY 1, 2),
conc AS (SELECT cu.supp_key, sum((vc / per.v) * (vc / per.v)) AS concentration FROM cu JOIN per ON cu.supp_key = per.supp_key GROUP BY 1),
s AS (SELECT per.supp_key, late_rate, lead_time_sd, return_rate, concentration FROM per JOIN conc ON per.supp_key = conc.supp_key),
mm AS (SELECT min(late_rate) a0, max(late_rate) a1, min(lead_time_sd) b0, max(lead_time_sd) b1, min(return_rate) c0, max(return_rate) c1,
              min(concentration) d0, max(concentration) d1 FROM s),
sc AS (SELECT supp_key, 0.35 * coalesce((late_rate - a0) / CASE WHEN a1 = a0 THEN 1 ELSE a1 - a0 END, 0)
  + 0.25 * coalesce((lead_time_sd - b0) / CASE WHEN b1 = b0 THEN 1 ELSE b1 - b0 END, 0)
  + 0.2 * coalesce((return_rate - c0) / CASE WHEN c1 = c0 THEN 1 ELSE c1 - c0 END, 0)
  + 0.2 * coalesce((concentration - d0) / CASE WHEN d1 = d0 THEN 1 ELSE d1 - d0 END, 0) AS risk_score FROM s, mm)
SELECT supp_key, CAST(round(CAST(risk_score AS DECIMAL(38,8)), 4) AS DOUBLE) AS risk_score,
  CASE WHEN risk_score >= 0.6 THEN 'replace or dual-source' WHEN risk_score >= 0.3 THEN 'monitor closely' ELSE 'keep' END AS recommendation FROM sc""")
def q_ml12(spark, sf):
    r = dz.supplier_risk(view(spark, sf, "shipments"))
    return r.select("supp_key", round_half_up("risk_score", 4).alias("risk_score"), "recommendation")
