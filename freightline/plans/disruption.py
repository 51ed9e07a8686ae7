"""Disruption and supplier-risk models (ML5-ML13).

Features are assembled with DataFrame joins (as-of damage, nearest
conflict); models are MLlib pipelines trained over expanding time folds.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightline.session import stored

ALERT_THRESHOLD = 0.35
NUMERIC_FEATURES = ["daily_damage", "conflict_risk", "fuel_price", "day_of_week", "shipment_weight"]
CATEGORICAL_FEATURES = ["carrier_type"]


def disruption_pipeline(max_iter: int = 20, seed: int = 42) -> Pipeline:
    idx = StringIndexer(inputCol="carrier_type", outputCol="carrier_idx", handleInvalid="keep")
    vec = VectorAssembler(inputCols=NUMERIC_FEATURES + ["carrier_idx"], outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=4, seed=seed)
    return Pipeline(stages=[idx, vec, gbt])


def time_folds(df: DataFrame, ts: str, id_col: str, k: int = 5) -> DataFrame:
    """Expanding time folds over the whole table (WN11 with one series): the
    position comes from a global running count, computed range-partitioned
    (no single-partition window)."""
    from ..operators.aggregates import distributed_running_sum
    d = df.withColumn("_one", F.lit(1))
    keyed = d.withColumn("_ord", F.struct(ts, id_col))
    r = distributed_running_sum(keyed, "_ord", ["_one"]).withColumnRenamed("_one_before", "row_idx")
    n = df.count()
    size = n // (k + 1)
    start = n - k * size
    x = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = F.lit(start) + F.col("fold") * size
    role = F.when(F.col("row_idx") < lo, "train").when(F.col("row_idx") < lo + size, "test")
    return x.withColumn("role", role).filter(F.col("role").isNotNull()).drop("_ord", "_one")


def cross_validate(df: DataFrame, ts: str, id_col: str, k: int = 5, max_iter: int = 20) -> DataFrame:
    """ML5: train on each expanding fold, ROC-AUC on its test block; fold -1 is the mean.  The fold
    loop is a fixed small constant (k); each fit is a distributed MLlib job."""
    from ..session import run_concurrently
    folds = time_folds(df, ts, id_col, k).persist()
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    spark = df.sparkSession

    def one(f):
        tr = folds.filter((F.col("fold") == f) & (F.col("role") == "train"))
        te = folds.filter((F.col("fold") == f) & (F.col("role") == "test"))
        model = disruption_pipeline(max_iter).fit(tr)
        return (f, float(ev.evaluate(model.transform(te))))
    rows = run_concurrently([lambda f=f: one(f) for f in range(k)], max_workers=k)
    folds.unpersist()
    return spark.createDataFrame([*rows, (-1, sum(auc for _, auc in rows) / len(rows))], "fold INT, auc DOUBLE")


def score(model: PipelineModel, df: DataFrame, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """ML7/ML11: probability of disruption, alert flag (strictly above the
    threshold) and a risk band."""
    p = model.transform(df).withColumn("risk_probability", vector_to_array("probability")[1])
    band = (F.when(F.col("risk_probability") >= 0.7, "high")
             .when(F.col("risk_probability") >= threshold, "medium").otherwise("low"))
    return p.withColumns({"alert": F.col("risk_probability") > threshold, "risk_level": band})


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """ML8: tree-ensemble importances as ranked rows."""
    gbt = model.stages[-1]
    names = NUMERIC_FEATURES + ["carrier_type"]
    imp = gbt.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature STRING, importance DOUBLE")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


# Recommendation rules of the disruption notebook.
RULES = [("daily_damage", 1, "Increase insurance coverage for weather-sensitive shipments", "High"),
         ("conflict_risk", 3, "Diversify suppliers away from conflict zones", "Critical")]


def recommendations(importance: DataFrame) -> DataFrame:
    """ML10: a rule fires when its feature ranks within the rule's top-n."""
    spark = importance.sparkSession
    rules = spark.createDataFrame(RULES, "feature STRING, top_n INT, recommendation STRING, priority STRING")
    return importance.join(F.broadcast(rules), "feature").filter(F.col("rank") <= F.col("top_n")) \
                     .select("feature", "rank", "recommendation", "priority")


def numbered(df: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows with their number (from 0) in the order of ``by`` and ``_id``, over the whole table."""
    from ..operators.aggregates import distributed_running_sum
    d = distributed_running_sum(df.withColumns({"_ord": F.struct(by.alias("h"), "_id"), "_one": F.lit(1)}), "_ord", ["_one"])
    return d.withColumnRenamed("_one_before", name).drop("_ord", "_one")


def permuted_column(df: DataFrame, col: str, seed: int = 7) -> DataFrame:
    """Replace ``col`` by a random permutation of itself over the whole table: the rows and the values are
    numbered by two independent random orders, range-partitioned, and joined by number."""
    d = stored(df.withColumn("_id", F.monotonically_increasing_id()), "permute")
    rows = numbered(d, F.xxhash64(F.lit(seed), "_id"), "_n")
    values = numbered(d.select("_id", F.col(col).alias("_perm")), F.xxhash64(F.lit(seed + 1), "_id"), "_n").drop("_id")
    return rows.join(values, "_n").drop(col, "_n", "_id").withColumnRenamed("_perm", col)


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """ML9: AUC drop when one feature is permuted; reported as shuffled - base
    (negative = important)."""
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    from ..session import run_concurrently
    base = ev.evaluate(model.transform(df))
    shuffled = run_concurrently([lambda f=f: float(ev.evaluate(model.transform(permuted_column(df, f)))) for f in features])
    rows = [(f, float(base), s_) for f, s_ in zip(features, shuffled)]
    out = df.sparkSession.createDataFrame(rows, "feature STRING, base_auc DOUBLE, shuffled_auc DOUBLE")
    return out.withColumn("shuffled_minus_base", F.col("shuffled_auc") - F.col("base_auc"))


# Fixed values (our definition, the reference has no scorer): supplier risk weights.
SUPPLIER_WEIGHTS = {"late_rate": 0.35, "lead_time_sd": 0.25, "return_rate": 0.2, "concentration": 0.2}


def supplier_risk(shipments: DataFrame, late_days: int = 30) -> DataFrame:
    """ML12 (our definition): late rate, lead-time variability, return rate and
    customer concentration (Herfindahl) per supplier, each min-max scaled over
    suppliers, weighted sum as the score; recommendation by score band."""
    lead = F.datediff("ship_date", "order_date")
    base = shipments.withColumns({"_lead": lead, "_late": (lead > late_days).cast("int"),
                                  "_ret": (F.col("return_flag") == "R").cast("int")})
    per = base.groupBy("supp_key").agg(F.avg("_late").alias("late_rate"), F.stddev_samp("_lead").alias("lead_time_sd"),
                                       F.avg("_ret").alias("return_rate"), F.sum("value").alias("_v"))
    cust = base.groupBy("supp_key", "cust_key").agg(F.sum("value").alias("_vc"))
    conc = cust.join(per.select("supp_key", "_v"), "supp_key").groupBy("supp_key").agg(
        F.sum((F.col("_vc") / F.col("_v")) ** 2).alias("concentration"))
    s = per.drop("_v").join(conc, "supp_key")
    # all bounds in one aggregate: one struct-valued subquery, planned once and reused
    bounds = s.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in SUPPLIER_WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    scaled = {}
    for c in SUPPLIER_WEIGHTS:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        scaled[f"{c}_scaled"] = F.coalesce((F.col(c) - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo), F.lit(0.0))
    s = s.withColumns(scaled)
    sc = sum((F.col(f"{c}_scaled") * w for c, w in SUPPLIER_WEIGHTS.items()), F.lit(0.0))
    s = s.withColumn("risk_score", sc)
    rec = (F.when(F.col("risk_score") >= 0.6, "replace or dual-source")
            .when(F.col("risk_score") >= 0.3, "monitor closely").otherwise("keep"))
    return s.withColumn("recommendation", rec)
