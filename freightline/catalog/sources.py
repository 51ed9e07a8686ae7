"""Source and sink queries (SRC1-SRC14).  Each one writes data that Spark
derives from the driver tables into the shared scratch folder, reads it back
through the source under test, and returns the result."""
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files as fs
from ..sources.tables import table
from ..sources.views import view, view_sql
from . import register
from ..functions.numeric import round_half_up
from .carbon import _SPEC_SQL, leg_emissions
from .joins import customer_points


@register("src1_src2_config_driven_csv_load", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_shipdate AS date, l_quantity AS value FROM lineitem""")
def q_src1(spark, sf):
    path = scratch_path(spark, "csv")
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                                             F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
                                             F.col("l_quantity").alias("value"))
    fs.write_table(li, path, fmt="csv")
    cfg = {"type": "csv", "path": path, "schema": "l_orderkey BIGINT, l_linenumber BIGINT, date STRING, value DOUBLE",
           "date_columns": ["date"], "date_column": "date", "required": ["date", "value"], "numeric": ["value"]}
    df = fs.load_dataset(spark, cfg)
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


@register("src3_parquet_scan_pruned", """
SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'""")
def q_src3(spark, sf):
    """Two columns and two predicates: the plan reads only those columns and
    pushes both filters into the Parquet scan."""
    li = table(spark, sf, "lineitem")
    return li.filter((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))) \
             .select("l_orderkey", "l_extendedprice")


@register("src4_json_envelope_pages", """
SELECT o_orderkey AS shipment_id, o_orderdate AS shipment_date, o_totalprice AS unit_price, o_orderstatus AS customs_status FROM orders""")
def q_src4(spark, sf):
    """Orders delivered as API pages: one JSON envelope per page of ~1000
    records (``{"metadata": .., "results": [..]}``), then read back."""
    o = table(spark, sf, "orders")
    rec = F.struct(F.col("o_orderkey").alias("shipment_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("shipment_date"),
                   F.col("o_totalprice").alias("unit_price"), F.col("o_orderstatus").alias("customs_status"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.collect_list(rec).alias("results"))
    env = pages.select(F.create_map(F.lit("version"), F.lit("1"), F.lit("page"), F.col("page").cast("string")).alias("metadata"), "results")
    path = scratch_path(spark, "envelopes")
    env.write.mode("overwrite").json(path)
    df = fs.read_enveloped_json(spark, path, "results",
                                "struct<shipment_id:bigint,shipment_date:string,unit_price:double,customs_status:string>")
    return df.withColumn("shipment_date", F.to_timestamp("shipment_date").cast("timestamp_ntz"))


@register("src5_graphml_edges", view_sql("edges") + "SELECT src, dst, round(length_km * 1000.0, 4) AS length, highway FROM edges")
def q_src5(spark, sf):
    path = scratch_path(spark, "graphml")
    fs.write_graphml_edges(view(spark, sf, "edges"), path)
    e = fs.read_graphml_edges(spark, path)
    return e.select("src", "dst", F.round("length", 4).alias("length"), "highway")


@register("src5_graphml_nodes", view_sql("nodes") + "SELECT node_id, lat, lon, elevation FROM nodes")
def q_src5n(spark, sf):
    path = scratch_path(spark, "graphml-nodes")
    fs.write_graphml_nodes(view(spark, sf, "nodes"), path)
    return fs.read_graphml_nodes(spark, path)


@register("src6_st1_geojson_merge", view_sql("places") + """,
cp AS (SELECT c.c_custkey, p.lat + ((c.c_custkey % 97) - 48) / 100.0 AS lat, p.lon + ((c.c_custkey * 7 % 89) - 44) / 100.0 AS lon
       FROM customer c JOIN places p ON c.c_nationkey = p.place_id)
SELECT 'Point' AS geometry_type, round(lat, 4) AS lat, round(lon, 4) AS lon, CAST(c_custkey AS VARCHAR) AS id FROM cp""")
def q_src6(spark, sf):
    """Customer points as feature collections (one per nation and page),
    written to two folders and merged on read."""
    c = customer_points(spark, sf).join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
                    F.create_map(F.lit("id"), F.col("c_custkey").cast("string")).alias("properties"))
    coll = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("page")).agg(F.collect_list(feat).alias("features")) \
            .select(F.lit("FeatureCollection").alias("type"), "features", "c_nationkey")
    a, b = scratch_path(spark, "geojson-a"), scratch_path(spark, "geojson-b")
    coll.filter(F.col("c_nationkey") < 12).drop("c_nationkey").write.mode("overwrite").json(a)
    coll.filter(F.col("c_nationkey") >= 12).drop("c_nationkey").write.mode("overwrite").json(b)
    g = fs.read_geojson(spark, [a, b])
    return g.select("geometry_type", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.col("properties")["id"].alias("id"))


@register("src8_partitioned_sink_pruned_read", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE year(l_shipdate) >= 1999 GROUP BY 1""")
def q_src8(spark, sf):
    """Write lineitem partitioned by ship year; the read filters on the
    partition column, so only the matching folders are listed and scanned."""
    path = scratch_path(spark, "by-year")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.year("l_shipdate").alias("ship_year"))
    fs.write_table(li, path, partition_by=["ship_year"])
    back = spark.read.parquet(path).filter(F.col("ship_year") >= 1999)
    return back.groupBy("ship_year").agg(F.count(F.lit(1)).alias("n"))


@register("src9_emissions_export_csv", _SPEC_SQL + """
SELECT CAST(ship_date AS TIMESTAMP) AS "timestamp", CAST(round(CAST(distance_km AS DECIMAL(38,8)), 4) AS DOUBLE) AS distance,
  CAST(round(CAST(co2_kg AS DECIMAL(38,8)), 4) AS DOUBLE) AS emissions, vehicle_type AS vehicle FROM em WHERE co2_kg IS NOT NULL""")
def q_src9(spark, sf):
    # no error <=> a value; filtering on the flag keeps the large emission
    # expression out of pushed-down join conditions
    e = leg_emissions(spark, sf).filter(F.col("error").isNull()).select(
        F.col("ship_date").cast("timestamp").alias("timestamp"), F.col("distance_km").alias("distance"),
        F.col("co2_kg").alias("emissions"), F.col("vehicle_type").alias("vehicle"))
    path = scratch_path(spark, "emissions-csv")
    fs.export_emissions(e, path, "csv")
    back = spark.read.option("header", True).schema("timestamp TIMESTAMP, distance DOUBLE, emissions DOUBLE, vehicle STRING").csv(path)
    return back.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), round_half_up("distance", 4).alias("distance"),
                       round_half_up("emissions", 4).alias("emissions"), "vehicle")


@register("src10_src11_map_features")
def q_src10(spark, sf):
    sh = view(spark, sf, "legs")
    pts = customer_points(spark, sf)
    f = fs.point_features(pts.withColumn("t", F.lit("2024-01-01").cast("timestamp")), "lat", "lon", "t", "c_custkey")
    r = sh.groupBy("order_key").agg(F.sum("distance_km").alias("distance_km"), F.sum("load_kg").alias("load_kg"))
    r = r.withColumn("coords", F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) \
         .withColumn("optimized", F.lit(True))
    rf = fs.route_feature(r, "coords", ["distance_km", "load_kg", "optimized"])
    return f.select(F.col("c_custkey").cast("string").alias("id"), "feature").unionByName(
        rf.select(F.col("order_key").cast("string").alias("id"), "feature"))


@register("src14_lineage_record")
def q_src14(spark, sf):
    """Run a cleaning step, count its output rows while writing (``observe``)
    and append one lineage row."""
    obs = Observation("clean")
    sh = view(spark, sf, "shipments").filter((F.col("weight") > 0) & (F.col("weight") < 10000))
    out = scratch_path(spark, "cleaned")
    sh.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(out)
    return fs.lineage_record(spark, "clean_shipments", {"min_weight": 0, "max_weight": 10000}, sf, metrics=obs.get)
