"""File sources and sinks (SRC1-SRC14).

Readers always take an explicit schema where the format allows it; JSON
envelopes and GeoJSON collections are read as one record per line/page so
that a file splits across tasks instead of becoming one giant record.
"""
from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import contract_report

SUPPORTED = ("csv", "parquet", "json", "api")


def load_dataset(spark: SparkSession, config: dict) -> DataFrame:
    """SRC1: pick a loader by ``type`` and validate the result against the
    dataset contract (required columns, parseable dates, numeric columns);
    any failure raises.  Config keys: type, path, schema (DDL), date_column,
    required, numeric, envelope (json/api)."""
    kind = config.get("type")
    if kind == "csv":
        df = read_csv(spark, config["path"], config.get("schema"), config.get("date_columns", ()))
    elif kind == "parquet":
        df = spark.read.parquet(config["path"])
    elif kind in ("json", "api"):
        df = read_enveloped_json(spark, config["path"], config.get("envelope", "data"), config.get("schema"))
    else:
        raise ValueError(f"Unsupported data source type: {kind}")
    req = config.get("required", [])
    dates = [config["date_column"]] if config.get("date_column") else []
    rep = contract_report(df, req, dates, config.get("numeric", []))
    bad = rep.filter(F.col("failures") > 0)
    if not bad.isEmpty():
        raise ValueError("dataset contract violated: " + "; ".join(f"{r['check']}:{r['column']}" for r in bad.collect()))
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None, date_columns: Sequence[str] = ()) -> DataFrame:
    """SRC2: CSV with header, explicit schema (no inference pass) and parsed dates."""
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    df = r.csv(path)
    return df.withColumns({c: F.to_timestamp(c) for c in date_columns if c in df.columns})


def read_enveloped_json(spark: SparkSession, path: str, key: str, record_schema: str | None = None) -> DataFrame:
    """SRC4: JSON records under an envelope key (one envelope per line, e.g. an
    API page).  A missing key is an error."""
    raw = spark.read.json(path) if record_schema is None else spark.read.schema(
        T.StructType([T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
                      T.StructField(key, T.ArrayType(T._parse_datatype_string(record_schema)))])).json(path)
    if key not in raw.columns:
        raise KeyError(f"envelope key {key!r} missing")
    return raw.select(F.inline(key))


GRAPHML_EDGE_SCHEMA = "_source BIGINT, _target BIGINT, length DOUBLE, highway STRING"


def write_graphml_edges(edges: DataFrame, path: str) -> None:
    """Edge list as GraphML-style XML (``<edge source= target=>`` rows)."""
    e = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"),
                     (F.col("length_km") * 1000.0).alias("length"), "highway")
    e.write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "edge").save(path)


def read_graphml_edges(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: edges of a GraphML file with a fixed schema (attributes as columns)."""
    df = spark.read.format("xml").option("rowTag", "edge").schema(GRAPHML_EDGE_SCHEMA).load(path)
    return df.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "length", "highway")


GRAPHML_NODE_SCHEMA = "_id BIGINT, y DOUBLE, x DOUBLE, elevation DOUBLE"


def write_graphml_nodes(nodes: DataFrame, path: str) -> None:
    """Node list as GraphML-style XML (``<node id=>`` rows with y/x/elevation data)."""
    n = nodes.select(F.col("node_id").alias("_id"), F.col("lat").alias("y"), F.col("lon").alias("x"), "elevation")
    n.write.mode("overwrite").format("xml").option("rootTag", "graph").option("rowTag", "node").save(path)


def read_graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: nodes of a GraphML file with a fixed schema."""
    df = spark.read.format("xml").option("rowTag", "node").schema(GRAPHML_NODE_SCHEMA).load(path)
    return df.select(F.col("_id").alias("node_id"), F.col("y").alias("lat"), F.col("x").alias("lon"), "elevation")


GEOJSON_SCHEMA = ("type STRING, features ARRAY<STRUCT<type: STRING, geometry: STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, "
                  "properties: MAP<STRING, STRING>>>")


def read_geojson(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """SRC6: GeoJSON feature collections (one collection per line) -> one row
    per point feature with its properties; several paths are unioned."""
    df = spark.read.schema(GEOJSON_SCHEMA).json(paths)
    f = df.select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates")[1].alias("lat"),
                    F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.properties").alias("properties"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """SRC7/SRC8: Parquet (or CSV) sink, optionally partitioned (e.g. by date)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


EXPORT_COLUMNS = ["timestamp", "distance", "emissions", "vehicle"]


def export_emissions(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SRC9: emissions history export with a fixed column order; only json/csv."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"Unsupported format: {fmt}")
    out = df.select(*EXPORT_COLUMNS)
    if fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)


def point_features(df: DataFrame, lat: str, lon: str, time: str, popup: str, color: str | None = None) -> DataFrame:
    """SRC10: one GeoJSON point feature per row (time, colour default #ff0000, popup)."""
    col = F.coalesce(F.col(color), F.lit("#ff0000")) if color else F.lit("#ff0000")
    props = F.struct(F.date_format(F.col(time), "yyyy-MM-dd'T'HH:mm:ss").alias("time"), col.alias("color"), F.col(popup).alias("popup"))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
                    props.alias("properties"))
    return df.select("*", F.to_json(feat).alias("feature"))


def route_feature(df: DataFrame, coords: str, props: Sequence[str]) -> DataFrame:
    """SRC11: LineString feature with route properties (distance, ETA, cost, CO2, optimised flag)."""
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("LineString").alias("type"), F.col(coords).alias("coordinates")).alias("geometry"),
                    F.struct(*[F.col(p) for p in props]).alias("properties"))
    return df.select("*", F.to_json(feat).alias("feature"))


# Route line colours, warehouse icons and risk zone colours of the map layers.
ROUTE_COLOR = ("#00cc00", "#ff3300")
WAREHOUSE_ICONS = {"cold_storage": ("snowflake", "blue"), "hazardous": ("radiation", "orange"), "fulfillment": ("box-open", "green")}
WAREHOUSE_DEFAULT = ("warehouse", "gray")
RISK_COLORS = {"flood": "#0066cc", "earthquake": "#ff0000", "political": "#ff9900"}


def optimized_route_feature(df: DataFrame, coords: str, optimized: str, props: Sequence[str]) -> DataFrame:
    """SRC11: LineString feature of a route with its figures; an optimised route is a solid green line,
    any other a dashed red one.  A null flag counts as not optimised."""
    flag = F.coalesce(F.col(optimized), F.lit(False))
    style = F.struct(F.when(flag, ROUTE_COLOR[0]).otherwise(ROUTE_COLOR[1]).alias("color"), F.when(~flag, "5").alias("dash_array"))
    styled = df.withColumns({"style": style, optimized: flag})
    return route_feature(styled, coords, [*props, optimized, "style"]).drop("style")


def warehouse_marker(kind) -> dict:
    """SRC12: icon and colour by warehouse type; unknown or missing types get the default."""
    out = {}
    for i, name in enumerate(("icon", "color")):
        table = F.create_map(*(F.lit(x) for k, v in WAREHOUSE_ICONS.items() for x in (k, v[i])))
        out[name] = F.coalesce(F.element_at(table, F.coalesce(F.col(kind), F.lit(""))), F.lit(WAREHOUSE_DEFAULT[i]))
    return out


def weather_marker(conditions) -> dict:
    """SRC12: icon, colour and popup of a weather report."""
    return {"icon": F.lit("cloud-showers-heavy"), "color": F.lit("lightgray"),
            "popup": F.concat(F.lit("Weather Alert: "), F.initcap(conditions))}


def risk_zone_feature(df: DataFrame, ring: str, risk_type: str, tooltip: Sequence[str] = ("name", "risk_level")) -> DataFrame:
    """SRC12: polygon feature of a risk zone with its layer name, fill colour (none for unlisted types)
    and tooltip fields."""
    fill = F.element_at(F.create_map(*(F.lit(x) for kv in RISK_COLORS.items() for x in kv)), F.coalesce(F.col(risk_type), F.lit("")))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(F.lit("Polygon").alias("type"), F.array(F.col(ring)).alias("coordinates")).alias("geometry"),
                    F.struct(*(F.col(t) for t in tooltip), F.concat(F.initcap(risk_type), F.lit(" Risk Zone")).alias("layer"),
                             fill.alias("fillColor"), fill.alias("color")).alias("properties"))
    return df.select("*", F.to_json(feat).alias("feature"))


def lineage_record(spark: SparkSession, step: str, params: dict, input_version: str,
                   metrics: dict | None = None) -> DataFrame:
    """SRC14: one lineage row per step: time, parameters (JSON), input version
    and the row count observed while the step's output was written."""
    row = [(step, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), json.dumps(params, sort_keys=True), input_version,
            int((metrics or {}).get("rows", -1)))]
    return spark.createDataFrame(row, "step STRING, processed_at TIMESTAMP_NTZ, parameters STRING, input_version STRING, rows BIGINT")
