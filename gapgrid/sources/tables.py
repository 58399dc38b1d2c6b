"""Other inputs, and the sinks: tables, reports, metrics, zone features, fitted estimators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgrid.functions import grid
from gapgrid.functions.projection import project_xy
from gapgrid.operators.geometry import StudyArea
from gapgrid.params import DEFAULT, Params

FEATURE_SCHEMA = ("type string, properties map<string,string>, "
                  "geometry struct<type:string, coordinates:array<array<array<double>>>>")


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def read_feed_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The named feed tables, or all of the folder, every column as text."""
    return {n: spark.read.csv(f"{folder}/{n}.txt", header=True, inferSchema=False) for n in names or feed_table_names(spark, folder)}


def feed_table_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the ``.txt`` tables of a feed (a dozen files)."""
    rows = spark.read.format("binaryFile").load([f"{folder}/*.txt"]).select(F.regexp_extract("path", r"/([^/]+)\.txt(/|$)", 1).alias("n")).distinct().collect()
    return sorted(r.n for r in rows)


def feed_shapes(shapes: DataFrame) -> DataFrame:
    """Typed vertices (shape_id, seq, lat, lon) of the feed's shapes table."""
    return shapes.select("shape_id", F.col("shape_pt_sequence").cast("int").alias("seq"),
                         F.col("shape_pt_lat").cast("double").alias("lat"), F.col("shape_pt_lon").cast("double").alias("lon"))


def population_cells(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(cell, population): people of all points of a cell, rounded half-even to whole numbers."""
    return (points.withColumn("cell", grid.point_to_cell("lat", "lon", p=p)).groupBy("cell")
            .agg(F.bround(F.sum(F.col("people").cast("double")), 0).cast("bigint").alias("population")))


def read_population(spark: SparkSession, path: str, p: Params = DEFAULT) -> DataFrame:
    """Population export (lat, lon, people) as CSV or Parquet → people per cell."""
    raw = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    return population_cells(raw, p).orderBy("cell")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def six_digits(col: str):
    """A double as text with six significant digits, trailing zeros removed."""
    v = F.col(col)
    mag = F.when(v == 0, 0).otherwise(F.floor(F.log10(F.abs(v))))
    sci = F.format_string("%.5e", v)
    mant, exp = F.regexp_extract(sci, r"^(.*)e", 1), F.regexp_extract(sci, r"e(.*)$", 1)
    top = F.coalesce(exp.try_cast("int"), F.lit(0))
    plain = F.element_at(F.array(*[F.format_string(f"%.{d}f", v) for d in range(10)]),
                         F.greatest(F.lit(1), F.least(F.lit(10), 6 - top)).cast("int"))
    tidy = lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)
    return F.when(v.isNull() | mag.isNull(), F.lit(None).cast("string")).when(
        (top < -4) | (top >= 6), F.concat(tidy(mant), F.lit("e"), exp)).otherwise(tidy(plain))


def report_rows(df: DataFrame) -> DataFrame:
    return df.select(*[six_digits(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_report_csv(df: DataFrame, root: str, phase: str, name: str) -> str:
    """CSV result table ``<root>/<phase>/<name>`` with six significant digits for floating columns."""
    path = f"{root}/{phase}/{name}"
    report_rows(df).write.mode("overwrite").csv(path, header=True)
    return path


def metrics_json(metrics: DataFrame) -> DataFrame:
    """(metric, value) rows as one JSON object with sorted keys.

    A numeric or boolean ``value`` column gives numbers or true and false. In a column of text, numbers, true, false, null and text that holds an
    object or a list stay what they are (metrics of several types travel as text), other text is quoted.
    """
    text = F.col("value").cast("string")
    bare = text.rlike(r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null|[\[{].*[\]}])$")
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    value = F.when(text.isNull(), F.lit("null")).when(bare, text).otherwise(quoted(text))
    entries = F.array_sort(F.collect_list(F.struct("metric", F.concat(quoted(F.col("metric")), F.lit(":"), value).alias("entry"))))
    return metrics.agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["entry"]), ","), F.lit("}")).alias("value"))


def write_metrics(metrics: DataFrame, root: str, phase: str) -> str:
    path = f"{root}/{phase}/metrics"
    metrics_json(metrics).coalesce(1).write.mode("overwrite").text(path)  # one row
    return path


def read_metrics(spark: SparkSession, root: str, phase: str) -> DataFrame:
    text = spark.read.text(f"{root}/{phase}/metrics")
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("metric", "value"))


def zone_feature_rows(df: DataFrame, cols: list[str], p: Params = DEFAULT) -> DataFrame:
    """One GeoJSON Feature per row as text, the cell polygon as geometry."""
    props = F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'),
                              grid.cell_geojson("cell", p=p), F.lit("}")).alias("value"))


def write_zone_features(df: DataFrame, path: str, cols: list[str], p: Params = DEFAULT) -> None:
    """Line-delimited GeoJSON features: splittable, and each line is a valid feature."""
    zone_feature_rows(df, cols, p).write.mode("overwrite").text(path)


def read_zone_features(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """Features with their properties as ``properties`` (a DDL list of names and types) says, or as a map of text."""
    kind = f"struct<{properties}>" if properties else "map<string,string>"
    return spark.read.schema(FEATURE_SCHEMA.replace("map<string,string>", kind)).json(path)


def write_study_area(spark: SparkSession, area: StudyArea, path: str) -> None:
    """The area as one GeoJSON feature: its ring (closed, longitude first) as polygon, its margin in metres as property."""
    ring = [[float(a), float(b)] for a, b in (*area.ring, area.ring[0])]
    feature = {"type": "Feature", "properties": {"kind": "study_area", "buffer_m": float(area.buffer_m)}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    spark.createDataFrame([(json.dumps(feature),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_study_area(spark: SparkSession, path: str, p: Params = DEFAULT) -> DataFrame:
    """One row (edges array<struct<x1, y1, x2, y2>> in projected metres, buffer_m) of a stored area."""
    f = read_zone_features(spark, path, "kind string, buffer_m double").where("properties.kind = 'study_area'")
    corners = f.select("properties.buffer_m", F.posexplode(F.col("geometry.coordinates")[0]).alias("i", "c"))
    x, y = project_xy(F.col("c")[1], F.col("c")[0], p)
    ring = corners.select("buffer_m", "i", x.alias("x"), y.alias("y")).groupBy("buffer_m").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("v"))
    edge = lambda i: F.struct(F.col("v")[i - 1]["x"].alias("x1"), F.col("v")[i - 1]["y"].alias("y1"), F.col("v")[i]["x"].alias("x2"), F.col("v")[i]["y"].alias("y2"))
    return ring.select(F.transform(F.sequence(F.lit(1), F.size("v") - 1), edge).alias("edges"), "buffer_m")


def save_estimator(rows: DataFrame, path: str) -> None:
    """Rates, coefficients or trees of a fitted technique as a table."""
    rows.write.mode("overwrite").parquet(path)


def load_estimator(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
