"""Row-level expressions and their null, tie and rounding rules."""

import math

from pyspark.sql import functions as F

from gapgrid.functions import grid, projection
from gapgrid.functions import scalars as S
from gapgrid.operators.joins import union_relaxed
from gapgrid.params import DEFAULT


def col(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_repair_mojibake(spark):
    df = spark.createDataFrame([("plain",), ("ChimorÃ©",), ("Chimoré",), ("中",), (None,), ("",)], "s string")
    assert col(df, S.repair_mojibake("s")) == ["plain", "Chimoré", "Chimoré", "中", None, ""]


def test_iso_year_week_edges(spark):
    df = spark.sql("SELECT timestamp_ntz'2021-01-03 10:00:00' ts UNION ALL SELECT timestamp_ntz'2024-12-30 00:00:00'")
    assert sorted(tuple(r) for r in df.select(S.iso_year("ts"), S.iso_week("ts"), S.weekday_of("ts")).collect()) == [
        (2020, 53, 7), (2025, 1, 1)]


def test_parse_is_lenient(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("2024-13-02 03:04:05",), ("x",), (None,)], "s string")
    out = col(df, S.parse_ts_lenient("s"))
    assert str(out[0]) == "2024-01-02 03:04:05" and out[1:] == [None, None, None]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(1.0,), (1.0000001,), (2.0,), (9.0,), (None,)], "x double")
    assert col(df, S.cut_right_closed("x", [1.0, 2.0], ["a", "b", "c"])) == ["a", "b", "b", "c", None]


def test_batch_of_file(spark):
    df = spark.createDataFrame([("q_2024-18.csv",), ("q_2024-17.csv",), ("q_2023-40.csv",)], "f string")
    assert col(df, S.batch_of_file("f")) == ["lote_2024", "lote_original", "lote_original"]


def test_round_all_is_half_even(spark):
    df = spark.createDataFrame([(2.5, 1), (3.5, 2)], "x double, n int")
    assert [tuple(r) for r in S.round_all(df, 0).collect()] == [(2.0, 1), (4.0, 2)]


def test_log_bins_close_the_last(spark):
    df = spark.createDataFrame([(0.1,), (1.0,), (10.0,), (0.05,)], "x double")
    assert col(df, S.log_bin("x", 2, -1.0, 1.0)) == [1, 2, 2, None]


def test_neighbours_and_distance(spark):
    df = spark.range(1).select(grid.point_to_cell(F.lit(DEFAULT.centre_lat), F.lit(DEFAULT.centre_lon)).alias("cell"))
    for k in (1, 2, 5):
        rows = df.select("cell", F.inline(grid.ring("cell", k))).select(grid.grid_distance("cell", "dst"), "ring", "dst").collect()
        assert len(rows) == 6 * k == len({r.dst for r in rows}) and all(r[0] == k == r.ring for r in rows)
    assert df.select(F.size(grid.disk("cell", 4))).first()[0] == 61
    back = df.select("cell", grid.point_to_cell(grid.cell_lat(), grid.cell_lon()).alias("again")).first()
    assert back.cell == back.again


def test_centre_of_each_cell_maps_to_it(stages):
    bad = stages.population.where(grid.point_to_cell(grid.cell_lat(), grid.cell_lon()) != F.col("cell"))
    assert bad.isEmpty()


def test_projection_round_trip_and_known_point(spark):
    # equator on the central meridian is (500 km, 10 000 km) in a southern zone
    x, y = projection.project_xy(F.lit(0.0), F.lit(-69.0))
    r = spark.range(1).select(x, y).first()
    assert abs(r[0] - 500000) < 1e-6 and abs(r[1] - 1e7) < 1e-6
    df = spark.createDataFrame([(-17.39, -66.15), (-17.0, -65.2), (-22.9, -69.0)], "lat double, lon double")
    x, y = projection.project_xy("lat", "lon")
    la, lo = projection.unproject_xy("x", "y")
    for r in df.withColumn("x", x).withColumn("y", y).select("lat", "lon", la.alias("a"), lo.alias("b")).collect():
        assert math.isclose(r.lat, r.a, abs_tol=1e-8) and math.isclose(r.lon, r.b, abs_tol=1e-8)


def test_union_relaxed_widens_before_the_union(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([("x", 2)], "a string, b int")
    c = spark.createDataFrame([(2.5,)], "b double")
    out = union_relaxed([a, b, c])
    assert dict(out.dtypes) == {"a": "string", "b": "double"}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("1", None), ("x", 2.0), (None, 2.5)], key=repr)
