"""Files in and out."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from gapgrid.plans.registry import QUERIES
from gapgrid.plans.stages import stages_for
from gapgrid.plans.views import FILE_A
from gapgrid.sources import exports, tables

from tests.conftest import SF_DIR


def write(path, text, encoding):
    path.write_bytes(text.encode(encoding))


def test_mixed_exports_become_one_table(spark, tmp_path):
    a = "date,userID,origin_latitude,origin_longitude,destination_latitude,destination_longitude,distancia,hora,origin_municipio\n"
    b = "date,userID,origin_latitude,origin_longitude,destination_latitude,destination_longitude,distancia,hour,origin_municipio,extra\n"
    write(tmp_path / "2023-01-02_to_2023-01-08_2023-01.csv", a + "2023-01-02 10:00:00,7,-17.4,-66.1,-17.5,-66.2,1200.5,10,Quillacollo\nbad,8,-17.4,-66.1,-17.5,-66.2,900,11,Tiquipaya\n", "utf-8")
    write(tmp_path / "2024-05-06_to_2024-05-12_2024-19.csv", b + "2024-05-06 08:00:00,u9,-17.4,-66.1,-17.5,-66.2,800,8,Chimoré,x\n", "latin-1")
    write(tmp_path / "2024-05-13_to_2024-05-19_2024-20.csv", "date,userID\n", "utf-8")
    trips, registry = exports.read_trip_exports(spark, f"{tmp_path}/*.csv")
    rows = {r.user_id: r for r in trips.collect()}
    assert set(rows) == {"7", "8", "u9"}
    assert rows["8"].ts is None and str(rows["7"].ts) == "2023-01-02 10:00:00"
    assert rows["u9"].muni == "Chimoré" and rows["u9"].source_encoding == "latin-1" and rows["u9"].source_batch == "lote_2024"
    assert rows["7"].extra is None and rows["7"].hour == 10 and rows["u9"].week == 19
    reg = {(r.source_encoding, r.columns): r.rows for r in registry.collect()}
    assert reg == {("utf-8", 9): 2, ("latin-1", 10): 1, ("utf-8", 2): 0}


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_quoted_breaks_in_any_split(spark, tmp_path, split):
    """Files with quoted breaks, commas and quotes equal Python's csv reader however they are split."""
    rnd = random.Random(split)
    want = []
    for k in range(3):
        rows = []
        for i in range(40):
            text = "".join(rnd.choices(['a', 'é', ',', '"', '\n', ' ', 'b"c', '\n\n', '"",'], k=rnd.randint(0, 12)))
            rows.append([f"2023-01-0{rnd.randint(1, 9)} 10:00:00", f"u{k}-{i}", text, rnd.choice(["x", ""])])
        if k == 1:
            rows = [[c.replace("\n", "").replace('"', "") for c in r] for r in rows]
        rows.insert(20, ["date", "userID", "origin_municipio", "the, last"])  # a record that equals the header
        with open(tmp_path / f"2023-0{k}.csv", "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([["date", "userID", "origin_municipio", "the, last"], *rows])
        want += [(f"2023-0{k}.csv", r[1], r[2] or None, r[3] or None) for r in rows]
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, str(split))
        trips, registry = exports.read_trip_exports(spark, f"{tmp_path}/*.csv")
        got = [(r.source_file, r.user_id, r.muni or None, r["the, last"] or None) for r in trips.collect()]
        assert {(r.columns, r.rows) for r in registry.collect()} == {(4, 41)}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('date,userID\n2023-01-01 10:00:00,"x\ny,z\n')
    with pytest.raises(ValueError, match="never closed"):
        exports.read_trip_exports(spark, f"{tmp_path}/*.csv")


def test_six_significant_digits(spark):
    vals = [0.0, 1234567.891, 0.000012345678, 3.14159265, -12.5, 100000.0, 999999.6, 0.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r.x for r in tables.report_rows(df).collect()] == [f"{v:.6g}" for v in vals]


def test_metrics_round_trip_sorted(spark, tmp_path):
    df = spark.createDataFrame([("b", "2"), ("a", "-1.5e3"), ("c", 'x "y"'), ("d", None), ("e", "[1, 2]"), ("f", "007")], "metric string, value string")
    path = tables.write_metrics(df, str(tmp_path), "02")
    assert list(json.loads(spark.read.text(path).first().value).items()) == [("a", -1500.0), ("b", 2), ("c", 'x "y"'), ("d", None), ("e", [1, 2]), ("f", "007")]
    got = {r.metric: r.value for r in tables.read_metrics(spark, str(tmp_path), "02").collect()}
    assert got["b"] == "2" and got["c"] == 'x "y"' and got["f"] == "007"


def test_zone_features_are_valid_geojson(stages, tmp_path):
    path = str(tmp_path / "z")
    tables.write_zone_features(stages.zones, path, ["cell", "query_count"])
    spark = stages.zones.sparkSession
    f = json.loads(spark.read.text(path).first().value)
    ring = f["geometry"]["coordinates"][0]
    assert f["type"] == "Feature" and ring[0] == ring[-1] and len(ring) == 7
    assert tables.read_zone_features(spark, path).where(F.col("geometry.type") == "Polygon").count() == stages.zones.count()


def test_study_area_round_trip(stages, tmp_path):
    from gapgrid.operators import geometry
    from gapgrid.plans.views import FIXTURE_PARAMS as P

    spark, area = stages.zones.sparkSession, stages.area
    tables.write_study_area(spark, area, f"{tmp_path}/area")
    back = tables.read_study_area(spark, f"{tmp_path}/area", P)
    r = back.first()
    assert r.buffer_m == area.buffer_m and len(r.edges) == len(area.ring)
    assert all(abs(e.x1 - x) < 1e-6 and abs(e.y1 - y) < 1e-6 for e, (x, y) in zip(r.edges, area.ring_xy))
    lats, lons = [c[1] for c in area.ring], [c[0] for c in area.ring]
    rnd = random.Random(2)
    pts = [(rnd.uniform(min(lats) - .02, max(lats) + .02), rnd.uniform(min(lons) - .02, max(lons) + .02)) for _ in range(400)] + [(None, 1.0)]
    df = spark.createDataFrame(pts, "lat double, lon double")
    both = geometry.add_inside(geometry.add_inside_of(df, back, "lat", "lon", "stored", P), area, "lat", "lon", "fresh", P)
    assert both.where("stored <> fresh OR stored IS NULL").count() == 0 < both.where("stored").count() < 400


def test_editions_name_only_what_is_complete(spark, tmp_path):
    from gapgrid.sources import editions

    root = str(tmp_path / "store")
    with pytest.raises(LookupError):
        editions.read_edition(spark, root)
    a, b = spark.range(3), spark.range(5)
    assert editions.write_edition(root, "one", {"gap": a, "weeks": b}) == 1
    a.write.parquet(f"{root}/edition-000002/gap")  # a run that broke off
    assert editions.read_edition(spark, root)[0] == "one"
    assert editions.write_edition(root, "two", {"gap": b}) == 2
    label, found = editions.read_edition(spark, root)
    assert label == "two" and list(found) == ["gap"] and found["gap"].count() == 5
    assert editions.read_edition(spark, root, 1)[1]["weeks"].count() == 5


def test_exports_of_a_table_whose_first_split_is_empty(spark):
    """The rows of the only row group belong to a middle split, so the first task writes nothing."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4000")
    try:
        got = QUERIES["detect_encoding"](spark, SF_DIR).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted(map(tuple, got)) == [("a", "utf-8"), ("b", "latin-1"), ("c", "utf-8")]


def test_registry_of_a_table_whose_first_split_is_empty(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4000")
    try:
        got = {(r.source_encoding, r.columns): r.rows for r in QUERIES["file_registry"](spark, SF_DIR).collect()}
    finally:
        spark.conf.set(name, before)
    trips = stages_for(spark, SF_DIR).trips.groupBy("source_file").count().collect()
    assert got == {("utf-8", 2): 0, **{("utf-8", 9) if r.source_file == FILE_A else ("latin-1", 10): r["count"] for r in trips}}
