"""Registered queries: every operator applied to the stand-in views or to the stages derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgrid.functions import grid, ordering, projection
from gapgrid.functions import scalars as S
from gapgrid.models import boosting, counts, rates, stored
from gapgrid.models import validation as V
from gapgrid.operators import checks, cleaning, evaluation, geometry, joins, network, profiles, stats, users, zones
from gapgrid.params import ACTION_MAP, LADDER
from gapgrid.plans import views
from gapgrid.plans.stages import Stages, stages_for
from gapgrid.session import checkpoint_root, materialize
from gapgrid.sources import editions, exports, tables

P = views.FIXTURE_PARAMS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register ``fn(st)`` over the stages of a data folder."""
    def keep(fn: Callable[[Stages], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(stages_for(spark, sf_dir))
        return fn
    return keep


def table_query(name: str):
    """Register ``fn(spark, sf_dir)`` over the given tables themselves."""
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


def r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded half-up so that engines that sum in another order agree."""
    return df.select(*[r(f.name, digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def scratch(df: DataFrame, name: str) -> str:
    import uuid

    return f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:10]}"


# ---- flagship --------------------------------------------------------------

def priority_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones with far fewer queries than their population predicts: one scan, one shuffle by zone."""
    t = views.trips(spark, sf_dir).where(S.valid_origin(P.bbox)).withColumn("cell", grid.point_to_cell("lat_orig", "lon_orig", p=P))
    pop = tables.population_cells(views.population_points(spark, sf_dir), P)
    z = pop.join(zones.zone_counts(t), "cell", "left").select("cell", "population", F.coalesce("query_count", F.lit(0)).alias("query_count"))
    e = rates.rate_global(z, z).select("cell", "population", "query_count", "expected", *S.gap_metrics("query_count", "expected", P.shrink))
    return rounded(evaluation.top_k(e, P.top_k))


QUERIES["priority_zones"] = priority_zones


# ---- sources and sinks -----------------------------------------------------

def _export_files(st: Stages) -> str:
    """The trips written back as CSV exports: UTF-8 and Latin-1 files, two headers, notes over two lines, and a file with a header only.

    Written by ``source_file``, because a plain write leaves a file with a header only where its first task has no rows.
    """
    path, spark = scratch(st.trips, "exports"), st.trips.sparkSession
    t = st.trips.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.col("user_id").alias("userID"),
                        F.col("lat_orig").alias("origin_latitude"), F.col("lon_orig").alias("origin_longitude"),
                        F.col("lat_dest").alias("destination_latitude"), F.col("lon_dest").alias("destination_longitude"),
                        F.col("dist_m").alias("distancia"), "event_id", F.col("muni").alias("origin_municipio"), "source_file")
    t.where(F.col("source_file") == views.FILE_A).write.partitionBy("source_file").csv(f"{path}/a", header=True)
    b = t.where(F.col("source_file") == views.FILE_B).withColumnRenamed("userID", "user_id").withColumn("nota", F.concat(F.lit('é,\n"'), "event_id", F.lit('"')))
    b.write.partitionBy("source_file").csv(f"{path}/b", header=True, encoding="ISO-8859-1", escape='"')
    spark.createDataFrame([("date,userID",)], "value string").coalesce(1).write.text(f"{path}/c/source_file=none")
    return f"{path}/*/*/part*"


@query("read_trip_exports")
def _(st):
    trips, _ = exports.read_trip_exports(st.trips.sparkSession, _export_files(st))
    return trips.agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("users"), F.count("ts").alias("times"),
                     F.count("dist_m").alias("distances"), F.round(F.sum("lat_orig"), 4).alias("sum_lat"),
                     F.round(F.sum("dist_m"), 2).alias("sum_dist"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                     F.sum("week").alias("sum_week"), F.count_if(F.col("muni") == views.NAME).alias("named"), F.count("nota").alias("notes"),
                     F.sum(F.regexp_extract("nota", r'^é,\n"(\d+)"$', 1).cast("long")).alias("sum_notes"))


@query("detect_encoding")
def _(st):
    enc = exports.detect_encoding(st.trips.sparkSession, _export_files(st))
    return enc.select(F.regexp_extract("path", "/([abc])/[^/]*/[^/]*$", 1).alias("folder"), "encoding").distinct()


@query("batch_of_file")
def _(st):
    return st.trips.groupBy("source_file", S.batch_of_file("source_file").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("file_registry")
def _(st):
    """Rows by encoding and width over the registry of all written files."""
    _, registry = exports.read_trip_exports(st.trips.sparkSession, _export_files(st))
    return registry.groupBy("source_encoding", "columns").agg(F.sum("rows").alias("rows"))


@query("schema_groups")
def _(st):
    """Column sets of the files: a file has the columns that hold a value somewhere in it."""
    cols = cleaning.data_columns(st.trips)
    per = st.trips.groupBy(F.col("source_file").alias("file")).agg(*[F.count(c).alias(c) for c in cols])
    heads = per.unpivot(["file"], cols, "column", "n").where("n > 0").select("file", "column")
    return profiles.schema_groups(heads)


@query("read_feed_tables")
def _(st):
    spark = st.trips.sparkSession
    path = scratch(st.trips, "feed")
    st.shapes.select("shape_id", F.col("seq").alias("shape_pt_sequence"), F.col("lat").alias("shape_pt_lat"),
                     F.col("lon").alias("shape_pt_lon")).write.csv(f"{path}/shapes.txt", header=True)
    feed = tables.read_feed_tables(spark, path)
    typed = tables.feed_shapes(feed["shapes"])
    return typed.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shape_id").alias("shapes"), F.round(F.sum("lat"), 4).alias("sum_lat"),
                     F.round(F.sum("lon"), 4).alias("sum_lon"), F.sum("seq").alias("sum_seq"))


@query("read_population")
def _(st):
    path = scratch(st.points, "population")
    st.points.write.parquet(path)
    return tables.read_population(st.points.sparkSession, path, P)


@table_query("read_columns")
def _(spark, sf_dir):
    return tables.read_columns(spark, f"{sf_dir}/events.parquet", ["event_id", "user_id"])


@query("write_table")
def _(st):
    path = scratch(st.clean, "clean")
    tables.write_table(st.clean.withColumn("year", S.iso_year("ts")), path, ["year"])
    return st.clean.sparkSession.read.parquet(path).select("event_id", "cell", "source_file")


@query("write_report_csv")
def _(st):
    path = tables.write_report_csv(st.gap_zones.select("cell", "observed", "lat"), scratch(st.clean, "report"), "05", "gap")
    return st.clean.sparkSession.read.csv(path, header=True, inferSchema=False)


def _metrics(df: DataFrame) -> DataFrame:
    return df.unpivot([], df.columns, "metric", "value").select("metric", F.col("value").cast("string").alias("value"))


@query("write_metrics")
def _(st):
    root = scratch(st.clean, "metrics")
    path = tables.write_metrics(_metrics(zones.zone_counters(st.zones, P)), root, "02")
    return st.clean.sparkSession.read.text(path)


@query("read_metrics")
def _(st):
    root = scratch(st.clean, "metrics")
    tables.write_metrics(_metrics(zones.zone_counters(st.zones, P)), root, "02")
    return tables.read_metrics(st.clean.sparkSession, root, "02")


@query("write_zone_features")
def _(st):
    return tables.zone_feature_rows(st.zones, ["cell", "query_count", "population"], P)


@query("read_zone_features")
def _(st):
    path = scratch(st.zones, "features")
    tables.write_zone_features(st.zones, path, ["cell", "query_count"], P)
    back = tables.read_zone_features(st.zones.sparkSession, path, "cell bigint, query_count bigint")
    return back.select("properties.cell", "properties.query_count", F.col("geometry.type").alias("kind"), F.size(F.col("geometry.coordinates")[0]).alias("vertices"))


@query("read_study_area")
def _(st):
    """Populated zones inside of the study area as it was written and read again."""
    path, spark = scratch(st.zones, "area"), st.zones.sparkSession
    tables.write_study_area(spark, st.area, path)
    centres = st.population.select("cell", grid.cell_lat("cell", p=P).alias("lat"), grid.cell_lon("cell", p=P).alias("lon"))
    return geometry.add_inside_of(centres, tables.read_study_area(spark, path, P), "lat", "lon", "inside", P).select("cell", "inside")


@query("save_estimator")
def _(st):
    """The rate technique that the rule chooses: fitted, stored, read again, and the test zones predicted from what was read."""
    path = scratch(st.train, "estimator")
    chosen = V.select_technique(st.oof, P)[0]
    tables.save_estimator(stored.fit_technique(st.train, chosen, p=P), path)
    fit = tables.load_estimator(st.train.sparkSession, path)
    return rounded(stored.predict_stored(st.test, fit, P).select("cell", F.lit(chosen).alias("technique"), "expected"))


@query("stored_ladder")
def _(st):
    """The technique that the rule chooses among all seven, stored, read again and applied to the test zones."""
    path = scratch(st.train, "estimator")
    tables.save_estimator(stored.fit_technique(st.train, st.selection[0], p=P), path)
    fit = tables.load_estimator(st.train.sparkSession, path)
    return rounded(stored.predict_stored(st.test, fit, P).select("cell", F.lit(st.selection[0]).alias("technique"), "expected"))


@query("declared_period")
def _(st):
    last = st.trips.agg(F.max(S.day_of("ts")).cast("string").alias("d")).scalar()
    return exports.declared_period(st.trips.select("source_file").distinct()).select("period_start", "period_end", last.alias("last_query"))


# ---- scalar expressions ----------------------------------------------------

@query("valid_origin")
def _(st):
    return st.trips.groupBy(S.valid_origin(P.bbox).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("valid_destination")
def _(st):
    return st.trips.groupBy(S.valid_destination().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("parse_ts_lenient")
def _(st):
    text = F.when(F.col("event_id") % 13 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return st.trips.select("event_id", "source_file", S.parse_ts_lenient(text).alias("parsed"))


@query("iso_year_week")
def _(st):
    shifted = F.date_add(F.to_date("ts"), (F.col("event_id") % 2000).cast("int"))
    return st.trips.groupBy(S.iso_year(shifted).alias("iso_year"), S.iso_week(shifted).alias("iso_week")).agg(F.count(F.lit(1)).alias("n"))


@query("ts_parts")
def _(st):
    return st.trips.groupBy(S.day_of("ts").cast("string").alias("day"), S.hour_of("ts").alias("hour"), S.weekday_of("ts").alias("weekday")
                            ).agg(F.count(F.lit(1)).alias("n"))


@table_query("repair_mojibake")
def _(spark, sf_dir):
    """Whole document texts, broken by reading their bytes as Latin-1 and repaired again."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return d.select("doc_id", F.md5(S.repair_mojibake(broken)).alias("repaired"))


@query("haversine_km")
def _(st):
    return rounded(st.points.select("point_id", S.haversine_km("lat", "lon", P.centre_lat, P.centre_lon).alias("km")))


@query("haversine_m")
def _(st):
    return rounded(st.trips.select("event_id", "source_file", S.haversine_m("lat_orig", "lon_orig", "lat_dest", "lon_dest").alias("m")), 3)


@query("project_xy")
def _(st):
    x, y = projection.project_xy("lat", "lon", P)
    return rounded(st.points.select("point_id", x.alias("x"), y.alias("y")), 3)


@query("unproject_xy")
def _(st):
    x, y = projection.project_xy("lat", "lon", P)
    xy = st.points.select("point_id", x.alias("x"), y.alias("y"))
    lat, lon = projection.unproject_xy("x", "y", P)
    return rounded(xy.select("point_id", lat.alias("lat"), lon.alias("lon")), 7)


@query("log1p_design")
def _(st):
    return rounded(st.table.select("cell", S.log1p_design("pop_ring1").alias("x_ring"), S.log1p_design("dist_centre_km").alias("x_dist")), 9)


@query("log_offset")
def _(st):
    return rounded(st.table.where("population > 0").select("cell", S.log_offset().alias("off")), 9)


@query("population_class")
def _(st):
    return st.table.select("cell", S.population_class(P).alias("class"))


@query("coverage_flag")
def _(st):
    return st.table.select("cell", S.coverage_flag("dist_network_m", P.coverage_m).cast("int").alias("covered"))


@query("in_model_flag")
def _(st):
    return st.zones.select("cell", S.in_model_flag(P).alias("in_model"))


@query("rate_per_1000")
def _(st):
    return rounded(st.zones.select("cell", S.rate_per_1000("query_count", "population").alias("rate")))


@query("gap_metrics")
def _(st):
    return rounded(st.gap_zones.select("cell", *S.gap_metrics("observed", "expected", P.shrink)))


@query("per_observed_week")
def _(st):
    return rounded(st.gap_zones.select("cell", S.per_observed_week("observed", st.observed_weeks).alias("observed_week")))


@query("cut_right_closed")
def _(st):
    return st.zones.select("cell", S.cut_right_closed("population", [100.0, 300.0, 500.0], ["a", "b", "c", "d"]).alias("band"))


@query("log_histogram")
def _(st):
    km = st.trips.where(S.valid_origin(P.bbox) & (F.col("dist_m") > 0)).select((F.col("dist_m") / 1000).alias("km"))
    return profiles.log_histogram(km, "km", 80, -1.0)


@query("priority_action")
def _(st):
    return st.gap_zones.select("cell", S.priority_action().alias("action"))


@query("map_link")
def _(st):
    return st.points.select("point_id", S.map_link("lat", "lon").alias("url"))


@query("field_template")
def _(st):
    return st.zones.select("cell", *S.field_template())


@query("null_to_false_signals")
def _(st):
    base = users.user_stats(users.possible_trips(st.trips, P)).select(
        "user_id", (F.col("n_queries") > P.users.volume).alias("s_volume"), (F.col("median_seconds") < P.users.fast_seconds).alias("s_fast"))
    return base.select("user_id", *S.null_to_false("s_volume", "s_fast"), S.count_true("s_volume", "s_fast").alias("n_signals"))


@query("clamped_gap_scale")
def _(st):
    return rounded(evaluation.clamped_gap(st.gap_zones))


@query("gap_as_null")
def _(st):
    return profiles.gap_as_null(st.weeks)


@query("round_all")
def _(st):
    return S.round_all(st.zones.select("cell", (F.col("query_count") * 0.1234567 + 0.0000321).alias("v")), 4)


# ---- grid ------------------------------------------------------------------

@query("point_to_cell")
def _(st):
    return grid.add_cell(st.trips, "lat_orig", "lon_orig", "cell", p=P).select("event_id", "source_file", "cell")


@query("cell_centroid")
def _(st):
    return rounded(st.population.select("cell", grid.cell_lat("cell", p=P).alias("lat"), grid.cell_lon("cell", p=P).alias("lon")), 9)


@query("cell_polygon")
def _(st):
    return st.population.select("cell", grid.cell_wkt("cell", p=P).alias("wkt"), grid.cell_geojson("cell", p=P).alias("geojson"))


@query("grid_ring")
def _(st):
    return st.population.select("cell", F.inline(grid.ring("cell", 2))).select("cell", "dst")


@query("grid_disk")
def _(st):
    return st.population.select("cell", F.inline(grid.disk("cell", 2)))


@query("grid_distance")
def _(st):
    cells = grid.add_cell(grid.add_cell(st.trips, "lat_orig", "lon_orig", "a", p=P), "lat_dest", "lon_dest", "b", p=P)
    return cells.groupBy(grid.grid_distance("a", "b").alias("rings")).agg(F.count(F.lit(1)).alias("n"))


@query("cell_parent")
def _(st):
    return st.population.select("cell", grid.cell_parent("cell", P).alias("block_id"))


@query("check_resolution")
def _(st):
    return st.population.agg(F.count_if(grid.wrong_resolution("cell", P.zone_res)).alias("wrong"), F.count(F.lit(1)).alias("cells"))


# ---- geometry --------------------------------------------------------------

@query("largest_component")
def _(st):
    return geometry.largest_component(st.origins.select("cell"), 1)


@query("convex_hull")
def _(st):
    ring = geometry.convex_hull(st.origins.join(st.main_cells, "cell", "left_semi"))
    return geometry.area_rows(st.trips.sparkSession, geometry.make_area(ring, P.buffer_m, P)).select("lon", "lat")


@query("study_area")
def _(st):
    area, main = cleaning.study_area(st.origins, P, P.component_k)
    return main.agg(F.count(F.lit(1)).alias("cells")).select("cells", F.lit(len(area.ring)).alias("vertices"),
                                                             F.lit(round(geometry.area_km2(area), 3)).alias("area_km2"))


@query("within_area")
def _(st):
    return st.points.select("point_id", geometry.within_area(st.area, "lat", "lon", P).alias("inside"))


def _one(st: Stages, **values) -> DataFrame:
    """One row of values derived from the study area, next to the number of its origins."""
    return st.origins.agg(F.count(F.lit(1)).alias("origins")).select("origins", *[F.lit(v).alias(k) for k, v in values.items()])


@query("add_inside")
def _(st):
    return geometry.add_inside(st.trips, st.area, "lat_orig", "lon_orig", "inside", P).groupBy(
        "inside").agg(F.count(F.lit(1)).alias("n"))


@query("area_km2")
def _(st):
    return _one(st, area_km2=round(geometry.area_km2(st.area), 3))


@query("area_centroid")
def _(st):
    lat, lon = geometry.area_centroid(st.area, P)
    return _one(st, lat=round(lat, 5), lon=round(lon, 5))


@query("area_bounds")
def _(st):
    return geometry.area_bounds(st.origins.join(st.main_cells, "cell", "left_semi"))


@query("area_variants")
def _(st):
    return geometry.area_variants(st.origins, p=P)


@query("densify_polyline")
def _(st):
    d = network.densify_polyline(st.shapes, P.network_step_m, P)
    return rounded(d.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")), 2)


@query("nearest_distance")
def _(st):
    x, y = projection.project_xy("lat", "lon", P)
    return rounded(network.nearest_distance(st.points.select("point_id", x.alias("x"), y.alias("y")), st.network, "point_id"), 3)


@query("polyline_length_km")
def _(st):
    return rounded(network.polyline_length_km(st.shapes, P))


@query("polyline_rings")
def _(st):
    lines = network.polyline_rings(st.shapes)
    return lines.select("shape_id", F.array_join(F.transform("points", lambda v: F.format_string("%.5f %.5f", v["lon"], v["lat"])), ",").alias("line"))


@query("feed_summary")
def _(st):
    return network.feed_summary({"shapes": st.shapes, "points": st.points, "frequencies": st.points.select(
        (F.col("people") * 10).cast("string").alias("headway_secs"))}, P)


@query("share_near_network")
def _(st):
    spots = st.trips.where(S.valid_origin(P.bbox)).groupBy(F.col("lat_orig").alias("lat"), F.col("lon_orig").alias("lon")).agg(
        F.count(F.lit(1)).alias("n"))
    near = materialize(geometry.add_inside(spots, st.area, "lat", "lon", "inside", P), "spots").where("inside")
    return rounded(network.share_near_network(near, st.network, P), 4)


# ---- joins -----------------------------------------------------------------

@query("join_inner_stats")
def _(st):
    base = users.possible_trips(st.trips, P)
    day = users.daily_counts(base).groupBy("user_id").agg(F.max("n").alias("max_day"))
    pair = users.pair_counts(base).groupBy("user_id").agg(F.avg((F.col("n") > 1).cast("int")).alias("repeated_share"))
    return rounded(day.join(pair, "user_id"))


@query("join_left_fill")
def _(st):
    per = zones.period_counts(st.clean, *st.gap)
    return zones.join_left_fill(st.zones.select("cell", "query_count"), per, "cell", {"query_count_before_gap": 0, "query_count_after_gap": 0})


@query("zone_union_join")
def _(st):
    return st.population.select("cell").join(zones.zone_counts(st.clean), "cell", "full").join(st.population, "cell", "left").select(
        "cell", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("query_count", "user_count", "population")])


@query("join_right_summary")
def _(st):
    pure = st.modal.where("modal_queries = total_queries").groupBy(F.col("label").alias("municipality")).agg(F.count(F.lit(1)).alias("pure_zones"))
    return pure.join(zones.summary_by(st.table.where("in_model"), "municipality").select("municipality", "zones"), "municipality", "right")


@query("semi_cells")
def _(st):
    return st.population.join(st.main_cells, "cell", "left_semi")


@query("anti_users")
def _(st):
    return cleaning.exclude_users(st.trips, st.anomalous).select("event_id", "user_id", "source_file")


@query("anti_test_blocks")
def _(st):
    blocks = st.table.where("in_test").select("block_id").distinct()
    return st.table.where("in_model").join(blocks, "block_id", "left_anti").select("cell", "block_id")


@query("ring_neighbor_join")
def _(st):
    return grid.neighbour_join(st.zones, st.population, 2).select("src", "dst", "ring", "population")


@query("nearest_ring_join")
def _(st):
    known = st.modal.select("cell", F.col("label"))
    todo = st.zones.join(known.where("label IS NOT NULL"), "cell", "left_anti")
    return zones.nearest_label(todo, known, P.label_k_max)


@query("lookup_with_default")
def _(st):
    rate = st.train.groupBy("municipality").agg((F.sum("query_count") / F.sum("population")).alias("rate"))
    return rounded(rates.lookup_with_default(st.table.where("in_model").select("cell", "municipality"), rate, "municipality", "rate",
                                             F.lit(0.5)).select("cell", "rate"), 9)


@query("gap_join")
def _(st):
    e = rates.rate_by_group(st.train, st.test, "distance_ring").select("cell", "expected")
    g = rates.rate_global(st.train, st.test).select("cell", F.col("expected").alias("expected_global"))
    return rounded(st.test.select("cell", "query_count").join(e, "cell").join(g, "cell"))


@query("ranking_self_join")
def _(st):
    return rounded(evaluation.ranking_self_join(st.gap_zones, st.gap_zones.select("cell", F.col("gap_pearson_global").alias("gap_pearson"))))


@query("edge_train_test")
def _(st):
    return zones.edge_train_test(st.table)


# ---- aggregations ----------------------------------------------------------

@query("daily_counts")
def _(st):
    return users.daily_counts(users.possible_trips(st.trips, P)).withColumn("day", F.col("day").cast("string"))


@query("pair_counts")
def _(st):
    return users.pair_counts(users.possible_trips(st.trips, P))


@query("user_stats")
def _(st):
    return rounded(users.user_stats(users.possible_trips(st.trips, P)))


@query("user_signals")
def _(st):
    return users.signals_of_trips(st.trips, P).select("user_id", *users.SIGNALS, "n_signals", "anomalous")


@query("signal_totals")
def _(st):
    return users.signal_totals(st.signals)


@query("zone_counts")
def _(st):
    return zones.zone_counts(st.clean)


@query("period_counts")
def _(st):
    return zones.period_counts(st.clean, *st.gap)


@query("ring_population")
def _(st):
    return zones.ring_population(st.zones, st.population, 2, "pop_ring2")


@query("modal_label")
def _(st):
    return zones.modal_label(st.clean)


@query("label_purity")
def _(st):
    return rounded(zones.label_purity(st.modal))


@query("summary_by")
def _(st):
    return zones.summary_by(st.table.where("in_model"), "distance_ring")


@query("municipality_summary")
def _(st):
    return zones.municipality_summary(zones.model_purity(st.modal, st.table, P), st.table)


@query("population_class_counts")
def _(st):
    return zones.population_class_counts(st.table, P)


@query("block_table")
def _(st):
    return zones.block_table(st.table)


@query("block_distance")
def _(st):
    return rounded(zones.block_distance(st.featured))


@query("quantile_cuts")
def _(st):
    cuts = zones.quantile_cuts(zones.block_distance(st.featured), P.n_rings)
    return rounded(cuts.select(*[F.col("cuts")[i].alias(f"cut{i + 1}") for i in range(P.n_rings - 1)]))


@query("describe_zones")
def _(st):
    return rounded(zones.describe_zones(st.table.where("in_model"), ["query_count", "population", "pop_ring1", "dist_centre_km"]))


@query("distance_percentiles")
def _(st):
    return rounded(profiles.distance_percentiles(st.trips, P))


def _text_dates(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name)
                       for f in df.schema.fields])


@query("weekly_coverage")
def _(st):
    return _text_dates(profiles.weekly_coverage(st.clean))


@query("gap_bounds")
def _(st):
    return _text_dates(profiles.gap_bounds(st.weeks))


@query("observed_weeks")
def _(st):
    return rounded(profiles.observed_weeks(st.weeks))


@query("weekly_means_around_gap")
def _(st):
    return rounded(profiles.weekly_means_around_gap(st.weeks, *st.gap))


@query("temporal_profile")
def _(st):
    return profiles.temporal_profile(st.clean)


@query("null_profile")
def _(st):
    return profiles.null_profile(st.trips)


@query("duplicate_profile")
def _(st):
    od = ["lat_orig", "lon_orig", "lat_dest", "lon_dest"]
    return profiles.duplicate_profile(st.trips, {"exact": cleaning.data_columns(st.trips), "od_ts": [*od, "ts"],
                                                 "user_ts": ["user_id", "ts"], "od_ts_user": [*od, "ts", "user_id"]})


@query("distance_unit_check")
def _(st):
    return profiles.distance_unit_check(st.trips)


@query("gini")
def _(st):
    return rounded(stats.gini(st.zones, "query_count"))


@query("lorenz_curve")
def _(st):
    return rounded(stats.lorenz_curve(st.zones, "query_count", "cell"))


@query("target_summary")
def _(st):
    return stats.target_summary(st.table.where("in_model"))


@query("coverage_contrast")
def _(st):
    return rounded(evaluation.coverage_contrast(st.gap_zones), 4)


@query("gap_summary")
def _(st):
    return evaluation.gap_summary(st.gap_zones, P.top_k)


@query("action_summary")
def _(st):
    return evaluation.action_summary(st.predictions)


@query("label_counts")
def _(st):
    return profiles.label_counts(st.table, "municipality")


@query("period_days")
def _(st):
    return profiles.period_days(st.clean, *st.gap)


@query("population_coverage")
def _(st):
    return zones.population_coverage(st.population, st.origins, st.area, P)


@query("coordinate_problems")
def _(st):
    return profiles.coordinate_problems(st.trips, P)


@query("zone_counters")
def _(st):
    return zones.zone_counters(st.zones, P)


@query("split_counters")
def _(st):
    return zones.split_counters(st.table)


@query("label_inheritance")
def _(st):
    return zones.label_inheritance(zones.model_purity(st.modal, st.table, P), st.table)


# ---- windows ---------------------------------------------------------------

@query("seconds_between")
def _(st):
    return users.seconds_between(users.possible_trips(st.trips, P))


@query("first_distinct")
def _(st):
    return cleaning.first_distinct(st.trips).select("event_id", "source_file", "copies")


@query("share_of_total")
def _(st):
    total = st.zones.agg(F.sum("query_count").alias("t")).scalar()
    return rounded(st.zones.select("cell", (F.col("query_count") / total * 100).alias("pct")))


@query("first_per_group")
def _(st):
    """First zone of every block by queries descending, cell ascending."""
    best = F.min(F.struct((-F.col("query_count")).alias("neg"), F.col("cell").alias("cell")))
    return st.table.groupBy("block_id").agg(best.alias("m")).select("block_id", F.col("m.cell").alias("cell"), (-F.col("m.neg")).alias("query_count"))


@query("rank_average")
def _(st):
    return stats.rank_average(st.zones, "query_count", "cell").select("cell", "rank")


@query("rank_first_deciles")
def _(st):
    return evaluation.rank_first_deciles(st.gap_zones.select("cell", "expected"), "expected", "cell").select("cell", "decile")


@query("running_length")
def _(st):
    return rounded(network.running_length(st.shapes, P), 4)


@query("priority_rank")
def _(st):
    return evaluation.prioritise(st.gap_zones, P).select("cell", "action", "priority_rank")


@query("growing_disk_sum")
def _(st):
    pairs = grid.neighbour_join(st.table, st.train.select("cell", F.col("query_count").alias("y"), F.col("population").alias("pop")), P.neighbours_k_max)
    return rates.growing_disk_sum(pairs, P.neighbours_min)


# ---- sort, limit, sample, sets ---------------------------------------------

@query("stable_sort")
def _(st):
    return exports.stable_sort(st.trips).select("source_file", "ts", "event_id")


@query("mixed_sort")
def _(st):
    counts_ = st.clean.groupBy("cell", "muni").agg(F.count(F.lit(1)).alias("n"))
    return counts_.orderBy(F.asc("cell"), F.desc("n"), F.asc("muni"))


@query("top_k")
def _(st):
    return rounded(evaluation.top_k(st.gap_zones, P.top_k).select("cell", "gap_pearson"))


@query("top10_share")
def _(st):
    return rounded(stats.top_share(st.table.where("in_model"), "query_count", 10))


@query("peak_hour")
def _(st):
    return profiles.peak_hour(profiles.temporal_profile(st.clean))


@query("worst_gaps")
def _(st):
    return rounded(evaluation.top_k(st.gap_zones, 5).select("cell", "observed", "gap_pearson"))


@query("seeded_sample")
def _(st):
    return profiles.seeded_sample(st.points, 500, P.seed, "point_id").select("point_id")


@query("stratified_block_draw")
def _(st):
    return zones.stratified_block_draw(zones.block_table(st.ringed), P.test_fraction, P.seed).select("block_id", "distance_ring")


@query("union_relaxed")
def _(st):
    a = st.trips.select("event_id", F.col("user_id").cast("int").alias("code"))
    b = st.points.select(F.col("point_id").alias("event_id"), F.concat(F.lit("p"), "people").alias("code"), F.lit(1).alias("extra"))
    return joins.union_relaxed([a, b])


@query("union_all")
def _(st):
    return ordering.union_all([st.train.select("cell", F.lit("train").alias("part")), st.test.select("cell", F.lit("test").alias("part"))])


@query("distinct_points")
def _(st):
    return st.trips.select("lat_orig", "lon_orig").distinct()


@query("set_disjoint")
def _(st):
    return checks.check_disjoint(st.train, st.test, ["cell"], "set_disjoint")


@query("set_equal")
def _(st):
    return checks.set_equal(st.table.where("in_test"), st.table.where("in_model"), ["distance_ring"])


@query("jaccard_topk")
def _(st):
    g = st.gap_zones.select("cell", F.col("gap_pearson_global").alias("gap_pearson"))
    return rounded(evaluation.jaccard_topk(evaluation.top_k(st.gap_zones, P.top_k), evaluation.top_k(g, P.top_k)))


@query("unpivot_pivot")
def _(st):
    batches = ["lote_2024", "lote_original"]
    return profiles.null_profile_wide(st.trips, batches)


# ---- composite cleaning and zones ------------------------------------------

@query("anomalous_users")
def _(st):
    return users.anomalous_users(users.signals_of_trips(st.trips, P))


@query("clean_trips")
def _(st):
    steps = cleaning.assign_steps(st.trips, st.area, st.anomalous, P)
    return cleaning.clean_trips(steps, P).select("event_id", "user_id", "cell", "source_file")


@query("filter_flow")
def _(st):
    return cleaning.filter_flow(cleaning.assign_steps(st.trips, st.area, st.anomalous, P))


@query("zone_table")
def _(st):
    return zones.zone_table(st.clean, st.population, st.area, P)


@query("zone_features")
def _(st):
    return rounded(zones.zone_features(st.zones, st.population, P).select("cell", "pop_ring1", "pop_ring2", "dist_centre_km", "block_id", "lat", "lon"), 7)


@query("network_contrast")
def _(st):
    f = st.featured.drop("covered", "dist_network_m")
    return zones.network_contrast(f, st.network, P).select("cell", "dist_network_m", F.col("covered").cast("int").alias("covered"))


@query("zone_municipality")
def _(st):
    return zones.zone_municipality(st.zones, st.modal, P).select("cell", "municipality")


@query("distance_rings")
def _(st):
    return zones.distance_rings(st.featured, P)[0].select("cell", "distance_ring")


@query("holdout_split")
def _(st):
    return zones.holdout_split(st.ringed, P).select("cell", "in_test")


@query("modelling_table")
def _(st):
    return rounded(zones.modelling_table(st.table).withColumn("covered", F.col("covered").cast("int")), 7)


# ---- spatial statistics ----------------------------------------------------

def _rates(st: Stages) -> DataFrame:
    return st.table.where("in_model").withColumn("y", F.log1p(S.rate_per_1000("query_count", "population")))


@query("spearman")
def _(st):
    return stats.spearman(st.table.where("in_model"), "population", "query_count", 6)


@query("spearman_matrix")
def _(st):
    return stats.spearman_matrix(st.table.where("in_model"), ["population", "pop_ring1", "pop_ring2", "dist_centre_km"], 6)


@query("hex_weights")
def _(st):
    return rounded(stats.hex_weights(st.table.where("in_model"), 2))


@query("moran_i")
def _(st):
    return rounded(stats.moran_i(_rates(st), "y", 1))


@query("moran_permutation_p")
def _(st):
    return stats.moran_permutation_p(_rates(st), "y", 1, P.permutations, P.seed)


@query("moran_correlogram")
def _(st):
    return stats.moran_correlogram(_rates(st), "y", P.correlogram_k, P.permutations, P.seed)


@query("local_moran")
def _(st):
    return rounded(stats.local_moran(_rates(st), "y").select("cell", "local_i", "quadrant"))


@query("lisa_clusters")
def _(st):
    return rounded(stats.lisa_clusters(_rates(st), "y", P.permutations, P.seed, P.lisa_alpha))


@query("cliffs_delta")
def _(st):
    return rounded(stats.cliffs_delta(st.gap_zones, "gap_pearson", "covered", 0, 1))


@query("centre_comparison")
def _(st):
    return stats.centre_comparison(st.table.where("in_model"), geometry.area_centroid(st.area, P), "query_count", P)


# ---- estimators ------------------------------------------------------------

@query("rate_global")
def _(st):
    return rounded(rates.rate_global(st.train, st.test).select("cell", "expected"))


@query("rate_by_group")
def _(st):
    return rounded(rates.rate_by_group(st.train, st.test, "municipality").select("cell", "expected"))


@query("rate_neighbourhood")
def _(st):
    return rounded(rates.rate_neighbourhood(st.train, st.test, p=P).select("cell", "expected"))


@query("poisson_glm")
def _(st):
    model = counts.poisson_glm(st.train, p=P)
    coefs = {counts.FULL_FIT: [float(model.intercept), *[float(c) for c in model.coefficients]]}
    return rounded(counts.coefficient_rows(st.train.sparkSession, coefs, "M1", P))


def _coef_rows(st: Stages, dispersion: bool) -> DataFrame:
    coefs = counts.fit_counts(st.train.withColumn("model", F.lit(counts.FULL_FIT)), p=P, dispersion=dispersion)
    return counts.coefficient_rows(st.train.sparkSession, coefs, "M2" if dispersion else "M1", P)


@query("negbin2_glm")
def _(st):
    return rounded(_coef_rows(st, True))


@query("poisson_boosting")
def _(st):
    """The searched settings, all iterations, every training zone."""
    return rounded(V.final_fit(st.train, st.test, "M3", p=P).select("cell", "expected"))


@query("boosting_grid_search")
def _(st):
    inner = V.block_folds(st.train, P.inner_folds, "inner")
    return rounded(boosting.boosting_grid_search(inner, p=P)[1])


@query("block_folds")
def _(st):
    return V.block_folds(st.table.where("in_model"), P.folds).select("cell", "block_id", "fold")


@query("count_metrics")
def _(st):
    return rounded(V.count_metrics(st.oof, by=["technique"]))


@query("cross_validate")
def _(st):
    return rounded(V.cross_validate(st.train, ["B0", "B1", "B2", "B3"], p=P))


@query("cv_summary")
def _(st):
    return rounded(V.cv_summary(V.count_metrics(st.oof, by=["technique", "fold"]), V.count_metrics(st.oof, by=["technique"])))


@query("one_se_rule")
def _(st):
    return rounded(V.one_se_rule(V.count_metrics(st.oof, by=["technique", "fold"]), P))


@query("ladder_summary")
def _(st):
    """All seven techniques, boosting with its whole search."""
    return rounded(V.cv_summary(V.count_metrics(st.oof_ladder, by=["technique", "fold"]), V.count_metrics(st.oof_ladder, by=["technique"])))


@query("select_technique")
def _(st):
    return rounded(st.selection[1])


@query("boosting_choices")
def _(st):
    """Inner deviance of every combination for each outer fold."""
    return rounded(V.outer_searches(st.train, p=P)[1])


@query("selected_gap_table")
def _(st):
    """The gap under the technique that the rule chooses among all seven."""
    model, technique = st.table.where("in_model"), st.selection[0]
    e, g = (V.expected_by_zone(st.train, st.test, t, p=P) for t in (technique, "B0"))
    return rounded(evaluation.gap_table(model, e, g, st.observed_weeks, P).withColumn("technique", F.lit(technique)))


def _fitted(st: Stages, dispersion: bool) -> tuple[DataFrame, float | None]:
    """Training rows under their own fit, and alpha."""
    train = st.train.withColumn("model", F.lit(counts.FULL_FIT))
    coefs = counts.fit_counts(train, p=P, dispersion=dispersion)
    return counts.expected_counts(train, coefs, P), float(coefs[counts.FULL_FIT][-1]) if dispersion else None


@query("pearson_dispersion")
def _(st):
    return rounded(counts.pearson_dispersion(_fitted(st, False)[0], 1 + len(P.predictors)), 5)


@query("coefficient_table")
def _(st):
    return counts.coefficient_table(_coef_rows(st, False), _coef_rows(st, True))


@query("expected_zeros")
def _(st):
    near = st.oof.where("technique = 'B3'").withColumnRenamed("observed", "query_count")
    return rounded(counts.expected_zeros(near, "B3").unionByName(counts.expected_zeros(_fitted(st, False)[0], "M1")), 4)


@query("expected_zeros_negbin")
def _(st):
    pred, alpha = _fitted(st, True)
    return rounded(counts.expected_zeros(pred, "M2", alpha=alpha), 4)


@query("expected_by_zone")
def _(st):
    return rounded(V.expected_by_zone(st.train, st.test, "B1", p=P))


@query("holdout_leak_share")
def _(st):
    return rounded(V.holdout_leak_share(st.train, P))


@query("final_fit")
def _(st):
    return rounded(V.final_fit(st.train, st.test, "B2", p=P).select("cell", "expected"))


@query("count_regressions_oof")
def _(st):
    return rounded(st.oof_all.where(F.col("technique").isin("M1", "M2")), 4)


# ---- evaluation ------------------------------------------------------------

def _test_pred(st: Stages) -> DataFrame:
    ref = rates.rate_global(st.train, st.test).select("cell", F.col("expected").alias("reference"))
    return V.final_fit(st.train, st.test, "B2", p=P).select("cell", F.col("query_count").alias("observed"), "expected").join(ref, "cell")


@query("d2_against")
def _(st):
    return rounded(V.d2_against(_test_pred(st), "observed", "expected", "reference"))


@query("calibration_deciles")
def _(st):
    return rounded(evaluation.calibration_deciles(st.gap_zones, "observed", "expected", "cell"))


@query("test_vs_cv_table")
def _(st):
    pred = _test_pred(st)
    d2 = V.d2_against(pred, "observed", "expected", "reference").scalar()
    m = V.count_metrics(pred).withColumn("d2_against_global", d2)
    b2 = st.oof.where("technique = 'B2'")
    cv = V.cv_summary(V.count_metrics(b2, by=["technique", "fold"]), V.count_metrics(b2, by=["technique"]))
    return rounded(evaluation.test_vs_cv_table(m, cv))


@query("gap_table")
def _(st):
    model = st.table.where("in_model")
    e, g = (V.expected_by_zone(st.train, st.test, t, p=P) for t in ("B2", "B0"))
    return rounded(evaluation.gap_table(model, e, g, st.observed_weeks, P).withColumn("covered", F.col("covered").cast("int")))


@query("gap_of_variant")
def _(st):
    return rounded(evaluation.gap_of_variant(st.train, st.test, "B1", "query_count_before_gap", P, P.pop_min_sensitivity))


@query("compare_rankings")
def _(st):
    return evaluation.compare_rankings(st.gap_zones, evaluation.gap_of_variant(st.train, st.test, "B3", p=P), P.top_k)


@query("sensitivity_table")
def _(st):
    best = V.one_se_rule(V.count_metrics(st.oof, by=["technique", "fold"]), P).where("is_best").first()
    v = {"best_mean_technique": evaluation.gap_of_variant(st.train, st.test, best.technique, p=P) if best else st.gap_zones.where(F.lit(False)),
         "global_rate": st.gap_zones.select("cell", F.col("gap_pearson_global").alias("gap_pearson")),
         "before_gap": evaluation.gap_of_variant(st.train, st.test, "B2", "query_count_before_gap", P),
         "larger_minimum_population": evaluation.gap_of_variant(st.train, st.test, "B2", p=P, min_population=P.pop_min_sensitivity)}
    return evaluation.sensitivity_table(st.gap_zones, {k: materialize(d, "variant") for k, d in v.items()}, P.top_k)


@query("prioritise")
def _(st):
    return rounded(evaluation.prioritise(st.gap_zones, P.but(only_uncovered=False)).select("cell", "gap_pearson", "action", "priority_rank"))


@query("zone_predictions")
def _(st):
    out = evaluation.zone_predictions(evaluation.prioritise(st.gap_zones, P), st.observed_weeks)
    return out.withColumn("covered", F.col("covered").cast("int"))


@query("field_list")
def _(st):
    return evaluation.field_list(st.predictions).drop("lat", "lon").transform(lambda d: rounded(d, 2))


@query("sensitivity_ladder")
def _(st):
    """``sensitivity_table`` with the best technique of all seven."""
    best = V.one_se_rule(V.count_metrics(st.oof_ladder, by=["technique", "fold"]), P).where("is_best").first()
    v = {"best_mean_technique": materialize(evaluation.gap_of_variant(st.train, st.test, best.technique, p=P), "variant")}
    return evaluation.sensitivity_table(st.gap_zones, v, P.top_k).withColumn("technique", F.lit(best.technique))


@query("edition_monitor")
def _(st):
    """This edition against the last one stored: two are written, one that no longer counts and one under the global rate."""
    root, spark = scratch(st.gap_zones, "editions"), st.gap_zones.sparkSession
    old = st.gap_zones.select("cell", (-F.col("gap_pearson")).alias("gap_pearson"))
    editions.write_edition(root, "first", {"gap": old, "weeks": st.weeks.limit(0)})
    last = st.gap_zones.select("cell", F.col("gap_pearson_global").alias("gap_pearson"))
    editions.write_edition(root, "second", {"gap": last, "weeks": st.weeks.where("observed").withColumn("complete", F.lit(True))})
    _, previous = editions.read_edition(spark, root)
    return evaluation.edition_monitor(st.gap_zones, previous["gap"], st.weeks, previous["weeks"])


# ---- checks ----------------------------------------------------------------

@query("check_unique")
def _(st):
    return ordering.union_all([checks.check_unique(st.zones, ["cell"], "zone"), checks.check_unique(st.trips, ["event_id"], "event")])


@query("check_no_nulls")
def _(st):
    return ordering.union_all([checks.check_no_nulls(st.table, name="table"), checks.check_no_nulls(st.trips, ["user_id", "dist_m"], "trips")])


@query("check_range")
def _(st):
    return ordering.union_all([checks.check_range(st.table, "population", 0, name="population"),
                               checks.check_range(zones.label_purity(st.modal), "pct_modal", 0, 100, True, "purity"),
                               checks.check_range(st.gap_zones, "expected", 0, open_low=True, name="expected")])


@query("check_reconciles")
def _(st):
    flow = cleaning.filter_flow(st.steps).agg(F.sum("removed").alias("x")).scalar()
    kept = st.clean.agg(F.count(F.lit(1)).alias("x")).scalar()
    raw = st.trips.agg(F.count(F.lit(1)).alias("x")).scalar()
    zone = st.zones.agg(F.sum("query_count").alias("x")).scalar()
    spark = st.trips.sparkSession
    pairs = spark.range(1).select(F.inline(F.array(F.struct((flow + kept).cast("double").alias("left"), raw.cast("double").alias("right")),
                                                   F.struct(zone.cast("double").alias("left"), kept.cast("double").alias("right")))))
    return checks.check_reconciles(pairs)


@query("check_disjoint")
def _(st):
    return ordering.union_all([checks.check_disjoint(st.train, st.test, ["block_id"], "blocks"),
                               checks.check_disjoint(st.clean, st.anomalous, ["user_id"], "users")])


@query("check_same_as_phase")
def _(st):
    a, b = _metrics(zones.zone_counters(st.zones, P)), _metrics(zones.zone_counters(st.table, P))
    return checks.check_same_as_phase(a, b)


@query("check_fold_integrity")
def _(st):
    return checks.check_fold_integrity(st.oof)


@query("check_no_leak")
def _(st):
    path = scratch(st.train, "coefficients")
    tables.save_estimator(_coef_rows(st, False), path)
    return checks.check_no_leak(tables.load_estimator(st.train.sparkSession, path), list(P.predictors), [*P.contrast, "query_count"])


@query("check_domain")
def _(st):
    return ordering.union_all([checks.check_domain(st.predictions, "action", ["mapear", "revisar", "sin_brecha"], "action"),
                               checks.check_domain(st.oof, "technique", list(LADDER), "technique")])


@query("check_ranking")
def _(st):
    ranked = evaluation.prioritise(st.gap_zones, P)
    return checks.check_ranking(ranked, "gap_pearson", "priority_rank", F.col("action") == ACTION_MAP)


@query("check_roundtrip")
def _(st):
    path = scratch(st.table, "table")
    tables.write_table(st.table, path)
    return checks.check_roundtrip(st.table, st.table.sparkSession.read.parquet(path))
