"""Connected zones, convex study areas and point-in-area tests."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions.ordering import union_all
from gapgrid.functions.projection import project_xy, unproject_xy
from gapgrid.params import DEFAULT, Params
from gapgrid.session import discard, materialize

UNIT = 10_000_000  # coordinates are compared in whole 1e-7 degrees (about a centimetre), so turns are exact
DIRECTIONS = 16

# the partial hull below runs in Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# ---- connected components --------------------------------------------------

def component_labels(cells: DataFrame, k: int = 1) -> DataFrame:
    """(cell, label) with one label per set of cells connected by disks of radius ``k``.

    Randomised contraction: each round every node joins the neighbour that comes first in a fresh hash order,
    the graph is rewritten on the survivors, and edges inside one survivor disappear. The expected number of
    live nodes falls by a constant factor per round whatever the shape, so long chains take O(log n) rounds.
    """
    nodes = materialize(cells.select("cell").distinct(), "cells")
    edges = materialize(grid.neighbour_join(nodes, nodes, k).where("src < dst").select("src", "dst"), "edges")
    picks = []
    left = nodes.count()
    for rnd in range(20 + 4 * max(1, left).bit_length()):  # rounds needed grow with the logarithm of the nodes
        if edges.isEmpty():
            break
        both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
        order = F.xxhash64(F.col("other"), F.lit(rnd))
        own = F.xxhash64(F.col("node"), F.lit(rnd))
        pick = both.groupBy("node").agg(F.min(F.struct(order.alias("h"), F.col("other").alias("id"))).alias("m")).select(
            "node", F.least(F.col("m"), F.struct(own.alias("h"), F.col("node").alias("id")))["id"].alias("to"))
        for _ in range(2):  # picks point down the hash order: follow them towards the local minimum
            pick = pick.alias("x").join(pick.alias("y"), F.col("x.to") == F.col("y.node")).select(
                F.col("x.node").alias("node"), F.col("y.to").alias("to"))
        pick = materialize(pick, "pick")
        picks.append(pick)
        a, b = pick.toDF("src", "a"), pick.toDF("dst", "b")
        done, edges = edges, materialize(
            edges.join(a, "src").join(b, "dst").where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        discard(done)
    else:
        raise RuntimeError("components did not settle")
    labels = nodes.withColumn("label", F.col("cell"))
    for pick in picks:
        labels = (labels.join(pick, F.col("label") == F.col("node"), "left")
                  .select("cell", F.coalesce("to", "label").alias("label")))
    labels = materialize(labels, "labels")
    discard(nodes, edges, *picks)
    return labels


def largest_component(cells: DataFrame, k: int = 1) -> DataFrame:
    """Cells of the largest component; of equal ones, the one that holds the smallest cell."""
    labels = component_labels(cells, k)
    best = (labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("first"))
            .orderBy(F.desc("n"), F.asc("first")).limit(1))
    return labels.join(F.broadcast(best.select("label")), "label", "left_semi").select("cell")  # one row


# ---- convex hull -----------------------------------------------------------

def _turn(o, a, b) -> int:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def hull_of(points: np.ndarray) -> list[tuple[float, float]]:
    """Counter-clockwise hull vertices of (x, y) rows in degrees, starting at the leftmost lowest point."""
    pts = sorted({(int(x), int(y)) for x, y in np.rint(np.asarray(points, float).reshape(-1, 2) * UNIT)})
    if len(pts) > 2:
        chains = []
        for seq in (pts, pts[::-1]):
            chain: list[tuple[int, int]] = []
            for pt in seq:
                while len(chain) > 1 and _turn(chain[-2], chain[-1], pt) <= 0:
                    chain.pop()
                chain.append(pt)
            chains.append(chain[:-1])
        pts = chains[0] + chains[1]
    return [(x / UNIT, y / UNIT) for x, y in pts]


def _partial_hull(batches):
    kept: list[tuple[float, float]] = []
    for pdf in batches:
        kept = hull_of(np.vstack([np.array(kept).reshape(-1, 2), pdf[["lon", "lat"]].to_numpy()]))
    yield pd.DataFrame(kept, columns=["lon", "lat"])


def convex_hull(points: DataFrame) -> list[tuple[float, float]]:
    """Hull ring (lon, lat) of all points.

    The extreme points in a few directions, found by one aggregate, span a polygon; points strictly inside it
    are no vertices and go first, by plain arithmetic. Every partition then keeps only the hull of what is left.
    """
    pts = points.select("lon", "lat")
    angles = [2 * math.pi * k / DIRECTIONS for k in range(DIRECTIONS)]
    far = [F.max_by(F.struct("lon", "lat"), F.col("lon") * math.cos(a) + F.col("lat") * math.sin(a)).alias(f"p{k}") for k, a in enumerate(angles)]
    corners = [tuple(v) for v in pts.agg(*far).first() if v is not None]
    poly = hull_of(np.array(corners)) if corners else []
    if len(poly) > 2:
        inside = F.lit(True)
        for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1]):
            clear = 4.0 / UNIT * math.hypot(x2 - x1, y2 - y1)  # farther inside than coordinates are rounded
            inside = inside & ((x2 - x1) * (F.col("lat") - y1) - (y2 - y1) * (F.col("lon") - x1) > clear)
        pts = pts.where(~inside)
    schema = "lon double, lat double"
    partial = pts.mapInPandas(_partial_hull, schema)
    merged = partial.repartition(8, F.xxhash64("lon", "lat")).mapInPandas(_partial_hull, schema)
    return hull_of(np.array([tuple(r) for r in merged.collect()]).reshape(-1, 2))


# ---- study area ------------------------------------------------------------

@dataclass(frozen=True)
class StudyArea:
    """Convex ring (lon, lat) with the same ring in projected metres and a metric margin around it."""

    ring: tuple[tuple[float, float], ...]
    ring_xy: tuple[tuple[float, float], ...]
    buffer_m: float


def _scalar_frame(df_session, pts: list[tuple[float, float]]) -> DataFrame:
    return df_session.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)],
                                      "i int, lon double, lat double")


def make_area(ring: list[tuple[float, float]], buffer_m: float, p: Params = DEFAULT) -> StudyArea:
    """Project the vertices (a few dozen) and close the description of the area."""
    from pyspark.sql import SparkSession

    x, y = project_xy("lat", "lon", p)
    rows = (_scalar_frame(SparkSession.active(), ring).select("i", x.alias("x"), y.alias("y")).orderBy("i").collect())
    return StudyArea(tuple(ring), tuple((r.x, r.y) for r in rows), buffer_m)


def _near(area: StudyArea, la: Column, lo: Column) -> Column:
    """Bounding box on plain degrees with room for the margin."""
    lons, lats = [v[0] for v in area.ring], [v[1] for v in area.ring]
    pad_lat = area.buffer_m / 110_000.0
    pad_lon = area.buffer_m / (110_000.0 * max(0.05, math.cos(math.radians(max(map(abs, lats)) + pad_lat))))
    return la.between(min(lats) - pad_lat, max(lats) + pad_lat) & lo.between(min(lons) - pad_lon, max(lons) + pad_lon)


def _inside(area: StudyArea, px: Column, py: Column) -> Column:
    """Point (projected metres) in the ring or closer to it than the margin.

    The edges are one constant array: written out edge by edge, the generated method passes the size that the JVM compiles.
    """
    edges = []
    for (x1, y1), (x2, y2) in zip(area.ring_xy, area.ring_xy[1:] + area.ring_xy[:1]):
        ux, uy = x2 - x1, y2 - y1
        length = math.hypot(ux, uy)
        ux, uy = (ux / length, uy / length) if length > 0 else (0.0, 0.0)
        edges.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2), ("ux", ux), ("uy", uy), ("length", length))]))
    if not edges:
        return F.lit(False)
    solid = F.lit(len(edges) > 2) & F.forall(F.array(*edges), lambda e: (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"]) >= 0)

    def close(e):
        # distance to the segment: across it where the foot lies on it, else to its first end (the other end
        # is the first end of the next edge)
        along = (px - e["x1"]) * e["ux"] + (py - e["y1"]) * e["uy"]
        across = (px - e["x1"]) * e["uy"] - (py - e["y1"]) * e["ux"]
        beside = (e["length"] > 0) & (F.abs(across) < area.buffer_m) & along.between(F.lit(0.0), e["length"])
        return beside | (F.hypot(px - e["x1"], py - e["y1"]) < area.buffer_m)

    return solid | F.exists(F.array(*edges), close)


def within_area(area: StudyArea, lat="lat", lon="lon", p: Params = DEFAULT) -> Column:
    """Inside the ring or closer to it than the margin; the outer boundary itself is outside.

    A bounding box settles far points before any projection is computed. As a single expression it can be used
    in any filter; ``add_inside`` is the faster form for large tables, with the same test.
    """
    la, lo = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    x, y = project_xy(la, lo, p)
    # the point is projected once per row: it travels as the only element of an array
    point = F.array(F.struct(x.alias("px"), y.alias("py")))
    return F.when(_near(area, la, lo), F.exists(point, lambda pt: _inside(area, pt["px"], pt["py"]))).otherwise(F.lit(False))


def add_inside(df: DataFrame, area: StudyArea, lat: str, lon: str, name: str, p: Params = DEFAULT) -> DataFrame:
    """Column ``name`` with the test of ``within_area``, as plain arithmetic on once-projected metres."""
    x, y = project_xy(lat, lon, p)
    inside = F.when(_near(area, F.col(lat), F.col(lon)), _inside(area, F.col("_px"), F.col("_py"))).otherwise(F.lit(False))
    return df.select("*", x.alias("_px"), y.alias("_py")).withColumn(name, inside).drop("_px", "_py")


def add_inside_of(df: DataFrame, stored: DataFrame, lat: str, lon: str, name: str, p: Params = DEFAULT) -> DataFrame:
    """The test of ``within_area`` against a stored area (one row: edges, buffer_m, see ``read_study_area``).

    The area reaches the test as a value of one row, so the plan doesn't depend on its vertices. Points without coordinates are outside.
    """
    area = stored.select(F.struct("edges", "buffer_m").alias("a")).scalar()
    x, y = project_xy(lat, lon, p)
    rows = df.select("*", x.alias("_px"), y.alias("_py")).withColumn("_area", area)
    px, py = F.col("_px"), F.col("_py")
    left = lambda e: (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"]) >= 0

    def close(e):
        ux, uy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * ux + (py - e["y1"]) * uy) / (ux * ux + uy * uy)))
        dx, dy = px - (e["x1"] + t * ux), py - (e["y1"] + t * uy)
        return dx * dx + dy * dy < F.col("_area.buffer_m") * F.col("_area.buffer_m")

    inside = F.forall("_area.edges", left) | F.exists("_area.edges", close)
    return rows.withColumn(name, F.coalesce(inside, F.lit(False))).drop("_px", "_py", "_area")


def area_parts(area: StudyArea) -> tuple[float, float, float, float]:
    """(km2 of area, x, y of its centroid, perimeter m): closed forms over the few vertices.

    The margin adds perimeter·b + π·b²; its strips and sectors shift the centroid by their own first moments.
    """
    xy, b = area.ring_xy, area.buffer_m
    n = len(xy)
    ox, oy = xy[0]
    pts = [(x - ox, y - oy) for x, y in xy]
    total = mx = my = per = 0.0
    turns = []
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        c = x1 * y2 - x2 * y1
        total += c / 2
        mx += (x1 + x2) * c / 6
        my += (y1 + y2) * c / 6
        length = math.hypot(x2 - x1, y2 - y1)
        if length and b:
            nx, ny = (y2 - y1) / length, -(x2 - x1) / length
            strip = length * b
            mx += strip * ((x1 + x2) / 2 + nx * b / 2)
            my += strip * ((y1 + y2) / 2 + ny * b / 2)
            total += strip
        per += length
        turns.append(math.atan2(y2 - y1, x2 - x1))
    if b:
        for i, (x, y) in enumerate(pts):
            a0 = turns[i - 1] - math.pi / 2
            sweep = (turns[i] - turns[i - 1]) % (2 * math.pi) if n > 1 else 2 * math.pi
            sector = sweep * b * b / 2
            mx += x * sector + b ** 3 / 3 * (math.sin(a0 + sweep) - math.sin(a0))
            my += y * sector - b ** 3 / 3 * (math.cos(a0 + sweep) - math.cos(a0))
            total += sector
    return total / 1e6, ox + mx / total, oy + my / total, per


def area_km2(area: StudyArea) -> float:
    return area_parts(area)[0]


def area_centroid(area: StudyArea, p: Params = DEFAULT) -> tuple[float, float]:
    """(lat, lon) of the centroid computed in metres."""
    from pyspark.sql import SparkSession

    _, x, y, _ = area_parts(area)
    la, lo = unproject_xy(F.lit(x), F.lit(y), p)
    row = SparkSession.active().range(1).select(la.alias("lat"), lo.alias("lon")).first()
    return row.lat, row.lon


def area_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"),
                      F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"))


def area_rows(spark, area: StudyArea) -> DataFrame:
    """The ring as a table (vertex, lon, lat)."""
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(area.ring)],
                                 "vertex int, lon double, lat double")


def area_variants(origins: DataFrame, ks=(None, 1, 2, 3), p: Params = DEFAULT) -> DataFrame:
    """Cells and km2 for the hull of all cells and of the main component at several contiguity radii."""
    cells = materialize(origins, "origins")
    parts = []
    for k in ks:
        main = cells.select("cell").distinct() if k is None else largest_component(cells.select("cell"), k)
        area = make_area(convex_hull(cells.join(main, "cell", "left_semi")), p.buffer_m, p)
        name = "all cells" if k is None else f"component k={k}"
        parts.append(main.agg(F.count(F.lit(1)).alias("cells")).select(
            F.lit(name).alias("variant"), "cells", F.lit(round(area_km2(area), 1)).alias("area_km2")))
    return union_all(parts)
