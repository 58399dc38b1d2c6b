"""Transit polylines and exact nearest-network distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions.ordering import quantiles, running, union_all
from gapgrid.functions.projection import project_xy
from gapgrid.params import DEFAULT, Params
from gapgrid.session import materialize


SLICE = 4096  # vertices of a polyline that are summed together


def segments(shapes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Segments of each shape in metres with the arc length before and after (shape_id, seq, lat, lon).

    Vertices are numbered over the whole table, neighbours meet by position, and lengths are summed per shape
    in slices of positions and then over the slices, so a polyline of any size is never whole in one task.
    """
    x, y = project_xy("lat", "lon", p)
    xy = shapes.select("shape_id", "seq", x.alias("x"), y.alias("y"))
    placed = materialize(running(xy, ["shape_id", "seq"], row_number="pos"), "vertices")
    prev = placed.select((F.col("pos") + 1).alias("pos"), "shape_id", F.col("x").alias("x0"), F.col("y").alias("y0"))
    length = F.coalesce(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")), F.lit(0.0))
    seg = placed.join(prev, ["pos", "shape_id"], "left").withColumn("len", length).withColumn("slice", F.floor(F.col("pos") / SLICE))
    w = Window.partitionBy("shape_id", "slice").orderBy("seq")
    seg = seg.withColumn("in_slice", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg = materialize(seg.withColumn("earlier", F.coalesce(F.lag("in_slice").over(w), F.lit(0.0))), "segments")
    # a slice's total is its last running sum, so that a vertex starts exactly where the one before it ends
    prior = Window.partitionBy("shape_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = seg.groupBy("shape_id", "slice").agg(F.max("in_slice").alias("t")).select(
        "shape_id", "slice", F.coalesce(F.sum("t").over(prior), F.lit(0.0)).alias("base"))
    return seg.join(base, ["shape_id", "slice"]).select(
        "shape_id", "seq", "x0", "y0", "x", "y", "len", (F.col("base") + F.col("in_slice")).alias("upto"), (F.col("base") + F.col("earlier")).alias("before"))


def running_length(shapes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return segments(shapes, p).select("shape_id", "seq", F.col("upto").alias("length_m"))


def polyline_length_km(shapes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return segments(shapes, p).groupBy("shape_id").agg((F.sum("len") / 1000).alias("length_km"))


def polyline_rings(shapes: DataFrame) -> DataFrame:
    """Ordered vertices of each shape as an array."""
    pts = F.array_sort(F.collect_list(F.struct("seq", "lon", "lat")))
    return shapes.groupBy("shape_id").agg(F.transform(pts, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat")))
                                          .alias("points"))


def densify_polyline(shapes: DataFrame, step_m: float, p: Params = DEFAULT) -> DataFrame:
    """Points at equal arc length, ``n = max(2, int(L / step))`` per shape, both ends kept.

    Each segment generates the sample numbers that fall into it, so points and segments are never joined.
    A sample on a vertex belongs to the segment that ends there; shapes of one point give nothing.
    """
    seg = materialize(segments(shapes, p), "arc-lengths")
    facts = seg.groupBy("shape_id").agg(F.max("upto").alias("total"), F.count(F.lit(1)).alias("pts"), F.max("seq").alias("last"),
                                        F.min(F.when(F.col("x0").isNotNull(), F.col("seq"))).alias("first"))
    seg = seg.join(facts, "shape_id")
    seg = seg.where((F.col("pts") > 1) & F.col("x0").isNotNull())
    n = F.greatest(F.lit(2), F.floor(F.col("total") / step_m)).cast("int")
    gap = F.col("total") / (n - 1)
    lo = F.when(F.col("seq") == F.col("first"), F.lit(0)).otherwise(F.floor(F.col("before") / gap).cast("int") + 1)
    hi = F.when(F.col("seq") == F.col("last"), n - 1).otherwise(F.floor(F.col("upto") / gap).cast("int"))
    ids = F.when((lo <= hi) & (F.col("total") > 0), F.sequence(lo, hi))
    dup = F.when((F.col("total") == 0) & (F.col("seq") == F.col("first")), F.sequence(F.lit(0), F.lit(1)))
    out = seg.withColumn("gap", gap).select("shape_id", "before", "len", "x0", "y0", "x", "y", "gap",
                                            F.explode(F.coalesce(ids, dup)).alias("i"))
    t = F.when(F.col("len") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") * F.col("gap") - F.col("before"))
                                                                 / F.col("len")))).otherwise(0.0)
    return out.select("shape_id", "i", (F.col("x0") + t * (F.col("x") - F.col("x0"))).alias("x"),
                      (F.col("y0") + t * (F.col("y") - F.col("y0"))).alias("y"))


# ---- nearest distance ------------------------------------------------------

BASE_M, FACTOR = 25.0, 8  # leaf boxes of 25 m, sides growing by 8 per level


def _boxes(df: DataFrame, x0: int, y0: int, top: int) -> DataFrame:
    """(level, bx, by, x1, x2, y1, y2): the boxes of every level that hold points of ``df``, with the extent of these points; built once."""
    leaf = [(F.floor(F.col(c) / BASE_M) - o).cast("bigint").alias(n) for c, o, n in (("x", x0, "lx"), ("y", y0, "ly"))]
    rows = df.select("x", "y", *leaf).groupBy("lx", "ly").agg(*[f(c).alias(n) for c, f, n in (("x", F.min, "x1"), ("x", F.max, "x2"), ("y", F.min, "y1"), ("y", F.max, "y2"))])
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("side", F.pow(F.lit(float(FACTOR)), "level").cast("bigint"))
    up = [F.expr(f"{c} div side").alias(n) for c, n in (("lx", "bx"), ("ly", "by"))]
    rows = rows.select("level", *up, "x1", "x2", "y1", "y2").groupBy("level", "bx", "by")
    return materialize(rows.agg(*[f(c).alias(c) for f, c in ((F.min, "x1"), (F.max, "x2"), (F.min, "y1"), (F.max, "y2"))]), "boxes")


def _span(*sides: DataFrame) -> tuple[int, int, int]:
    """Lowest leaf numbers and the number of levels after which one box covers all sides."""
    found = [df.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first() for df in sides]
    cells = [[int(math.floor(v / BASE_M)) for v in r] for r in found if r[0] is not None]
    x0, y0 = (min(c[k] for c in cells) for k in (0, 1)) if cells else (0, 0)
    span = max([max(c[2] - x0, c[3] - y0) + 1 for c in cells], default=1)
    top = 0
    while FACTOR ** top < span:
        top += 1
    return x0, y0, top


def nearest_distance(points: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, distance) from each point (key, x, y) to the nearest target (x, y); exact at any distance.

    Both sides are described once by nested boxes with the extents of what they hold. From the one root box down, each point box keeps only
    the target boxes that can still hold its nearest target: those whose extent is not farther than the best guaranteed distance. What is
    left of a level is written, and the next one starts from there. Only boxes, whose number per level is set by the ground they cover, are
    paired; equal points and equal targets are merged first, and real points meet targets only inside the few leaf boxes that are left.
    """
    pts = materialize(points.select("x", "y").distinct(), "points")
    tgt = materialize(targets.select("x", "y").distinct(), "targets")
    x0, y0, top = _span(pts, tgt)
    pbox, tbox = _boxes(pts, x0, y0, top), _boxes(tgt, x0, y0, top)

    def at(boxes: DataFrame, level: int, side: str) -> DataFrame:
        names = ["bx", "by", "x1", "x2", "y1", "y2"]
        up = [F.expr(f"{c} div {FACTOR}").alias(f"{side}_u{c}") for c in ("bx", "by")]
        return boxes.where(F.col("level") == level).select(*[F.col(c).alias(f"{side}_{c}") for c in names], *up)

    def kept(pairs: DataFrame) -> DataFrame:
        gap = [F.greatest(F.col(f"t_{c}1") - F.col(f"p_{c}2"), F.col(f"p_{c}1") - F.col(f"t_{c}2"), F.lit(0.0)) for c in "xy"]
        reach = [F.greatest(F.col(f"t_{c}2") - F.col(f"p_{c}1"), F.col(f"p_{c}2") - F.col(f"t_{c}1")) for c in "xy"]
        bound = Window.partitionBy("p_bx", "p_by")  # surviving boxes only: bounded by geometry
        pairs = pairs.withColumn("near", F.hypot(*gap)).withColumn("far", F.hypot(*reach)).withColumn("best", F.min("far").over(bound))
        # a hair of room: extents and points are rounded apart
        return pairs.where("near <= best * (1 + 1e-12)").select("p_bx", "p_by", "t_bx", "t_by", "t_x1", "t_x2", "t_y1", "t_y2", "far")

    roots = [at(b, top, side) for b, side in ((pbox, "p"), (tbox, "t"))]  # one box on either side
    frontier = kept(roots[0].join(roots[1], (F.col("p_bx") == F.col("t_bx")) & (F.col("p_by") == F.col("t_by"))))
    for level in range(top - 1, -1, -1):
        parents = frontier.select(*[F.col(f"{s}_{c}").alias(f"{s}_u{c}") for s in "pt" for c in ("bx", "by")])
        pairs = parents.join(at(pbox, level, "p"), ["p_ubx", "p_uby"]).join(at(tbox, level, "t"), ["t_ubx", "t_uby"])
        frontier = materialize(kept(pairs), "frontier")
    leaf = frontier.select("p_bx", "p_by", F.struct("far", "t_bx", "t_by").alias("f"), "t_bx", "t_by", "t_x1", "t_x2", "t_y1", "t_y2")
    boxed = lambda df, side: df.select("x", "y", *[(F.floor(F.col(c) / BASE_M) - o).cast("bigint").alias(f"{side}_b{c}") for c, o in (("x", x0), ("y", y0))])
    # the most promising box of each point box gives every point a true bound; then only boxes that come
    # closer than the bound to the point itself are opened
    first = leaf.groupBy("p_bx", "p_by").agg(F.min("f").alias("m")).select("p_bx", "p_by", "m.t_bx", "m.t_by")
    t = boxed(tgt, "t").withColumnsRenamed({"x": "x_", "y": "y_"})
    dist = F.hypot(F.col("x") - F.col("x_"), F.col("y") - F.col("y_"))
    bound = boxed(pts, "p").join(first, ["p_bx", "p_by"]).join(t, ["t_bx", "t_by"]).groupBy("x", "y", "p_bx", "p_by").agg(F.min(dist).alias("u"))
    bound = materialize(bound, "bound")
    apart = [F.greatest(F.col(f"t_{c}1") - F.col(c), F.col(c) - F.col(f"t_{c}2"), F.lit(0.0)) for c in "xy"]
    closer = bound.join(leaf, ["p_bx", "p_by"]).where(F.hypot(*apart) < F.col("u")).select("x", "y", "t_bx", "t_by")
    better = closer.join(t, ["t_bx", "t_by"]).groupBy("x", "y").agg(F.min(dist).alias("d"))
    best = bound.join(better, ["x", "y"], "left").select("x", "y", F.least("u", "d").alias("distance"))
    return points.select(key, "x", "y").join(best, ["x", "y"], "left").select(key, "distance")


def distinct_shapes(shapes: DataFrame) -> DataFrame:
    """The shapes (shape_id, seq, lat, lon) without copies: of those with the same vertices in the same places, the smallest ``shape_id``.

    A shape is told by its number of vertices and by sums over two 64-bit hashes of each (halves, so that sums don't overflow): one small row per
    shape whatever its length. Only the shapes that stay are read again.
    """
    parts = [h for k in (1, 2) for h in _halves(F.xxhash64("seq", "lat", "lon", F.lit(k)))]
    rows = shapes.select("shape_id", *[h.alias(f"h{i}") for i, h in enumerate(parts)])
    told = [f"h{i}" for i in range(len(parts))]
    facts = rows.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in told])
    kept = materialize(facts.groupBy("n", *told).agg(F.min("shape_id").alias("shape_id")).select("shape_id"), "distinct-shapes")
    return shapes.join(kept, "shape_id", "left_semi")


def _halves(h: Column) -> list[Column]:
    return [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]


def network_points(shapes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Distinct sampled points of the network; shapes that share a street share them, and copies of a shape are sampled once."""
    return densify_polyline(distinct_shapes(shapes), p.network_step_m, p).select("x", "y").distinct()


def share_near_network(origins: DataFrame, targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Share of origins (lat, lon, n) within the coverage distance; equal origins are looked up once.

    Origins look into the nine boxes of the coverage distance around them: one equality join, which stops at the first hit.
    """
    side = p.coverage_m
    x, y = project_xy("lat", "lon", p)
    box = lambda c: F.floor(F.col(c) / side).cast("bigint")
    uniq = materialize(origins.groupBy("lat", "lon").agg(F.sum("n").alias("n")).select("lat", "lon", "n", x.alias("x"), y.alias("y")), "origins")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    seek = uniq.select("lat", "lon", "x", "y", F.explode(around).alias("o")).withColumn("bx", box("x") + F.col("o.a")).withColumn("by", box("y") + F.col("o.b"))
    t = targets.select(F.col("x").alias("tx"), F.col("y").alias("ty"), box("x").alias("bx2"), box("y").alias("by2"))
    hit = seek.join(t, (F.col("bx") == F.col("bx2")) & (F.col("by") == F.col("by2")) & (F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")) <= side), "left_semi")
    near = uniq.join(hit.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi").agg(F.sum("n").alias("n")).scalar()
    return uniq.agg((F.coalesce(near, F.lit(0)) / F.sum("n") * 100).alias("pct_near"))


def feed_summary(tables: dict[str, DataFrame], p: Params = DEFAULT) -> DataFrame:
    """Rows of each feed table and the length and headway measures of the network."""
    parts = [df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(f"rows_{name}").alias("measure"), "value")
             for name, df in sorted(tables.items())]
    km = polyline_length_km(tables["shapes"], p)
    km = materialize(km, "lengths")
    median = quantiles(km, "length_km", {"m": 0.5}).scalar()
    one = km.agg(F.count(F.lit(1)).cast("double").alias("shapes"), F.round(F.sum("length_km"), 1).alias("shapes_total_km")).select(
        "shapes", F.round(median, 2).alias("shape_median_km"), "shapes_total_km")
    parts.append(one.unpivot([], ["shapes", "shape_median_km", "shapes_total_km"], "measure", "value"))
    if "frequencies" in tables:
        head = F.col("headway_secs").cast("double") / 60
        parts.append(quantiles(tables["frequencies"].select(head.alias("h")), "h", {"m": 0.5})
                     .select(F.lit("headway_median_min").alias("measure"), F.round("m", 1).alias("value")))
    return union_all(parts)
