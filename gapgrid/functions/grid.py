"""Planar hexagonal grid on local metres.

A cell is one BIGINT: resolution, then axial q, then axial r, each axis shifted to be positive. Neighbours
are therefore plain additions, equality joins hash one long, and the numeric order is the (q, r) order.
The grid is planar around ``Params.centre``: right for a metropolitan area or one map zone, not for the globe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.params import DEFAULT, Params

HALF = 1 << 20
STEP_Q = 1 << 21
STEP_RES = 1 << 42
SQRT3 = math.sqrt(3.0)


def metres_per_degree(p: Params = DEFAULT) -> tuple[float, float]:
    """(east, north) metres per degree at the grid origin."""
    north = math.radians(1.0) * 6_371_000.0
    return north * math.cos(math.radians(p.centre_lat)), north


def edge_of(res: int, p: Params = DEFAULT) -> float:
    return p.edge_m if res == p.zone_res else p.edge_m * p.block_factor


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(q: Column, r: Column, res: int) -> Column:
    return (F.lit(res * STEP_RES) + (q.cast("bigint") + HALF) * STEP_Q + (r.cast("bigint") + HALF)).cast("bigint")


def cell_res(cell="cell") -> Column:
    return F.shiftright(_c(cell), 42).cast("int")


def cell_q(cell="cell") -> Column:
    return F.shiftright(_c(cell), 21).bitwiseAND(F.lit(STEP_Q - 1)) - HALF


def cell_r(cell="cell") -> Column:
    return _c(cell).bitwiseAND(F.lit(STEP_Q - 1)) - HALF


def _cell_of_metres(x: Column, y: Column, res: int, p: Params) -> Column:
    """Cell of local metres from the three hexagon axes.

    With u = X + Y, v = Y − X, w = 2X the unit steps a, b, c below fix the hexagon: r = ⌊(a + b) / 3⌋ and
    q + r = ⌊(a + c) / 3⌋. Unlike rounding cube coordinates this repeats each input only a few times, which
    keeps the expression small wherever the optimizer copies it.
    """
    edge = edge_of(res, p)
    sx, sy = x / (SQRT3 * edge), y / edge
    a, b, c = F.floor(sx + sy + 1), F.floor(sy - sx + 1), F.floor(sx * 2 + 1)
    r, qr = F.floor((a + b) / 3), F.floor((a + c) / 3)
    return (qr * STEP_Q - r * (STEP_Q - 1) + (res * STEP_RES + HALF * STEP_Q + HALF)).cast("bigint")


def point_to_cell(lat, lon, res: int | None = None, p: Params = DEFAULT) -> Column:
    """Cell that holds a point; null coordinates give null."""
    kx, ky = metres_per_degree(p)
    x, y = (_c(lon) - p.centre_lon) * kx, (_c(lat) - p.centre_lat) * ky
    return _cell_of_metres(x, y, res or p.zone_res, p)


def add_cell(df: DataFrame, lat: str, lon: str, name: str, res: int | None = None, p: Params = DEFAULT) -> DataFrame:
    return df.withColumn(name, point_to_cell(lat, lon, res, p))


def centre_xy(cell="cell", res: int | None = None, p: Params = DEFAULT) -> tuple[Column, Column]:
    edge = edge_of(res or p.zone_res, p)
    q, r = cell_q(cell), cell_r(cell)
    return (q + r / 2) * (SQRT3 * edge), r * (1.5 * edge)


def cell_lat(cell="cell", res: int | None = None, p: Params = DEFAULT) -> Column:
    return F.lit(p.centre_lat) + centre_xy(cell, res, p)[1] / metres_per_degree(p)[1]


def cell_lon(cell="cell", res: int | None = None, p: Params = DEFAULT) -> Column:
    return F.lit(p.centre_lon) + centre_xy(cell, res, p)[0] / metres_per_degree(p)[0]


def cell_ring(cell="cell", res: int | None = None, p: Params = DEFAULT) -> Column:
    """Closed ring of the cell as ``array<struct<lon,lat>>`` (seven points, the first repeated)."""
    edge = edge_of(res or p.zone_res, p)
    kx, ky = metres_per_degree(p)
    x, y = centre_xy(cell, res, p)

    def vertex(i: Column) -> Column:
        a = F.radians(i * 60.0 - 30.0)
        return F.struct((F.lit(p.centre_lon) + (x + edge * F.cos(a)) / kx).alias("lon"),
                        (F.lit(p.centre_lat) + (y + edge * F.sin(a)) / ky).alias("lat"))

    return F.transform(F.array(*[F.lit(i % 6).cast("double") for i in range(7)]), vertex)


def _coord_text(v: Column, sep: str) -> Column:
    return F.concat(F.format_string("%.6f", v["lon"]), F.lit(sep), F.format_string("%.6f", v["lat"]))


def cell_wkt(cell="cell", res: int | None = None, p: Params = DEFAULT) -> Column:
    pts = F.transform(cell_ring(cell, res, p), lambda v: _coord_text(v, " "))
    return F.concat(F.lit("POLYGON (("), F.array_join(pts, ", "), F.lit("))"))


def cell_geojson(cell="cell", res: int | None = None, p: Params = DEFAULT) -> Column:
    pts = F.transform(cell_ring(cell, res, p), lambda v: F.concat(F.lit("["), _coord_text(v, ","), F.lit("]")))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(pts, ","), F.lit("]]}"))


def grid_distance(a, b) -> Column:
    """Rings between two cells of one resolution."""
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return F.expr("0").cast("bigint") + F.shiftright(F.abs(dq) + F.abs(dr) + F.abs(dq + dr), 1)


def disk(cell="cell", k: int = 1, k_min: int = 0) -> Column:
    """``array<struct<ring,dst>>`` of the cells between ring ``k_min`` and ring ``k``."""
    base = _c(cell)
    lo, hi = F.lit(-k), F.lit(k)

    def row(dq: Column) -> Column:
        span = F.sequence(F.greatest(lo, -dq - k), F.least(hi, -dq + k))
        return F.transform(span, lambda dr: F.struct(
            F.shiftright(F.abs(dq) + F.abs(dr) + F.abs(dq + dr), 1).cast("int").alias("ring"),
            (base + dq.cast("bigint") * STEP_Q + dr).alias("dst")))

    cells = F.flatten(F.transform(F.sequence(lo, hi), row))
    return F.filter(cells, lambda c: c["ring"] >= k_min) if k_min else cells


def ring(cell="cell", k: int = 1) -> Column:
    return disk(cell, k, k)


def cell_parent(cell="cell", p: Params = DEFAULT) -> Column:
    """Coarse block that holds the centre of the zone.

    Block centres are every ``block_factor``-th zone, so many zone centres lie exactly on a block border. Whole
    number cube rounding decides those the same way everywhere.
    """
    n = p.block_factor
    q, r = cell_q(cell), cell_r(cell)
    axes = (q, r, -q - r)
    near = [F.floor((2 * v + n) / (2 * n)) for v in axes]
    dq, dr, ds = (F.abs(n * k - v) for k, v in zip(near, axes))
    lead_q, lead_r = (dq > dr) & (dq > ds), dr > ds
    bq = F.when(lead_q, -near[1] - near[2]).otherwise(near[0])
    br = F.when(lead_q | ~lead_r, near[1]).otherwise(-near[0] - near[2])
    return pack(bq, br, p.block_res)


def wrong_resolution(cell="cell", res: int = DEFAULT.zone_res) -> Column:
    return cell_res(cell) != res


def neighbour_pairs(cells: DataFrame, k: int, k_min: int = 1, cell: str = "cell") -> DataFrame:
    """(src, ring, dst) for every cell of the input and every grid cell around it, present or not."""
    return (cells.select(F.col(cell).alias("src")).select("src", F.inline(disk("src", k, k_min)))
            .select("src", "ring", "dst"))


def neighbour_join(cells: DataFrame, table: DataFrame, k: int, k_min: int = 1, cell: str = "cell",
                   table_cell: str = "cell") -> DataFrame:
    """Each cell with its neighbours that exist in ``table`` (a distance join made an equality join)."""
    return neighbour_pairs(cells, k, k_min, cell).join(table.withColumnRenamed(table_cell, "dst"), "dst")
