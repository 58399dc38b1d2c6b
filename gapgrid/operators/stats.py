"""Concentration, rank association and spatial autocorrelation."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions.ordering import average_ranks, hash_rank, running, union_all
from gapgrid.params import DEFAULT, NO_NEIGHBOURS, NOT_SIGNIFICANT, Params
from gapgrid.session import materialize


# ---- concentration ---------------------------------------------------------

def _cumulative(df: DataFrame, value: str) -> DataFrame:
    """Distinct values in order with frequency and running count and sum; ties are one row."""
    freq = (df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("f")).withColumn("s", F.col("v") * F.col("f")))
    return running(freq, ["v"], sums={"cf": "f", "cs": "s"})


def gini(df: DataFrame, value: str) -> DataFrame:
    """Gini coefficient: 0 for an even split (and for an empty or zero total)."""
    c = _cumulative(df, value)
    # sum of the running totals of f equal values: f·(total before) + v·f·(f+1)/2
    inner = F.sum(F.col("f") * (F.col("cs") - F.col("s")) + F.col("v") * F.col("f") * (F.col("f") + 1) / 2)
    n, t = F.sum("f"), F.sum("s")
    return c.agg(F.when(F.coalesce(t, F.lit(0.0)) == 0, 0.0).otherwise(
        (n + 1 - 2 * F.try_divide(inner, t)) / n).alias("gini"))


def lorenz_curve(df: DataFrame, value: str, key: str) -> DataFrame:
    """(zone_share, value_share) for every row in ascending order; ties by key."""
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t"))
    pts = running(rows, ["v", key], row_number="i", sums={"c": "v"})
    return pts.select(key, (F.col("i") / total.select("n").scalar()).alias("zone_share"),
                      F.try_divide(F.col("c"), total.select("t").scalar()).alias("value_share"))


def top_share(df: DataFrame, value: str, k: int) -> DataFrame:
    """Share (%) of the ``k`` largest values."""
    top = df.select(F.col(value).alias("v")).orderBy(F.desc("v")).limit(k).agg(F.sum("v").alias("s")).scalar()
    return df.agg((F.try_divide(top, F.sum(value)) * 100).alias("pct_top"))


def target_summary(zones: DataFrame, value: str = "query_count") -> DataFrame:
    """Zones, share of zeros, Gini, share of the ten largest and population variance over mean."""
    v = F.col(value)
    g = gini(zones, value).scalar()
    top = zones.select(v.alias("v")).orderBy(F.desc("v")).limit(10).agg(F.sum("v").alias("s")).scalar()
    return zones.agg(F.count(F.lit(1)).alias("zones"), F.round(F.avg((v == 0).cast("int")) * 100, 2).alias("pct_zero"),
                     F.round(g, 3).alias("gini"), F.round(F.try_divide(top, F.sum(v)) * 100, 1).alias("pct_top10"),
                     F.round(F.try_divide(F.var_pop(v), F.avg(v)), 3).alias("variance_over_mean"))


# ---- rank association ------------------------------------------------------

def _weighted_corr(x: str, y: str, n: str) -> Column:
    """Pearson correlation of weighted rows, centred with the known mean rank to keep the sums small."""
    w, a, b = F.col(n), F.col(x), F.col(y)
    sw = F.sum(w)
    cov = F.sum(w * a * b) - F.sum(w * a) * F.sum(w * b) / sw
    va = F.sum(w * a * a) - F.pow(F.sum(w * a), 2.0) / sw
    vb = F.sum(w * b * b) - F.pow(F.sum(w * b), 2.0) / sw
    return F.try_divide(cov, F.sqrt(va * vb))


def _ranked_values(combos: DataFrame, value: str, rank: str, by: list[str]) -> DataFrame:
    """Centred average rank of every distinct value, within ``by``.

    Doubled ranks (2·rank − N − 1) are whole numbers, so the sums that follow do not depend on their order.
    """
    freq = combos.groupBy(*by, value).agg(F.sum("n").alias("freq"))
    cum = running(freq, [*by, value], sums={"_cum": "freq"})
    size = cum.agg(F.sum("freq").alias("total")) if not by else cum.groupBy(*by).agg(
        F.sum("freq").alias("total"), F.min(F.col("_cum") - F.col("freq")).alias("start"))
    twice = 2 * F.col("_cum") - (F.col("freq") - 1)
    if not by:
        return cum.select(value, (twice - size.scalar() - 1).cast("double").alias(rank))
    return cum.join(size, by).select(*by, value, (twice - 2 * F.col("start") - F.col("total") - 1).cast("double").alias(rank))


def _with_ranks(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct value combinations with their frequency ``n`` and one centred rank per column.

    Combinations are counted before ranking, so repeated values cost one row.
    """
    by = by or []
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    combos = materialize(rows.groupBy(*by, *cols).agg(F.count(F.lit(1)).alias("n")), "combos")
    out = combos
    for c in cols:
        out = out.join(_ranked_values(combos, c, f"r_{c}", by), [*by, c])
    return out


def rank_average(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, rank) with tied values sharing the mean of their positions."""
    return df.select(key, value).join(average_ranks(df, value).select(value, "rank"), value)


def spearman_by(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation inside every group; null when a side is constant."""
    return _with_ranks(df, [x, y], by).groupBy(*by).agg(_weighted_corr(f"r_{x}", f"r_{y}", "n").alias("spearman"))


def spearman_matrix(df: DataFrame, cols: list[str], digits: int | None = 3) -> DataFrame:
    """Rank correlation of every pair (a, b) of columns, each column ranked once."""
    ranked = _with_ranks(df, cols)
    pairs = list(combinations_with_replacement(cols, 2))
    one = ranked.agg(*[_weighted_corr(f"r_{a}", f"r_{b}", "n").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    both = [(i, a, b) for i, (a, b) in enumerate(pairs)] + [(i, b, a) for i, (a, b) in enumerate(pairs) if a != b]
    rho = (lambda i: F.round(F.col(f"c{i}"), digits)) if digits is not None else (lambda i: F.col(f"c{i}"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(i).alias("spearman"))
                                         for i, a, b in both])))


def spearman(df: DataFrame, x: str, y: str, digits: int | None = None) -> DataFrame:
    rho = _weighted_corr(f"r_{x}", f"r_{y}", "n")
    return _with_ranks(df, [x, y]).agg((F.round(rho, digits) if digits is not None else rho).alias("spearman"))


def associations(df: DataFrame, variables: list[str], targets: list[str], digits: int = 3) -> DataFrame:
    """(variable, target, spearman) for each combination."""
    m = spearman_matrix(df, list(dict.fromkeys([*variables, *targets])), digits)
    return (m.where(F.col("a").isin(variables) & F.col("b").isin(targets))
            .select(F.col("a").alias("variable"), F.col("b").alias("target"), "spearman"))


def cliffs_delta(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """P(a > b) − P(a < b) through rank sums: 2U/(m·n) − 1 instead of the m×n comparison."""
    two = df.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("v")).agg(
        F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    two = two.withColumn("n", F.col("na") + F.col("nb"))
    r = _ranked_values(two, "v", "rank", [])
    m, n = F.sum("na"), F.sum("nb")
    # centred doubled ranks c = 2·rank − (m + n) − 1 give 2U/(m·n) − 1 = Σ c / (m·n)
    return two.join(r, "v").agg(F.try_divide(F.sum(F.col("rank") * F.col("na")), m * n).alias("delta"))


# ---- spatial autocorrelation -----------------------------------------------

def hex_weights(cells: DataFrame, k: int = 1, ring: bool = False) -> DataFrame:
    """(src, dst, w) row-standardised neighbour weights; cells without neighbours have no rows."""
    pairs = grid.neighbour_join(cells.select("cell"), cells.select("cell"), k, k if ring else 1)
    deg = pairs.groupBy("src").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return pairs.join(deg, "src").select("src", "dst", "w")


def _ring_weights(cells: DataFrame, k_max: int) -> DataFrame:
    """Row-standardised weights for each exact ring 1..k_max from one neighbour join."""
    pairs = grid.neighbour_join(cells.select("cell"), cells.select("cell"), k_max)
    deg = pairs.groupBy("src", "ring").agg((F.lit(1.0) / F.count(F.lit(1))).alias("w"))
    return pairs.join(deg, ["src", "ring"]).select("src", "dst", "ring", "w")


def _centred(df: DataFrame, value: str) -> DataFrame:
    mean = df.agg(F.avg(value).alias("m")).scalar()
    return df.select("cell", (F.col(value) - mean).alias("z"))


def moran_rings(df: DataFrame, value: str, k_max: int) -> DataFrame:
    """(ring, I) for every exact ring; S0 is the number of cells that have a neighbour at that ring."""
    z = materialize(_centred(df, value), "z")
    w = _ring_weights(z, k_max)
    num = (w.join(z.toDF("src", "zi"), "src").join(z.toDF("dst", "zj"), "dst").groupBy("ring")
           .agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0")))
    tot = z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    return num.select("ring", (tot.select("n").scalar() / F.col("s0") * F.col("num") / tot.select("ss").scalar()).alias("moran_i"))


def moran_i(df: DataFrame, value: str, k: int = 1) -> DataFrame:
    """Global Moran I for the exact ring ``k``."""
    return moran_rings(df, value, k).where(F.col("ring") == k)


def moran_permutations(df: DataFrame, value: str, k_max: int, perms: int, seed) -> DataFrame:
    """(ring, perm, moran_i) under seeded shuffles of the values over the cells.

    Shuffle p gives the cell at position i of its hash order the value of the i-th cell of the table. Both
    orders are sliced, so no task holds a whole shuffle; the ring weights are joined once for all of them.
    """
    z = materialize(running(_centred(df, value), ["cell"], row_number="idx"), "zi")
    draws = z.select("cell").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    order = hash_rank(draws, "cell", F.concat_ws("-", F.lit(str(seed)), F.col("perm").cast("string")), "idx", ["perm"])
    # a cell carries its values under all shuffles as one array: neighbour joins have no row per shuffle
    values = F.transform(F.array_sort(F.collect_list(F.struct("perm", "z"))), lambda v: v["z"])
    shuffled = materialize(order.join(z.select("idx", "z"), "idx").groupBy("cell").agg(values.alias("zs")), "perm")
    w = materialize(_ring_weights(z, k_max), "w")
    zero = F.array_repeat(F.lit(0.0), perms)
    total = F.aggregate(F.collect_list("zj"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))  # a ring has few cells
    lag = w.join(shuffled.toDF("dst", "zj"), "dst").groupBy("src", "ring").agg(total.alias("sums"), F.first("w").alias("w"))
    each = F.posexplode(F.zip_with("sums", "zs", lambda a, b: a * b))
    num = (lag.join(shuffled.toDF("src", "zs"), "src").select("ring", "w", each).groupBy("ring", (F.col("pos") + 1).alias("perm"))
           .agg(F.sum(F.col("w") * F.col("col")).alias("num"), F.count(F.lit(1)).alias("s0")))
    tot = z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("ss"))
    return num.select("ring", "perm", (tot.select("n").scalar() / F.col("s0") * F.col("num") / tot.select("ss").scalar())
                      .alias("moran_i"))


def folded_p(larger: Column, perms: int) -> Column:
    """Pseudo p of ``larger`` shuffles at or above the observed value, folded to the smaller tail."""
    return (F.least(larger, perms - larger) + 1) / F.lit(perms + 1)


def moran_correlogram(df: DataFrame, value: str, k_max: int, perms: int, seed) -> DataFrame:
    """(k, approx_km, moran_i, p_value) for rings 1..k_max."""
    obs = moran_rings(df, value, k_max)
    sim = moran_permutations(df, value, k_max, perms, seed).withColumnRenamed("moran_i", "sim")
    larger = sim.join(F.broadcast(obs), "ring").groupBy("ring").agg(  # one row per ring
        F.count_if(F.round("sim", 9) >= F.round("moran_i", 9)).alias("larger"))
    return obs.join(larger, "ring").select(F.col("ring").alias("k"), F.round(F.col("ring") * 0.92, 2).alias("approx_km"),
                                           F.round("moran_i", 4).alias("moran_i"),
                                           F.round(folded_p(F.col("larger"), perms), 4).alias("p_value"))


def moran_permutation_p(df: DataFrame, value: str, k: int, perms: int, seed) -> DataFrame:
    return moran_correlogram(df, value, k, perms, seed).where(F.col("k") == k).select("k", "moran_i", "p_value")


def local_moran(df: DataFrame, value: str) -> DataFrame:
    """(cell, z, lag, local_i, quadrant, degree) with first-ring neighbours.

    Cells without neighbours are left out of the mean and come back with the no-neighbour label.
    """
    cells = df.select("cell", F.col(value).alias("v"))
    w = hex_weights(cells)
    linked = w.groupBy(F.col("src").alias("cell")).agg(F.count(F.lit(1)).alias("degree"))
    inner = cells.join(linked, "cell")
    st = inner.agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("s2"))
    m, n, s2 = (st.select(c).scalar() for c in ("m", "n", "s2"))
    z = inner.select("cell", "degree", (F.col("v") - m).alias("z"))
    lag = (w.join(z.select(F.col("cell").alias("dst"), "z"), "dst").groupBy(F.col("src").alias("cell"))
           .agg(F.sum(F.col("w") * F.col("z")).alias("lag")))
    hi, lag_hi = F.col("z") > 0, F.col("lag") > 0
    quad = (F.when(hi & lag_hi, "HH").when(~hi & lag_hi, "LH").when(~hi & ~lag_hi, "LL").otherwise("HL"))
    scale = (n - 1) / (n * s2)
    full = z.join(lag, "cell").select("cell", "degree", "z", "lag", (F.col("z") * F.col("lag") * scale).alias("local_i"),
                                      quad.alias("quadrant"))
    return cells.select("cell").join(full, "cell", "left").withColumn("quadrant", F.coalesce("quadrant", F.lit(NO_NEIGHBOURS)))


def _distinct_draws(n: Column, count: Column, h) -> Column:
    """``count`` different numbers in [0, n) from whole numbers ``h(i)``: each draw skips the earlier ones in order."""
    def add(done: Column, i: Column) -> Column:
        first = F.pmod(h(i), n - i)
        lifted = F.aggregate(F.array_sort(done), first, lambda acc, e: acc + (acc >= e).cast("bigint"))
        return F.concat(done, F.array(lifted))

    start = F.expr("cast(array() as array<bigint>)")
    return F.aggregate(F.sequence(F.lit(0), count.cast("int") - 1), start, add)


VALUES_PER_RANGE = 1 << 18  # values that meet the draws of a cell at once (2 MB)


def lisa_clusters(df: DataFrame, value: str, perms: int, seed, alpha: float = 0.05) -> DataFrame:
    """(cell, quadrant, p_value, cluster): local Moran with conditional shuffles.

    For every cell and shuffle, as many other cells as it has neighbours are drawn without repetition by position. Values stand in ranges of
    positions, one array each; a cell sends every range the positions that it drew there, for all shuffles in one row, and gets their sums
    back as one array over the shuffles. So there is one row per cell and range, not one per draw.
    """
    base = materialize(local_moran(df, value), "lisa")
    inner = materialize(running(base.where(F.col("degree").isNotNull()).select("cell", "degree", "z", "lag"), ["cell"],
                                row_number="idx"), "lisa-idx")
    others = inner.agg((F.count(F.lit(1)) - 1).alias("n")).scalar()
    size = F.lit(VALUES_PER_RANGE)

    def digits(perm: Column):
        """Twelve md5 digits as a number: a draw that any engine can reproduce."""
        return lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", "cell", perm, i, F.lit(str(seed)))), 1, 12), 16, 10).cast("bigint")

    def drawn(perm: Column) -> Column:
        """Positions from 0 on, the cell's own left out."""
        return F.transform(_distinct_draws(F.col("others"), F.col("degree"), digits(perm)), lambda d: d + (d + 1 >= F.col("idx")).cast("bigint"))

    draws = inner.withColumn("others", others).withColumn("picks", F.transform(F.sequence(F.lit(1), F.lit(perms)), drawn))
    of = lambda x: F.floor(x / size)
    touched = F.array_distinct(F.flatten(F.transform("picks", lambda p: F.transform(p, of))))
    sent = draws.select("cell", "picks", F.explode(touched).alias("range"))
    sent = sent.select("cell", "range", F.transform("picks", lambda p: F.filter(p, lambda x: of(x) == F.col("range"))).alias("here"))
    values = inner.groupBy(of(F.col("idx") - 1).alias("range")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "z"))), lambda v: v["z"]).alias("values"))
    add = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + F.get("values", F.pmod(x, size).cast("int")))
    parts = sent.join(values, "range").select("cell", F.transform("here", add).alias("part"))
    whole = F.aggregate(F.collect_list("part"), F.array_repeat(F.lit(0.0), perms), lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
    sums = parts.groupBy("cell").agg(whole.alias("sums"))
    # nine digits: sums of equal values in another order are equal
    seen = F.size(F.filter("sums", lambda s: F.round(F.col("z") * s / F.col("degree"), 9) >= F.round(F.col("z") * F.col("lag"), 9)))
    p = inner.join(sums, "cell").select("cell", folded_p(seen, perms).alias("p_value"))
    sig = F.when(F.col("degree").isNull(), NO_NEIGHBOURS).when(F.col("p_value") < alpha, F.col("quadrant")).otherwise(NOT_SIGNIFICANT)
    return base.join(p, "cell", "left").select("cell", "quadrant", "p_value", sig.alias("cluster"))


def centre_comparison(zones: DataFrame, centroid: tuple[float, float], target: str, p: Params = DEFAULT) -> DataFrame:
    """Association of the target with the distance to the reference point and to the centroid of the area."""
    from gapgrid.functions.scalars import haversine_km

    d = zones.select(F.col(target), F.round(haversine_km("lat", "lon", p.centre_lat, p.centre_lon), 6).alias("dist_centre_km"),
                     F.round(haversine_km("lat", "lon", *centroid), 6).alias("dist_centroid_km"))
    return associations(d, ["dist_centre_km", "dist_centroid_km"], [target])
