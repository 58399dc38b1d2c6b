"""The zone table and its features: exposure, neighbourhood population, labels, rings and hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions import scalars as S
from gapgrid.functions.ordering import hash_rank, quantiles
from gapgrid.operators.geometry import StudyArea, within_area
from gapgrid.functions.projection import project_xy
from gapgrid.operators.network import nearest_distance
from gapgrid.params import DEFAULT, UNKNOWN_LABEL, Params
from gapgrid.session import materialize

# Columns of the modelling table.
MODEL_COLUMNS = ["cell", "query_count", "user_count", "query_count_before_gap", "query_count_after_gap", "population",
                 "pop_ring1", "pop_ring2", "dist_centre_km", "dist_network_m", "covered", "municipality",
                 "distance_ring", "block_id", "in_model", "in_test", "lat", "lon"]


# ---- zone table ------------------------------------------------------------

def zone_counts(clean: DataFrame) -> DataFrame:
    """Queries and distinct users per zone; a missing user counts as one more user."""
    return (clean.groupBy("cell", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("cell")
            .agg(F.sum("n").alias("query_count"), F.count(F.lit(1)).alias("user_count")))


def join_left_fill(left: DataFrame, right: DataFrame, key: str, fill: dict) -> DataFrame:
    return left.join(right, key, "left").fillna(fill)


def zone_table(clean: DataFrame, population: DataFrame, area: StudyArea, p: Params = DEFAULT) -> DataFrame:
    """Populated cells with their centre in the area, united with the cells that have queries.

    Populated zones without queries keep 0, zones with queries but no population record get 0 people.
    """
    inside = population.where(within_area(area, grid.cell_lat("cell", p=p), grid.cell_lon("cell", p=p), p)).select("cell")
    zones = inside.join(zone_counts(clean), "cell", "full").join(population, "cell", "left")
    return zones.select("cell", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                  for c in ("query_count", "user_count", "population")])


def period_counts(clean: DataFrame, start, end) -> DataFrame:
    day = S.day_of("ts")
    return clean.groupBy("cell").agg(F.count_if(day < F.lit(start)).alias("query_count_before_gap"),
                                     F.count_if(day >= F.lit(end)).alias("query_count_after_gap"))


def zone_counters(zones: DataFrame, p: Params = DEFAULT) -> DataFrame:
    q, pop = F.col("query_count"), F.col("population")
    return zones.agg(F.count(F.lit(1)).alias("zones"), F.count_if(q > 0).alias("with_queries"),
                     F.count_if((pop > 0) & (q == 0)).alias("populated_without_queries"),
                     F.count_if(pop >= p.pop_min).alias("above_minimum"), F.sum(pop).alias("population"))


def population_coverage(population: DataFrame, origin_cells: DataFrame, area: StudyArea, p: Params = DEFAULT) -> DataFrame:
    """Populated cells in the area, those without any origin, and those below the minimum population."""
    inside = population.where(within_area(area, grid.cell_lat("cell", p=p), grid.cell_lon("cell", p=p), p))
    seen = origin_cells.select("cell").distinct().withColumn("_seen", F.lit(True))
    return inside.join(seen, "cell", "left").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("population").alias("population"),
        F.count_if(F.col("_seen").isNull()).alias("without_origins"),
        F.count_if(F.col("population") < p.pop_min).alias("below_minimum"))


# ---- territorial features --------------------------------------------------

def ring_population(zones: DataFrame, population: DataFrame, k: int, name: str, p: Params = DEFAULT) -> DataFrame:
    """Population of the exact ring ``k`` around each zone, missing cells as 0."""
    return ring_populations(zones, population, {k: name})


def ring_populations(zones: DataFrame, population: DataFrame, names: dict[int, str]) -> DataFrame:
    """Several rings from one neighbour join."""
    k_max = max(names)
    near = grid.neighbour_join(zones.select("cell"), population.select("cell", "population"), k_max)
    sums = near.groupBy(F.col("src").alias("cell")).agg(
        *[F.sum(F.when(F.col("ring") == k, F.col("population")).otherwise(0)).alias(n) for k, n in names.items()])
    return join_left_fill(zones.select("cell"), sums, "cell", {n: 0 for n in names.values()})


def zone_features(zones: DataFrame, population: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Centre, ring populations, distance to the reference point and validation block."""
    rings = ring_populations(zones, population, {1: "pop_ring1", 2: "pop_ring2"})
    out = zones.join(rings, "cell").withColumn("lat", grid.cell_lat("cell", p=p)).withColumn("lon", grid.cell_lon("cell", p=p))
    return (out.withColumn("dist_centre_km", F.round(S.haversine_km("lat", "lon", p.centre_lat, p.centre_lon), 4))
            .withColumn("block_id", grid.cell_parent("cell", p)))


def network_contrast(zones: DataFrame, network: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Distance to the mapped network (its sampled points) and coverage flag: for reading the gap, never predictors."""
    x, y = project_xy("lat", "lon", p)
    d = nearest_distance(zones.select("cell", x.alias("x"), y.alias("y")), network, "cell")
    return (zones.join(d, "cell").withColumn("covered", S.coverage_flag("distance", p.coverage_m))
            .withColumn("dist_network_m", F.round("distance", 1)).drop("distance"))


# ---- labels ----------------------------------------------------------------

def modal_label(clean: DataFrame, label: str = "muni") -> DataFrame:
    """Most frequent label of each zone's queries with its count and the total; ties alphabetical, null first.

    Labels that were decoded wrongly are repaired before they are counted.
    """
    counts = clean.groupBy("cell", label).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("cell", S.repair_mojibake(F.col(label).cast("string")).alias(label)).agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(label).alias("label")))
    return counts.groupBy("cell").agg(best.alias("m"), F.sum("n").alias("total")).select(
        "cell", F.col("m.label").alias("label"), (-F.col("m.neg")).alias("modal_queries"), F.col("total").alias("total_queries"))


def label_purity(modal: DataFrame) -> DataFrame:
    return modal.withColumn("pct_modal", F.col("modal_queries") / F.col("total_queries") * 100)


def ring_distance(cells: DataFrame, targets: DataFrame, k_max: int) -> DataFrame:
    """(cell, ring) of each of ``cells`` that has a target within ``k_max`` rings: the ring of its nearest one.

    A distance transform by grid lines. On the line ``b`` rows away the cells at distance |b| form one interval, and the distance grows by one
    per cell beyond its ends. So per line only the next target from the interval's one end, and the one before its other end, can be the nearest:
    two ordered lookups on each of the 2 ``k_max`` + 1 lines around a cell, whatever the distance is.
    """
    q, r = grid.cell_q("cell"), grid.cell_r("cell")
    seek = cells.select("cell").distinct().select("cell", q.alias("q"), r.alias("r"), F.explode(F.sequence(F.lit(-k_max), F.lit(k_max))).alias("b"))
    lo, hi = F.col("q") - F.greatest("b", F.lit(0)), F.col("q") + F.greatest(-F.col("b"), F.lit(0))
    seek = seek.select("cell", "b", (F.col("r") + F.col("b")).alias("line"), lo.alias("lo"), hi.alias("hi"))
    none = F.lit(None).cast("long")
    marks = targets.select("cell").distinct().select(r.alias("line"), q.alias("at"), q.alias("mark"), none.alias("cell"), F.lit(0).alias("b"), none.alias("lo"), none.alias("hi"))
    ends = [seek.select("line", F.col(e).alias("at"), none.alias("mark"), "cell", "b", "lo", "hi") for e in ("lo", "hi")]
    first = F.col("mark").isNull()  # targets come before the lookups at the same place
    found = []
    for end, order, beyond in ((ends[0], F.desc("at"), lambda m: m - F.col("hi")), (ends[1], F.asc("at"), lambda m: F.col("lo") - m)):
        w = Window.partitionBy("line").orderBy(order, first).rowsBetween(Window.unboundedPreceding, 0)
        near = marks.unionByName(end).withColumn("m", F.last("mark", ignorenulls=True).over(w)).where(F.col("cell").isNotNull() & F.col("m").isNotNull())
        found.append(near.select("cell", (F.abs("b") + F.greatest(beyond(F.col("m")), F.lit(0))).cast("int").alias("ring")))
    return found[0].unionByName(found[1]).groupBy("cell").agg(F.min("ring").alias("ring")).where(F.col("ring") <= k_max)


def exact_ring(cell: str, k: str) -> Column:
    """The 6 k cells of ring ``k`` (a column, 1 or more) around ``cell``, line by line."""
    def line(b: Column) -> Column:
        left, right, gap = -F.greatest(b, F.lit(0)), F.greatest(-b, F.lit(0)), F.col(k) - F.abs(b)
        steps = F.when(gap == 0, F.sequence(left, right)).otherwise(F.array(left - gap, right + gap))
        return F.transform(steps, lambda dq: F.col(cell) + dq.cast("bigint") * grid.STEP_Q + b)

    return F.flatten(F.transform(F.sequence(-F.col(k), F.col(k)), line))


def nearest_label(cells: DataFrame, labelled: DataFrame, k_max: int) -> DataFrame:
    """(cell, label) of the modal label among the nearest labelled ring of each cell, 1 <= ring <= ``k_max``; ties to the smallest label.

    Cells that hold a label themselves are left out. The ring's number comes from a distance transform, and only that ring is looked up.
    """
    known = labelled.where(F.col("label").isNotNull()).select("cell", "label")
    rings = materialize(ring_distance(cells.join(known, "cell", "left_anti"), known, k_max), "rings")
    around = rings.select("cell", F.explode(exact_ring("cell", "ring")).alias("dst"))
    votes = around.join(known.withColumnRenamed("cell", "dst"), "dst").groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("cell").agg(F.min(F.struct((-F.col("n")).alias("neg"), "label")).alias("m")).select("cell", F.col("m.label").alias("label"))


def zone_municipality(zones: DataFrame, modal: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Own modal label, else that of the nearest labelled zones, else the unknown label."""
    own = modal.select("cell", F.col("label").cast("string").alias("label"))
    base = zones.join(own, "cell", "left")
    near = nearest_label(base.where(F.col("label").isNull()), own, p.label_k_max).withColumnRenamed("label", "_near")
    return (base.join(near, "cell", "left")
            .withColumn("municipality", F.coalesce("label", "_near", F.lit(UNKNOWN_LABEL))).drop("label", "_near"))


# ---- rings, blocks, hold-out -----------------------------------------------

def block_distance(zones: DataFrame) -> DataFrame:
    """Mean distance of each block over its model zones, or over all its zones when it has none."""
    d = F.col("dist_centre_km")
    return zones.groupBy("block_id").agg(
        F.coalesce(F.avg(F.when(F.col("in_model"), d)), F.avg(d)).alias("block_dist_km"),
        F.max("in_model").alias("has_model"))


def quantile_cuts(blocks: DataFrame, n: int) -> DataFrame:
    """Inner linear quantiles of the distance of blocks with model zones, as one array."""
    return blocks.where("has_model").agg(
        F.percentile("block_dist_km", F.array(*[F.lit(i / n) for i in range(1, n)])).alias("cuts"))


def distance_rings(zones: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, list[float]]:
    """Zones with ``distance_ring`` A1… by quantiles of block distance; three numbers visit the driver."""
    blocks = block_distance(zones)
    cuts = quantile_cuts(blocks, p.n_rings).first().cuts
    labels = [f"A{i}" for i in range(1, p.n_rings + 1)]
    rings = blocks.select("block_id", S.cut_right_closed("block_dist_km", cuts, labels).alias("distance_ring"))
    return zones.join(rings, "block_id", "left"), [round(c, 2) for c in cuts]


def block_table(zones: DataFrame) -> DataFrame:
    return zones.where("in_model").groupBy("block_id").agg(
        F.round(F.avg("dist_centre_km"), 3).alias("block_dist_km"), F.count(F.lit(1)).alias("n_cells"),
        F.first("distance_ring").alias("distance_ring"))


def stratified_block_draw(blocks: DataFrame, fraction: float, seed) -> DataFrame:
    """Seeded draw of ``max(1, round(fraction · n))`` blocks of every ring (half-even rounding)."""
    ranked = hash_rank(blocks, "block_id", seed, "rn", ["distance_ring"])
    size = blocks.groupBy("distance_ring").agg(
        F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * fraction, 0)).cast("bigint").alias("take"))
    return ranked.join(size, "distance_ring").where("rn <= take").drop("rn", "take")


def holdout_split(zones: DataFrame, p: Params = DEFAULT) -> DataFrame:
    drawn = stratified_block_draw(block_table(zones), p.test_fraction, p.seed).select("block_id", F.lit(True).alias("_t"))
    return (zones.join(drawn, "block_id", "left").withColumn("in_test", F.coalesce("_t", F.lit(False))).drop("_t"))


def modelling_table(zones: DataFrame) -> DataFrame:
    return zones.select(*MODEL_COLUMNS).orderBy("cell")


def edge_train_test(zones: DataFrame) -> DataFrame:
    """Test zones that touch a training zone."""
    model = zones.where("in_model")
    test, train = model.where("in_test").select("cell"), model.where("NOT in_test").select("cell")
    return grid.neighbour_join(test, train, 1).agg(F.count_distinct("src").alias("edge_zones"))


# ---- descriptions ----------------------------------------------------------

def summary_by(zones: DataFrame, group: str) -> DataFrame:
    """Blocks, zones, queries and population per group with shares and the rate per 1 000 people."""
    agg = zones.groupBy(group).agg(F.count_distinct("block_id").alias("blocks"), F.count(F.lit(1)).alias("zones"),
                                   F.sum("query_count").alias("queries"), F.sum("population").alias("population"))
    total = zones.agg(F.count(F.lit(1)).alias("tz"), F.sum("query_count").alias("tq"))
    return agg.select("*", F.round(F.col("zones") / total.select("tz").scalar() * 100, 2).alias("pct_zones"),
                      F.round(F.try_divide(F.col("queries"), total.select("tq").scalar()) * 100, 2).alias("pct_queries"),
                      F.round(S.rate_per_1000("queries", "population"), 1).alias("rate_per_1000"))


def model_purity(modal: DataFrame, zones: DataFrame, p: Params = DEFAULT) -> DataFrame:
    keep = zones.where("in_model").select("cell")
    return label_purity(modal).join(keep, "cell").withColumn("mixed", F.col("pct_modal") < p.mixed_threshold)


def municipality_summary(purity: DataFrame, zones: DataFrame) -> DataFrame:
    """Weighted purity and mixed zones next to the summary of every municipality, pure zones or not."""
    left = purity.groupBy(F.col("label").cast("string").alias("municipality")).agg(
        F.round(F.sum("modal_queries") / F.sum("total_queries") * 100, 2).alias("pct_modal_queries"),
        F.count_if("mixed").alias("mixed_zones"))
    right = summary_by(zones.where("in_model"), "municipality").select("municipality", "zones", "queries", "population")
    return left.join(right, "municipality", "right").select("municipality", "zones", "queries", "population",
                                                            "pct_modal_queries", "mixed_zones")


def label_inheritance(purity: DataFrame, zones: DataFrame) -> DataFrame:
    n = zones.where("in_model").agg(F.count(F.lit(1)).alias("n")).scalar()
    return purity.agg(F.round(F.sum("modal_queries") / F.sum("total_queries") * 100, 2).alias("pct_modal"),
                      F.round(F.avg(F.col("mixed").cast("int")) * 100, 2).alias("pct_mixed"),
                      (n - F.count(F.lit(1))).alias("inherited_zones"))


def population_class_counts(zones: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return zones.groupBy(S.population_class(p).alias("class")).agg(F.count(F.lit(1)).alias("zones"),
                                                                   F.sum("query_count").alias("queries"))


def describe_zones(zones: DataFrame, variables: list[str]) -> DataFrame:
    """n, mean, sample std, min, quartiles and max of each variable, one row per variable."""
    long = zones.select([F.col(v).cast("double").alias(v) for v in variables]).unpivot([], variables, "variable", "x")
    facts = long.where(F.col("x").isNotNull()).groupBy("variable", "x").agg(F.count(F.lit(1)).alias("f")).groupBy("variable").agg(
        F.sum("f").alias("n"), (F.sum(F.col("x") * F.col("f")) / F.sum("f")).alias("mean"), _std_from_freq(), F.min("x").alias("min"), F.max("x").alias("max"))
    q = quantiles(long, "x", {"p25": .25, "median": .5, "p75": .75}, ["variable"])
    return facts.join(q, "variable").select("variable", "n", "mean", "std", "min", "p25", "median", "p75", "max")


def _std_from_freq() -> Column:
    """Sample standard deviation of weighted distinct values; values are zone scale, so sums of squares are safe."""
    n, s, q = F.sum("f"), F.sum(F.col("x") * F.col("f")), F.sum(F.col("x") * F.col("x") * F.col("f"))
    return F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).alias("std")


def split_counters(zones: DataFrame) -> DataFrame:
    """Blocks, zones and share of queries of the test part, zones and blocks of the training part."""
    m = zones.where("in_model")
    t = F.col("in_test")
    per_block = m.groupBy("block_id", "in_test").agg(F.count(F.lit(1)).alias("z"), F.sum("query_count").alias("q"))
    return per_block.agg(F.count_if(t).alias("test_blocks"), F.coalesce(F.sum(F.when(t, F.col("z"))), F.lit(0)).alias("test_zones"),
                         F.round(F.sum(F.when(t, F.col("q")).otherwise(0)) / F.sum("q") * 100, 2).alias("pct_test_queries"),
                         F.count_if(~t).alias("train_blocks"), F.coalesce(F.sum(F.when(~t, F.col("z"))), F.lit(0)).alias("train_zones"))
