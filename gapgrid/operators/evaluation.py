"""Gap between observed and expected demand, its stability, and the priority list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import scalars as S
from gapgrid.functions.ordering import quantiles, running, union_all
from gapgrid.models.validation import expected_by_zone
from gapgrid.operators.stats import spearman, spearman_by
from gapgrid.params import ACTION_MAP, DEFAULT, Params
from gapgrid.session import materialize

# Columns of the delivered tables.
GAP_COLUMNS = ["cell", "municipality", "population", "query_count", "dist_centre_km", "dist_network_m", "covered", "lat", "lon"]
PREDICTION_COLUMNS = ["cell", "lat", "lon", "municipality", "population", "observed", "expected", "observed_week",
                      "expected_week", "gap_pearson", "ratio_obs_exp", "unmet_demand", "covered", "dist_network_m",
                      "partition", "action", "priority_rank"]
FIELD_COLUMNS = ["priority_rank", "cell", "municipality", "population", "observed_week", "expected_week", "gap_pearson",
                 "unmet_demand", "dist_network_m", "lat", "lon", "osm_url", "field_result", "field_notes"]


def rank_first_deciles(df: DataFrame, expected: str, key: str, bins: int = 10) -> DataFrame:
    """Decile of each row from its position by expected value; ties by key.

    Quantile bins of the positions 1..n, right-closed: ``max(1, ceil((rank − 1)·bins/(n − 1)))``.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    pos = running(df, [expected, key], row_number="_rn")
    bin_no = F.greatest(F.lit(1), F.floor(((F.col("_rn") - 1) * bins + n - 2) / F.greatest(n - 1, F.lit(1))))
    return pos.withColumn("decile", bin_no.cast("int")).drop("_rn")


def calibration_deciles(df: DataFrame, observed: str, expected: str, key: str) -> DataFrame:
    return rank_first_deciles(df.select(key, observed, expected), expected, key).groupBy("decile").agg(
        F.count(F.lit(1)).alias("zones"), F.sum(F.col(observed).cast("double")).alias("observed"),
        F.sum(F.col(expected)).alias("expected")).withColumn("ratio", F.col("observed") / F.col("expected"))


def test_vs_cv_table(test_metrics: DataFrame, cv: DataFrame) -> DataFrame:
    """Each test metric next to its cross-validation mean and sd, or the pooled value when there is no mean."""
    names = ["deviance", "d2", "mae", "spearman", "calibration", "d2_against_global"]
    long = test_metrics.select(*names).unpivot([], names, "metric", "test")
    have = ["deviance", "d2", "mae", "spearman"]
    cv_rows = F.array(*[F.struct(F.lit(n).alias("metric"),
                                 (F.col(f"{n}_mean") if n in have else F.lit(None).cast("double")).alias("mean"),
                                 (F.col(f"{n}_sd") if n in have else F.lit(None).cast("double")).alias("cv_sd"),
                                 (F.col(f"oof_{n}") if n != "d2_against_global" else F.lit(None).cast("double")).alias("oof"))
                        for n in names])
    cv_long = cv.select(F.inline(cv_rows)).select("metric", F.coalesce("mean", "oof").alias("cv_mean"), "cv_sd")
    return long.join(cv_long, "metric", "left")


def gap_table(zones: DataFrame, expected: DataFrame, expected_global: DataFrame, weeks, p: Params = DEFAULT) -> DataFrame:
    """One row per model zone with the expected count, its weekly value and the gap measures."""
    g = expected_global.select("cell", F.col("expected").alias("_global"))
    out = zones.select(*GAP_COLUMNS).join(expected, "cell").join(g, "cell").withColumnRenamed("query_count", "observed")
    return out.select(*[("observed" if c == "query_count" else c) for c in GAP_COLUMNS], "expected", "partition",
                      S.per_observed_week("expected", weeks).alias("expected_week"), *S.gap_metrics("observed", "expected", p.shrink),
                      S.gap_pearson("observed", "_global").alias("gap_pearson_global"))


def gap_of_variant(train: DataFrame, test: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT,
                   min_population: int | None = None, **boost) -> DataFrame:
    """(cell, gap_pearson, …) for another technique, target column or population threshold."""
    if min_population is not None:
        train, test = (d.where(F.col("population") >= min_population) for d in (train, test))
    e = expected_by_zone(train, test, technique, target, p, **boost)
    both = train.select("cell", target).unionByName(test.select("cell", target))
    return e.join(both, "cell").select("cell", *S.gap_metrics(target, "expected", p.shrink))


def top_k(df: DataFrame, k: int, value: str = "gap_pearson", key: str = "cell") -> DataFrame:
    """The ``k`` lowest values, ties by key."""
    return df.orderBy(F.asc(value), F.asc(key)).limit(k)


def jaccard_topk(a: DataFrame, b: DataFrame, key: str = "cell") -> DataFrame:
    both = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full")
    return both.agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count(F.lit(1))).alias("jaccard"))


def ranking_self_join(base: DataFrame, variant: DataFrame) -> DataFrame:
    return base.select("cell", F.col("gap_pearson").alias("gap_x")).join(
        variant.select("cell", F.col("gap_pearson").alias("gap_y")), "cell")


def compare_rankings(base: DataFrame, variant: DataFrame, k: int) -> DataFrame:
    """Common zones, Spearman of the gap on them, Jaccard of the two top-k lists."""
    common = ranking_self_join(base, variant)
    rho = spearman(common, "gap_x", "gap_y", 3).scalar()
    jac = jaccard_topk(top_k(base, k), top_k(variant, k)).select(F.round("jaccard", 3).alias("j")).scalar()
    return common.agg(F.count(F.lit(1)).alias("common_zones")).select("common_zones", rho.alias("spearman"), jac.alias("jaccard"))


def sensitivity_table(gap: DataFrame, variants: dict[str, DataFrame], k: int) -> DataFrame:
    """Agreement of every variant with the main gap, over all zones and over uncovered zones.

    All variants and both universes are ranked in one pass under the keys (variant, universe).
    """
    keys = ["variant", "universe"]
    base = gap.select("cell", F.col("gap_pearson").alias("gap_x"), F.explode(
        F.when(F.col("covered") == 0, F.array(F.lit("all"), F.lit("uncovered"))).otherwise(F.array(F.lit("all")))).alias("universe"))
    base = materialize(base, "base-gap")
    mine = union_all([v.select(F.lit(name).alias("variant"), "cell", F.col("gap_pearson").alias("gap_y")) for name, v in variants.items()])
    flags = base.where("universe = 'uncovered'").select("cell", F.lit(True).alias("_open"))
    mine = mine.join(flags, "cell", "left").withColumn("universe", F.explode(
        F.when(F.col("_open"), F.array(F.lit("all"), F.lit("uncovered"))).otherwise(F.array(F.lit("all"))))).drop("_open")
    mine = materialize(mine, "variant-gaps")
    common = mine.join(base, ["cell", "universe"])
    n = common.groupBy(*keys).agg(F.count(F.lit(1)).alias("common_zones"))
    rho = spearman_by(common, "gap_x", "gap_y", keys).select(*keys, F.round("spearman", 3).alias("spearman"))
    first = lambda df, by, value: df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(value, "cell"))).where(F.col("_rn") <= k)
    names = F.explode(F.array(*[F.lit(v) for v in variants]))
    a = first(base, ["universe"], "gap_x").select(names.alias("variant"), "universe", "cell", F.lit(1).alias("_a"))
    b = first(mine, keys, "gap_y").select(*keys, "cell", F.lit(1).alias("_b"))
    jac = a.join(b, [*keys, "cell"], "full").groupBy(*keys).agg(
        F.round(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count(F.lit(1)), 3).alias("jaccard"))
    every = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(u).alias("universe")) for v in variants for u in ("all", "uncovered")])
    rows = gap.sparkSession.range(1).select(F.inline(every))
    return rows.join(n, keys, "left").join(rho, keys, "left").join(jac, keys, "left").select(
        *keys, F.coalesce("common_zones", F.lit(0)).cast("bigint").alias("common_zones"), "spearman", "jaccard")


def gap_summary(gap: DataFrame, k: int) -> DataFrame:
    top = top_k(gap, k)
    in_top = top.agg(F.sum("unmet_demand").alias("s")).scalar()
    n_top = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    return gap.agg(F.count(F.lit(1)).alias("zones"), F.count_if(F.col("gap_pearson") < 0).alias("below_expected"),
                   F.count_if(F.col("gap_pearson") < -2).alias("below_minus2"), F.round(F.sum("unmet_demand"), 3).alias("unmet_total"),
                   F.round(F.try_divide(in_top, F.sum("unmet_demand")) * 100, 1).alias("pct_unmet_top"),
                   F.round(n_top / F.count(F.lit(1)) * 100, 2).alias("pct_zones_top"))


def coverage_contrast(gap: DataFrame) -> DataFrame:
    facts = gap.groupBy("covered").agg(
        F.count(F.lit(1)).alias("zones"), F.sum("population").alias("population"),
        (F.avg((F.col("gap_pearson") < 0).cast("int")) * 100).alias("pct_below"), F.sum("unmet_demand").alias("unmet"))
    median = quantiles(gap, "gap_pearson", {"median_gap": 0.5}, ["covered"])
    return facts.join(median, "covered").select("covered", "zones", "population", "median_gap", "pct_below", "unmet")


def clamped_gap(gap: DataFrame) -> DataFrame:
    """Gap limited to ± its 95th percentile of absolute value (the colour scale of a map)."""
    limit = quantiles(gap.select(F.abs("gap_pearson").alias("size")), "size", {"l": 0.95}).scalar()
    return gap.select("cell", limit.alias("limit"), S.clamp("gap_pearson", limit).alias("clamped"))


# ---- priorities ------------------------------------------------------------

def prioritise(gap: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Action per zone and rank 1..k of the most negative gaps (among zones to map, or all negative ones)."""
    acted = gap.withColumn("action", S.priority_action())
    pool = acted.where(F.col("action") == ACTION_MAP) if p.only_uncovered else acted.where("gap_pearson < 0")
    w = Window.partitionBy(F.lit(0)).orderBy("gap_pearson", "cell")  # k rows
    ranks = top_k(pool, p.top_k).select("cell", F.row_number().over(w).cast("bigint").alias("priority_rank"))
    return acted.join(ranks, "cell", "left")


def zone_predictions(prioritised: DataFrame, weeks) -> DataFrame:
    out = prioritised.withColumn("observed_week", S.per_observed_week("observed", weeks)).select(*PREDICTION_COLUMNS)
    return S.round_all(out, 4)


def field_list(predictions: DataFrame) -> DataFrame:
    """Visit list of the ranked zones with a map link and the empty visit record."""
    top = predictions.where(F.col("priority_rank").isNotNull()).withColumn("osm_url", S.map_link("lat", "lon"))
    return S.round_all(top.select("*", *S.field_template()).select(*FIELD_COLUMNS), 3).orderBy("priority_rank")


def action_summary(pred: DataFrame) -> DataFrame:
    from gapgrid.params import ACTION_NONE, ACTION_REVIEW

    top, a = F.col("priority_rank").isNotNull(), F.col("action")
    return pred.agg(
        F.count_if(top).alias("priority_zones"), F.count_if(a == ACTION_MAP).alias("to_map"),
        F.count_if(a == ACTION_REVIEW).alias("to_review"), F.count_if(a == ACTION_NONE).alias("no_gap"),
        F.coalesce(F.sum(F.when(top, F.col("population"))), F.lit(0)).alias("priority_population"),
        F.round(F.try_divide(F.sum(F.when(top, F.col("unmet_demand"))), F.sum(F.when(a == ACTION_MAP, F.col("unmet_demand")))) * 100, 1)
        .alias("pct_unmet_uncovered"), F.count_distinct(F.when(top, F.col("municipality"))).alias("municipalities"))


def edition_monitor(gap: DataFrame, previous: DataFrame, weeks: DataFrame, previous_weeks: DataFrame) -> DataFrame:
    """Alert rows: agreement with the previous edition below 0.8, calibration outside [0.9, 1.1], new bad weeks."""
    rho = spearman(ranking_self_join(gap, previous), "gap_x", "gap_y", 6)
    cal = gap.agg(F.round(F.sum("expected") / F.sum("observed"), 6).alias("calibration"))
    bad = weeks.where("NOT observed OR NOT complete").select("start")
    old = previous_weeks.where("NOT observed OR NOT complete").select("start")
    new = bad.join(old, "start", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return union_all([
        rho.select(F.lit("ranking_agreement").alias("check"), F.col("spearman").alias("value"), (F.col("spearman") < 0.8).alias("alert")),
        cal.select(F.lit("calibration").alias("check"), F.col("calibration").alias("value"),
                   (~F.col("calibration").between(0.9, 1.1)).alias("alert")),
        new.select(F.lit("new_bad_weeks").alias("check"), F.col("n").cast("double").alias("value"), (F.col("n") > 0).alias("alert"))])
