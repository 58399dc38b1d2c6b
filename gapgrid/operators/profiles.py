"""Quality and time profiles of the raw and clean trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import scalars as S
from gapgrid.functions.ordering import hash_rank, quantiles, union_all
from gapgrid.operators.cleaning import data_columns
from gapgrid.params import DEFAULT, Params


# ---- calendar --------------------------------------------------------------

def weekly_coverage(trips: DataFrame) -> DataFrame:
    """Queries and days with data for every ISO week between the first and the last, missing weeks as 0."""
    obs = (trips.where(F.col("ts").isNotNull()).groupBy(S.day_of("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
           .groupBy(S.monday_of("day").alias("start")).agg(F.sum("n").alias("queries"),
                                                           F.count(F.lit(1)).cast("int").alias("days_with_data")))
    span = obs.agg(F.min("start").alias("a"), F.max("start").alias("b"))
    weeks = span.where(F.col("a").isNotNull()).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 week"))).alias("start"))
    full = weeks.join(obs, "start", "left")
    n, d = (F.coalesce(c, F.lit(0)) for c in ("queries", "days_with_data"))
    return full.select(S.iso_year("start").alias("year"), S.iso_week("start").alias("week"), "start",
                       n.cast("bigint").alias("queries"), d.cast("int").alias("days_with_data"),
                       (n > 0).alias("observed"), (d == 7).alias("complete"))


def gap_bounds(weeks: DataFrame) -> DataFrame:
    """First missing Monday and the Monday after the last missing one; null when no week is missing."""
    missing = weeks.where(~F.col("observed"))
    return missing.agg(F.min("start").alias("gap_start"), F.date_add(F.max("start"), 7).alias("gap_end"))


def observed_weeks(weeks: DataFrame) -> DataFrame:
    return weeks.agg((F.sum("days_with_data") / 7).alias("observed_weeks"))


def weekly_means_around_gap(weeks: DataFrame, start, end) -> DataFrame:
    full = F.col("complete")
    return weeks.agg(F.avg(F.when(full & (F.col("start") < F.lit(start)), F.col("queries"))).alias("mean_before"),
                     F.avg(F.when(full & (F.col("start") >= F.lit(end)), F.col("queries"))).alias("mean_after"))


def period_days(trips: DataFrame, start, end) -> DataFrame:
    days = trips.where(F.col("ts").isNotNull()).select(S.day_of("ts").alias("day")).distinct()
    return days.agg(F.count_if(F.col("day") < F.lit(start)).alias("days_before"),
                    F.count_if(F.col("day") >= F.lit(end)).alias("days_after"))


def gap_as_null(weeks: DataFrame) -> DataFrame:
    return weeks.select("start", S.value_when("observed", "queries").alias("queries"))


def temporal_profile(trips: DataFrame) -> DataFrame:
    """Count and share by hour and by weekday (1 = Monday), from one pass."""
    base = trips.where(F.col("ts").isNotNull()).groupBy(S.hour_of("ts").alias("hour"), S.weekday_of("ts").alias("weekday")
                                                        ).agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(F.struct(F.lit("hour").alias("dimension"), F.col("hour").cast("int").alias("value")),
                   F.struct(F.lit("weekday").alias("dimension"), F.col("weekday").cast("int").alias("value")))
    counts = base.select("n", F.inline(rows)).groupBy("dimension", "value").agg(F.sum("n").alias("queries"))
    w = Window.partitionBy("dimension")  # at most 24 rows
    return counts.withColumn("pct", F.round(F.col("queries") / F.sum("queries").over(w) * 100, 3))


def peak_hour(profile: DataFrame) -> DataFrame:
    """Hour with the highest share (ties: the earliest) and the share of Saturday and Sunday."""
    hour, weekend = F.col("dimension") == "hour", (F.col("dimension") == "weekday") & (F.col("value") >= 6)
    best = F.max(F.when(hour, F.struct(F.col("pct").alias("p"), (-F.col("value")).alias("v"))))
    return profile.agg((-best["v"]).alias("peak_hour"), F.round(F.sum(F.when(weekend, F.col("pct"))), 1)
                       .alias("weekend_pct"))


# ---- nulls, copies, coordinates --------------------------------------------

def null_profile(df: DataFrame, batch: str = "source_batch") -> DataFrame:
    """Share of nulls per column, in total and per batch, as (column, scope, pct).

    One aggregate per batch; the total is the sum of the batches.
    """
    cols = data_columns(df)
    per = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rolled = per.groupingSets([[], [batch]], batch).agg(
        F.grouping(batch).alias("_all"), F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in cols])
    scope = F.when(F.col("_all") == 1, "global").otherwise(F.coalesce(F.col(batch), F.lit("null")))
    long = rolled.select(scope.alias("scope"), "_n", *cols).unpivot(["scope", "_n"], cols, "column", "nulls")
    return long.select("column", "scope", F.round(F.col("nulls") / F.col("_n") * 100, 3).alias("pct"))


def null_profile_wide(df: DataFrame, batches: list[str], batch: str = "source_batch") -> DataFrame:
    return null_profile(df, batch).groupBy("column").pivot("scope", ["global", *batches]).agg(F.first("pct"))


def duplicate_profile(df: DataFrame, definitions: dict[str, list[str]]) -> DataFrame:
    """Surplus copies under several definitions; null keys count as equal."""
    parts = []
    for name, cols in definitions.items():
        per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("surplus")).select(
            F.lit(name).alias("definition"), F.lit(", ".join(cols)).alias("columns"), "surplus",
            F.round(F.col("surplus") / F.col("rows") * 100, 4).alias("pct")))
    return union_all(parts)


def coordinate_problems(trips: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return trips.agg(F.count_if(S.zero_origin()).alias("zero_origin"),
                     F.count_if(~S.zero_origin() & ~S.valid_origin(p.bbox)).alias("outside_box"))


def seeded_sample(df: DataFrame, n: int, seed, key: str) -> DataFrame:
    """``n`` rows in the seeded order of a unique key: those ranked first, whatever ``n`` is."""
    return hash_rank(df, key, seed, "_rank").where(F.col("_rank") <= n).drop("_rank")


def distance_unit_check(trips: DataFrame, n: int | None = None, seed=None, key: str = "event_id", dist: str = "dist_m") -> DataFrame:
    """Unit of the distance column: the one with the smaller median relative error against the great circle.

    Every row counts; ``n`` takes a seeded sample instead.
    """
    ok = trips.where(F.col(dist).isNotNull() & (F.col("lat_orig") != 0) & (F.col("lat_dest") != 0))
    ok = ok if n is None else seeded_sample(ok, n, seed, key)
    geo = ok.select(dist, S.haversine_m("lat_orig", "lon_orig", "lat_dest", "lon_dest").alias("geo")).where("geo > 0")
    errors = geo.select(F.inline(F.array(
        F.struct(F.lit("m").alias("unit"), (F.abs(F.col(dist) - F.col("geo")) / F.col("geo") * 100).alias("error")),
        F.struct(F.lit("km").alias("unit"), (F.abs(F.col(dist) - F.col("geo") / 1000) / (F.col("geo") / 1000) * 100).alias("error")))))
    q = quantiles(errors, "error", {"median": 0.5}, ["unit"])
    return q.agg(F.max(F.when(F.col("unit") == "m", F.col("median"))).alias("m"), F.max(F.when(F.col("unit") == "km", F.col("median"))).alias("km")).select(
        F.when(F.col("m") < F.col("km"), "metres").otherwise("km").alias("unit"),
        F.round(F.least("m", "km"), 3).alias("median_error_pct"))


def value_percentiles(df: DataFrame, value: str, points: list[float], names: list[str], above: float | None = None
                      ) -> DataFrame:
    """Exact linear percentiles from value frequencies, and the share above a limit."""
    out = quantiles(df, value, dict(zip(names, points)))
    if above is not None:
        v = F.col(value)
        share = df.agg((F.count_if(v > above) / F.count(v) * 100).alias("p")).scalar()
        out = out.withColumn("pct_above", share)
    return out


def distance_percentiles(trips: DataFrame, p: Params = DEFAULT) -> DataFrame:
    km = trips.where(S.valid_origin(p.bbox) & (F.col("dist_m") > 0)).select((F.col("dist_m") / 1000).alias("km"))
    return value_percentiles(km, "km", [0.5, 0.9, 0.99, 0.999], ["p50", "p90", "p99", "p99_9"], p.dist_max_m / 1000)


def log_histogram(df: DataFrame, value: str, bins: int, low: float | None, high: Column | float | None = None
                  ) -> DataFrame:
    """Counts in bins of equal width on log10; bounds default to the smallest and largest positive value."""
    pos = df.where(F.col(value) > 0)
    limits = pos.agg(F.log10(F.min(value)).alias("a"), F.log10(F.max(value)).alias("b"))
    lo = F.lit(low) if low is not None else limits.select("a").scalar()
    hi = F.lit(high) if high is not None else limits.select("b").scalar()
    return (pos.withColumn("bin", S.log_bin(value, bins, lo, hi)).where(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))


def schema_groups(headers: DataFrame) -> DataFrame:
    """Number each file's column set in the order its first file appears (``file``, ``column``)."""
    sets = headers.groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"))
    firsts = sets.groupBy("columns").agg(F.min("file").alias("first"))
    w = Window.partitionBy(F.lit(0)).orderBy("first")  # one row per distinct header
    return sets.join(firsts.withColumn("schema_id", F.row_number().over(w) - 1), "columns").select("file", "schema_id")
