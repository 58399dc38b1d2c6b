"""Per-user usage statistics and the anomalous-user signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions import scalars as S
from gapgrid.params import DEFAULT, Params

SIGNALS = ["s_volume", "s_intensity", "s_dispersion", "s_burst", "s_no_routine", "s_fast"]


def possible_trips(trips: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Trips with a possible origin and destination, a user and a time, with both cells."""
    ok = (S.valid_origin(p.bbox) & S.valid_destination() & F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return trips.where(ok).select("user_id", "ts", grid.point_to_cell("lat_orig", "lon_orig", p=p).alias("cell_orig"),
                                  grid.point_to_cell("lat_dest", "lon_dest", p=p).alias("cell_dest"))


def daily_counts(base: DataFrame) -> DataFrame:
    return base.groupBy("user_id", S.day_of("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(base: DataFrame) -> DataFrame:
    return base.groupBy("user_id", "cell_orig", "cell_dest").agg(F.count(F.lit(1)).alias("n"))


def seconds_between(base: DataFrame, slot_seconds: int = 60) -> DataFrame:
    """(user_id, seconds, freq): whole seconds between consecutive rows of a user, as frequencies.

    Equal instants are counted first, then the gap to the previous instant is taken inside one time slot.
    The first instant of a slot looks at the last instant of the user's previous slot, found on the table of
    slots. One busy user is thereby spread over as many tasks as there are slots.
    """
    instants = (base.groupBy("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
                .agg(F.count(F.lit(1)).alias("n"))
                .withColumn("slot", F.floor(F.col("us") / (slot_seconds * 1_000_000))))
    inside = Window.partitionBy("user_id", "slot").orderBy("us")
    gaps = instants.withColumn("prev", F.lag("us").over(inside))
    slots = instants.groupBy("user_id", "slot").agg(F.min("us").alias("us"), F.max("us").alias("last"))
    heads = slots.select("user_id", "us", F.lag("last").over(Window.partitionBy("user_id").orderBy("slot")).alias("prev"))
    step = F.floor((F.col("us") - F.col("prev")) / 1_000_000).cast("bigint")
    pieces = (gaps.where(F.col("prev").isNotNull()).select("user_id", step.alias("seconds"), F.lit(1).cast("bigint").alias("freq"))
              .unionByName(heads.where(F.col("prev").isNotNull())
                           .select("user_id", step.alias("seconds"), F.lit(1).cast("bigint").alias("freq")))
              .unionByName(instants.where(F.col("n") > 1)
                           .select("user_id", F.lit(0).cast("bigint").alias("seconds"), (F.col("n") - 1).alias("freq"))))
    return pieces.groupBy("user_id", "seconds").agg(F.sum("freq").alias("freq"))


def user_stats(base: DataFrame) -> DataFrame:
    """One row per user: queries, active days, origin cells, busiest day, repeated-pair share, median gap.

    Every branch counts before it shuffles by user, so no task ever holds the rows of one user.
    """
    days = (daily_counts(base).groupBy("user_id")
            .agg(F.sum("n").alias("n_queries"), F.count(F.lit(1)).alias("active_days"), F.max("n").alias("max_day")))
    pairs = (pair_counts(base).groupBy("user_id", "cell_orig")
             .agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated"))
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cells"),
                                     (F.sum("repeated") / F.sum("pairs")).alias("repeated_share")))
    median = (seconds_between(base).groupBy("user_id")
              .agg(F.percentile("seconds", 0.5, F.col("freq")).alias("median_seconds")))
    return days.join(pairs, "user_id").join(median, "user_id", "left")


def user_signals(stats: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Six signals, their number and the anomalous flag; a null comparison counts as no signal."""
    t = p.users
    rules = {
        "s_volume": F.col("n_queries") > t.volume,
        "s_intensity": F.col("n_queries") / F.col("active_days") > t.per_active_day,
        "s_dispersion": F.col("n_cells") > t.origin_cells,
        "s_burst": F.col("max_day") > t.burst,
        "s_no_routine": (F.col("repeated_share") < t.repeated_share) & (F.col("n_queries") > t.repeated_min_queries),
        "s_fast": F.col("median_seconds") < t.fast_seconds,
    }
    flagged = stats.select("*", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()])
    return (flagged.withColumn("n_signals", S.count_true(*SIGNALS))
            .withColumn("anomalous", F.col("n_signals") >= t.min_signals))


def signals_of_trips(trips: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return user_signals(user_stats(possible_trips(trips, p)), p)


def anomalous_users(signals: DataFrame) -> DataFrame:
    return signals.where("anomalous").select("user_id", "n_queries", "n_signals")


def signal_totals(signals: DataFrame) -> DataFrame:
    """Users per signal, plus the users and queries of the anomalous ones."""
    one = signals.agg(*[F.count_if(s).alias(s) for s in SIGNALS], F.count_if("anomalous").alias("anomalous_users"),
                      F.coalesce(F.sum(F.when(F.col("anomalous"), F.col("n_queries"))), F.lit(0))
                      .alias("anomalous_queries"))
    return one.unpivot([], SIGNALS + ["anomalous_users", "anomalous_queries"], "measure", "value")
