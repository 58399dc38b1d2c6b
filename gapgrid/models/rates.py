"""Rate baselines: the expected count is a training rate times the population of the zone.

Each function takes training rows and the frame to predict. Out-of-fold versions treat every fold at once:
the training sums of a fold are the totals minus the fold's own part, so no row is copied per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.params import DEFAULT, Params
from gapgrid.session import materialize

GROUP_OF = {"B1": "municipality", "B2": "distance_ring"}


def _sums(df: DataFrame, target: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(target).cast("double").alias("y"), F.sum("population").cast("double").alias("pop"),
                               F.count(F.lit(1)).alias("rows"))


def _global_rate(train: DataFrame, target: str) -> Column:
    return train.agg((F.sum(target) / F.sum("population")).alias("rate")).scalar()


def rate_global(train: DataFrame, frame: DataFrame, target: str = "query_count") -> DataFrame:
    """B0: global training rate."""
    return frame.withColumn("expected", _global_rate(train, target) * F.col("population"))


def lookup_with_default(frame: DataFrame, rates: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    return frame.join(rates.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def rate_by_group(train: DataFrame, frame: DataFrame, group: str, target: str = "query_count") -> DataFrame:
    """B1 and B2: rate of the zone's group, the global rate for a group not seen in training."""
    rates = _sums(train, target, group).select(group, (F.col("y") / F.col("pop")).alias("_rate"))
    out = lookup_with_default(frame, rates, group, "_rate", _global_rate(train, target))
    return out.withColumn("expected", F.col("_rate") * F.col("population")).drop("_rate")


def growing_disk_sum(pairs: DataFrame, need: int) -> DataFrame:
    """(src, y, pop): sums over the smallest disk that holds at least ``need`` neighbours.

    ``pairs`` is (src, ring, y, pop). Rings are summed first, so the window per cell sees at most k rows.
    """
    rings = pairs.groupBy("src", "ring").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("pop").alias("pop"))
    w = Window.partitionBy("src").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    cum = rings.select("src", "ring", *[F.sum(c).over(w).alias(c) for c in ("n", "y", "pop")]).where(F.col("n") >= need)
    return cum.groupBy("src").agg(F.min(F.struct("ring", "n", "y", "pop")).alias("m")).select("src", "m.ring", "m.n", "m.y", "m.pop")


def neighbourhood_sums(frame: DataFrame, train: DataFrame, target: str, p: Params, outside: str | None = None) -> DataFrame:
    """Smallest sufficient disk of training zones around each zone of ``frame``, the zone itself excluded.

    Near rings settle almost every zone; only the rest look as far as the maximum ring. ``outside`` names a
    fold column: then only neighbours of another fold count.
    """
    extra = [outside] if outside else []
    table = train.select("cell", *[F.col(c).alias("_other") for c in extra], F.col(target).cast("double").alias("y"),
                         F.col("population").cast("double").alias("pop"))
    parts, todo = [], frame.select("cell", *extra)
    for hi in sorted({min(2, p.neighbours_k_max), p.neighbours_k_max}):
        pairs = grid.neighbour_join(todo, table, hi)
        if outside:
            pairs = pairs.join(todo.withColumnRenamed("cell", "src"), "src").where(F.col("_other") != F.col(outside))
        found = materialize(growing_disk_sum(pairs, p.neighbours_min), "disks")
        parts.append(found)
        todo = materialize(todo.join(found.select(F.col("src").alias("cell")), "cell", "left_anti"), "too-few")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def growing_disk_rate(frame: DataFrame, train: DataFrame, target: str, p: Params = DEFAULT) -> DataFrame:
    """(cell, _rate) of the zones of ``frame`` that have enough training zones within reach."""
    return neighbourhood_sums(frame, train, target, p).select(F.col("src").alias("cell"), (F.col("y") / F.col("pop")).alias("_rate"))


def rate_neighbourhood(train: DataFrame, frame: DataFrame, target: str = "query_count", p: Params = DEFAULT) -> DataFrame:
    """B3: rate of the nearest training zones, the global rate where there are too few within reach."""
    out = lookup_with_default(frame, growing_disk_rate(frame, train, target, p), "cell", "_rate", _global_rate(train, target))
    return out.withColumn("expected", F.col("_rate") * F.col("population")).drop("_rate")


# ---- out of fold -----------------------------------------------------------

def _fold_global(rows: DataFrame, target: str) -> DataFrame:
    per = _sums(rows, target, "fold")
    tot = _sums(rows, target)
    return per.select("fold", ((tot.select("y").scalar() - F.col("y")) / (tot.select("pop").scalar() - F.col("pop"))).alias("_global"))


def oof_rates(rows: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT) -> DataFrame:
    """Out-of-fold expected counts of a rate technique; ``rows`` carries ``fold``."""
    base = rows.join(F.broadcast(_fold_global(rows, target)), "fold")  # one row per fold
    if technique == "B0":
        rate = base.withColumn("_rate", F.col("_global"))
    elif technique in GROUP_OF:
        g = GROUP_OF[technique]
        per = _sums(rows, target, g, "fold")
        tot = per.groupBy(g).agg(*[F.sum(c).alias(f"t_{c}") for c in ("y", "pop", "rows")])
        part = per.join(tot, g).select(g, "fold", F.when(F.col("t_rows") > F.col("rows"), (F.col("t_y") - F.col("y"))
                                                         / (F.col("t_pop") - F.col("pop"))).alias("_rate"))
        rate = base.join(part, [g, "fold"], "left").withColumn("_rate", F.coalesce("_rate", "_global"))
    elif technique == "B3":
        near = neighbourhood_sums(rows, rows, target, p, "fold").select(
            F.col("src").alias("cell"), (F.col("y") / F.col("pop")).alias("_rate"))
        rate = base.join(near, "cell", "left").withColumn("_rate", F.coalesce("_rate", "_global"))
    else:
        raise ValueError(technique)
    return rate.withColumn("expected", F.col("_rate") * F.col("population")).drop("_rate", "_global")
