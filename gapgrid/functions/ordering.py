"""Ranks, running sums and seeded orders over whole tables without a one-task window.

A window without a partition moves every row to one task. Here Spark's range partitioning cuts the order into ranges first, which are
written with their numbers; each range is ranked on its own, and the totals of the earlier ranges (one row per range)
are added back by a join. The plan is the same for two ranges and for a million.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.session import materialize

ROWS_PER_RANGE = 200_000  # rows that one range or slice should hold; their number follows from the counted rows


def in_ranges(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """``df`` with its range in the order of ``keys`` as ``_range``, written once.

    Spark samples the keys and deals the rows by range; the number of the range is the number of the partition. It is written with the
    rows, so that whatever is computed later, or again after a lost executor, sees the same ranges.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    dealt = df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id())
    return materialize(dealt.coalesce(tasks) if ranges > tasks else dealt, "ranges")


def running(df: DataFrame, keys: list[str], row_number: str | None = None, sums: dict[str, str] | None = None,
            ranges: int | None = None) -> DataFrame:
    """Add the position and inclusive running sums over the whole table in ascending ``keys`` order.

    ``keys`` must be non-null and identify a row. ``sums`` maps new column → summed column. Running values are taken inside ranges;
    a table of one row per range holds what the ranges before add up to and is joined by the range's number.
    """
    sums = sums or {}
    ranges = ranges or -(-df.count() // ROWS_PER_RANGE)
    cut = in_ranges(materialize(df, "ordered"), keys, ranges) if ranges > 1 else df.withColumn("_range", F.lit(0))
    w = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *([F.count(F.lit(1)).over(w).alias(row_number)] if row_number else []),
                       *[F.sum(c).over(w).alias(new) for new, c in sums.items()])
    if ranges < 2:
        return local.drop("_range")
    parts = {**({"_n": F.count(F.lit(1))} if row_number else {}), **{f"_s_{new}": F.sum(c) for new, c in sums.items()}}
    prior = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("_range").agg(*[v.alias(k) for k, v in parts.items()]).select(
        "_range", *[F.coalesce(F.sum(k).over(prior), F.lit(0)).alias(k) for k in parts])
    out = local.join(materialize(before, "range-totals"), "_range")
    if row_number:
        out = out.withColumn(row_number, F.col(row_number) + F.col("_n"))
    for new in sums:
        out = out.withColumn(new, F.col(new) + F.col(f"_s_{new}"))
    return out.drop("_range", *parts)


def average_ranks(df: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """(value, freq, rank): tied values share the mean of their positions.

    Equal values are counted before any ordering, so a value held by a third of all rows is one row here.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("freq"))
    return (running(freq, [value], sums={"_cum": "freq"})
            .select(value, "freq", (F.col("_cum") - (F.col("freq") - 1) / 2.0).alias(rank)))


def quantiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """One row (per ``by`` group) with the linear quantile ``points[name]`` of ``value`` in each column ``name``.

    Equal values are counted first, positions come from range sums, and the two neighbours of a quantile are minima:
    no task holds a whole column. Nulls in ``value`` are left out; ``by`` columns must not be null.
    """
    by = by or []
    freq = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(freq, [*by, "_v"], sums={"_cum": "_n"})
    facts = [F.sum("_n").alias("_total"), F.min(F.col("_cum") - F.col("_n")).alias("_start")]
    if by:
        cum = cum.join(cum.groupBy(*by).agg(*facts), by)
    else:
        cum = cum.withColumn("_total", freq.agg(F.sum("_n").alias("t")).scalar()).withColumn("_start", F.lit(0))
    upto = F.col("_cum") - F.col("_start")
    out, parts = [], []
    for i, (name, q) in enumerate(points.items()):
        at = F.lit(float(q)) * (F.col("_total") - 1)
        parts += [F.min(F.when(upto > F.floor(at), F.col("_v"))).alias(f"_a{i}"), F.min(F.when(upto > F.ceil(at), F.col("_v"))).alias(f"_b{i}")]
        at = F.lit(float(q)) * (F.col("_total") - 1)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        out.append(F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b).alias(name))
    return cum.groupBy(*by).agg(F.max("_total").alias("_total"), *parts).select(*by, *out)


def seeded_hash(key, seed) -> Column:
    """md5 of ``key|seed``: an order that any engine can reproduce."""
    k = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", k.cast("string"), s.cast("string")))


def hash_rank(df: DataFrame, key: str, seed, out: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Position of each row in the seeded order of its ``by`` group, for groups of any size.

    md5 is uniform, so its leading digits cut every group into even slices; only the slice counts are
    accumulated per group. The number of digits follows from the row count.
    """
    by = by or []
    digits, slices = 1, 16
    total = df.count()
    while slices * ROWS_PER_RANGE < total:
        digits, slices = digits + 1, slices * 16
    cut = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_slice", F.substring("_h", 1, digits))
    prior = (Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
               .select(*by, "_slice", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off")))
    w = Window.partitionBy(*by, "_slice").orderBy("_h", key)
    ranked = cut.withColumn(out, F.row_number().over(w))
    return (ranked.join(offsets, [*by, "_slice"]).withColumn(out, (F.col(out) + F.col("_off")).cast("bigint"))
            .drop("_h", "_slice", "_off"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
