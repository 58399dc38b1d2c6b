"""Ordered cleaning of trip queries with a full account of what each rule removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions import scalars as S
from gapgrid.operators.geometry import StudyArea, add_inside, convex_hull, largest_component, make_area
from gapgrid.params import DEFAULT, LINEAGE, Params
from gapgrid.session import materialize

RULES = {0: "raw", 1: "zero origin", 2: "origin outside the box", 3: "copy of an exact duplicate",
         4: "origin outside the study area", 5: "distance above the maximum", 6: "anomalous user"}


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in LINEAGE]


def _presence(digests: DataFrame, h: str) -> DataFrame:
    """(word, bits): the 2^25 presence bits of the digests ``h`` as at most 2^19 whole numbers, a fixed size."""
    slot = F.pmod(F.col(h), F.lit(1 << 25))
    return digests.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def first_distinct(df: DataFrame, copies: str = "copies", among: Column | None = None) -> DataFrame:
    """One row per set of exact copies, with the lineage of the first file and the number of copies.

    Copies agree on every data column. Digests of the rows are counted first (eight bytes a row are shuffled, and combined before that);
    those that occur twice set bits of a table of fixed size, and only rows whose bit is set are grouped by all their columns. The rest, most
    rows, pass in the map stage. A shared bit or digest costs a shuffled row and changes nothing. Rows outside of ``among`` (not
    true) pass as they are, with one copy each.
    """
    lineage, data = [c for c in LINEAGE if c in df.columns], data_columns(df)
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    rows = df.withColumn("_among", among).withColumn("_h", F.xxhash64(*data))
    twice = rows.where("_among").groupBy("_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = F.broadcast(materialize(_presence(twice, "_h"), "presence"))  # 2^19 rows of two numbers at most
    slot = F.pmod(F.col("_h"), F.lit(1 << 25))
    marked = rows.withColumn("_slot", slot).join(bits, F.shiftright("_slot", 6) == F.col("word"), "left")
    again = F.col("_among") & F.coalesce(F.expr("shiftright(bits, cast(_slot & 63 as int)) & 1L") == 1, F.lit(False))
    marked = marked.withColumn("_again", again)
    aggs = [F.count(F.lit(1)).alias(copies)]
    if lineage:
        aggs.append(F.min(F.struct(*lineage)).alias("_first"))
    merged = marked.where("_again").groupBy(*data).agg(*aggs).select(*data, *[F.col(f"_first.{c}").alias(c) for c in lineage], copies)
    return marked.where("NOT _again").select(*data, *lineage, F.lit(1).cast("long").alias(copies)).unionByName(merged)


def exclude_users(df: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows whose user is known and not listed; rows without a user are dropped even for an empty list."""
    return df.where(F.col(user).isNotNull()).join(users.select(user).distinct(), user, "left_anti")


def valid_origins(trips: DataFrame, anomalous: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Distinct valid origins of users that are not anomalous, with their cell."""
    pts = exclude_users(trips.where(S.valid_origin(p.bbox)).select("user_id", "lat_orig", "lon_orig"), anomalous)
    return (pts.select(F.col("lat_orig").alias("lat"), F.col("lon_orig").alias("lon")).distinct()
            .withColumn("cell", grid.point_to_cell("lat", "lon", p=p)))


def study_area(origins: DataFrame, p: Params = DEFAULT, k: int | None = 1) -> tuple[StudyArea, DataFrame]:
    """(area, cells of the main component); ``k=None`` keeps every cell."""
    cells = origins.select("cell").distinct()
    main = cells if k is None else largest_component(cells, k)
    ring = convex_hull(origins.join(main, "cell", "left_semi"))
    return make_area(ring, p.buffer_m, p), main


def assign_steps(raw: DataFrame, area: StudyArea, anomalous: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per set of copies with ``drop_step``: the first rule that removes it, 0 if it is kept.

    A null in a rule removes the row at that rule. The copies rule only removes surplus copies, so it is not
    a step of the surviving row but is read from ``copies``. Rows that the first two rules remove are not looked at for copies and stand one by one.
    """
    bad = anomalous.select("user_id").distinct().withColumn("_bad", F.lit(True))
    step = (F.when(F.coalesce(S.zero_origin(), F.lit(True)), 1)
            .when(~F.coalesce(S.in_bbox(p.bbox), F.lit(False)), 2)
            .when(~F.col("_inside"), 4)
            .when(F.coalesce(F.col("dist_m") > p.dist_max_m, F.lit(True)), 5)
            .when(F.col("user_id").isNull() | F.coalesce(F.col("_bad"), F.lit(False)), 6).otherwise(0))
    first_two = F.coalesce(S.zero_origin(), F.lit(True)) | ~F.coalesce(S.in_bbox(p.bbox), F.lit(False))
    rows = add_inside(first_distinct(raw, among=~first_two), area, "lat_orig", "lon_orig", "_inside", p)
    return rows.join(bad, "user_id", "left").withColumn("drop_step", step).drop("_bad", "_inside")


def clean_trips(steps: DataFrame, p: Params = DEFAULT) -> DataFrame:
    kept = steps.where("drop_step = 0").drop("drop_step", "copies")
    return kept.withColumn("cell", grid.point_to_cell("lat_orig", "lon_orig", p=p))


def filter_flow(steps: DataFrame) -> DataFrame:
    """Removed and kept rows per rule, from one pass over the assigned steps."""
    surplus = F.when(~F.col("drop_step").isin(1, 2), F.col("copies") - 1).otherwise(0)
    one = steps.agg(F.sum("copies").alias("c0"),
                    *[F.coalesce(F.sum(F.when(F.col("drop_step") == s, F.col("copies"))), F.lit(0)).alias(f"c{s}")
                      for s in (1, 2)],
                    F.coalesce(F.sum(surplus), F.lit(0)).alias("c3"),
                    *[F.count_if(F.col("drop_step") == s).alias(f"c{s}") for s in (4, 5, 6)])
    rows = F.array(*[F.struct(F.lit(s).alias("step"), F.lit(RULES[s]).alias("rule"),
                              (F.lit(0) if s == 0 else F.col(f"c{s}")).cast("bigint").alias("removed"))
                     for s in RULES])
    w = Window.partitionBy("total").orderBy("step")  # seven rows
    return (one.select(F.col("c0").alias("total"), F.inline(rows))
            .withColumn("kept", F.col("total") - F.sum("removed").over(w))
            .select("step", "rule", "removed", "kept",
                    F.round(F.col("kept") / F.col("total") * 100, 3).alias("pct_kept")))
