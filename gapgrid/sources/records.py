"""Records of CSV files over several lines, read by splits.

Spark reads the physical lines of a file split by split. A quoted field may hold line breaks, so whether a line begins a record depends
on all lines before it. Every line is a function of one bit, "are we inside a quoted field?"; for nearly all lines it is the
identity. A split reports what it makes of either bit, these few facts are chained over the splits of a file, and each split then knows
with which bit it begins. Only files in which some line leaves a quote open take this path; the lines of all others are their
records, and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapgrid.session import materialize

# A quoted field (quotes inside are doubled) and a plain one; what follows a closing quote belongs to the field.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|[^,"][^,]*+|)'
#: Lines that end outside of quotes if they begin outside, and if they begin inside.
_CLOSED = rf"^{_FIELD}(?:,{_FIELD})*+$"
_CLOSES = rf'^[^"]*+(?:""[^"]*+)*+"(?!")[^,]*+(?:,{_FIELD})*+$'


def lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, at, i, value): physical lines; ``at`` is where their split begins, ``i`` rises within a split."""
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
                                        F.monotonically_increasing_id().alias("i"), "value")


def left_open(value: Column) -> Column:
    """Whether a line that begins outside of quotes ends inside."""
    return F.when(~value.contains('"'), False).otherwise(~value.rlike(_CLOSED))


def stays_open(value: Column) -> Column:
    """Whether a line that begins inside of quotes ends inside."""
    return F.when(~value.contains('"'), True).otherwise(~value.rlike(_CLOSES))


def unquoted_fields(value: Column) -> Column:
    """Number of fields of a record."""
    return F.size(F.split(F.regexp_replace(value, r'(?s)"[^"]*+(?:""[^"]*+)*+"', "q"), ","))


def joined_records(some: DataFrame) -> DataFrame:
    """(path, at, i, value) of the records of the files whose lines ``some`` holds; the lines of a record are joined by line feeds.

    ``ValueError`` names the files whose last quote is never closed.
    """
    some = materialize(some, "open-lines")  # the line numbers must not change from here on
    here = Window.partitionBy("path", "at").orderBy("i")  # lines of one split
    outside, inside = left_open(F.col("value")).cast("int"), stays_open(F.col("value")).cast("int")
    # of the four functions of a bit: two are constant, one keeps it, one flips it
    fixed = F.when(outside == inside, outside)
    flips = F.when((outside == 1) & (inside == 0), 1).otherwise(0)
    rows = some.withColumn("fixed", fixed).withColumn("flips", flips)
    before, upto = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.sum("flips").over(upto)).withColumn("c", F.col("fixed") - F.col("n"))
    rows = rows.withColumn("base", F.last("c", ignorenulls=True).over(before)).withColumn("turns", F.coalesce(F.lag("n").over(here), F.lit(0)))
    rows = materialize(rows.withColumn("base_after", F.last("c", ignorenulls=True).over(upto)), "open-bits")
    # one row per split: the bit behind it as a constant, or the flips that it adds
    ends = rows.groupBy("path", "at").agg(F.max_by(F.struct("base_after", "n"), "i").alias("e")).select(
        "path", "at", F.pmod(F.col("e.base_after") + F.col("e.n"), F.lit(2)).alias("set"), F.when(F.col("e.base_after").isNull(), F.col("e.n")).otherwise(0).alias("adds"))
    file = Window.partitionBy("path").orderBy("at")
    ends = ends.withColumn("sum", F.sum("adds").over(file)).withColumn("c", F.col("set") - F.col("sum"))
    bit = lambda frame: F.pmod(F.coalesce(F.last("c", ignorenulls=True).over(frame), F.lit(0)) + F.coalesce(F.sum("adds").over(frame), F.lit(0)), F.lit(2))
    ends = materialize(ends.withColumn("start", bit(file.rowsBetween(Window.unboundedPreceding, -1))).withColumn("stop", bit(file.rowsBetween(Window.unboundedPreceding, 0))), "split-bits")
    bad = ends.groupBy("path").agg(F.max_by("stop", "at").alias("stop")).where("stop = 1").limit(5).collect()
    if bad:
        raise ValueError("a quote is never closed in " + ", ".join(r.path for r in bad))
    open_bit = F.pmod(F.coalesce("base", "start") + F.col("turns"), F.lit(2))
    rows = rows.join(ends.select("path", "at", "start"), ["path", "at"]).withColumn("first", F.when(open_bit == 0, F.col("i")))
    rows = rows.withColumn("own", F.last("first", ignorenulls=True).over(upto))
    # a record that begins in an earlier split
    starts = materialize(rows.groupBy("path", "at").agg(F.max(F.when(F.col("first").isNotNull(), F.struct("at", "first"))).alias("s")), "split-starts")
    starts = starts.withColumn("earlier", F.last("s", ignorenulls=True).over(file.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(starts.select("path", "at", "earlier"), ["path", "at"])
    key = F.when(F.col("own").isNotNull(), F.struct("at", F.col("own").alias("first"))).otherwise(F.col("earlier"))
    parts = F.array_sort(F.collect_list(F.struct("at", "i", "value")))
    return rows.withColumn("key", key).groupBy("path", "key").agg(F.transform(parts, lambda x: x["value"]).alias("v")).select(
        "path", F.col("key.at").alias("at"), F.col("key.first").alias("i"), F.array_join("v", "\n").alias("value"))


def records(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(records, open files): ``path``, ``at``, ``i``, ``value`` of every record that is not blank; paths of the files with records over several lines."""
    every = lines(spark, glob)
    broken = materialize(every.groupBy("path").agg(F.bool_or(left_open(F.col("value"))).alias("open")).where("open").select("path"), "open-files")
    if broken.isEmpty():
        return every.where(F.trim("value") != ""), broken
    plain = every.join(broken, "path", "left_anti")
    return plain.unionByName(joined_records(every.join(broken, "path", "left_semi"))).where(F.trim("value") != ""), broken
