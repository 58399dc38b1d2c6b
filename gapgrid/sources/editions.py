"""Versioned store of the editions of the analysis: tables per edition, and a manifest that names the complete ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number bigint, label string, tables array<string>"


def editions(spark: SparkSession, root: str) -> DataFrame:
    """(number, label, tables) of the complete editions, none if there is no manifest yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def write_edition(root: str, label: str, tables: dict[str, DataFrame]) -> int:
    """Write the tables of a new edition and return its number.

    The manifest is added to last, so a run that breaks off leaves no edition that could be read; its number is used again and its tables
    are overwritten. One writer at a time is assumed.
    """
    spark = next(iter(tables.values())).sparkSession
    number = (editions(spark, root).agg(F.max("number").alias("n")).first().n or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/edition-{number:06d}/{name}")
    spark.createDataFrame([(number, label, sorted(tables))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return number


def read_edition(spark: SparkSession, root: str, number: int | None = None) -> tuple[str, dict[str, DataFrame]]:
    """(label, tables) of the edition ``number``, by default the last complete one; ``LookupError`` if there is none."""
    rows = editions(spark, root)
    rows = rows if number is None else rows.where(F.col("number") == number)
    last = rows.orderBy(F.desc("number")).first()
    if last is None:
        raise LookupError(f"no edition {'' if number is None else number} in {root}")
    return last.label, {t: spark.read.parquet(f"{root}/edition-{last.number:06d}/{t}") for t in last.tables}
