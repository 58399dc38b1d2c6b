"""Weekly trip exports: encodings, header variants, lineage."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.functions import scalars as S
from gapgrid.session import materialize
from gapgrid.sources.records import records, unquoted_fields

# Header variants of the exports and their common names.
RENAMES = {
    "origin_latitude": "lat_orig", "origin_longitude": "lon_orig",
    "destination_latitude": "lat_dest", "destination_longitude": "lon_dest",
    "hora": "hour", "dia_de_semana": "day_of_week", "dia_de_mes": "day_of_month", "fin_de_semana": "weekend",
    "userID": "user_id", "distancia": "dist_m", "origin_municipio": "muni",
}
TYPES = {"lat_orig": "double", "lon_orig": "double", "lat_dest": "double", "lon_dest": "double", "dist_m": "double",
         "hour": "int", "day_of_week": "int", "day_of_month": "int"}
DATE_COLUMN = "date"
SORT_KEYS = ["source_file", "ts", "user_id", "lat_orig", "lon_orig", "lat_dest", "lon_dest"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_facts(rows: DataFrame) -> DataFrame:
    """(path, source_file, encoding, header, raw, columns, rows, copies) of every file of ``rows`` (see ``records``), header-only files too.

    A file is UTF-8 when every record is valid, otherwise Latin-1; the header (``raw`` as read) is the first record of its first split. ``copies`` counts
    the records that look like the header, itself included.
    """
    first = F.min(F.when(F.col("at") == 0, F.struct("i", "value")))
    facts = rows.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"), first.alias("f"), F.count(F.lit(1)).alias("lines"))
    same = rows.join(facts.select("path", F.col("f.value").alias("raw")), "path").where("value = raw").groupBy("path").agg(F.count(F.lit(1)).alias("copies"))
    facts = facts.join(same, "path")
    text = F.when(F.col("ok"), F.col("f.value")).otherwise(_latin(F.col("f.value")))
    return facts.select("path", base_name(F.col("path")).alias("source_file"), F.when(F.col("ok"), "utf-8").otherwise("latin-1").alias("encoding"),
                        text.alias("header"), F.col("f.value").alias("raw"), unquoted_fields(text).alias("columns"), (F.col("lines") - 1).alias("rows"), "copies")


def _latin(text: Column) -> Column:
    return F.decode(text.cast("binary"), "ISO-8859-1")


def detect_encoding(spark: SparkSession, glob: str) -> DataFrame:
    """(path, source_file, encoding) of every file."""
    return file_facts(records(spark, glob)[0]).select("path", "source_file", "encoding")


def declared_period(files: DataFrame, name: str = "source_file") -> DataFrame:
    """First start and last end date declared in names like ``2024-01-01_to_2024-01-07_2024-01.csv``."""
    start = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1)
    end = F.regexp_extract(name, r"_to_(\d{4}-\d{2}-\d{2})", 1)
    return files.agg(F.min(F.when(start != "", start)).alias("period_start"), F.max(F.when(end != "", end)).alias("period_end"))


def read_trip_exports(spark: SparkSession, glob: str, renames: dict[str, str] = RENAMES, types: dict[str, str] = TYPES) -> tuple[DataFrame, DataFrame]:
    """(trips, registry): all exports as one table with common names, lineage, ``ts`` and ISO year and week.

    Passes over the lines: one for open quotes, one for the facts of the files, one for the rows. Every record is parsed once, and a header only
    says which field has which name; names come from the distinct headers (a handful). Columns without a declared type stay text. Quoted
    fields may hold commas, doubled quotes and line breaks (read as line feeds). A record equal to its header is a record. Blank lines
    between records are skipped. The registry has one row per file. Rows are not sorted; see ``stable_sort``.
    """
    every, _ = records(spark, glob)
    facts = materialize(file_facts(every), "file-facts")
    heads = [r.header for r in facts.select("header").distinct().collect() if r.header]
    names = {h: [renames.get(c.strip(), c.strip()) for c in next(csv.reader([h]))] for h in sorted(heads)}
    columns = list(dict.fromkeys(c for cols in names.values() for c in cols))
    width = max([len(c) for c in names.values()], default=1)
    about = facts.select("path", "encoding", "header", "raw", "source_file")
    rows = every.join(about, "path").where("value <> raw").select("value", *about.columns[1:])
    # records that look like the header stand in the facts as often as they occur
    alike = facts.where("copies > 1").withColumn("k", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
    rows = rows.unionByName(alike.select(F.col("raw").alias("value"), *about.columns[1:]))
    rows = rows.withColumn("value", F.when(F.col("encoding") == "utf-8", F.col("value")).otherwise(_latin(F.col("value"))))
    rows = rows.withColumn("_f", F.from_csv("value", ", ".join(f"f{k} string" for k in range(width)), {"escape": '"', "multiLine": "true"}))
    cols = []
    for c in columns:
        field = F.lit(None).cast("string")
        for h, own in names.items():
            if c in own:
                field = F.when(F.col("header") == h, F.col(f"_f.f{own.index(c)}")).otherwise(field)
        cols.append((field.try_cast(types[c]) if c in types else field).alias(c))
    file = F.col("source_file")
    trips = rows.select(*cols, file, S.batch_of_file(file).alias("source_batch"), F.col("encoding").alias("source_encoding"))
    if DATE_COLUMN not in columns:
        trips = trips.withColumn(DATE_COLUMN, F.lit(None).cast("string"))
    trips = trips.withColumn("ts", S.parse_ts_lenient(F.col(DATE_COLUMN)))
    return trips.withColumn("year", S.iso_year("ts")).withColumn("week", S.iso_week("ts")), file_registry(facts)


def stable_sort(trips: DataFrame) -> DataFrame:
    """Order that makes a rewritten file identical; a range sort, so no task holds the whole table."""
    keys = [k for k in SORT_KEYS if k in trips.columns]
    return trips.orderBy(*keys)


def file_registry(facts: DataFrame) -> DataFrame:
    """One row per file, header-only files with 0 rows: batch, encoding, columns and rows."""
    return facts.select("path", "source_file", S.batch_of_file("source_file").alias("source_batch"), F.col("encoding").alias("source_encoding"), "columns", "rows")
