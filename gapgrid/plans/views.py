"""Stand-in inputs: trips, population points and polylines derived from the given tables by integer arithmetic.

All rows of ``events``, ``customer`` and ``lineitem`` are used; deliberate defects (a week without data, zero
and far origins, null users and distances, exact copies in a second file) exercise the cleaning rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.functions.scalars import batch_of_file
from gapgrid.params import Params, UserThresholds

FILE_A, FILE_B = "2024-01-01_to_2024-01-14_a_2024-10.csv", "2024-01-15_to_2024-01-30_b_2024-20.csv"

NAME = "Chimoré"
BROKEN = NAME.encode().decode("latin-1")  # a name that an export decoded wrongly

# Thresholds that mark some of the synthetic users.
FIXTURE_PARAMS = Params(users=UserThresholds(volume=77, per_active_day=3.65, origin_cells=5, burst=10, repeated_share=0.33,
                                             repeated_min_queries=50, fast_seconds=13_500, min_signals=2))


def _offset(col: str, factor: int, mod: int, shift: int):
    return (F.col(col) * factor) % mod - shift


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "value")
    gap = (F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")) & (
        F.col("ts") < F.lit("2024-01-22 00:00:00").cast("timestamp_ntz"))
    e, u = F.col("event_id"), F.col("user_id")
    hx, hy = _offset("user_id", 7919, 401, 200), _offset("user_id", 6101, 401, 200)
    jx, jy = _offset("event_id", 104729, 41, 20), _offset("event_id", 7907, 41, 20)
    dx, dy = _offset("event_id", 15485863, 61, 30), _offset("event_id", 32452843, 61, 30)
    far = F.when(u % 50 == 9, 300000).otherwise(0)
    label = (u + F.when(e % 11 == 0, 1).otherwise(0)) % 5
    base = ev.select(
        "event_id", F.when(e % 103 != 0, u).alias("user_id"),
        F.when(gap, F.col("ts") + F.expr("interval 7 days")).otherwise(F.col("ts")).alias("ts"),
        F.when(e % 97 == 0, 0.0).when(e % 89 == 0, 40.0).otherwise((-1739358 + hx * 40 + jx * 25 + far) / 1e5).alias("lat_orig"),
        F.when(e % 97 == 0, 0.0).otherwise((-6615701 + hy * 40 + jy * 25) / 1e5).alias("lon_orig"),
        ((-1739358 + hx * 40 + dx * 60) / 1e5).alias("lat_dest"), ((-6615701 + hy * 40 + dy * 60) / 1e5).alias("lon_dest"),
        F.when(e % 101 != 0, F.when(e % 71 == 0, 60000.0).otherwise(F.col("value") * 100)).alias("dist_m"),
        F.when(u % 7 != 0, F.when(label != 3, label.cast("string")).when(e % 3 == 0, BROKEN).otherwise(NAME)).alias("muni"),
        F.explode(F.when(e % 20 == 0, F.array(F.lit(FILE_A), F.lit(FILE_B))).otherwise(F.array(F.lit(FILE_A)))).alias("source_file"))
    return base.withColumn("source_batch", batch_of_file("source_file"))


def population_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("point_id"), ((-1739358 + _offset("c_custkey", 7919, 401, 200) * 45) / 1e5).alias("lat"),
        ((-6615701 + _offset("c_custkey", 6101, 401, 200) * 45) / 1e5).alias("lon"), (1 + (c * 31) % 400).alias("people"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    return line.select(
        F.col("l_orderkey").alias("shape_id"), n.alias("seq"),
        ((-1739358 + _offset("l_orderkey", 613, 301, 150) * 40 + n * 300) / 1e5).alias("lat"),
        ((-6615701 + _offset("l_orderkey", 419, 301, 150) * 40 + n * n * 90) / 1e5).alias("lon"))
