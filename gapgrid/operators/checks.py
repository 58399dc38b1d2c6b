"""Data checks: each returns one row (check, violations, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(name: str, df: DataFrame, count: Column) -> DataFrame:
    return df.agg(F.coalesce(count, F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("ok"))


def check_unique(df: DataFrame, cols: list[str], name: str = "unique") -> DataFrame:
    """Keys that appear more than once."""
    return _row(name, df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")), F.count_if(F.col("n") > 1))


def check_no_nulls(df: DataFrame, cols: list[str] | None = None, name: str = "no_nulls") -> DataFrame:
    total = F.lit(0)
    for c in cols or df.columns:
        total = total + F.col(c).isNull().cast("int")
    return _row(name, df, F.sum(total))


def check_range(df: DataFrame, col: str, low: float | None = None, high: float | None = None, open_low: bool = False,
                name: str | None = None) -> DataFrame:
    bad = F.lit(False)
    if low is not None:
        bad = bad | ((F.col(col) <= low) if open_low else (F.col(col) < low))
    if high is not None:
        bad = bad | (F.col(col) > high)
    return _row(name or f"range_{col}", df, F.count_if(bad))


def check_reconciles(pairs: DataFrame, name: str = "reconciles", tol: float = 0.0) -> DataFrame:
    """``pairs`` has columns ``left`` and ``right``; rows that differ by more than ``tol`` (relative)."""
    scale = F.greatest(F.abs("left"), F.abs("right"), F.lit(1.0))
    return _row(name, pairs, F.count_if(F.abs(F.col("left") - F.col("right")) > tol * scale))


def check_disjoint(a: DataFrame, b: DataFrame, cols: list[str], name: str = "disjoint") -> DataFrame:
    return _row(name, a.select(*cols).intersect(b.select(*cols)), F.count(F.lit(1)))


def set_equal(a: DataFrame, b: DataFrame, cols: list[str], name: str = "set_equal") -> DataFrame:
    x, y = a.select(*cols).distinct(), b.select(*cols).distinct()
    return _row(name, x.exceptAll(y).unionByName(y.exceptAll(x)), F.count(F.lit(1)))


def check_same_as_phase(a: DataFrame, b: DataFrame, name: str = "same_metrics") -> DataFrame:
    """Metrics (metric, value) that both phases report with different values."""
    both = a.select("metric", F.col("value").alias("va")).join(b.select("metric", F.col("value").alias("vb")), "metric")
    return _row(name, both, F.count_if(~F.col("va").eqNullSafe(F.col("vb"))))


def check_fold_integrity(oof: DataFrame, name: str = "fold_integrity") -> DataFrame:
    """Zones predicted more than once per technique plus blocks split over several folds."""
    twice = oof.groupBy("technique", "cell").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    split = oof.groupBy("block_id").agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    return _row(name, twice.unionByName(split), F.sum("v"))


def check_no_leak(coefficients: DataFrame, predictors: list[str], forbidden: list[str], name: str = "no_leak") -> DataFrame:
    """Parameters of a stored fit (rows with ``parameter``) that are forbidden, not declared, or declared and missing."""
    own = coefficients.where(~F.col("parameter").isin("const", "alpha")).select("parameter").distinct()
    bad = F.count_if(F.col("parameter").isin(forbidden)) + F.count_if(~F.col("parameter").isin(predictors))
    return _row(name, own, bad + len(predictors) - F.count_if(F.col("parameter").isin(predictors)))


def check_domain(df: DataFrame, col: str, allowed: list, name: str | None = None) -> DataFrame:
    return _row(name or f"domain_{col}", df, F.count_if(~F.col(col).isin(allowed) | F.col(col).isNull()))


def check_ranking(df: DataFrame, value: str, rank: str, rule: Column, name: str = "ranking") -> DataFrame:
    """Ranked rows that break the rule, plus unranked rows of the rule that beat the worst ranked one."""
    ranked = F.col(rank).isNotNull()
    worst = df.agg(F.max(F.when(ranked, F.col(value))).alias("w")).scalar()
    return _row(name, df, F.count_if(ranked & ~rule) + F.count_if(~ranked & rule & (F.col(value) < worst)))


def check_roundtrip(a: DataFrame, b: DataFrame, name: str = "roundtrip") -> DataFrame:
    return _row(name, a.exceptAll(b).unionByName(b.exceptAll(a)), F.count(F.lit(1)))
