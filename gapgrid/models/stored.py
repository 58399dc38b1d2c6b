"""Fitted techniques as one kind of table, and predictions from what was stored.

All seven techniques share the columns of ``SCHEMA``: each row is one named part of a fit (a rate, a training zone's counts, a coefficient,
the bin edges of a predictor, a tree). Nothing else is needed to predict: rates and zones are joined, coefficients and trees
become one column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgrid.models import counts
from gapgrid.models.boosting import Boosted, boosting_grid_search, fit_boosting, predict_boosting, reserve_flag
from gapgrid.models.rates import GROUP_OF, growing_disk_rate, lookup_with_default
from gapgrid.models.validation import block_folds, floored
from gapgrid.params import DEFAULT, Params

SCHEMA = ("technique string, kind string, name string, number bigint, value double, weight double, "
          "nodes array<int>, cuts array<int>, numbers array<double>")
GLOBAL, GROUP, ZONE, COEFFICIENT, BASE, EDGES, TREE = "global", "group", "zone", "coefficient", "base", "edges", "tree"


def _part(df: DataFrame, technique: str, kind: str, **columns) -> DataFrame:
    given = {"technique": F.lit(technique), "kind": F.lit(kind), **columns}
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def fit_technique(train: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT, boosting_iter: int | None = None,
                  boosting_grid: tuple | None = None) -> DataFrame:
    """The fit of ``technique`` on all training rows, in stored form."""
    y, pop = F.sum(target).cast("double"), F.sum("population").cast("double")
    whole = _part(train.agg(y.alias("y"), pop.alias("pop")), technique, GLOBAL, value=F.col("y") / F.col("pop"), weight=F.col("pop"))
    if technique == "B0":
        return whole
    if technique in GROUP_OF:
        per = train.groupBy(F.col(GROUP_OF[technique]).alias("g")).agg(y.alias("y"), pop.alias("pop"))
        return whole.unionByName(_part(per, technique, GROUP, name=F.col("g"), value=F.col("y") / F.col("pop"), weight=F.col("pop")))
    if technique == "B3":
        return whole.unionByName(_part(train, technique, ZONE, number=F.col("cell"), value=F.col(target), weight=F.col("population")))
    spark = train.sparkSession
    if technique in ("M1", "M2"):
        fit = counts.fit_counts(train.withColumn("model", F.lit(counts.FULL_FIT)), target, p, technique == "M2")
        rows = counts.coefficient_rows(spark, fit, technique, p)
        return _part(rows, technique, COEFFICIENT, name=F.col("parameter"), value=F.col("value"))
    if technique != "M3":
        raise ValueError(technique)
    best, _ = boosting_grid_search(block_folds(train, p.inner_folds, "inner"), target, p, boosting_iter, boosting_grid)
    full = reserve_flag(train, p).withColumn("model", F.lit(counts.FULL_FIT))
    return boosted_parts(spark, fit_boosting(full, {counts.FULL_FIT: best}, target, p, boosting_iter))


def boosted_parts(spark, fit: Boosted) -> DataFrame:
    """Stored form of the full fit of a boosting: some hundred trees of bounded size, a few hundred edges per predictor."""
    m = counts.FULL_FIT
    rows = [("M3", BASE, "max_depth", fit.settings[m]["max_depth"], fit.base[m], None, None, None, None)]
    rows += [("M3", EDGES, name, i, None, None, None, None, [float(e) for e in e_]) for i, (name, e_) in enumerate(fit.edges.items())]
    rows += [("M3", TREE, None, i, None, None, list(j), list(c), [float(x) for x in v]) for i, (j, c, v) in enumerate(fit.trees[m])]
    return spark.createDataFrame(rows, SCHEMA)


def predict_stored(frame: DataFrame, stored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """``frame`` with ``expected`` under the one technique that ``stored`` holds; ``ValueError`` if it holds none or several."""
    names = [r.technique for r in stored.select("technique").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"stored fit: one technique is wanted, found {sorted(names)}")
    technique = names[0]
    part = lambda kind: stored.where(F.col("kind") == kind)
    if technique in ("B0", "B3") or technique in GROUP_OF:
        rate = part(GLOBAL).select("value").scalar()
        if technique == "B0":
            out = frame.withColumn("_rate", rate)
        elif technique == "B3":
            zones = part(ZONE).select(F.col("number").alias("cell"), F.col("value").alias("_y"), F.col("weight").alias("population"))
            out = lookup_with_default(frame, growing_disk_rate(frame, zones, "_y", p), "cell", "_rate", rate)
        else:
            g = GROUP_OF[technique]
            out = lookup_with_default(frame, part(GROUP).select(F.col("name").alias(g), F.col("value").alias("_rate")), g, "_rate", rate)
        return floored(out.withColumn("expected", F.col("_rate") * F.col("population")).drop("_rate"))
    whole = frame.withColumn("model", F.lit(counts.FULL_FIT))
    if technique in ("M1", "M2"):
        rows = part(COEFFICIENT).select(F.lit(counts.FULL_FIT).alias("model"), F.col("name").alias("parameter"), "value")
        return floored(counts.expected_counts(whole, counts.coefs_from_rows(rows, p), p).drop("model"))
    m = counts.FULL_FIT
    base = part(BASE).first()
    fit = Boosted({r.name: list(r.numbers) for r in part(EDGES).orderBy("number").collect()}, {m: base.value}, settings={m: {"max_depth": base.number}})
    fit.trees[m] = [(list(r.nodes), list(r.cuts), list(r.numbers)) for r in part(TREE).orderBy("number").collect()]
    return floored(predict_boosting(whole, fit, p).drop("model"))
