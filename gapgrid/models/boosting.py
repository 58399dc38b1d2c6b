"""Poisson gradient boosting on the rate, weighted by population, with early stopping.

Predictors are cut into at most 255 bins first. The Poisson loss of a zone depends on its bins, population and
count only, so zones with equal bins, fold and reserve flag are summed into one row before any tree grows.
A model's summed rows are bounded by the number of bins, whatever the number of zones, so each model (fold, grid
combination) is one small group, and all models of a search grow side by side. Trees grow level by level.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.functions.ordering import hash_rank, running
from gapgrid.functions.scalars import log1p_design
from gapgrid.params import DEFAULT, PREDICTION_FLOOR, Params
from gapgrid.session import materialize

MAX_BINS, PATIENCE, STOP_TOL = 255, 10, 1e-7

# the growing of one model runs in Python workers, which need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Boosted:
    """Bin edges per predictor and, per model, the base score and its trees.

    A tree is three lists indexed by node (root 1, children 2n and 2n + 1): predictor number or −1 for a leaf,
    the last bin that goes left, and the value.
    """

    edges: dict[str, list[float]]
    base: dict[int, float]
    trees: dict[int, list[tuple[list[int], list[int], list[float]]]] = field(default_factory=dict)
    train_loss: dict[int, list[float]] = field(default_factory=dict)
    reserve_loss: dict[int, list[float]] = field(default_factory=dict)
    settings: dict[int, dict] = field(default_factory=dict)

    def n_iter(self, model: int) -> int:
        return len(self.trees[model])


def bin_edges(rows: DataFrame, p: Params) -> dict[str, list[float]]:
    """Quantile edges of each predictor (at most 254 numbers each)."""
    return {c: _quantile_edges(rows.select(log1p_design(c).alias("v")).where(F.col("v").isNotNull())) for c in p.predictors}


def _quantile_edges(values: DataFrame) -> list[float]:
    """Linear quantiles i / MAX_BINS of ``v``: every counted value tells which quantiles it is a neighbour of."""
    total = values.count()
    if total < 2:
        return sorted(r.v for r in values.collect())
    cum = running(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")), ["v"], sums={"_cum": "n"})
    start, end = F.col("_cum") - F.col("n"), F.col("_cum") - 1
    first = F.greatest(F.lit(1), F.floor((start - 1) * MAX_BINS / (total - 1)))
    last = F.least(F.lit(MAX_BINS - 1), F.ceil((end + 1) * MAX_BINS / (total - 1)))
    near = cum.select("v", start.alias("s"), end.alias("e"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("i"))
    at = F.col("i") * (total - 1)
    low, over = F.floor(at / MAX_BINS), F.pmod(at, F.lit(MAX_BINS))
    high = low + (over > 0).cast("int")
    edges = near.groupBy("i").agg(F.max(F.when(low.between(F.col("s"), F.col("e")), F.col("v"))).alias("a"),
                                  F.max(F.when(high.between(F.col("s"), F.col("e")), F.col("v"))).alias("b"))
    out = edges.select((F.col("a") + (F.col("b") - F.col("a")) * over / MAX_BINS).alias("x")).where("x IS NOT NULL").collect()
    return sorted({r.x for r in out})


def binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Add ``bins``: per predictor, the number of edges below the value."""
    def count_below(name: str, cuts: list[float]):
        lits = F.array(*[F.lit(float(e)) for e in cuts]) if cuts else F.expr("cast(array() as array<double>)")
        return F.size(F.filter(lits, lambda e: e < F.col(f"_v_{name}"))).cast("int")

    vals = rows.select("*", *[log1p_design(c).alias(f"_v_{c}") for c in edges])
    return vals.select(*rows.columns, F.array(*[count_below(c, e) for c, e in edges.items()]).alias("bins"))


def reserve_flag(rows: DataFrame, p: Params, by: list[str] | None = None) -> DataFrame:
    """Mark the early-stopping reserve: a seeded random tenth of the zones (of each ``by`` group), not of the blocks."""
    take = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * p.boosting_reserve, 0))
    ranked = hash_rank(rows, "cell", f"reserve-{p.seed}", "_rn", by)
    if not by:
        return ranked.withColumn("reserve", F.col("_rn") <= rows.agg(take.alias("n")).scalar()).drop("_rn")
    return ranked.join(rows.groupBy(*by).agg(take.alias("_take")), by).withColumn("reserve", F.col("_rn") <= F.col("_take")).drop("_rn", "_take")


def _tree_table(spark, trees: dict[int, list]) -> DataFrame:
    """(model, trees) as a table of one row per model; it holds the fitted trees only, whatever the data."""
    kind = pa.list_(pa.struct([("j", pa.list_(pa.int32())), ("cut", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))
    ids = sorted(trees)
    rows = [[{"j": j, "cut": c, "value": v} for j, c, v in trees[m]] for m in ids]
    return spark.createDataFrame(pa.table({"model": pa.array(ids, pa.int32()), "trees": pa.array(rows, kind)}))


def _leaf(tree: Column, depth: int) -> Column:
    """Leaf reached by the row's bins: one comparison per level."""
    def step(node: Column, _: Column) -> Column:
        j = F.element_at(tree["j"], node)
        right = (F.element_at(F.col("bins"), F.greatest(j, F.lit(0)) + 1) > F.element_at(tree["cut"], node)).cast("int")
        return F.when(j < 0, node).otherwise(2 * node + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)


def _score(depth: int) -> Column:
    """Sum of the leaf values over all trees of the row's model."""
    return F.aggregate("trees", F.lit(0.0), lambda acc, t: acc + F.element_at(t["value"], _leaf(t, depth)))


def _depth(s: dict, p: Params = DEFAULT) -> int:
    return s["max_depth"] or p.boosting_depth


GROWN = ("model int, base double, trees array<struct<j:array<int>,cut:array<int>,value:array<double>>>, "
         "train_loss array<double>, reserve_loss array<double>")


def fit_boosting(rows: DataFrame, settings: dict[int, dict], target: str = "query_count", p: Params = DEFAULT,
                 max_iter: int | None = None) -> Boosted:
    """Fit one model per id; ``rows`` carries ``model``, ``cell``, the predictors and ``reserve``.

    ``settings[model]`` has ``max_depth`` (None: ``p.boosting_depth`` levels), ``min_leaf`` and ``learning_rate``.
    """
    limit = max_iter or p.boosting_max_iter
    depth = {m: _depth(s, p) for m, s in settings.items()}
    size = 2 ** (max(depth.values()) + 1) - 1
    edges = bin_edges(rows, p)
    table = binned(rows, edges).groupBy("model", "reserve", "bins").agg(
        F.sum("population").cast("double").alias("pop"), F.sum(target).cast("double").alias("y"), F.count(F.lit(1)).alias("rows"))

    def grow(group: pa.Table) -> pa.Table:
        m = group["model"][0].as_py()
        bins = group["bins"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        out = grow_model(bins, *(group[c].to_numpy() for c in ("reserve", "pop", "y", "rows")), depth[m], settings[m]["min_leaf"],
                         settings[m]["learning_rate"], limit, size)
        base, trees, train, reserve = out
        kind = pa.list_(pa.struct([("j", pa.list_(pa.int32())), ("cut", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))]))
        return pa.table([pa.array([m], pa.int32()), pa.array([base]), pa.array([[{"j": j, "cut": c, "value": v} for j, c, v in trees]], kind),
                         pa.array([train], pa.list_(pa.float64())), pa.array([reserve], pa.list_(pa.float64()))],
                        names=["model", "base", "trees", "train_loss", "reserve_loss"])

    fit = Boosted(edges, {}, settings=settings)
    # models are few and long to grow: each gets a task of its own
    for r in table.repartition(len(settings), "model").groupBy("model").applyInArrow(grow, GROWN).collect():
        fit.base[r.model] = r.base
        fit.trees[r.model] = [(list(t.j), list(t.cut), list(t.value)) for t in r.trees]
        fit.train_loss[r.model], fit.reserve_loss[r.model] = list(r.train_loss), list(r.reserve_loss)
    if not fit.base:
        raise ValueError("boosting: there are no training rows")
    return fit


def _stopped(losses: list[float]) -> bool:
    """No loss of the last PATIENCE rounds improves on the one before them."""
    if len(losses) <= PATIENCE:
        return False
    return min(losses[-PATIENCE:]) > losses[-PATIENCE - 1] - STOP_TOL


def grow_model(bins, reserve, pop, y, rows, depth: int, min_leaf: int, rate: float, max_iter: int, size: int):
    """(base, trees, losses in training, losses in reserve) of one model from its summed rows."""
    held = reserve.astype(bool)
    own = ~held
    base = float(np.log(max(y[own].sum(), 1e-9) / pop[own].sum())) if own.any() else 0.0
    f = np.full(len(y), base)
    trees, losses = [], ([], [])
    for _ in range(max_iter if own.any() else 0):
        h = pop * np.exp(f)
        tree, leaf = _grow_tree(bins, own, h - y, h, rows, depth, min_leaf, rate, size)
        trees.append(tree)
        f = f + np.array(tree[2])[leaf - 1]
        loss = pop * np.exp(f) - y * f
        for part, into in ((own, losses[0]), (held, losses[1])):
            if part.any():
                into.append(float(loss[part].sum() / pop[part].sum()))
        if _stopped(losses[1]):
            break
    return base, trees, *losses


def _grow_tree(bins, own, g, h, rows, depth: int, min_leaf: int, rate: float, size: int):
    """One tree and every row's leaf. Of equal gains (nine digits) the first predictor and then the lowest cut wins."""
    j, cut, value = [-1] * size, [0] * size, [0.0] * size
    node, open_nodes = np.ones(len(g), np.int64), [1]
    for level in range(depth + 1):
        order = np.array(open_nodes)
        at = np.searchsorted(order, node)
        mine = own & (at < len(order)) & (order[np.minimum(at, len(order) - 1)] == node)
        k, n = at[mine], len(order)
        sums = [np.bincount(k, x[mine], n) for x in (g, h, rows)]
        for i, leaf in enumerate(open_nodes):
            value[leaf - 1] = float(-rate * sums[0][i] / sums[1][i]) if sums[1][i] > 0 else 0.0
        if level == depth:
            break
        best = [(1e-9, -1, 0)] * n
        for c in range(bins.shape[1]):
            cell = k * (MAX_BINS + 1) + bins[mine, c]
            gl, hl, rl = (np.cumsum(np.bincount(cell, x[mine], n * (MAX_BINS + 1)).reshape(n, -1), 1) for x in (g, h, rows))
            gt, ht, rt = (x[:, None] for x in sums)
            with np.errstate(divide="ignore", invalid="ignore"):
                part = lambda a, b: np.where(b > 0, a * a / b, 0.0)
                gain = np.round(part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), 9)
            gain[(rl < min_leaf) | (rt - rl < min_leaf)] = -np.inf
            at_best = gain.argmax(1)
            for i in range(n):
                if gain[i, at_best[i]] > best[i][0]:
                    best[i] = (gain[i, at_best[i]], c, int(at_best[i]))
        grown = []
        for leaf, (_, c, b) in zip(open_nodes, best):
            if c >= 0:
                j[leaf - 1], cut[leaf - 1] = c, b
                here = node == leaf
                node[here] = 2 * leaf + (bins[here, c] > b)
                grown += [2 * leaf, 2 * leaf + 1]
        if not grown:
            break
        open_nodes = sorted(grown)
    return (j, cut, value), node


def predict_boosting(frame: DataFrame, fit: Boosted, p: Params = DEFAULT) -> DataFrame:
    """Expected count (rate times population) under the row's ``model``; one pass over the frame."""
    cols = frame.columns
    depth = max(_depth(s, p) for s in fit.settings.values())
    base = pa.table({"model": pa.array(list(fit.base), pa.int32()), "_f": pa.array(list(fit.base.values()))})
    model = _tree_table(frame.sparkSession, fit.trees).join(frame.sparkSession.createDataFrame(base), "model")
    out = binned(frame, fit.edges).join(F.broadcast(model), "model")
    return out.withColumn("expected", F.exp(F.col("_f") + _score(depth)) * F.col("population")).select(*cols, "expected")


def grid_models(rows: DataFrame, grid: tuple[dict, ...], inner_folds: int, outer: list[int]) -> tuple[DataFrame, dict[int, dict]]:
    """Rows of the search: one model per (outer fold, combination, inner fold), each without its own inner fold.

    ``rows`` carries ``outer`` and ``inner``; model id = (outer · combinations + combination) · inner_folds + fold.
    """
    size = len(grid) * inner_folds
    settings = {o * size + i: grid[i // inner_folds] for o in outer for i in range(size)}
    ids = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i % inner_folds != F.col("inner"))
    return rows.withColumn("model", F.explode(F.transform(ids, lambda i: (F.col("outer") * size + i).cast("int")))), settings


def boosting_searches(rows: DataFrame, outer: list[int], target: str = "query_count", p: Params = DEFAULT, max_iter: int | None = None,
                      grid: tuple[dict, ...] | None = None) -> tuple[dict[int, dict], DataFrame]:
    """(chosen settings per outer fold, table of inner deviance per outer fold and combination); all searches grow side by side."""
    from gapgrid.models.validation import deviance

    grid = grid or p.boosting_grid
    size = len(grid) * p.inner_folds
    rows = materialize(rows, "search")
    parts = reserve_flag(rows, p, ["outer"]).select("cell", "outer", "reserve")
    train, settings = grid_models(rows.join(parts, ["cell", "outer"]), grid, p.inner_folds, outer)
    fit = fit_boosting(train, settings, target, p, max_iter)
    held = rows.withColumn("model", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda c: (
        F.col("outer") * size + c * p.inner_folds + F.col("inner")).cast("int"))))
    pred = predict_boosting(held, fit, p).withColumn("expected", F.greatest("expected", F.lit(PREDICTION_FLOOR)))
    per = pred.groupBy("outer", "model").agg(deviance(target, "expected").alias("dev"))
    score = per.groupBy("outer", F.floor(F.pmod(F.col("model"), F.lit(size)) / p.inner_folds).cast("int").alias("combination")).agg(
        F.avg("dev").alias("inner_deviance"))
    names = F.array(*[F.struct(F.lit(i).alias("combination"), F.lit(g["max_depth"]).cast("int").alias("max_depth"),
                               F.lit(g["min_leaf"]).alias("min_leaf"), F.lit(g["learning_rate"]).alias("learning_rate"))
                      for i, g in enumerate(grid)])
    labels = rows.sparkSession.range(1).select(F.inline(names))
    scored = materialize(score.join(labels, "combination"), "grid")
    best = scored.groupBy("outer").agg(F.min(F.struct("inner_deviance", "combination")).alias("b")).collect()
    return {r.outer: grid[r.b.combination] for r in best}, scored


def boosting_grid_search(rows: DataFrame, target: str = "query_count", p: Params = DEFAULT, max_iter: int | None = None,
                         grid: tuple[dict, ...] | None = None) -> tuple[dict, DataFrame]:
    """(chosen settings, table of inner deviance per combination). ``rows`` carries ``inner`` block folds."""
    chosen, scored = boosting_searches(rows.withColumn("outer", F.lit(0)), [0], target, p, max_iter, grid)
    if not chosen:
        raise ValueError("boosting: there are no training rows")
    return chosen[0], scored.drop("outer")


def boosted_rows(spark, fit: Boosted) -> DataFrame:
    """Stored form: (model, base, trees)."""
    base = pa.table({"model": pa.array(list(fit.base), pa.int32()), "base": pa.array(list(fit.base.values()))})
    return _tree_table(spark, fit.trees).join(spark.createDataFrame(base), "model")


def boosted_from_rows(rows: DataFrame, edges: dict[str, list[float]], settings: dict[int, dict]) -> Boosted:
    """Read ``boosted_rows`` back (a bounded number of trees per model)."""
    fit = Boosted(edges, {}, settings=settings)
    for r in rows.collect():
        fit.base[r.model], fit.trees[r.model] = r.base, [(list(t.j), list(t.cut), list(t.value)) for t in r.trees]
    return fit
