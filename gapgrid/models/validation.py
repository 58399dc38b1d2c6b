"""Block folds, count metrics, cross-validation, selection rule and expected counts per zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.functions import grid
from gapgrid.functions.ordering import hash_rank, running, union_all
from gapgrid.models.boosting import boosting_grid_search, boosting_searches, fit_boosting, predict_boosting, reserve_flag
from gapgrid.models.counts import FULL_FIT, expected_counts, fit_counts, with_models
from gapgrid.models.rates import GROUP_OF, oof_rates, rate_by_group, rate_global, rate_neighbourhood
from gapgrid.operators.stats import spearman_by
from gapgrid.params import DEFAULT, LADDER, PART_TEST, PART_TRAIN, PREDICTION_FLOOR, Params
from gapgrid.session import materialize

METRICS = ["deviance", "d2", "mae", "calibration", "spearman"]


# ---- folds -----------------------------------------------------------------

def _fold_plan(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, list[int], list[int]]]:
    """Largest blocks first into the lightest fold, by size class: (size, first folds, repeating folds).

    Within a class every block weighs the same, so once the loads differ by less than one block the choice
    repeats with period ``folds``; the plan is as short as the list of distinct sizes, not of blocks.
    """
    load, plan = [0] * folds, []
    for size, count in sizes:
        first: list[int] = []
        while len(first) < count and max(load) - min(load) >= size:
            j = load.index(min(load))
            load[j] += size
            first.append(j)
        rest = count - len(first)
        cycle: list[int] = []
        if rest:
            probe = list(load)
            for _ in range(folds):
                j = probe.index(min(probe))
                probe[j] += size
                cycle.append(j)
            for j in range(folds):
                load[j] += size * (rest // folds)
            for j in cycle[: rest % folds]:
                load[j] += size
        plan.append((size, first, cycle))
    return plan


def block_folds(rows: DataFrame, folds: int, name: str = "fold") -> DataFrame:
    """Add a fold so that every block is whole in one fold and folds are balanced by rows.

    The driver sees only how many blocks there are of each size (a block holds a few dozen zones).
    """
    blocks = rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = [(r["size"], r["n"]) for r in blocks.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]
    order = running(blocks.withColumn("neg", -F.col("block_id")), ["size", "neg"], row_number="pos")
    below, start = {}, 0
    for size, n in reversed(sizes):
        below[size] = start
        start += n
    out = F.lit(None).cast("int")
    for size, first, cycle in _fold_plan(sizes, folds):
        i = F.col("pos") - 1 - below[size]
        pick = F.lit(None).cast("int")
        if cycle:
            pick = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.pmod(i - len(first), F.lit(folds)) + 1).cast("int"))
        if first:
            pick = F.when(i < len(first), F.element_at(F.array(*[F.lit(c) for c in first]),
                                                       (F.least(i, F.lit(len(first) - 1)) + 1).cast("int"))).otherwise(pick)
        out = F.when(F.col("size") == size, pick).otherwise(out)
    return rows.join(order.select("block_id", out.alias(name)), "block_id")


# ---- metrics ---------------------------------------------------------------

def _ylog(y: Column, of: Column) -> Column:
    return F.when(y > 0, y * F.log(y / of)).otherwise(0.0)


def _c(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def deviance(y, yhat) -> Column:
    """Mean Poisson deviance as an aggregate."""
    y, f = _c(y), _c(yhat)
    return 2 * F.avg(_ylog(y, f) - y + f)


def floored(df: DataFrame, expected: str = "expected") -> DataFrame:
    return df.withColumn(expected, F.greatest(F.col(expected).cast("double"), F.lit(PREDICTION_FLOOR)))


def count_metrics(df: DataFrame, observed: str = "observed", expected: str = "expected", by: list[str] | None = None
                  ) -> DataFrame:
    """Deviance, D² against the mean, MAE, calibration, Spearman and n per group."""
    by = by or []
    d = floored(df, expected).withColumn("_g", F.lit(0))
    keys = [*by, "_g"]
    y, f = _c(observed), _c(expected)
    agg = d.groupBy(*keys).agg(
        deviance(observed, expected).alias("deviance"), F.avg(F.abs(y - f)).alias("mae"), F.sum(f).alias("sf"), F.sum(y).alias("sy"),
        F.sum(F.when(y > 0, y * F.log(y)).otherwise(0.0)).alias("syl"), F.count(F.lit(1)).alias("n"))
    ybar = F.col("sy") / F.col("n")
    null_dev = 2 * (F.col("syl") - F.when(F.col("sy") > 0, F.col("sy") * F.log(ybar)).otherwise(0.0)) / F.col("n")
    rho = spearman_by(d, observed, expected, keys)
    return (agg.join(rho, keys, "left")
            .select(*by, "deviance", (1 - F.try_divide(F.col("deviance"), null_dev)).alias("d2"), "mae",
                    F.try_divide("sf", "sy").alias("calibration"), "spearman", "n"))


def d2_against(df: DataFrame, observed: str, expected: str, reference: str) -> DataFrame:
    d = floored(floored(df, expected), reference)
    return d.agg((1 - deviance(observed, expected) / deviance(observed, reference)).alias("d2"))


# ---- cross-validation ------------------------------------------------------

def out_of_fold(rows: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT,
                boosting_iter: int | None = None, boosting_grid: tuple | None = None) -> DataFrame:
    """(rows, expected): each zone predicted by the fit without its fold; ``rows`` carries ``fold``."""
    if technique in ("B0", "B1", "B2", "B3"):
        return floored(oof_rates(rows, technique, target, p))
    folds = list(range(p.folds))
    if technique in ("M1", "M2"):
        train = with_models(rows, folds).where(F.col("model") != FULL_FIT)
        coefs = fit_counts(train, target, p, technique == "M2")
        return floored(expected_counts(rows.withColumn("model", F.col("fold")), coefs, p).drop("model"))
    train = with_models(rows, folds).where(F.col("model") != FULL_FIT)
    chosen, _ = outer_searches(rows, target, p, boosting_iter, boosting_grid)
    parts = reserve_flag(rows, p).select("cell", "reserve")
    fit = fit_boosting(train.join(parts, "cell"), chosen, target, p, boosting_iter)
    return floored(predict_boosting(rows.withColumn("model", F.col("fold")), fit, p).drop("model"))


def outer_searches(rows: DataFrame, target: str = "query_count", p: Params = DEFAULT, boosting_iter: int | None = None,
                   boosting_grid: tuple | None = None) -> tuple[dict[int, dict], DataFrame]:
    """(settings chosen for each fold without its own rows, inner deviance of every combination per fold)."""
    rows = materialize(rows, "outer")
    folds = list(range(p.folds))
    inner = [block_folds(rows.where(F.col("fold") != f), p.inner_folds, "inner").withColumn("outer", F.lit(f)) for f in folds]
    return boosting_searches(union_all(inner), folds, target, p, boosting_iter, boosting_grid)


def select_technique(oof: DataFrame, p: Params = DEFAULT) -> tuple[str, DataFrame]:
    """(the technique that the one-standard-error rule chooses, the rule's table) from out-of-fold predictions."""
    rule = materialize(one_se_rule(count_metrics(oof, by=["technique", "fold"]), p), "rule")
    chosen = rule.where("is_chosen").first()
    if chosen is None:
        raise ValueError("selection: there are no out-of-fold predictions")
    return chosen.technique, rule


def final_fit(train: DataFrame, frame: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT,
              boosting_iter: int | None = None, boosting_grid: tuple | None = None) -> DataFrame:
    """Fit on all training rows and predict ``frame``."""
    if technique == "B0":
        out = rate_global(train, frame, target)
    elif technique in GROUP_OF:
        out = rate_by_group(train, frame, GROUP_OF[technique], target)
    elif technique == "B3":
        out = rate_neighbourhood(train, frame, target, p)
    elif technique in ("M1", "M2"):
        coefs = fit_counts(train.withColumn("model", F.lit(FULL_FIT)), target, p, technique == "M2")
        out = expected_counts(frame.withColumn("model", F.lit(FULL_FIT)), coefs, p).drop("model")
    else:
        best, _ = boosting_grid_search(block_folds(train, p.inner_folds, "inner"), target, p, boosting_iter, boosting_grid)
        full = reserve_flag(train, p).withColumn("model", F.lit(FULL_FIT))
        fit = fit_boosting(full, {FULL_FIT: best}, target, p, boosting_iter)
        out = predict_boosting(frame.withColumn("model", F.lit(FULL_FIT)), fit, p).drop("model")
    return floored(out)


def cross_validate(rows: DataFrame, techniques: list[str], target: str = "query_count", p: Params = DEFAULT, **boost
                   ) -> DataFrame:
    """Out-of-fold predictions (cell, fold, technique, observed, expected) of every technique."""
    return union_all([out_of_fold(rows, t, target, p, **(boost if t == "M3" else {})).select(
        "cell", "block_id", "fold", F.lit(t).alias("technique"), F.col(target).alias("observed"), "expected") for t in techniques])


def cv_summary(fold_metrics: DataFrame, pooled: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over folds next to the pooled out-of-fold metrics."""
    names = ["deviance", "d2", "mae", "spearman"]
    per = fold_metrics.groupBy("technique").agg(*[f(n).alias(f"{n}_{s}") for n in names
                                                  for f, s in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
    return per.join(pooled.select("technique", *[F.col(c).alias(f"oof_{c}") for c in [*METRICS, "n"]]), "technique")


def one_se_rule(fold_metrics: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The simplest technique whose mean deviance is within the tolerance of the best (seven rows at most)."""
    order = F.array_position(F.array(*[F.lit(t) for t in LADDER]), F.col("technique"))
    r = fold_metrics.groupBy("technique").agg(F.avg("deviance").alias("mean"), F.stddev_samp("deviance").alias("sd"),
                                              F.count(F.lit(1)).alias("folds"))
    r = r.withColumn("se", F.col("sd") / F.sqrt("folds")).withColumn("step", order)
    best = r.agg(F.min(F.struct("mean", "step", "technique", "se")).alias("b")).scalar()
    r = r.select("*", best["technique"].alias("best"), (best["mean"] + p.tolerance_se * best["se"]).alias("threshold"))
    r = r.withColumn("within", F.col("mean") <= F.col("threshold"))
    chosen = r.where("within").agg(F.min(F.struct("step", "technique")).alias("c")).scalar()
    return r.select("technique", "mean", "sd", "folds", "se", "within", "threshold",
                    (F.col("technique") == F.col("best")).alias("is_best"),
                    (F.col("technique") == chosen["technique"]).alias("is_chosen"))


def expected_by_zone(train: DataFrame, test: DataFrame, technique: str, target: str = "query_count", p: Params = DEFAULT,
                     **boost) -> DataFrame:
    """Expected count in which no zone sees itself: out of fold for training zones, final fit for test zones."""
    a = out_of_fold(train, technique, target, p, **boost).select("cell", "expected", F.lit(PART_TRAIN).alias("partition"))
    b = final_fit(train, test, technique, target, p, **boost).select("cell", "expected", F.lit(PART_TEST).alias("partition"))
    return a.unionByName(b)


def holdout_leak_share(train: DataFrame, p: Params = DEFAULT, draws: int | None = None) -> DataFrame:
    """Mean % of reserve zones with a first-ring neighbour outside the reserve, over seeded random reserves."""
    cells = train.select("cell")
    n = cells.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * p.boosting_reserve, 0)).alias("n")).scalar()
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws or p.leak_draws))))
    seed = F.concat_ws("-", F.lit(str(p.seed)), F.col("draw").cast("string"))
    reserve = hash_rank(drawn, "cell", seed, "rn", ["draw"]).where(F.col("rn") <= n).select("draw", "cell")
    pairs = grid.neighbour_join(cells, cells, 1).select("src", "dst")
    near = reserve.withColumnRenamed("cell", "src").join(pairs, "src")
    out = near.join(reserve.withColumnRenamed("cell", "dst"), ["draw", "dst"], "left_anti").select("draw", "src").distinct()
    hit = out.groupBy("draw").agg(F.count(F.lit(1)).alias("hit"))
    size = reserve.groupBy("draw").agg(F.count(F.lit(1)).alias("size"))
    return size.join(hit, "draw", "left").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("size") * 100).alias("pct_leak"))
