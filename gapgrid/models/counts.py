"""Poisson and negative binomial (NB2) regressions with a log-population offset.

Reweighted least squares on the DataFrame: each pass is one aggregation of the normal equations, grouped by
model, so all folds advance together; only p×p sums per model reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgrid.functions.scalars import log1p_design, log_offset
from gapgrid.params import DEFAULT, Params

FULL_FIT = -1  # model id of the fit on all training rows
ALPHA = "alpha"


def design(frame: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The frame with one ``x_<predictor>`` column per predictor and the offset."""
    return frame.select("*", *[log1p_design(c).alias(f"x_{c}") for c in p.predictors], log_offset().alias("off"))


def poisson_glm(train: DataFrame, target: str = "query_count", p: Params = DEFAULT):
    """M1 through Spark ML (log link, offset, at most 200 iterations); returns the fitted model."""
    data = VectorAssembler(inputCols=[f"x_{c}" for c in p.predictors], outputCol="features").transform(design(train, p))
    glr = GeneralizedLinearRegression(family="poisson", link="log", labelCol="y", offsetCol="off", maxIter=200, tol=1e-10)
    return glr.fit(data.withColumn("y", F.col(target).cast("double")))


def _psi(x, log=F.log):
    """Digamma for x > 0 (column or number): recurrence to x + 8, then the asymptotic series."""
    z = x + 8
    r = 1 / (z * z)
    return log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - sum(1 / (x + i) for i in range(8))


def _psi1(x):
    """Trigamma for x > 0 (column or number)."""
    z = x + 8
    r = 1 / (z * z)
    return 1 / z + r / 2 + r / z * (1 / 6 - r * (1 / 30 - r / 42)) + sum(1 / ((x + i) * (x + i)) for i in range(8))


def _lgamma(x, log=F.log):
    """Logarithm of the gamma function for x > 0 (column or number), in the same way."""
    z = x + 8
    r = 1 / (z * z)
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    return (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - log(low)


def with_models(rows: DataFrame, folds: list[int]) -> DataFrame:
    """Each training row once per model it trains: the full fit and every fold but its own."""
    ids = [FULL_FIT, *folds]
    models = F.filter(F.array(*[F.lit(i) for i in ids]), lambda m: m != F.col("fold"))
    return rows.withColumn("model", F.explode(models))


def _pick(coefs: dict[int, np.ndarray], j: int) -> Column:
    """Coefficient ``j`` of the row's model, as literals."""
    out = F.lit(None).cast("double")
    for m, b in coefs.items():
        out = F.when(F.col("model") == m, float(b[j])).otherwise(out)
    return out


def _linear(coefs: dict[int, np.ndarray], names: list[str]) -> Column:
    eta = _pick(coefs, 0)
    for j, n in enumerate(names, start=1):
        eta = eta + _pick(coefs, j) * F.col(n)
    return eta


def fit_counts(rows: DataFrame, target: str = "query_count", p: Params = DEFAULT, dispersion: bool = False,
               max_iter: int = 100, tol: float = 1e-8) -> dict[int, np.ndarray]:
    """Coefficients (intercept, predictors…, and alpha with ``dispersion``) per model id.

    Without training rows, or if the passes do not settle, a ``ValueError`` says so; nothing unfinished is returned.

    ``rows`` carries ``model``. The NB2 fit starts at the Poisson solution and moves all coefficients and the dispersion together. Where the
    counts scatter no more than Poisson counts, the NB2 likelihood has no maximum: alpha is then 0, the Poisson limit, with its coefficients.
    """
    names = [f"x_{c}" for c in p.predictors]
    data = design(rows, p).select("model", F.col(target).cast("double").alias("y"), "off", *names).persist()
    try:
        first = {r.model: math.log(max(r.y, 1e-9) / r.pop) for r in data.groupBy("model").agg(
            F.sum("y").alias("y"), F.sum(F.exp("off")).alias("pop")).collect()}
        if not first:
            raise ValueError("count regression: there are no training rows")
        beta = {m: np.r_[b, np.zeros(len(names))] for m, b in first.items()}
        beta = _passes(data, names, beta, max_iter, tol)
        return _joint_newton(data, names, beta, max_iter, tol) if dispersion else beta
    finally:
        data.unpersist()


def _model_rows(spark, values: dict[int, np.ndarray]) -> DataFrame:
    """One row per model: its id and its numbers c0, c1, …"""
    size = len(next(iter(values.values())))
    return spark.createDataFrame([(int(m), *map(float, v)) for m, v in values.items()], "model int, " + ", ".join(f"c{j} double" for j in range(size)))


def _with_linear(data: DataFrame, names: list[str], values: dict[int, np.ndarray]) -> DataFrame:
    """``data`` with its model's numbers, ``lin`` and ``mu``; the numbers travel as a table of one row per model, so the plan stays the same."""
    lin = F.col("c0")
    for j, n in enumerate(names, start=1):
        lin = lin + F.col(f"c{j}") * F.col(n)
    cur = data.join(F.broadcast(_model_rows(data.sparkSession, values)), "model")
    return cur.withColumn("lin", lin).withColumn("mu", F.exp(F.col("lin") + F.col("off")))


def _passes(data: DataFrame, names: list[str], beta: dict, max_iter: int, tol: float) -> dict:
    """Poisson coefficients by reweighted least squares."""
    size = len(names) + 1
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    for _ in range(max_iter):
        cur = _with_linear(data, names, beta).withColumn("work", F.col("lin") + (F.col("y") - F.col("mu")) / F.col("mu"))
        sums = [F.sum(F.col("mu") * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(size) for j in range(i, size)]
        sums += [F.sum(F.col("mu") * x[i] * F.col("work")).alias(f"b{i}") for i in range(size)]
        shift = 0.0
        for r in cur.groupBy("model").agg(*sums).collect():
            a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
            new = np.linalg.solve(a, np.array([r[f"b{i}"] for i in range(size)]))
            shift = max(shift, float(np.max(np.abs(new - beta[r.model]) / (np.abs(beta[r.model]) + 1e-3))))
            beta[r.model] = new
        if shift < tol:
            return beta
    raise ValueError(f"count regression: no convergence in {max_iter} passes (last change {shift:.3g}, wanted {tol:.3g})")


def _joint_newton(data: DataFrame, names: list[str], beta: dict, max_iter: int, tol: float) -> dict:
    """NB2 coefficients and alpha by Newton steps on (coefficients, log theta), theta = 1 / alpha, from one aggregation per pass.

    A pass gives the log-likelihood, its gradient and its second derivatives at the point that was tried. A point that is worse than the one
    before is given up for one half as far. The excess of the squared Poisson residuals over the counts tells whether there is a maximum,
    and gives the first theta.
    """
    size = len(names) + 1
    x = [F.lit(1.0), *[F.col(n) for n in names]]
    y, mu = F.col("y"), F.col("mu")
    out, point = {}, {}
    for r in _with_linear(data, names, beta).groupBy("model").agg(F.sum((y - mu) * (y - mu) - y).alias("excess"), F.sum(mu * mu).alias("mm")).collect():
        if r.excess <= 0:
            out[r.model] = np.r_[beta[r.model], 0.0]
        else:
            point[r.model] = np.r_[beta[r.model], math.log(r.mm / r.excess)]
    t = F.exp(F.col(f"c{size}"))
    q = (y + t) / (t + mu)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(-mu * t * (t + y) / ((t + mu) * (t + mu)) * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs]
    sums += [F.sum((y - mu) * mu / ((t + mu) * (t + mu)) * x[i]).alias(f"m{i}") for i in range(size)]
    sums += [F.sum((y - mu) * t / (t + mu) * x[i]).alias(f"g{i}") for i in range(size)]
    sums += [F.sum(_psi(y + t) - _psi(t) + F.log(t) + 1 - F.log(t + mu) - q).alias("s1"),
             F.sum(_psi1(y + t) - _psi1(t) + 1 / t - 2 / (t + mu) + q / (t + mu)).alias("s2"),
             F.sum(_lgamma(y + t) - _lgamma(t) + t * F.log(t) + y * F.log(mu) - (y + t) * F.log(t + mu)).alias("ll")]
    best: dict[int, float] = {}
    step: dict[int, np.ndarray] = {}
    for _ in range(max_iter):
        if not point:
            return out
        for r in _with_linear(data.where(F.col("model").isin(list(point))), names, point).groupBy("model").agg(*sums).collect():
            m, here = r.model, point[r.model]
            if m in best and not r.ll >= best[m] - 1e-10 * (1 + abs(best[m])):
                step[m] = step[m] / 2
                point[m] = here - step[m]
                continue
            best[m], th = r.ll, math.exp(here[size])
            g = np.array([*[r[f"g{i}"] for i in range(size)], th * r.s1])
            h = np.empty((size + 1, size + 1))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"a{i}_{j}"]
            h[size, :size] = h[:size, size] = [th * r[f"m{i}"] for i in range(size)]
            h[size, size] = th * th * r.s2 + th * r.s1
            if np.linalg.eigvalsh(h)[-1] >= 0:  # not a hill here: leave out what couples theta, and climb along it
                h[size, :size] = h[:size, size] = 0.0
                h[size, size] = -abs(h[size, size]) - 1e-9
            move = np.linalg.solve(h, -g)
            move[size] = max(-2.0, min(2.0, move[size]))
            if float(np.max(np.abs(move) / (np.abs(here) + 1e-3))) < tol:
                end = here + move
                out[m] = np.r_[end[:size], math.exp(-end[size])]
                del point[m]
            else:
                step[m], point[m] = move, here + move
    raise ValueError(f"count regression: no convergence in {max_iter} passes of models {sorted(point)}")


def expected_counts(frame: DataFrame, coefs: dict[int, np.ndarray], p: Params = DEFAULT) -> DataFrame:
    """Expected count under the row's ``model``."""
    names = [f"x_{c}" for c in p.predictors]
    cols = frame.columns
    return design(frame, p).withColumn("expected", F.exp(_linear(coefs, names) + F.col("off"))).select(*cols, "expected")


def coefficient_rows(spark, coefs: dict[int, np.ndarray], technique: str, p: Params = DEFAULT) -> DataFrame:
    """(technique, model, parameter, value): the stored form of a fitted count model."""
    names = ["const", *p.predictors, ALPHA]
    return spark.createDataFrame([(technique, int(m), n, float(v)) for m, b in coefs.items() for n, v in zip(names, b)],
                                 "technique string, model int, parameter string, value double")


def coefficient_table(poisson: DataFrame, negbin: DataFrame) -> DataFrame:
    """Parameters of both fits side by side; alpha exists only for NB2."""
    a = poisson.where(F.col("model") == FULL_FIT).select("parameter", F.round("value", 4).alias("poisson"))
    b = negbin.where(F.col("model") == FULL_FIT).select("parameter", F.round("value", 4).alias("negbin"))
    return a.join(b, "parameter", "full")


def coefs_from_rows(df: DataFrame, p: Params = DEFAULT) -> dict[int, np.ndarray]:
    """Read back ``coefficient_rows`` (a few numbers per model)."""
    names = ["const", *p.predictors, ALPHA]
    out: dict[int, dict] = {}
    for r in df.collect():
        out.setdefault(r.model, {})[r.parameter] = r.value
    return {m: np.array([v[n] for n in names if n in v]) for m, v in out.items()}


def pearson_dispersion(pred: DataFrame, n_params: int, target: str = "query_count") -> DataFrame:
    """Pearson chi-square over residual degrees of freedom."""
    y, mu = F.col(target), F.col("expected")
    return pred.agg((F.sum((y - mu) * (y - mu) / mu) / (F.count(F.lit(1)) - n_params)).alias("dispersion"))


def expected_zeros(pred: DataFrame, technique: str, target: str = "query_count", alpha: float | None = None) -> DataFrame:
    """Observed zeros against those a model expects; rate techniques only count zones below one half."""
    mu = F.col("expected")
    nb2 = F.pow(1 + alpha * mu, F.lit(-1.0 / alpha)) if alpha else F.exp(-mu)  # alpha 0 is the Poisson limit
    zero = {"M1": F.exp(-mu), "M2": nb2}.get(technique)
    agg = pred.agg(F.count_if(F.col(target) == 0).alias("observed_zeros"),
                   (F.sum(zero) if zero is not None else F.max(F.lit(None).cast("double"))).alias("expected_zeros"),
                   F.count_if(mu < 0.5).alias("zones_below_half"))
    return agg.select(F.lit(technique).alias("technique"), "observed_zeros", "expected_zeros",
                      F.try_divide("expected_zeros", "observed_zeros").alias("ratio"), "zones_below_half")
