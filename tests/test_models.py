"""Fitted models by invariants, folds by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgrid.models import boosting, counts, rates
from gapgrid.models import validation as V
from gapgrid.operators import checks
from gapgrid.params import DEFAULT


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(3)
    n = 400
    d, ring, pop = rnd.uniform(0, 20, n), rnd.integers(0, 5000, n), rnd.integers(10, 900, n)
    mu = pop * np.exp(-3 - 0.12 * d + 0.1 * np.log1p(ring))
    y = rnd.poisson(mu * rnd.gamma(2.0, 0.5, n))
    data = [(i, int(i // 10), int(y[i]), int(pop[i]), float(d[i]), int(ring[i]), int(i // 10 % 5)) for i in range(n)]
    return spark.createDataFrame(data, "cell long, block_id long, query_count long, population long, dist_centre_km double, pop_ring1 long, fold int").persist()


def test_poisson_solves_its_score_equations_and_agrees_with_ml(rows):
    beta = counts.fit_counts(rows.withColumn("model", F.lit(-1)))[-1]
    model = counts.poisson_glm(rows)
    assert np.allclose(beta, [model.intercept, *model.coefficients], atol=1e-6)
    pred = counts.expected_counts(rows.withColumn("model", F.lit(-1)), {-1: beta})
    s = counts.design(pred).agg(*[F.sum((F.col("query_count") - F.col("expected")) * x) for x in (
        F.lit(1.0), F.col("x_dist_centre_km"), F.col("x_pop_ring1"))]).first()
    assert max(map(abs, s)) < 1e-4


def test_negbin_is_at_its_maximum(rows):
    fit = counts.fit_counts(rows.withColumn("model", F.lit(-1)), dispersion=True)[-1]
    pdf = counts.design(rows).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf.x_dist_centre_km, pdf.x_pop_ring1])
    y, off = pdf.query_count.to_numpy(float), pdf.off.to_numpy()

    def loglik(b):
        mu, a = np.exp(x @ b[:3] + off), b[3]
        r = 1 / a
        lg = np.vectorize(math.lgamma)
        return (lg(y + r) - lg(r) - lg(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))).sum()

    best = loglik(fit)
    assert fit[3] > 0
    for j in range(4):
        for h in (1e-3, -1e-3):
            moved = fit.copy()
            moved[j] += h * max(1.0, abs(fit[j]))
            assert loglik(moved) <= best + 1e-7


def test_fold_models_equal_separate_fits(rows):
    together = counts.fit_counts(counts.with_models(rows, [0, 1]))
    alone = counts.fit_counts(rows.where("fold <> 1").withColumn("model", F.lit(1)))
    assert np.allclose(together[1], alone[1], atol=1e-7)


def test_boosting_loss_falls_and_respects_leaf_size(rows):
    data = boosting.reserve_flag(rows, DEFAULT).withColumn("model", F.lit(0))
    fit = boosting.fit_boosting(data, {0: {"max_depth": 2, "min_leaf": 20, "learning_rate": 0.1}}, max_iter=4)
    loss = fit.train_loss[0]
    assert all(b < a for a, b in zip(loss, loss[1:])) and fit.n_iter(0) <= 4
    pred = boosting.predict_boosting(rows.withColumn("model", F.lit(0)), fit)
    assert pred.where("expected <= 0 OR expected IS NULL").isEmpty()
    per_rate = pred.groupBy(F.round(F.col("expected") / F.col("population"), 10)).count().agg(F.min("count")).first()[0]
    assert per_rate >= 1


def test_boosting_leaves_and_stop_rule(rows):
    data = boosting.reserve_flag(rows, DEFAULT).withColumn("model", F.lit(3))
    fit = boosting.fit_boosting(data, {3: {"max_depth": None, "min_leaf": 25, "learning_rate": 0.1}})
    n = fit.n_iter(3)
    assert n == DEFAULT.boosting_max_iter or boosting._stopped(fit.reserve_loss[3])
    assert not any(boosting._stopped(fit.reserve_loss[3][:k]) for k in range(n))
    # the first tree: leaf sizes, and leaf values from the sums of its zones
    j, cut, value = fit.trees[3][0]
    own = boosting.binned(data, fit.edges).where("NOT reserve").toPandas()
    rate = own.query_count.sum() / own.population.sum()
    leaves = {}
    for b, y, pop in zip(own.bins, own.query_count, own.population):
        node = 1
        while j[node - 1] >= 0:
            node = 2 * node + int(b[j[node - 1]] > cut[node - 1])
        s = leaves.setdefault(node, [0, 0.0, 0.0])
        s[0] += 1
        s[1] += y
        s[2] += pop * rate
    for node, (size, y, h) in leaves.items():
        assert size >= 25 and math.isclose(value[node - 1], 0.1 * (y - h) / h, rel_tol=1e-9)


def test_boosting_survives_storage(rows, tmp_path):
    from gapgrid.sources import tables

    data = boosting.reserve_flag(rows, DEFAULT).withColumn("model", F.lit(0))
    setting = {0: {"max_depth": 2, "min_leaf": 20, "learning_rate": 0.1}}
    fit = boosting.fit_boosting(data, setting, max_iter=5)
    tables.save_estimator(boosting.boosted_rows(rows.sparkSession, fit), str(tmp_path / "t"))
    back = boosting.boosted_from_rows(tables.load_estimator(rows.sparkSession, str(tmp_path / "t")), fit.edges, setting)
    frame = rows.withColumn("model", F.lit(0))
    a, b = (boosting.predict_boosting(frame, x).agg(F.sum("expected")).first()[0] for x in (fit, back))
    assert a == b


def test_regressions_say_when_they_fail(rows):
    with pytest.raises(ValueError, match="no training rows"):
        counts.fit_counts(rows.limit(0).withColumn("model", F.lit(0)))
    with pytest.raises(ValueError, match="no convergence"):
        counts.fit_counts(rows.withColumn("model", F.lit(0)), max_iter=2)


def greedy(sizes, n):
    load, out = [0] * n, {}
    for b, s in sorted(sizes.items(), key=lambda kv: (-kv[1], -kv[0])):
        j = load.index(min(load))
        load[j] += s
        out[b] = j
    return out


@pytest.mark.parametrize("seed", range(4))
def test_block_folds_equal_the_greedy_assignment(spark, seed):
    rnd = random.Random(seed)
    sizes = {b: rnd.choice([1, 2, 3, 7, 7, 20]) for b in range(60)}
    df = spark.createDataFrame([(b * 100 + i, b) for b, s in sizes.items() for i in range(s)], "cell long, block_id long")
    got = {r.block_id: r.fold for r in V.block_folds(df, 5).select("block_id", "fold").distinct().collect()}
    assert got == greedy(sizes, 5)


def test_oof_never_uses_its_own_fold(rows):
    base = rows.withColumn("municipality", (F.col("cell") % 3).cast("string")).withColumn("distance_ring", F.lit("A1"))
    pdf = base.toPandas()
    got = {r.cell: r.expected for r in rates.oof_rates(base, "B1").collect()}
    for _, r in pdf.sample(30, random_state=1).iterrows():
        tr = pdf[(pdf.fold != r.fold) & (pdf.municipality == r.municipality)]
        assert math.isclose(got[r.cell], tr.query_count.sum() / tr.population.sum() * r.population, rel_tol=1e-12)


def test_unseen_group_falls_back_to_the_global_rate(rows):
    train = rows.withColumn("municipality", F.lit("a"))
    frame = rows.limit(5).withColumn("municipality", F.lit("new"))
    a = rates.rate_by_group(train, frame, "municipality").agg(F.sum("expected")).first()[0]
    b = rates.rate_global(train, frame).agg(F.sum("expected")).first()[0]
    assert math.isclose(a, b, rel_tol=1e-12)


def test_metrics_of_a_perfect_prediction(rows):
    m = V.count_metrics(rows.select(F.col("query_count").alias("observed"), F.greatest("query_count", F.lit(1e-6)).alias("expected"))).first()
    assert abs(m.deviance) < 1e-4 and m.d2 > 0.9999 and m.mae < 1e-5 and math.isclose(m.spearman, 1.0, abs_tol=1e-9)


def test_cross_validation_integrity(stages):
    assert checks.check_fold_integrity(stages.oof).first().ok
    assert stages.oof.where("expected <= 0").isEmpty()


def test_rule_prefers_the_simplest_within_one_error(spark):
    df = spark.createDataFrame([("B0", f, 10.0 + f) for f in range(4)] + [("B1", f, 9.5 + f) for f in range(4)]
                               + [("M1", f, 30.0 + f) for f in range(4)], "technique string, fold int, deviance double")
    out = {r.technique: r for r in V.one_se_rule(df).collect()}
    assert out["B0"].is_chosen and out["B1"].is_best and not out["M1"].within


def test_counts_without_excess_scatter_give_the_poisson_limit(spark):
    rnd = np.random.default_rng(4)
    data = [(i, int(i % 3), float(v), int(k)) for i, (v, k) in enumerate(zip(rnd.uniform(0, 9, 200), rnd.integers(0, 900, 200)))]
    df = spark.createDataFrame([(i, 3 + b, 50, v, k) for i, b, v, k in data], "cell long, query_count long, population long, dist_centre_km double, pop_ring1 long")
    df = df.withColumn("model", F.lit(-1))
    fit, plain = counts.fit_counts(df, dispersion=True)[-1], counts.fit_counts(df)[-1]
    assert fit[-1] == 0.0 and np.allclose(fit[:-1], plain)
    zeros = counts.expected_zeros(counts.expected_counts(df, {-1: plain}), "M2", alpha=0.0).first()
    assert np.isclose(zeros.expected_zeros, counts.expected_zeros(counts.expected_counts(df, {-1: plain}), "M1").first().expected_zeros)


def test_stored_fits_predict_as_in_memory(spark, rows, tmp_path):
    from gapgrid.functions import grid
    from gapgrid.models import stored
    from gapgrid.params import LADDER
    from gapgrid.sources import tables

    cell = grid.pack(F.col("cell") % 20, F.floor(F.col("cell") / 20), 8)
    frame = rows.withColumn("municipality", F.concat(F.lit("m"), (F.col("cell") % 7).cast("string"))).withColumn("distance_ring", F.concat(F.lit("A"), (F.col("block_id") % 4).cast("string")))
    frame = frame.withColumn("cell", cell)
    train, test = frame.where("block_id % 6 <> 0").persist(), frame.where("block_id % 6 = 0").withColumn("municipality", F.when(F.col("query_count") % 5 > 0, F.col("municipality")))
    quick = {"boosting_iter": 6, "boosting_grid": ({"max_depth": 2, "min_leaf": 3, "learning_rate": 0.1},)}
    for technique in LADDER:
        more = quick if technique == "M3" else {}
        path = f"{tmp_path}/{technique}"
        tables.save_estimator(stored.fit_technique(train, technique, **more), path)
        back = tables.load_estimator(spark, path)
        assert back.schema == spark.createDataFrame([], stored.SCHEMA).schema
        got = {r.cell: r.expected for r in stored.predict_stored(test, back).collect()}
        want = {r.cell: r.expected for r in V.final_fit(train, test, technique, **more).collect()}
        assert len(got) > 50 and got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 * max(1, want[c]) for c in want), technique
    with pytest.raises(ValueError, match="one technique"):
        stored.predict_stored(test, back.limit(0))
