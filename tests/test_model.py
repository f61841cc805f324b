"""Numeric checks of the modelling layer (no statsmodels/scipy/sklearn here)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickscore.functions.distributions import t_two_sided
from clickscore.operators import design as DS
from clickscore.operators import evaluate as EV
from clickscore.operators import ordinal as OR
from clickscore.operators.ordinal import _partials


def simulate(n, beta, tau, seed=7):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, len(beta)))
    eta = X @ np.asarray(beta)
    u = rng.random(n)
    F1 = 1 / (1 + np.exp(-(tau[0] - eta)))
    F2 = 1 / (1 + np.exp(-(tau[1] - eta)))
    y = np.where(u < F1, 0, np.where(u < F2, 1, 2))
    return X, y


@pytest.fixture(scope="module")
def sim(spark):
    beta, tau = [0.8, -0.5, 0.0], [-0.4, 0.9]
    X, y = simulate(20000, beta, tau)
    rows = [tuple(map(float, x)) + (int(t),) for x, t in zip(X, y)]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, nps_ord int").repartition(4)
    fit = OR.fit_ordinal(df, ["x0", "x1", "x2"])
    return X, y, beta, tau, df, fit


def test_fit_recovers_simulated_coefficients(sim):
    X, y, beta, tau, df, fit = sim
    assert fit.converged
    se = fit.bse
    assert np.all(np.abs(fit.beta - beta) < 4 * se[:3])
    assert np.all(np.abs(fit.tau - tau) < 4 * se[3:])


def test_gradient_zero_and_hessian_matches_finite_differences(sim):
    X, y, beta, tau, df, fit = sim
    ll, g, H = _partials(X, y, fit.beta, *fit.tau)
    assert np.max(np.abs(g)) < 1e-5
    theta = np.concatenate([fit.beta, fit.tau])
    eps = 1e-5
    num = np.zeros_like(H)
    for j in range(len(theta)):
        tp, tm = theta.copy(), theta.copy()
        tp[j] += eps
        tm[j] -= eps
        gp = _partials(X, y, tp[:3], *tp[3:])[1]
        gm = _partials(X, y, tm[:3], *tm[3:])[1]
        num[:, j] = (gp - gm) / (2 * eps)
    assert np.max(np.abs(num - H)) / np.max(np.abs(H)) < 1e-6


def test_loglik_recomputed_from_emitted_coefficients(sim):
    X, y, beta, tau, df, fit = sim
    eta = X @ fit.beta
    F1 = 1 / (1 + np.exp(-(fit.tau[0] - eta)))
    F2 = 1 / (1 + np.exp(-(fit.tau[1] - eta)))
    p = np.where(y == 0, F1, np.where(y == 1, F2 - F1, 1 - F2))
    assert math.isclose(np.log(p).sum(), fit.llf, rel_tol=1e-9)
    n = np.bincount(y, minlength=3)
    assert math.isclose(fit.llnull, float((n * np.log(n / n.sum())).sum()), rel_tol=1e-12)


def test_predictions_and_marginal_effects(spark, sim):
    X, y, beta, tau, df, fit = sim
    pred = OR.predict(df, fit)
    s = pred.agg(F.max(F.abs(F.col("p_detractor") + F.col("p_passive") + F.col("p_promoter") - 1))).first()[0]
    assert s < 1e-12
    ame = OR.marginal_effects(df, fit).collect()
    for r in ame:
        assert abs(r["AME_promoter"] + r["AME_passive"] + r["AME_detractor"]) < 1e-12
    cm = EV.confusion(pred).agg(F.sum("n")).first()[0]
    assert cm == 20000
    rep = {r["label"]: r for r in EV.classification_report(pred).collect()}
    acc = pred.agg(F.avg((F.col("pred") == F.col("nps_ord")).cast("double"))).first()[0]
    assert math.isclose(rep["accuracy"]["f1"], acc, rel_tol=1e-12)


def test_multi_model_fit_equals_single_fits(spark, sim):
    X, y, beta, tau, df, fit = sim
    many = OR.fit_ordinal_many(df, {"all": ["x0", "x1", "x2"], "two": ["x0", "x1"]})
    assert np.allclose(many["all"].beta, fit.beta, atol=1e-8)
    single = OR.fit_ordinal(df, ["x0", "x1"])
    assert np.allclose(many["two"].beta, single.beta, atol=1e-8)


def test_vif_equals_regression_form(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=500)
    b = 0.8 * a + 0.6 * rng.normal(size=500)
    c = rng.normal(size=500)
    rows = [(float(x), float(y_), float(z)) for x, y_, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {r["feature"]: r["VIF"] for r in DS.vif(df, ["a", "b", "c"]).collect()}
    M = np.column_stack([a, b, c])
    for j, name in enumerate("abc"):
        others = np.column_stack([np.ones(500), np.delete(M, j, axis=1)])
        coef, *_ = np.linalg.lstsq(others, M[:, j], rcond=None)
        resid = M[:, j] - others @ coef
        r2 = 1 - resid.var() / M[:, j].var()
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-8)


def test_vif_of_collinear_and_constant_columns(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 400)) * [[1.0], [3.0], [1e-3]] + [[0.0], [1e6], [5.0]]
    rows = [(float(x), float(x), float(y), float(z), float(y + z), 7.0) for x, y, z in zip(a, b, c)]
    df = spark.createDataFrame(rows, "a double, a2 double, b double, c double, bc double, k double")
    got = {r["feature"]: r["VIF"] for r in DS.vif(df, ["a", "a2", "b", "k"]).collect()}
    assert got["a"] == got["a2"] == math.inf and got["k"] is None and abs(got["b"] - 1) < 0.05
    got = {r["feature"]: r["VIF"] for r in DS.vif(df.selectExpr("a", "b / 3 AS b", "c * 1000 AS c", "b / 3 + c * 1000 AS s"), ["a", "b", "c", "s"]).collect()}
    assert got["b"] == got["c"] == got["s"] == math.inf and abs(got["a"] - 1) < 0.05
    assert DS.high_vif(DS.vif(df, ["a", "a2", "b"])) == ["a", "a2"]
    assert DS.independent(df, ["k", "a", "a2", "b"]) == ["a", "b"]


def test_binary_logit_penalised_gradient_is_zero(spark, sim):
    X, y, beta, tau, df, fit = sim
    cols = ["x0", "x1", "x2"]
    coefs = {r["feature"]: r["coef"] for r in EV.binary_logit(df, cols, 2).collect()}
    w = np.array([coefs[c] for c in cols])
    yb = (y == 2).astype(float)
    # the intercept is unpenalised: solve sum(sigma(Xw + b) - y) = 0 for b
    b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(X @ w + b)))
        b -= (p - yb).sum() / (p * (1 - p)).sum()
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad = X.T @ (p - yb) + w / 1.0          # C = 1: 0.5|w|^2 + sum(logloss)
    assert np.max(np.abs(grad)) < 1e-3 * len(y) ** 0.5


def test_t_distribution_tail():
    assert abs(t_two_sided(2.228138851986, 10) - 0.05) < 1e-6
    assert abs(t_two_sided(1.959963984540054, 1e7) - 0.05) < 1e-5
    assert abs(t_two_sided(1.0, 1) - 0.5) < 1e-12 and abs(t_two_sided(12.706204736, 1) - 0.05) < 1e-9
    assert abs(t_two_sided(4.302652730, 2) - 0.05) < 1e-9 and abs(t_two_sided(2.570581836, 5) - 0.05) < 1e-9
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)


def test_stratified_split_is_exact_per_stratum(spark):
    from clickscore.plans import context as C
    prof = C.profile(spark, "/root/testdata/sf0.01")
    s = DS.stratified_split(prof)
    for r in s.groupBy("nps_category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect():
        assert r["t"] == int(math.floor(r["n"] * 0.8 + 0.5))
    f = DS.stratified_folds(prof)
    sizes = f.groupBy("nps_category", "fold").count().collect()
    by_cat = {}
    for r in sizes:
        by_cat.setdefault(r["nps_category"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_cat.values())


def test_grouped_fits_equal_separate_fits(spark, sim):
    X, y, beta, tau, df, fit = sim
    g = df.withColumn("_grp", (F.monotonically_increasing_id() % 2).cast("int"))
    g = spark.createDataFrame(g.collect(), g.schema)      # freeze the group labels
    many = OR.fit_ordinal_many(g, {0: (["x0", "x1"], 0), 1: (["x0", "x1", "x2"], 1)}, group_col="_grp")
    s0 = OR.fit_ordinal(g.filter("_grp = 0"), ["x0", "x1"])
    s1 = OR.fit_ordinal(g.filter("_grp = 1"), ["x0", "x1", "x2"])
    assert np.allclose(many[0].beta, s0.beta, atol=1e-8) and np.allclose(many[1].beta, s1.beta, atol=1e-8)
    assert math.isclose(many[1].llf, s1.llf, rel_tol=1e-12)
    pred = OR.predict_grouped(g, many, "_grp")
    assert pred.count() == g.count()


def _rows(spark, x, y):
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", nps_ord int")


def test_a_missing_class_gives_nulls(spark):
    rnd = np.random.default_rng(1)
    d = _rows(spark, rnd.normal(size=(60, 2)), np.repeat([0, 2], 30))
    fits = OR.fit_ordinal_many(d, {"m": ["x0", "x1"], "b": ["x0", "x1"], "none": ["x0"]}, links={"b": OR.binary(2, 1.0), "none": OR.binary(1, 1.0)})
    assert not fits["m"].converged and np.isnan(fits["m"].beta).all() and fits["b"].converged and not fits["none"].converged
    row = OR.fit_statistics(spark, {"m": fits["m"]}).first()
    assert row["mcfadden_r2"] is None and row["aic"] is None and row["converged"] is False and row["nobs"] == 60
    assert {r["coef"] for r in OR.coefficient_table(spark, fits["m"]).collect()} == {None}
    assert {r["pred"] for r in OR.predict(d, fits["m"]).collect()} == {None}


def test_separated_classes_do_not_converge(spark):
    x = np.linspace(-3, 3, 90)[:, None]
    y = np.repeat([0, 1, 2], 30)
    fit = OR.fit_ordinal(_rows(spark, x, y), ["x0"])
    assert not fit.converged and np.isnan(fit.beta).all() and fit.iterations < 50
    rnd = np.random.default_rng(2)                                # one column separates class 2 only, the other is noise
    z = np.column_stack([np.where(y == 2, 1.0, 0.0), rnd.normal(size=90)])
    assert not OR.fit_ordinal(_rows(spark, z, np.where(y == 2, 2, rnd.integers(0, 2, 90))), ["x0", "x1"]).converged
    kept = OR.fit_ordinal_many(_rows(spark, x, y), {"b": ["x0"]}, links={"b": OR.binary(2, 1.0)})["b"]       # the penalty bounds it
    assert kept.converged and np.isfinite(kept.beta).all()


def test_equal_columns_fit_like_one(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 1))
    y = np.clip(np.round(1 + x[:, 0] + rnd.logistic(size=400)), 0, 2).astype(int)
    one = OR.fit_ordinal(_rows(spark, x, y), ["x0"])
    two = OR.fit_ordinal(_rows(spark, np.column_stack([x, x]), y), ["x0", "x1"])
    assert one.converged and two.converged and abs(one.llf - two.llf) < 1e-6
    assert abs(two.beta.sum() - one.beta[0]) < 1e-5 and abs(two.beta[0] - two.beta[1]) < 1e-6


def test_folds_prepare_like_separate_designs(spark):
    from clickscore.operators import design as DS
    from clickscore.plans import context as C
    cols = DS.RATE_COLS[:4]
    prof = C.profile(spark, "/root/testdata/sf0.01")
    f = EV.fold_frame(prof, cols, 5)
    prep = EV.fold_preparation(f, cols, 5)
    models = OR.fit_ordinal_many(f, {i: (cols, i) for i in prep}, group_col="fold", prep=prep, leave_out=True)
    got = {r["fold"]: r["cv_accuracy"] for r in EV.fold_accuracy(f, models, prep).collect()}
    for i in range(5):
        tr, va = DS.prepare_design_pair(f.filter(F.col("fold") != i), f.filter(F.col("fold") == i), cols)
        fit = OR.fit_ordinal(tr, cols)
        assert np.abs(fit.beta - models[i].beta).max() < 1e-6 and np.abs(fit.tau - models[i].tau).max() < 1e-6
        right = OR.predict(va, fit).filter(F.col("pred") == F.col("nps_ord")).count()
        assert abs(got[i + 1] - right / va.count()) < 1e-12


def test_all_models_share_their_passes(spark, sim, monkeypatch):
    d, cols = sim[4], ["x0", "x1", "x2"]
    runs = []
    once = OR.passes
    monkeypatch.setattr(OR, "passes", lambda *a, **k: runs.append(len(a[1])) or once(*a, **k))
    models = {"A": cols, "B": cols[:1], "up": cols, "down": cols}
    OR.fit_ordinal_many(d, models, links={"up": OR.binary(2, 1.0), "down": OR.binary(0, 1.0)})
    assert runs[0] == 4 and len(runs) < 20
