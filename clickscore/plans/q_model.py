"""Queries for the modelling layer.

Design preparation and splits are SQL-expressible and carry oracles; the
fitted-model tables are checked by row count in the driver and numerically
in tests/test_model.py (gradient at the optimum, finite differences,
recovery of simulated coefficients, likelihood recomputed from the
emitted coefficients).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import GROUP_LABELS
from clickscore.operators import design as DS
from clickscore.operators import evaluate as EV
from clickscore.operators import ordinal as OR
from clickscore.operators._util import local_frame, round_doubles
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import register

_PRE = [O.fixtures_cte(), O.resp_cte(), O.base_cte(), O.profile_cte()]
_ORD = "CASE nps_category WHEN 'detractor' THEN 0 WHEN 'passive' THEN 1 WHEN 'promoter' THEN 2 END"
_KEYS = "userhasheduuid, nps_score, nps_category"


def _design_sql(cols: list[str]) -> str:
    caps = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap_{c}" for c in cols)
    cl = ", ".join(f"COALESCE(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(CAST({c} AS DOUBLE), cap_{c}) END, 0) AS {c}"
                   for c in cols)
    st = ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in cols)
    z = ", ".join(O.sround(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1 ELSE sd_{c} END", 6)
                  + f" AS {c}" for c in cols)
    return O.with_(*_PRE, f"caps AS (SELECT {caps} FROM profile)",
                   f"cl AS (SELECT {_KEYS}, {_ORD} AS nps_ord, {cl} FROM profile, caps)",
                   f"st AS (SELECT {st} FROM cl)") + f"SELECT {_KEYS}, nps_ord, {z} FROM cl, st"


def _prof(spark, sf):
    return C.profile(spark, sf)


@register("m1_design_rate", _design_sql(DS.RATE_COLS))
def m1_design_rate(spark, sf):
    return round_doubles(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS))


@register("m1_design_intensity", _design_sql(DS.INTENSITY_COLS))
def m1_design_intensity(spark, sf):
    return round_doubles(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.INTENSITY_COLS))


@register("m1_design_behaviour", _design_sql(DS.BEHAV_COLS))
def m1_design_behaviour(spark, sf):
    return round_doubles(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.BEHAV_COLS))


@register("m3_log_volume", O.with_(*_PRE, f"""
lv AS (SELECT {_KEYS}, {_ORD} AS nps_ord, ln(1 + CAST(COALESCE(total_feature_clicks, 0) AS DOUBLE)) AS x
       FROM profile)""") + f"""
SELECT {_KEYS}, nps_ord,
       {O.sround('(x - AVG(x) OVER ()) / CASE WHEN STDDEV_POP(x) OVER () = 0 THEN 1 ELSE STDDEV_POP(x) OVER () END', 6)}
         AS log_total_clicks
FROM lv""")
def m3_log_volume(spark, sf):
    return round_doubles(DS.log_volume(DS.with_target(_prof(spark, sf))))


_SHUF = ("md5(concat_ws('|', '42', CAST(userhasheduuid AS VARCHAR), COALESCE(CAST(nps_score AS VARCHAR), ''), "
         "nps_category))")


@register("m5_stratified_split", O.with_(*_PRE) + f"""
SELECT {_KEYS},
       ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY {_SHUF}, userhasheduuid)
         <= round(COUNT(*) OVER (PARTITION BY nps_category) * 0.8) AS is_train
FROM profile""")
def m5_stratified_split(spark, sf):
    return DS.stratified_split(_prof(spark, sf)).select("userhasheduuid", "nps_score", "nps_category", "is_train")


@register("m6_stratified_folds", O.with_(*_PRE) + f"""
SELECT {_KEYS},
       CAST((ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY {_SHUF}, userhasheduuid) - 1) % 5 AS INTEGER) AS fold
FROM profile""")
def m6_stratified_folds(spark, sf):
    return DS.stratified_folds(_prof(spark, sf)).select("userhasheduuid", "nps_score", "nps_category", "fold")


def _pair_sql(cols: list[str]) -> str:
    split = (f"sp AS (SELECT *, {_ORD} AS nps_ord, ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY {_SHUF}, "
             f"userhasheduuid) <= round(COUNT(*) OVER (PARTITION BY nps_category) * 0.8) AS is_train FROM profile)")
    filled = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0) AS {c}" for c in cols)
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in cols)
    cl = ", ".join(f"LEAST({c}, cap_{c}) AS {c}" for c in cols)
    st = ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in cols)
    z = ", ".join(O.sround(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1 ELSE sd_{c} END", 6)
                  + f" AS {c}" for c in cols)
    return O.with_(*_PRE, split, f"fl AS (SELECT {_KEYS}, nps_ord, is_train, {filled} FROM sp)",
                   f"caps AS (SELECT {caps} FROM fl WHERE is_train)",
                   f"cl AS (SELECT {_KEYS}, nps_ord, is_train, {cl} FROM fl, caps)",
                   f"st AS (SELECT {st} FROM cl WHERE is_train)") + f"SELECT {_KEYS}, nps_ord, is_train, {z} FROM cl, st"


@register("m2_design_train_test", _pair_sql(DS.RATE_COLS))
def m2_design_train_test(spark, sf):
    s = DS.stratified_split(DS.with_target(_prof(spark, sf)))
    tr, te = DS.prepare_design_pair(s.filter("is_train"), s.filter("NOT is_train"), DS.RATE_COLS)
    return round_doubles(tr.withColumn("is_train", F.lit(True)).unionByName(te.withColumn("is_train", F.lit(False))))


# ---- rows-only: fitted models -------------------------------------------------------------
@register("m4_vif_rate", None)
def m4_vif_rate(spark, sf):
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    return DS.vif(d, DS.RATE_COLS)


@register("m4_vif_intensity", None)
def m4_vif_intensity(spark, sf):
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.INTENSITY_COLS)
    return DS.vif(d, DS.INTENSITY_COLS)


def _specs(spark, sf):
    """Specifications, once per session and source version."""
    return C.memo(spark, sf, ("specs",), lambda: EV.specifications(_prof(spark, sf)))


def _spec_fits(spark, sf, models=("A", "B", "C", "D")):
    """The four fits of M8 are made side by side, once; every query takes its own."""
    sp = _specs(spark, sf)
    fits = C.memo(spark, sf, ("fits",), lambda: EV.fit_all(sp))
    return sp, {m: fits[m] for m in models}


@register("m7_ordinal_fit_A", None)
def m7_ordinal_fit_A(spark, sf):
    sp, fits = _spec_fits(spark, sf, ("A",))
    return OR.coefficient_table(spark, fits["A"])


@register("m8_model_comparison", None)
def m8_model_comparison(spark, sf):
    sp, fits = _spec_fits(spark, sf)
    names = {"A": "A — rate_", "B": "B — intensity_", "C": "C — rate_ + behav", "D": "D — rate_ + log(total)"}
    return OR.fit_statistics(spark, {names[k]: v for k, v in fits.items()})


@register("m11_coefficients_all", None)
def m11_coefficients_all(spark, sf):
    sp, fits = _spec_fits(spark, sf)
    out = None
    for m, fit in fits.items():
        t = OR.coefficient_table(spark, fit).withColumn("model", F.lit(m))
        out = t if out is None else out.unionByName(t)
    return out


@register("m12_significant_A", None)
def m12_significant_A(spark, sf):
    sp, fits = _spec_fits(spark, sf, ("A",))
    return OR.significant(OR.coefficient_table(spark, fits["A"]))


@register("m12_compare_A_C", None)
def m12_compare_A_C(spark, sf):
    sp, fits = _spec_fits(spark, sf, ("A", "C"))
    return OR.compare_models(OR.coefficient_table(spark, fits["A"]), OR.coefficient_table(spark, fits["C"]))


@register("m12_compare_A_D", None)
def m12_compare_A_D(spark, sf):
    sp, fits = _spec_fits(spark, sf, ("A", "D"))
    return OR.compare_models(OR.coefficient_table(spark, fits["A"]), OR.coefficient_table(spark, fits["D"]))


@register("m13_marginal_effects", None)
def m13_marginal_effects(spark, sf):
    sp, fits = _spec_fits(spark, sf, ("A",))
    return OR.marginal_effects(sp.design, fits["A"])


def _train_test(spark, sf):
    return C.memo(spark, sf, ("train_test",), lambda: EV.train_test(_prof(spark, sf), _specs(spark, sf).columns["A"]))


def _folds(spark, sf):
    return C.memo(spark, sf, ("folds",), lambda: EV.cross_validate(_prof(spark, sf), _specs(spark, sf).columns["A"]))


@register("m9_test_predictions", None)
def m9_test_predictions(spark, sf):
    fit, pred = _train_test(spark, sf)
    return pred.select("userhasheduuid", "nps_score", "nps_category", "nps_ord", "p_detractor", "p_passive",
                       "p_promoter", "pred")


@register("m15_test_accuracy", None)
def m15_test_accuracy(spark, sf):
    fit, pred = _train_test(spark, sf)
    return EV.accuracy(pred)


@register("m16_confusion_matrix", None)
def m16_confusion_matrix(spark, sf):
    fit, pred = _train_test(spark, sf)
    return EV.confusion(pred)


@register("m17_classification_report", None)
def m17_classification_report(spark, sf):
    fit, pred = _train_test(spark, sf)
    return EV.classification_report(pred)


@register("m14_cv_accuracy", None)
def m14_cv_accuracy(spark, sf):
    return _folds(spark, sf)


@register("m14_cv_summary", None)
def m14_cv_summary(spark, sf):
    return EV.cv_summary(_folds(spark, sf))


def _checks(spark, fits):
    names = dict(zip(EV.CHECKS, ("coef_checkA", "coef_checkB")))
    return [EV.check_table(spark, fits[m], name) for m, name in names.items()]


@register("m18_binary_logits", None)
def m18_binary_logits(spark, sf):
    _, fits = _spec_fits(spark, sf, tuple(EV.CHECKS))
    a, b = _checks(spark, fits)
    return a.join(b, "feature")


@register("m19_parallel_lines", None)
def m19_parallel_lines(spark, sf):
    _, fits = _spec_fits(spark, sf, ("A", *EV.CHECKS))
    return EV.parallel_lines(OR.coefficient_table(spark, fits["A"]), *_checks(spark, fits))


# ---- the model operators at fixed coefficients, against plain SQL ---------------------------
# Documented constants, not a fit: they make every step after the fit SQL-checkable.
_FIXED = {c: round(0.35 - 0.07 * i, 2) for i, c in enumerate(DS.RATE_COLS)}
_TAU = (-0.6, 0.9)


def _fixed_fit():
    k = len(_FIXED)
    return OR.OrdinalFit(list(_FIXED), np.array(list(_FIXED.values())), np.array(_TAU), -100.0, -110.0, 102, [30, 30, 42],
                         np.diag(np.linspace(0.01, 0.05, k + 2)), 0, True, 0.0)


def _fixed_predictions(spark, sf):
    return OR.predict(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS), _fixed_fit())


def _fixed_ctes() -> str:
    cols = DS.RATE_COLS
    caps = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap_{c}" for c in cols)
    cl = ", ".join(f"COALESCE(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(CAST({c} AS DOUBLE), cap_{c}) END, 0) AS {c}"
                   for c in cols)
    st = ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in cols)
    z = ", ".join(f"({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1 ELSE sd_{c} END AS {c}" for c in cols)
    eta = " + ".join(f"({b}) * {c}" for c, b in _FIXED.items())
    return O.with_(*_PRE, f"caps AS (SELECT {caps} FROM profile)",
                   f"cl AS (SELECT {_KEYS}, {_ORD} AS nps_ord, {cl} FROM profile, caps)",
                   f"st AS (SELECT {st} FROM cl)", f"z AS (SELECT {_KEYS}, nps_ord, {z} FROM cl, st)",
                   f"e AS (SELECT *, {eta} AS eta FROM z)",
                   f"f AS (SELECT *, 1 / (1 + exp(eta - ({_TAU[0]}))) AS f1, 1 / (1 + exp(eta - ({_TAU[1]}))) AS f2 FROM e)",
                   """pr AS (SELECT *, f1 AS p0, f2 - f1 AS p1, 1 - f2 AS p2,
       CASE WHEN f1 >= f2 - f1 AND f1 >= 1 - f2 THEN 0 WHEN f2 - f1 >= 1 - f2 THEN 1 ELSE 2 END AS pred FROM f)""")


@register("m9_fixed_predictions", _fixed_ctes() + f"""
SELECT {_KEYS}, nps_ord, {O.sround('p0', 6)} AS p_detractor, {O.sround('p1', 6)} AS p_passive,
       {O.sround('p2', 6)} AS p_promoter, pred FROM pr""")
def m9_fixed_predictions(spark, sf):
    """M9 at the fixed coefficients."""
    return round_doubles(_fixed_predictions(spark, sf).select(
        "userhasheduuid", "nps_score", "nps_category", "nps_ord", "p_detractor", "p_passive", "p_promoter", "pred"))


_LIK = "ln(CASE nps_ord WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)"
_GRAD = "CASE nps_ord WHEN 0 THEN f1 - 1 WHEN 1 THEN f1 + f2 - 1 ELSE f2 END"


@register("m7_fixed_likelihood", _fixed_ctes() + " UNION ALL ".join(
    [f"SELECT 'loglik' AS quantity, {O.sround(f'sum({_LIK})', 6)} AS value FROM pr"]
    + [f"SELECT 'd_{c}', {O.sround(f'sum(({_GRAD}) * {c})', 6)} FROM pr" for c in DS.RATE_COLS]
    + [f"SELECT 'd_tau1', {O.sround('sum(CASE nps_ord WHEN 0 THEN 1 - f1 WHEN 1 THEN -f1 * (1 - f1) / (f2 - f1) ELSE 0 END)', 6)} FROM pr",
       f"SELECT 'd_tau2', {O.sround('sum(CASE nps_ord WHEN 0 THEN 0 WHEN 1 THEN f2 * (1 - f2) / (f2 - f1) ELSE -f2 END)', 6)} FROM pr"]))
def m7_fixed_likelihood(spark, sf):
    """M7's distributed pass (log-likelihood and gradient) at the fixed coefficients."""
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    ll, g, _ = OR.likelihood_passes(d, [(DS.RATE_COLS, list(_FIXED.values()), *_TAU)])[0]
    names = ["loglik"] + [f"d_{c}" for c in DS.RATE_COLS] + ["d_tau1", "d_tau2"]
    rows = [(n, float(v)) for n, v in zip(names, [ll, *g])]
    return round_doubles(local_frame(spark, rows, [("quantity", "string"), ("value", "double")]))


@register("m13_fixed_marginal_effects", _fixed_ctes() + """,
m AS (SELECT avg(f1 * (1 - f1)) AS a, avg(f2 * (1 - f2)) AS b FROM pr),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {b})" for c, b in _FIXED.items()) + f""") t(feature, beta))
SELECT feature, CASE {" ".join(f"WHEN feature = 'rate_{g}' THEN {O.q(v)}" for g, v in GROUP_LABELS.items())} END AS label,
       {O.sround('b * beta', 6)} AS AME_promoter, {O.sround('(a - b) * beta', 6)} AS AME_passive,
       {O.sround('-a * beta', 6)} AS AME_detractor FROM c, m""")
def m13_fixed_marginal_effects(spark, sf):
    """M13 at the fixed coefficients."""
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    return round_doubles(OR.marginal_effects(d, _fixed_fit())).withColumn("label", X.predictor_label("feature"))


@register("m15_fixed_accuracy", _fixed_ctes() + f""",
n AS (SELECT nps_ord, count(*) AS c FROM pr GROUP BY 1)
SELECT {O.sround('(SELECT avg(CAST(pred = nps_ord AS INTEGER)) FROM pr)', 6)} AS accuracy,
       (SELECT nps_ord FROM n ORDER BY c DESC, nps_ord LIMIT 1) AS majority_class,
       {O.sround('(SELECT max(c) / CAST(sum(c) AS DOUBLE) FROM n)', 6)} AS baseline,
       {O.sround('(SELECT avg(CAST(pred = nps_ord AS INTEGER)) FROM pr) - (SELECT max(c) / CAST(sum(c) AS DOUBLE) FROM n)', 4)} AS gain_vs_baseline""")
def m15_fixed_accuracy(spark, sf):
    """M15 at the fixed coefficients."""
    return round_doubles(EV.accuracy(_fixed_predictions(spark, sf)))


@register("m16_fixed_confusion", _fixed_ctes() + """
SELECT CAST(a.range AS INTEGER) AS "true", CAST(b.range AS INTEGER) AS predicted,
       (SELECT count(*) FROM pr WHERE nps_ord = a.range AND pred = b.range) AS n
FROM range(3) a, range(3) b""")
def m16_fixed_confusion(spark, sf):
    """M16 at the fixed coefficients."""
    return EV.confusion(_fixed_predictions(spark, sf))


@register("m17_fixed_report", _fixed_ctes() + f""",
c AS (SELECT CAST(range AS INTEGER) AS k, (SELECT count(*) FROM pr WHERE nps_ord = range AND pred = range) AS tp,
             (SELECT count(*) FROM pr WHERE nps_ord = range) AS support, (SELECT count(*) FROM pr WHERE pred = range) AS said FROM range(3)),
r AS (SELECT *, CASE WHEN said > 0 THEN tp / CAST(said AS DOUBLE) ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END AS q FROM c),
s AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM r),
t AS (
  SELECT CASE k WHEN 0 THEN 'detractor' WHEN 1 THEN 'passive' ELSE 'promoter' END AS label, p, q, f, support FROM s
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / CAST(sum(support) AS DOUBLE), sum(support) FROM s
  UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f), sum(support) FROM s
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(q * support) / sum(support), sum(f * support) / sum(support),
                   sum(support) FROM s)
SELECT label, {O.sround('p', 6)} AS precision, {O.sround('q', 6)} AS recall, {O.sround('f', 6)} AS f1, CAST(support AS BIGINT) AS support
FROM t""")
def m17_fixed_report(spark, sf):
    """M17 at the fixed coefficients."""
    return round_doubles(EV.classification_report(_fixed_predictions(spark, sf)))


# the statistics after a fit, from the log-likelihood at the fixed coefficients
def _fit_of(beta: dict, ll: float, counts: list[int]):
    n = sum(counts)
    null = float(sum(c * np.log(c / n) for c in counts if c))
    return OR.OrdinalFit(list(beta), np.array(list(beta.values())), np.array(_TAU), ll, null, n, counts, np.eye(len(beta) + 2), 0, True, 0.0)


@register("m8_fixed_statistics", _fixed_ctes() + f""",
l AS (SELECT sum({_LIK}) AS ll, count(*) AS n FROM pr), c AS (SELECT nps_ord, count(*) AS c FROM pr GROUP BY 1),
z0 AS (SELECT sum(c * ln(c / CAST((SELECT n FROM l) AS DOUBLE))) AS ll0 FROM c)
SELECT 'fixed' AS model, {O.sround('1 - ll / ll0', 4)} AS mcfadden_r2, {O.sround(f'2 * ({len(_FIXED)} + 2) - 2 * ll', 2)} AS aic,
       {O.sround(f'({len(_FIXED)} + 2) * ln(n) - 2 * ll', 2)} AS bic, {O.sround('ll', 2)} AS loglik, CAST({len(_FIXED)} AS INTEGER) AS n_vars,
       CAST(n AS BIGINT) AS nobs, true AS converged FROM l, z0""")
def m8_fixed_statistics(spark, sf):
    """M8's comparison row (M10) at the fixed coefficients."""
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    ll = OR.likelihood_passes(d, [(DS.RATE_COLS, list(_FIXED.values()), *_TAU)])[0][0]
    return OR.fit_statistics(spark, {"fixed": _fit_of(_FIXED, float(ll), OR.class_counts(d))})


# two-sided normal tail by Simpson's rule over 2,000 steps
_TAIL = ("2 * (0.5 - abs(z) / 6000 / sqrt(2 * pi()) * list_sum([exp(-0.5 * pow(abs(z) * i / 2000, 2))"
         " * CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END FOR i IN range(2001)]))")
_SIG = "CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS sig"


# One diagonal Newton step: from given coefficients b, b + g / I with standard error 1 / sqrt(I), where g is the gradient and
# I the information of each coefficient alone.  No fit, so SQL can say it, yet every number comes from all rows.
_ZERO = {c: 0.0 for c in DS.RATE_COLS}
_INFO = "(CASE WHEN nps_ord < 2 THEN f1 * (1 - f1) ELSE 0 END + CASE WHEN nps_ord > 0 THEN f2 * (1 - f2) ELSE 0 END)"


def _one_step(spark, sf, beta: dict, link=OR.ORDINAL, last=_TAU):
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    theta = np.array([*beta.values(), *last])
    _, g, H = OR.passes(d, [{"cols": list(beta), "theta": theta, "link": link}])[0]
    k, info = len(beta), -np.diag(H)
    return OR.OrdinalFit(list(beta), theta[:k] + g[:k] / info[:k], theta[k:], -100.0, -110.0, 102, [30, 30, 42], np.diag(1 / info), 1, True, 0.0)


def _step_cte(name: str, beta: dict) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {b} + sum(({_GRAD}) * {c}) / sum({_INFO} * {c} * {c}) AS b,"
                              f" 1 / sqrt(sum({_INFO} * {c} * {c})) AS s FROM pr_{name}" for c, b in beta.items())
    r = lambda e: O.sround(e, 4)
    return f"""{name} AS (
  SELECT feature, {r('b')} AS coef, {r('s')} AS std_err, {r('z')} AS z, {r(_TAIL)} AS p_value, {r('exp(b)')} AS "OR",
         {r(f'exp(b - {OR.Z975} * s)')} AS "OR_CI_low", {r(f'exp(b + {OR.Z975} * s)')} AS "OR_CI_high"
  FROM (SELECT *, b / s AS z FROM ({rows})))"""


def _at(name: str, beta: dict) -> list[str]:
    """Probabilities at ``beta`` as pr_<name>, and the one-step table as <name>."""
    eta = " + ".join(f"({b}) * {c}" for c, b in beta.items())
    return [f"pr_{name} AS (SELECT *, 1 / (1 + exp(e0 - ({_TAU[0]}))) AS f1, 1 / (1 + exp(e0 - ({_TAU[1]}))) AS f2 FROM (SELECT *, {eta} AS e0 FROM z))",
            _step_cte(name, beta)]


def _steps(**models: dict) -> str:
    return _fixed_ctes() + ", " + ", ".join(x for name, beta in models.items() for x in _at(name, beta))


@register("m11_one_step_coefficients", _steps(a=_FIXED) + f" SELECT *, {_SIG} FROM a")
def m11_one_step_coefficients(spark, sf):
    """Coefficient table, tails, odds ratios and intervals of one-step estimates."""
    return OR.coefficient_table(spark, _one_step(spark, sf, _FIXED))


@register("m12_one_step_significant", _steps(a=_FIXED) + f" SELECT *, {_SIG} FROM a WHERE p_value < 0.05")
def m12_one_step_significant(spark, sf):
    return OR.significant(OR.coefficient_table(spark, _one_step(spark, sf, _FIXED)))


@register("m12_one_step_compare", _steps(a=_FIXED, b=_ZERO) + """
SELECT feature, a."OR" AS "OR1", a."OR_CI_low" AS "CL1", a."OR_CI_high" AS "CH1", a.p_value AS pv1,
       b."OR" AS "OR2", b."OR_CI_low" AS "CL2", b."OR_CI_high" AS "CH2", b.p_value AS pv2
FROM a JOIN b USING (feature) WHERE a.p_value < 0.05 OR b.p_value < 0.05""")
def m12_one_step_compare(spark, sf):
    """The join of two coefficient tables."""
    return OR.compare_models(*[OR.coefficient_table(spark, _one_step(spark, sf, b)) for b in (_FIXED, _ZERO)])


def _check_cte(name: str, positive: int) -> str:
    p = "(1 / (1 + exp(-0.2)))"
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {O.sround(f'sum((CAST(nps_ord = {positive} AS INTEGER) - {p}) * {c}) / sum({p} * (1 - {p}) * {c} * {c})', 6)} AS v FROM z"
        for c in DS.RATE_COLS) + ")"


@register("m19_one_step_parallel_lines", _steps(a=_FIXED) + f""", {_check_cte('p', 2)}, {_check_cte('d', 0)},
w AS (SELECT a.feature, coef AS coef_ordinal, p.v AS "coef_promoVsResto", d.v AS "coef_detractVsResto",
             sign(coef) = sign(p.v) AS "consist_A", sign(coef) <> sign(d.v) AS "consist_B"
      FROM a JOIN p ON a.feature = p.feature JOIN d ON a.feature = d.feature)
SELECT feature, coef_ordinal, "coef_promoVsResto", "coef_detractVsResto", "consist_A", "consist_B",
       "consist_A" AND "consist_B" AS consistente,
       {O.sround('avg(CAST("consist_A" AND "consist_B" AS INTEGER)) OVER () * 100', 6)} AS pct_consistent FROM w""")
def m19_one_step_parallel_lines(spark, sf):
    """M19 on the one-step estimates of the ordinal model and of both binary checks."""
    checks = [EV.check_table(spark, _one_step(spark, sf, _ZERO, OR.binary(j), (0.2,)), name)
              for j, name in zip(EV.CHECKS.values(), ("coef_checkA", "coef_checkB"))]
    return round_doubles(EV.parallel_lines(OR.coefficient_table(spark, _one_step(spark, sf, _FIXED)), *checks))


def _binary_sql(positive: int, name: str) -> str:
    eta = " + ".join(f"({b}) * {c}" for c, b in _FIXED.items()) + " + 0.2"
    y = f"CAST(nps_ord = {positive} AS INTEGER)"
    rows = [f"SELECT '{name}_loss' AS quantity, "
            + O.sround(f"sum({y} * ({eta}) - ln(1 + exp({eta}))) - 0.5 * {sum(b * b for b in _FIXED.values())}", 6) + " AS value FROM z"]
    rows += [f"SELECT '{name}_{c}', " + O.sround(f"sum(({y} - 1 / (1 + exp(-({eta})))) * {c}) - ({b})", 6) + " FROM z" for c, b in _FIXED.items()]
    return " UNION ALL ".join(rows + [f"SELECT '{name}_intercept', " + O.sround(f"sum({y} - 1 / (1 + exp(-({eta}))))", 6) + " FROM z"])


@register("m18_fixed_gradient", _fixed_ctes() + " UNION ALL ".join(_binary_sql(j, m) for m, j in EV.CHECKS.items()))
def m18_fixed_gradient(spark, sf):
    """M18's penalised objective and gradient at the fixed coefficients, both checks in one pass."""
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    theta = np.array([*_FIXED.values(), 0.2])
    links = [OR.binary(j, 1.0) for j in EV.CHECKS.values()]
    found = OR.passes(d, [{"cols": DS.RATE_COLS, "theta": theta, "link": link} for link in links])
    rows = []
    for m, link, r in zip(EV.CHECKS, links, found):
        ll, g, _ = link.penalised(*r, theta)
        rows += [(f"{m}_{n}", float(v)) for n, v in zip(["loss", *DS.RATE_COLS, "intercept"], [ll, *g])]
    return round_doubles(local_frame(spark, rows, [("quantity", "string"), ("value", "double")]))


def _fold_sql() -> str:
    cols = DS.RATE_COLS
    caps = ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in cols)
    st = ", ".join(f"avg(least({c}, cap_{c})) AS mu_{c}, stddev_pop(least({c}, cap_{c})) AS sd_{c}" for c in cols)
    z = ", ".join(f"(least({c}, cap_{c}) - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END AS {c}" for c in cols)
    eta = " + ".join(f"({b}) * {c}" for c, b in _FIXED.items())
    raw = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in cols)
    right = "nps_ord = CASE WHEN f1 >= f2 - f1 AND f1 >= 1 - f2 THEN 0 WHEN f2 - f1 >= 1 - f2 THEN 1 ELSE 2 END"
    return O.with_(*_PRE, f"""fo AS (
  SELECT {_KEYS}, {_ORD} AS nps_ord, {raw},
         CAST((ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY {_SHUF}, userhasheduuid) - 1) % 5 AS INTEGER) AS fold FROM profile)""",
                   "i AS (SELECT CAST(range AS INTEGER) AS i FROM range(5))",
                   f"caps AS (SELECT i, {caps} FROM fo JOIN i ON fold <> i GROUP BY i)",
                   f"st AS (SELECT i, {st} FROM fo JOIN i ON fold <> i JOIN caps USING (i) GROUP BY i)",
                   f"z AS (SELECT fold, nps_ord, {z} FROM fo JOIN caps ON fold = caps.i JOIN st ON fold = st.i)",
                   f"e AS (SELECT fold, nps_ord, {eta} AS eta FROM z)",
                   f"f AS (SELECT *, 1 / (1 + exp(eta - ({_TAU[0]}))) AS f1, 1 / (1 + exp(eta - ({_TAU[1]}))) AS f2 FROM e)") + f"""
SELECT fold + 1 AS fold, {O.sround(f'avg(CAST({right} AS INTEGER))', 6)} AS cv_accuracy FROM f GROUP BY 1"""


@register("m14_fixed_fold_accuracy", _fold_sql())
def m14_fixed_fold_accuracy(spark, sf):
    """M14's folds, their training statistics and accuracies, at the fixed coefficients."""
    f = EV.fold_frame(_prof(spark, sf), DS.RATE_COLS)
    prep = EV.fold_preparation(f, DS.RATE_COLS)
    return round_doubles(EV.fold_accuracy(f, {i: _fixed_fit() for i in prep}, prep))


# ---- M4: variance inflation in SQL, by Gauss-Jordan elimination -----------------------------------
def _vif_sql(cols: list[str]) -> str:
    """1 / (1 - R^2) is the diagonal of the inverted correlation matrix.  A recursive query eliminates one
    column of [R | I] a step (for columns that vary and don't determine each other)."""
    k = len(cols)
    caps = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.99) AS cap_{c}" for c in cols)
    cl = ", ".join(f"COALESCE(CASE WHEN {c} IS NULL THEN NULL ELSE LEAST(CAST({c} AS DOUBLE), cap_{c}) END, 0) AS {c}" for c in cols)
    r = ", ".join("[" + ", ".join("1.0" if a == b else f"corr({a}, {b})" for b in cols)
                  + ", " + ", ".join("1.0" if a == b else "0.0" for b in cols) + "]" for a in cols)
    step = (f"[[CASE WHEN i = s THEN m[s][j] / m[s][s] ELSE m[i][j] - m[i][s] * m[s][j] / m[s][s] END"
            f" FOR j IN range(1, {2 * k + 1})] FOR i IN range(1, {k + 1})]")
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(cols, 1))
    return O.with_(*_PRE, f"caps AS (SELECT {caps} FROM profile)", f"cl AS (SELECT {cl} FROM profile, caps)",
                   f"r AS (SELECT [{r}]::DOUBLE[][] AS m FROM cl)").replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, g(s, m) AS (SELECT 1, m FROM r UNION ALL SELECT s + 1, {step} FROM g WHERE s <= {k})
SELECT feature, {O.sround(f'm[i][{k} + i]', 6)} AS "VIF" FROM g, (VALUES {names}) n(i, feature) WHERE s = {k + 1}"""


@register("m4_fixed_vif_rate", _vif_sql(DS.RATE_COLS))
def m4_fixed_vif_rate(spark, sf):
    """M4 over all eleven rates."""
    return round_doubles(DS.vif(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS), DS.RATE_COLS))


@register("m4_fixed_vif_behaviour", _vif_sql(DS.BEHAV_COLS))
def m4_fixed_vif_behaviour(spark, sf):
    return round_doubles(DS.vif(DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.BEHAV_COLS), DS.BEHAV_COLS))


_PAIR = ["rate_grading", "rate_modules"]


@register("m4_fixed_vif_pair", _fixed_ctes() + f""",
r AS (SELECT corr({_PAIR[0]}, {_PAIR[1]}) AS r FROM z)
SELECT f.feature, {O.sround('1 / (1 - r * r)', 6)} AS "VIF" FROM r, (VALUES ('{_PAIR[0]}'), ('{_PAIR[1]}')) f(feature)""")
def m4_fixed_vif_pair(spark, sf):
    """M4 for two columns, where it is 1 / (1 - r^2)."""
    d = DS.prepare_design(DS.with_target(_prof(spark, sf)), DS.RATE_COLS)
    return round_doubles(DS.vif(d, _PAIR))
