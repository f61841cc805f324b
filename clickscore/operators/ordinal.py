"""Proportional-odds (ordinal logit) model fitted as a Spark job.

P(y <= j | x) = sigma(tau_j - x.beta), three ordered classes.  Spark ML has no
ordinal model, so the fit is Newton-Raphson where every iteration is ONE pass
over the (cached) design: each Arrow batch returns its partial log-likelihood,
gradient and Hessian (p = k + 2 parameters) as long-form (index, value) rows,
Spark sums them per index, and the driver solves a p x p system (p <= 16).
The log-likelihood is concave, so this reaches the same optimum as the
study's BFGS; step-halving keeps tau_1 < tau_2 and the likelihood rising.

Per-row math (eta = x.beta, F_j = sigma(tau_j - eta), f_j = F_j (1 - F_j),
d = tau_2 - tau_1, q = 1/(e^d - 1), c = e^d/(e^d - 1)^2):
  log p   y0: ln F1 | y1: ln F2 + ln(1 - F1) + ln(1 - e^-d) | y2: ln(1 - F2)
  d/d eta y0: -(1 - F1) | y1: F1 + F2 - 1 | y2: F2
  d/d t1  y0: 1 - F1    | y1: -F1 - q     | y2: 0
  d/d t2  y0: 0         | y1: 1 - F2 + q  | y2: -F2
  Hessian with a1 = f1 [y in 0,1], a2 = f2 [y in 1,2]:
  eta.eta -(a1 + a2), eta.t1 a1, eta.t2 a2, t1.t1 -a1 - c[y1], t2.t2 -a2 - c[y1], t1.t2 c[y1]
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.distributions import normal_two_sided
from clickscore.operators._util import local_frame, materialize

Z975 = 1.959963984540054


def _log_sigmoid(a):
    return -np.logaddexp(0.0, -a)


def _partials(X_: np.ndarray, y: np.ndarray, beta: np.ndarray, t1: float, t2: float):
    """ll, gradient, Hessian of one batch (numpy, vectorised)."""
    eta = X_ @ beta
    a1, a2 = t1 - eta, t2 - eta
    F1, F2 = 1.0 / (1.0 + np.exp(-a1)), 1.0 / (1.0 + np.exp(-a2))
    d = t2 - t1
    y0, y1, y2 = (y == 0), (y == 1), (y == 2)
    em1 = math.expm1(d)
    q = 1.0 / em1
    c = math.exp(d) / (em1 * em1)
    log1m_emd = math.log(-math.expm1(-d))
    ll = (np.sum(_log_sigmoid(a1[y0]))
          + np.sum(_log_sigmoid(a2[y1]) + _log_sigmoid(-a1[y1])) + y1.sum() * log1m_emd
          + np.sum(_log_sigmoid(-a2[y2])))
    g_eta = np.where(y0, -(1 - F1), np.where(y1, F1 + F2 - 1, F2))
    g_t1 = np.where(y0, 1 - F1, np.where(y1, -F1 - q, 0.0))
    g_t2 = np.where(y0, 0.0, np.where(y1, 1 - F2 + q, -F2))
    f1, f2 = F1 * (1 - F1), F2 * (1 - F2)
    w1 = np.where(y2, 0.0, f1)
    w2 = np.where(y0, 0.0, f2)
    k = X_.shape[1]
    p = k + 2
    g = np.empty(p)
    g[:k] = X_.T @ g_eta
    g[k], g[k + 1] = g_t1.sum(), g_t2.sum()
    H = np.empty((p, p))
    H[:k, :k] = -(X_ * (w1 + w2)[:, None]).T @ X_
    H[:k, k] = H[k, :k] = X_.T @ w1
    H[:k, k + 1] = H[k + 1, :k] = X_.T @ w2
    n1 = y1.sum()
    H[k, k] = -w1.sum() - c * n1
    H[k + 1, k + 1] = -w2.sum() - c * n1
    H[k, k + 1] = H[k + 1, k] = c * n1
    return ll, g, H


def _binary_partials(X_: np.ndarray, y: np.ndarray, beta: np.ndarray, b0: float):
    """ll, gradient, Hessian of one batch of a logistic regression (coefficients, then intercept)."""
    eta = X_ @ beta + b0
    p = 1.0 / (1.0 + np.exp(-eta))
    Z = np.column_stack([X_, np.ones(len(X_))])
    return np.sum(np.where(y, _log_sigmoid(eta), _log_sigmoid(-eta))), Z.T @ (y - p), -(Z * (p * (1 - p))[:, None]).T @ Z


@dataclass
class Link:
    """What a model adds to the shared passes: its extra parameters, start, and one batch's sums."""
    extra: int = 2                     # thresholds
    positive: int | None = None        # a class, for a binary model of that class against the rest
    C: float = math.inf                # inverse strength of the L2 penalty on the coefficients

    def partials(self, X_, y, theta):
        k = X_.shape[1]
        if self.positive is None:
            return _partials(X_, y, theta[:k], theta[k], theta[k + 1])
        return _binary_partials(X_, y == self.positive, theta[:k], theta[k])

    def start(self, k: int, n_j: list[int]) -> np.ndarray:
        n = sum(n_j)
        if self.positive is None:
            c1, c2 = n_j[0] / n, (n_j[0] + n_j[1]) / n
            return np.concatenate([np.zeros(k), [math.log(c1 / (1 - c1)), math.log(c2 / (1 - c2))]])
        share = min(max(n_j[self.positive] / n, 0.5 / n), 1 - 0.5 / n)
        return np.concatenate([np.zeros(k), [math.log(share / (1 - share))]])

    def possible(self, n_j: list[int]) -> bool:
        """A maximum needs all three classes, unless a penalty bounds the coefficients and both sides have rows."""
        return min(n_j) > 0 if self.positive is None else 0 < n_j[self.positive] < sum(n_j)

    def admits(self, theta: np.ndarray) -> bool:
        return self.positive is not None or theta[-1] > theta[-2]

    def penalised(self, ll, g, H, theta):
        if math.isinf(self.C):
            return ll, g, H
        k = len(theta) - self.extra
        w = np.concatenate([theta[:k], np.zeros(self.extra)]) / self.C
        return ll - 0.5 * float(w[:k] @ theta[:k]), g - w, H - np.diag(np.concatenate([np.full(k, 1 / self.C), np.zeros(self.extra)]))


ORDINAL = Link()


def binary(positive: int, C: float = math.inf) -> Link:
    return Link(1, positive, C)


def passes(design: DataFrame, jobs: list[dict], y: str = "nps_ord", group_col: str | None = None):
    """One distributed pass that evaluates several models at once; [(ll, grad, hess), ...].

    A job has ``cols``, ``theta``, ``link``; optionally ``only`` or ``but`` (the rows whose ``group_col``
    equals that group, or all others), and ``prep`` (caps, means, deviations: its own capping and
    standardisation, so that folds need no copies of the frame).  Each partition emits long-form
    (model, index, value) partial sums; Spark adds them per (model, index); the driver gets
    sum_m (1 + p_m + p_m^2) rows.
    """
    used = sorted({c for j in jobs for c in j["cols"]} | ({group_col} if group_col else set()))
    sizes = [len(j["theta"]) for j in jobs]

    def part(it):
        acc = [None] * len(jobs)
        for pdf in it:
            if len(pdf) == 0:
                continue
            whole = pdf[y].to_numpy(dtype=int)
            for m, j in enumerate(jobs):
                rows, yb = pdf, whole
                if j.get("only") is not None or j.get("but") is not None:
                    mask = ((pdf[group_col] == j["only"]) if j.get("only") is not None else (pdf[group_col] != j["but"])).to_numpy()
                    if not mask.any():
                        continue
                    rows, yb = pdf.loc[mask], whole[mask]
                X_ = rows[j["cols"]].to_numpy(dtype=float)
                if j.get("prep") is not None:
                    cap, mean, dev = j["prep"]
                    X_ = (np.minimum(X_, cap) - mean) / dev
                r = j["link"].partials(X_, yb, j["theta"])
                acc[m] = r if acc[m] is None else (acc[m][0] + r[0], acc[m][1] + r[1], acc[m][2] + r[2])
        frames = []
        for m, a in enumerate(acc):
            if a is None:
                continue
            vals = np.concatenate([[a[0]], a[1], a[2].ravel()])
            frames.append(pd.DataFrame({"m": np.full(len(vals), m, dtype=np.int32),
                                        "i": np.arange(len(vals), dtype=np.int32), "v": vals}))
        if frames:
            yield pd.concat(frames, ignore_index=True)

    rows = (design.select(*used, y).mapInPandas(part, "m int, i int, v double")
            .groupBy("m", "i").agg(F.sum("v").alias("v")).collect())
    vecs = [np.zeros(1 + p + p * p) for p in sizes]
    for r in rows:
        vecs[r["m"]][r["i"]] = r["v"]
    return [(v[0], v[1:1 + p], v[1 + p:].reshape(p, p)) for v, p in zip(vecs, sizes)]


def likelihood_passes(design: DataFrame, specs: list[tuple], y: str = "nps_ord", group_col: str | None = None):
    """``passes`` for ordinal models given as (cols, beta, t1, t2[, group])."""
    return passes(design, [{"cols": list(sp[0]), "theta": np.concatenate([np.asarray(sp[1], float), [sp[2], sp[3]]]), "link": ORDINAL,
                            "only": sp[4] if len(sp) > 4 else None} for sp in specs], y, group_col)


@dataclass
class OrdinalFit:
    features: list[str]
    beta: np.ndarray
    tau: np.ndarray
    llf: float
    llnull: float
    nobs: int
    class_counts: list[int]
    cov: np.ndarray
    iterations: int
    converged: bool
    grad_norm: float
    extras: dict = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.features)

    @property
    def n_params(self) -> int:
        return self.k + len(self.tau)

    @property
    def aic(self) -> float:
        return 2 * self.n_params - 2 * self.llf

    @property
    def bic(self) -> float:
        return self.n_params * math.log(self.nobs) - 2 * self.llf if self.nobs else math.nan

    @property
    def mcfadden(self) -> float:
        return 1 - self.llf / self.llnull if self.llnull else math.nan

    @property
    def bse(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))


def class_counts(design: DataFrame, y: str = "nps_ord") -> list[int]:
    rows = design.groupBy(y).count().collect()            # at most 3 rows
    m = {r[y]: r["count"] for r in rows}
    return [int(m.get(j, 0)) for j in range(3)]


def fit_ordinal(design: DataFrame, cols: list[str], y: str = "nps_ord", max_iter: int = 50,
                tol: float = 1e-9, persist: bool = True) -> OrdinalFit:
    """M7: maximum-likelihood fit; the design is cached for the iterations."""
    return fit_ordinal_many(design, {"_": cols}, y, max_iter, tol, persist)["_"]


def _direction(H: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Newton direction; directions that the data don't determine (null space of H) are left alone."""
    values, vectors = np.linalg.eigh(-H)
    known = values > 1e-12 * max(1.0, float(values[-1]))
    return vectors[:, known] @ ((vectors[:, known].T @ g) / values[known])


FLAT = 1e-7          # information per row below which a direction has run away


def _runs_away(theta: np.ndarray, H: np.ndarray, n: int) -> bool:
    """Separation: along some direction the likelihood rises forever, so its curvature is gone and the
    parameters have grown.  (A direction that is flat from the start, as of equal columns, hasn't grown.)"""
    values, vectors = np.linalg.eigh(-H / n)
    flat = vectors[:, values < FLAT]
    return bool(flat.size) and float(np.abs(flat.T @ theta).max()) > 8.0


def fit_ordinal_many(design: DataFrame, models: dict, y: str = "nps_ord", max_iter: int = 50,
                     tol: float = 1e-9, persist: bool = True, group_col: str | None = None,
                     links: dict[str, Link] | None = None, prep: dict | None = None, leave_out: bool = False) -> dict[str, OrdinalFit]:
    """Fit several specifications; every Newton pass over the data evaluates
    all models that are still iterating, whatever their ``links``.

    ``models`` maps name -> cols, or name -> (cols, group) together with
    ``group_col`` to fit each model on its own row group, or with ``leave_out``
    on all rows but the group's (CV folds).  ``prep`` maps name -> (caps, means,
    deviations).  A model without a maximum (a class has no row, or the classes are
    separated) comes back with ``converged`` false and NaN estimates.
    """
    spec = {m: (v if isinstance(v, tuple) else (v, None)) for m, v in models.items()}
    used = sorted({c for cols, _ in spec.values() for c in cols} | ({group_col} if group_col else set()))
    d = design.select(*used, y).filter(F.col(y).isNotNull())
    if persist:                       # reliable checkpoint: iterations survive executor loss
        d = materialize(d)
    cnt = d.groupBy(*([group_col] if group_col else []), y).count().collect()          # groups x 3 rows

    def counted(grp):
        rows = [r for r in cnt if grp is None or (r[group_col] != grp if leave_out else r[group_col] == grp)]
        return [sum(r["count"] for r in rows if r[y] == j) for j in range(3)]

    st = {}
    for m, (cols, grp) in spec.items():
        link, n_j = (links or {}).get(m, ORDINAL), counted(grp)
        able = link.possible(n_j)
        n = sum(n_j)
        st[m] = {"cols": list(cols), "link": link, "n": n, "n_j": n_j, "it": 0, "done": not able, "able": able, "conv": False, "s": 1.0,
                 "step": None, "llnull": float(sum(c * math.log(c / n) for c in n_j if c)) if n else 0.0,
                 "theta": link.start(len(cols), n_j) if able else np.full(len(cols) + link.extra, np.nan),
                 "job": {"cols": list(cols), "link": link, "prep": (prep or {}).get(m), "but" if leave_out else "only": grp}}

    def evaluate(thetas: dict) -> dict:
        found = passes(d, [{**st[m]["job"], "theta": t} for m, t in thetas.items()], y, group_col) if thetas else []
        return {m: st[m]["link"].penalised(*r, thetas[m]) for m, r in zip(thetas, found)}

    for m, (ll, g, H) in evaluate({m: s_["theta"] for m, s_ in st.items() if s_["able"]}).items():
        st[m].update(ll=ll, g=g, H=H)

    def close(s_):
        s_["done"] = True
        s_["conv"] = bool(np.max(np.abs(s_["g"])) < 1e-5 * max(1.0, s_["n"])) and not _runs_away(s_["theta"], s_["H"], s_["n"])

    for _ in range(max_iter * 40):
        active = [m for m in st if not st[m]["done"]]
        if not active:
            break
        cands = {}
        for m in active:
            s_ = st[m]
            if s_["step"] is None:                  # new Newton direction
                s_["it"] += 1
                s_["step"], s_["s"] = _direction(s_["H"], s_["g"]), 1.0
            while s_["s"] >= 1e-10:
                cand = s_["theta"] + s_["s"] * s_["step"]
                if s_["link"].admits(cand):
                    cands[m] = cand
                    break
                s_["s"] /= 2
            if m not in cands:                      # no admissible step left
                close(s_)
        for m, (ll_c, g_c, H_c) in evaluate(cands).items():
            s_ = st[m]
            if ll_c >= s_["ll"] - 1e-12 * max(1.0, abs(s_["ll"])):
                gain = ll_c - s_["ll"]
                s_.update(theta=cands[m], ll=ll_c, g=g_c, H=H_c, step=None)
                small = np.max(np.abs(g_c)) < tol * max(1.0, s_["n"]) or abs(gain) < 1e-13 * max(1.0, abs(ll_c))
                if small or s_["it"] >= max_iter or _runs_away(s_["theta"], H_c, s_["n"]):
                    close(s_)
            else:
                s_["s"] /= 2                        # step-halving on the next pass
                if s_["s"] < 1e-10:
                    close(s_)
    out = {}
    for m, s_ in st.items():
        k, p = len(s_["cols"]), len(s_["theta"])
        lost = not s_["able"] or (not s_["conv"] and _runs_away(s_["theta"], s_["H"], s_["n"]))
        theta = np.full(p, np.nan) if lost else s_["theta"]
        cov = np.full((p, p), np.nan) if lost else np.linalg.pinv(-s_["H"])
        out[m] = OrdinalFit(s_["cols"], theta[:k], theta[k:], float(s_["ll"]) if s_["able"] else math.nan, s_["llnull"], s_["n"],
                            s_["n_j"], cov, s_["it"], s_["conv"], float(np.max(np.abs(s_["g"]))) if s_["able"] else math.nan)
    return out


# ---- M9: probabilities and prediction as column expressions ------------------------
def _number(v: float):
    return F.lit(None).cast("double") if math.isnan(v) else F.lit(float(v))


def linear_predictor(fit: OrdinalFit, prep: tuple | None = None):
    """x.beta; with ``prep`` of the columns capped and standardised by it."""
    eta = F.lit(0.0)
    for i, (c, b) in enumerate(zip(fit.features, fit.beta)):
        x = F.col(c) if prep is None else (F.least(F.col(c), F.lit(float(prep[0][i]))) - F.lit(float(prep[1][i]))) / F.lit(float(prep[2][i]))
        eta = eta + x * _number(b)
    return eta


def _classified(design: DataFrame, eta, t1, t2) -> DataFrame:
    """Class probabilities and the likeliest class; NULL where the model has no estimates."""
    d = design.select("*", (1 / (1 + F.exp(-(t1 - eta)))).alias("_F1"), (1 / (1 + F.exp(-(t2 - eta)))).alias("_F2"))
    p0, p1, p2 = F.col("_F1"), F.col("_F2") - F.col("_F1"), 1 - F.col("_F2")
    pred = F.when(p0.isNull() | p2.isNull(), F.lit(None)).when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)
    return d.select(*design.columns, p0.alias("p_detractor"), p1.alias("p_passive"), p2.alias("p_promoter"), pred.alias("pred"))


def predict(design: DataFrame, fit: OrdinalFit) -> DataFrame:
    return _classified(design, linear_predictor(fit), _number(fit.tau[0]), _number(fit.tau[1]))


def predict_grouped(design: DataFrame, fits: dict, group_col: str, prep: dict | None = None) -> DataFrame:
    """M9 for models fitted per row group: pick each row's model (and preparation) by its group."""
    eta = t1 = t2 = F
    for grp, fit in fits.items():
        cond = F.col(group_col) == F.lit(grp)
        eta = eta.when(cond, linear_predictor(fit, (prep or {}).get(grp)))
        t1, t2 = t1.when(cond, _number(fit.tau[0])), t2.when(cond, _number(fit.tau[1]))
    return _classified(design.filter(F.col(group_col).isin(list(fits))), eta, t1, t2)


# ---- M10, M11 -------------------------------------------------------------------------------
def fit_statistics(spark, fits: dict[str, OrdinalFit]) -> DataFrame:
    """One row a model; a model without a maximum has NULL statistics and ``converged`` false."""
    some = lambda v, n: None if math.isnan(v) else round(v, n)
    rows = [(name, some(f.mcfadden, 4), some(f.aic, 2), some(f.bic, 2), some(f.llf, 2), f.k, f.nobs,
             f.converged) for name, f in fits.items()]
    return local_frame(spark, rows, [("model", "string"), ("mcfadden_r2", "double"), ("aic", "double"),
                                     ("bic", "double"), ("loglik", "double"), ("n_vars", "int"), ("nobs", "long"),
                                     ("converged", "boolean")])


def coefficient_table(spark, fit: OrdinalFit) -> DataFrame:
    """Coefficients (thresholds removed): coef, se, z, p, OR and 95 % CI, stars."""
    se = fit.bse[:fit.k]
    rows = []
    for name, b, s in zip(fit.features, fit.beta, se):
        z = b / s if s > 0 else float("nan")
        p = normal_two_sided(z) if s > 0 else float("nan")
        rows.append((name, float(b), float(s), float(z), float(p), math.exp(b),
                     math.exp(b - Z975 * s), math.exp(b + Z975 * s)))
    df = local_frame(spark, rows, [("feature", "string")] + [(c, "double") for c in
                                   ("coef", "std_err", "z", "p_value", "OR", "OR_CI_low", "OR_CI_high")])
    num = ["coef", "std_err", "z", "p_value", "OR", "OR_CI_low", "OR_CI_high"]
    df = df.select("feature", *[F.round(F.nanvl(F.col(c), F.lit(None)), 4).alias(c) for c in num])
    return (df.withColumn("sig", F.when(F.col("p_value").isNull(), F.lit("")).otherwise(X.stars("p_value")))
            .orderBy(F.col("coef").desc(), F.col("feature")))


def significant(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant predictors sorted by odds ratio."""
    return coefs.filter(F.col("p_value") < alpha).orderBy("OR", "feature")


def compare_models(c1: DataFrame, c2: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Common predictors significant in either model, by OR of the first."""
    a = c1.select("feature", F.col("OR").alias("OR1"), F.col("OR_CI_low").alias("CL1"),
                  F.col("OR_CI_high").alias("CH1"), F.col("p_value").alias("pv1"))
    b = c2.select("feature", F.col("OR").alias("OR2"), F.col("OR_CI_low").alias("CL2"),
                  F.col("OR_CI_high").alias("CH2"), F.col("p_value").alias("pv2"))
    return (a.join(b, "feature").filter((F.col("pv1") < alpha) | (F.col("pv2") < alpha))
            .orderBy("OR1", "feature"))


# ---- M13 ---------------------------------------------------------------------------------------
def marginal_effects(design: DataFrame, fit: OrdinalFit) -> DataFrame:
    """Average marginal effects on the three class probabilities (one pass)."""
    eta = linear_predictor(fit)
    F1 = 1 / (1 + F.exp(-(_number(fit.tau[0]) - eta)))
    F2 = 1 / (1 + F.exp(-(_number(fit.tau[1]) - eta)))
    m = design.agg(F.avg(F1 * (1 - F1)).alias("mf1"), F.avg(F2 * (1 - F2)).alias("mf2"))
    spark = design.sparkSession
    coef = local_frame(spark, [(c, None if math.isnan(b) else float(b)) for c, b in zip(fit.features, fit.beta)],
                       [("feature", "string"), ("beta", "double")])
    j = coef.crossJoin(m)           # k x 1 rows
    return (j.select("feature",
                     (F.col("mf2") * F.col("beta")).alias("AME_promoter"),
                     ((F.col("mf1") - F.col("mf2")) * F.col("beta")).alias("AME_passive"),
                     (-F.col("mf1") * F.col("beta")).alias("AME_detractor"))
            .orderBy(F.col("AME_promoter").desc(), F.col("feature")))
