"""Model specifications and evaluation.

Every scan is a Spark job over the profile; the driver only orchestrates a
fixed number of fits (4 specifications, 1 train/test, 5 folds) and keeps
constant-size results (coefficients, accuracies).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.functions.constants import CATEGORIES
from clickscore.operators import design as DS
from clickscore.operators import ordinal as OR
from clickscore.operators._util import exact_quantiles, local_frame, materialize
from clickscore.operators.base import KEYS

ALL_COLS = DS.RATE_COLS + DS.INTENSITY_COLS + DS.BEHAV_COLS


def full_design(profile: DataFrame, p: float = 0.99) -> DataFrame:
    """All prepared predictor families in one frame (each column prepared on its own)."""
    prof = DS.with_target(profile)
    d = DS.prepare_design(prof, ALL_COLS, p, keep=KEYS + ["nps_ord", DS.SCALE_COL])
    return DS.log_volume(d, keep=KEYS + ["nps_ord"] + ALL_COLS)


@dataclass
class Specs:
    design: DataFrame
    vif_rate: DataFrame
    vif_intensity: DataFrame
    high_rate: list
    high_intensity: list
    columns: dict


def specifications(profile: DataFrame) -> Specs:
    """M8: A rate, B intensity, C rate + behaviour, D rate + log volume; VIF>10 dropped
    (the rate list is used for A, C and D, the intensity list for B), then constant
    columns and columns that others determine."""
    d = materialize(full_design(profile))
    vr, vi = DS.vif(d, DS.RATE_COLS), DS.vif(d, DS.INTENSITY_COLS)
    hr, hi = DS.high_vif(vr), DS.high_vif(vi)
    rate_clean = [c for c in DS.RATE_COLS if c not in hr]
    cols = {"A": rate_clean, "B": [c for c in DS.INTENSITY_COLS if c not in hi],
            "C": rate_clean + DS.BEHAV_COLS, "D": rate_clean + ["log_total_clicks"]}
    return Specs(d, vr, vi, hr, hi, {m: DS.independent(d, c) for m, c in cols.items()})


CHECKS = {"promoter_vs_rest": 2, "detractor_vs_rest": 0}       # M18: binary checks of specification A


def fit_all(specs: Specs, C: float = 1.0) -> dict[str, OR.OrdinalFit]:
    """The specifications and the penalised binary checks of A, all fitted in the same passes."""
    models = {**specs.columns, **{name: specs.columns["A"] for name in CHECKS}}
    return OR.fit_ordinal_many(specs.design, models, links={name: OR.binary(j, C) for name, j in CHECKS.items()})


# ---- M15-M17 -----------------------------------------------------------------------------
def accuracy(pred: DataFrame, y: str = "nps_ord") -> DataFrame:
    """Accuracy, majority-class baseline and gain in one aggregate."""
    counts = pred.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    maj = counts.agg(F.max_by(y, F.struct(F.col("n"), -F.col(y))).alias("majority_class"),
                     F.max("n").alias("_nmax"), F.sum("n").alias("_n"))
    acc = pred.agg(F.avg((F.col("pred") == F.col(y)).cast("double")).alias("accuracy"))
    return (acc.crossJoin(maj).select(
        "accuracy", "majority_class", (F.col("_nmax") / F.col("_n")).alias("baseline"),
        F.round(F.col("accuracy") - F.col("_nmax") / F.col("_n"), 4).alias("gain_vs_baseline")))


def confusion(pred: DataFrame, y: str = "nps_ord") -> DataFrame:
    spark = pred.sparkSession
    grid = spark.range(3).select(F.col("id").cast("int").alias("true")).crossJoin(
        spark.range(3).select(F.col("id").cast("int").alias("predicted")))
    c = pred.groupBy(F.col(y).cast("int").alias("true"), F.col("pred").cast("int").alias("predicted")).count()
    return grid.join(c, ["true", "predicted"], "left").select("true", "predicted",
                                                               F.coalesce("count", F.lit(0)).alias("n"))


def classification_report(pred: DataFrame, y: str = "nps_ord") -> DataFrame:
    """Per class precision/recall/F1/support + accuracy, macro and weighted averages
    (0 where a denominator is 0)."""
    cm = confusion(pred, y)
    per = cm.groupBy(F.col("true").alias("cls")).agg(
        F.sum(F.when(F.col("true") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
    predicted = cm.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("npred"))
    r = per.join(predicted, "cls")
    prec = F.coalesce(F.try_divide("tp", "npred"), F.lit(0.0))
    rec = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    r = r.select("cls", prec.alias("precision"), rec.alias("recall"), "support", "tp")
    r = r.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    names = F.create_map(*[x for i, c in enumerate(CATEGORIES) for x in (F.lit(i), F.lit(c))])
    rows = r.select(names[F.col("cls")].alias("label"), "precision", "recall", "f1", F.col("support").cast("long"))
    tot = r.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(n)
                  for c, n in (("precision", "wp"), ("recall", "wr"), ("f1", "wf"))])
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), F.try_divide("tp", "n").alias("f1"),
                     F.col("n").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)


def train_test(profile: DataFrame, cols: list[str], frac: float = 0.8, seed: int = 42):
    """Split, prepare with train statistics, fit on train, predict test."""
    prof = DS.with_target(profile)
    s = materialize(DS.stratified_split(prof, frac, seed))
    tr, te = DS.prepare_design_pair(s.filter("is_train"), s.filter("NOT is_train"), DS.RATE_COLS)
    fit = OR.fit_ordinal(tr, cols)
    pred = OR.predict(te, fit)
    return fit, pred


def fold_frame(profile: DataFrame, cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Keys, target, ``fold`` and the raw columns with NULL -> 0, stored once."""
    f = DS.stratified_folds(DS.with_target(profile), k, seed)
    return materialize(f.select(*KEYS, "nps_ord", "fold", *[F.expr(f"coalesce(CAST(`{c}` AS DOUBLE), 0.0) AS `{c}`") for c in cols]))


def fold_preparation(folds: DataFrame, cols: list[str], k: int = 5, p: float = 0.99) -> dict[int, tuple]:
    """Caps, means and deviations of every fold's training part (all other folds), without copying a row:
    a training part is a set of conditional aggregates over the one frame."""
    if not cols:
        return {i: (np.zeros(0), np.zeros(0), np.ones(0)) for i in range(k)}
    cells = [(i, c) for i in range(k) for c in cols]
    part = folds.selectExpr("fold", *[f"CASE WHEN fold <> {i} THEN `{c}` END AS x{i}_{n}" for i in range(k) for n, c in enumerate(cols)])
    names = [f"x{i}_{n}" for i in range(k) for n in range(len(cols))]
    caps = exact_quantiles(part, names, [p], names=names).first()                       # k x columns numbers
    cap = {cell: caps[n] for cell, n in zip(cells, names)}
    some = [n for n, cell in zip(names, cells) if cap[cell] is not None]
    got = part.agg(*[F.expr(f"{f}(CASE WHEN {n} > {caps[n]!r}D THEN {caps[n]!r}D ELSE {n} END) AS {f}_{n}") for n in some for f in ("avg", "stddev_pop")]).first() if some else {}
    out = {}
    for i in range(k):
        mine = [f"x{i}_{n}" for n in range(len(cols))]
        if all(n in some for n in mine):
            dev = np.array([got[f"stddev_pop_{n}"] for n in mine])
            out[i] = np.array([caps[n] for n in mine]), np.array([got[f"avg_{n}"] for n in mine]), np.where(dev == 0, 1.0, dev)
    return out


def fold_accuracy(folds: DataFrame, fits: dict, prep: dict) -> DataFrame:
    """Accuracy of each fold's model on the fold; folds are numbered from 1."""
    pred = OR.predict_grouped(folds, fits, "fold", prep)
    return (pred.groupBy((F.col("fold") + 1).cast("int").alias("fold"))
            .agg(F.avg((F.col("pred") == F.col("nps_ord")).cast("double")).alias("cv_accuracy")))


def cross_validate(profile: DataFrame, cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Per-fold accuracy.

    The k models are fitted side by side over one frame; every model prepares a row
    with its own training statistics as it reads it.  A fold whose training part
    lacks a class is skipped, as in the study.
    """
    f = fold_frame(profile, cols, k, seed)
    prep = fold_preparation(f, cols, k)
    fits = OR.fit_ordinal_many(f, {i: (cols, i) for i in prep}, group_col="fold", persist=False, prep=prep, leave_out=True)
    fits = {i: fit for i, fit in fits.items() if min(fit.class_counts) > 0}
    if not fits:
        return local_frame(profile.sparkSession, [], [("fold", "int"), ("cv_accuracy", "double")])
    return fold_accuracy(f, fits, prep)


def cv_summary(folds: DataFrame) -> DataFrame:
    return folds.agg(F.avg("cv_accuracy").alias("mean_accuracy"), F.stddev_pop("cv_accuracy").alias("std_accuracy"),
                     F.count(F.lit(1)).alias("n_folds"))


# ---- M18, M19 -------------------------------------------------------------------------------
def binary_logit(design: DataFrame, cols: list[str], positive: int, C: float = 1.0,
                 y: str = "nps_ord", name: str = "coef") -> DataFrame:
    """L2-penalised logistic regression of (y == positive) vs rest: minimises
    0.5 |w|^2 / C + sum(logloss), by the same passes as the ordinal fit."""
    fit = OR.fit_ordinal_many(design, {"_": cols}, y, links={"_": OR.binary(positive, C)})["_"]
    return check_table(design.sparkSession, fit, name)


def check_table(spark, fit: OR.OrdinalFit, name: str = "coef") -> DataFrame:
    """Feature and coefficient of a binary check, largest first."""
    rows = [(c, None if np.isnan(b) else float(b)) for c, b in zip(fit.features, fit.beta)]
    return local_frame(spark, rows, [("feature", "string"), (name, "double")]).orderBy(F.col(name).desc())


def parallel_lines(coef_ordinal: DataFrame, check_a: DataFrame, check_b: DataFrame) -> DataFrame:
    """Does each ordinal coefficient point the same way as promoter-vs-rest and
    the other way than detractor-vs-rest?  The share is over all features (<= 16 rows).

    Result column names are fixed by the study: coef_ordinal, coef_promoVsResto,
    coef_detractVsResto, consist_A, consist_B, consistente, pct_consistent.
    """
    tall = (coef_ordinal.selectExpr("feature", "'coef_ordinal' AS model", "coef")
            .union(check_a.selectExpr("feature", "'coef_promoVsResto'", "coef_checkA"))
            .union(check_b.selectExpr("feature", "'coef_detractVsResto'", "coef_checkB")))
    names = ["coef_ordinal", "coef_promoVsResto", "coef_detractVsResto"]
    wide = tall.groupBy("feature").pivot("model", names).agg(F.first("coef")).dropna(subset=names)
    up, promoter, detractor = [F.signum(n) for n in names]
    judged = wide.withColumns({"consist_A": up == promoter, "consist_B": up != detractor,
                               "consistente": (up == promoter) & (up != detractor)})
    share = judged.agg((100 * F.count_if("consistente") / F.count(F.lit(1))).alias("pct_consistent"))
    return judged.crossJoin(F.broadcast(share))          # one row
