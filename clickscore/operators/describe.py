"""Descriptive statistics over the profile and the sessions (D13-D30, Q1-Q6,
B11-B22).

The notebooks loop over columns in pandas; here each table is one Spark
aggregate: columns are unpivoted to long form (``stack``) when a statistic is
per column, and cut points (quantiles) are one-row aggregates cross-joined
back (a one-row frame is the only thing broadcast).  Exact quantiles are
linear-interpolated (as pandas) and come from ``exact_quantiles``, which
brackets them first, so no group's values meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import CATEGORIES, GROUP_LABELS, GROUPS, WINDOW_DAYS
from clickscore.operators._util import at_most, exact_quantiles, local_frame
from clickscore.operators.base import KEYS

# ---- fixed values: activity band labels (right-closed cuts at Q1, Q3, p95) ----
BANDS = ["Bajo (<Q1)", "Medio (Q1–Q3)", "Alto (Q3–p95)", "Power user (>p95)"]


def _one_row(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


def stack(df: DataFrame, cols: list[str], keep: list[str], name: str = "metric",
          value: str = "value", labels: list[str] | None = None) -> DataFrame:
    """Unpivot ``cols`` into (keep..., name, value) rows."""
    labels = labels or cols
    args = ", ".join(f"'{lab}', CAST(`{c}` AS DOUBLE)" for lab, c in zip(labels, cols))
    return df.select(*keep, F.expr(f"stack({len(cols)}, {args}) AS ({name}, {value})"))


def group_label_map():
    return F.create_map(*[x for g in GROUPS for x in (F.lit(g), F.lit(GROUP_LABELS[g]))])


# ---- B12-B17: derived per-row metrics ----------------------------------------------
def add_metrics(profile: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    active = " + ".join(f"(CASE WHEN clicks_{g} > 0 THEN 1 ELSE 0 END)" for g in GROUPS)
    return profile.select(
        "*",
        (F.col("n_sessions").cast("double") / F.lit(window_days / 7)).alias("sessions_per_week"),
        F.expr(f"{active} AS n_active_groups"),
        F.log1p(F.coalesce(F.col("total_feature_clicks").cast("double"), F.lit(0.0))).alias("log_total_clicks"),
        X.ordinal_code("nps_category").alias("nps_ord"))


def session_metrics(sessions: DataFrame) -> DataFrame:
    """Duration (min), start hour, weekday (Monday = 0)."""
    return sessions.select("*", X.duration_minutes("session_start", "session_end").alias("duration_min"),
                           F.hour("session_start").alias("hour"), F.weekday("session_start").alias("weekday"))


# ---- Q1-Q3 -----------------------------------------------------------------------
def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None,
              prefix: str = "q", approximate: bool = False) -> DataFrame:
    """Linear-interpolated quantiles, or with ``approximate`` those of a mergeable sketch; one row (per ``by`` group)."""
    names = [f"{prefix}{str(p).replace('0.', '')}" for p in probs]
    return exact_quantiles(df, col, probs, by, names, approximate=approximate)


def winsorize(df: DataFrame, col: str, p: float = 0.99, fill_zero_first: bool = False,
              out: str | None = None, cap_fallback_max: bool = False) -> DataFrame:
    """Q3: cap ``col`` at its exact p-quantile (computed on the same frame)."""
    out = out or col
    v = F.coalesce(F.col(col), F.lit(0.0)) if fill_zero_first else F.col(col)
    base = df.withColumn("_w", v.cast("double"))
    cap = exact_quantiles(base, "_w", [p], names=["_cap"])
    if cap_fallback_max:
        cap = (cap.crossJoin(_one_row(base.agg(F.max("_w").alias("_mx"))))
               .select(F.when(F.col("_cap") > 0, F.col("_cap")).otherwise(F.col("_mx")).alias("_cap")))
    return (base.crossJoin(_one_row(cap))
            .withColumn(out, X.cap_upper("_w", "_cap")).drop("_w", "_cap"))


# ---- D13 ---------------------------------------------------------------------------
def population_summary(profile: DataFrame) -> DataFrame:
    one = profile.agg(
        F.count(F.lit(1)).alias("n_teachers"),
        F.sum("total_feature_clicks").alias("total_events"),
        F.avg("total_feature_clicks").alias("avg_clicks"),
        F.avg("n_sessions").alias("avg_sessions"),
        F.avg("n_distinct_features").alias("avg_distinct_features"))
    median = exact_quantiles(profile, "total_feature_clicks", [0.5], names=["median_clicks"])
    return one.crossJoin(_one_row(median)).select("n_teachers", "total_events", "avg_clicks", "median_clicks",
                                                  "avg_sessions", "avg_distinct_features")


# ---- B18, D14 ------------------------------------------------------------------------
def activity_bands(profile: DataFrame) -> DataFrame:
    cuts = exact_quantiles(profile, "total_feature_clicks", [0.25, 0.75, 0.95], names=["q1", "q3", "p95"])
    t = F.col("total_feature_clicks")
    band = (F.when((t > -1) & (t <= F.col("q1")), F.lit(0)).when((t > F.col("q1")) & (t <= F.col("q3")), F.lit(1))
            .when((t > F.col("q3")) & (t <= F.col("p95")), F.lit(2)).when(t > F.col("p95"), F.lit(3)))
    return profile.crossJoin(_one_row(cuts)).withColumn("band_id", band)


def band_distribution(profile: DataFrame) -> DataFrame:
    b = activity_bands(profile)
    n_all = b.agg(F.count(F.lit(1)).alias("_n"), F.first("q1").alias("q1"), F.first("q3").alias("q3"),
                  F.first("p95").alias("p95"))
    counts = b.groupBy("band_id").agg(F.count(F.lit(1)).alias("n"))
    labels = local_frame(profile.sparkSession, list(enumerate(BANDS)), [("band_id", "int"), ("band", "string")])
    return (labels.join(counts, "band_id", "left").crossJoin(_one_row(n_all))
            .select("band_id", "band", F.coalesce("n", F.lit(0)).alias("n"),
                    F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("_n"), 1).cast("double").alias("pct"),
                    "q1", "q3", "p95"))


# ---- Q4 ---------------------------------------------------------------------------------
def clicks_histogram(profile: DataFrame, bins: int = 60, p: float = 0.99) -> DataFrame:
    w = winsorize(profile.select("total_feature_clicks"), "total_feature_clicks", p, out="x")
    rng = w.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rng = rng.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    idx = F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = w.crossJoin(_one_row(rng)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = profile.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(_one_row(rng))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).alias("n")))


# ---- D15, D16 --------------------------------------------------------------------------
def score_histogram(profile: DataFrame) -> DataFrame:
    n = profile.agg(F.count(F.lit(1)).alias("_n"))
    counts = profile.groupBy("nps_score").agg(F.count(F.lit(1)).alias("n"))
    grid = profile.sparkSession.range(11).select(F.col("id").cast("int").alias("nps_score"))
    return (grid.join(counts, "nps_score", "left").crossJoin(_one_row(n))
            .select("nps_score", F.coalesce("n", F.lit(0)).alias("n"),
                    F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("_n"), 1).cast("double").alias("pct")))


def category_share(profile: DataFrame) -> DataFrame:
    tot = profile.agg(F.count(F.lit(1)).alias("_n"))
    c = (profile.groupBy("nps_category").agg(F.count(F.lit(1)).alias("n")).crossJoin(_one_row(tot))
         .withColumn("pct", F.round(F.col("n") * 100.0 / F.col("_n"), 1).cast("double")))
    net = c.agg((F.sum(F.when(F.col("nps_category") == "promoter", F.col("pct")).otherwise(0.0))
                 - F.sum(F.when(F.col("nps_category") == "detractor", F.col("pct")).otherwise(0.0)))
                .alias("net_score"))
    return c.crossJoin(_one_row(net)).select("nps_category", "n", "pct", F.round("net_score", 1).alias("net_score"))


# ---- D17, D18 ------------------------------------------------------------------------------
def group_usage(profile: DataFrame) -> DataFrame:
    # one row of 11 x 3 aggregates and one of 11 medians, unpivoted last
    one = profile.agg(F.count(F.lit(1)).alias("_n"), *[F.expr(e) for g in GROUPS for e in (
        f"CAST(sum(clicks_{g}) AS BIGINT) AS t_{g}", f"round(avg(CAST(clicks_{g} AS DOUBLE)), 1) AS a_{g}", f"count_if(clicks_{g} > 0) AS u_{g}")])
    medians = exact_quantiles(profile, [f"clicks_{g}" for g in GROUPS], [0.5], names=[f"m_{g}" for g in GROUPS])
    args = ", ".join(f"'{g}', t_{g}, a_{g}, u_{g}, round(m_{g}, 1)" for g in GROUPS)
    g = one.crossJoin(_one_row(medians)).select("_n", F.expr(
        f"stack({len(GROUPS)}, {args}) AS (grp, total_clicks, avg_clicks, _users, median_clicks)"))
    # 11 rows: the cumulative share runs on one partition by design
    w = Window.orderBy(F.col("total_clicks").desc(), F.col("grp"))
    return g.select(
        "grp", group_label_map()[F.col("grp")].alias("label"), "total_clicks", "avg_clicks", "median_clicks",
        F.round(F.col("_users") * 100.0 / F.col("_n"), 1).cast("double").alias("penetration_pct"),
        F.round(F.sum("total_clicks").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 100.0
                / F.sum("total_clicks").over(Window.partitionBy()), 1).cast("double").alias("cum_pct"))


# ---- D19-D21 -----------------------------------------------------------------------------
def family_means(profile: DataFrame, family: str) -> DataFrame:
    """Category x group means of ``rate`` or ``intensity`` (NULLs skipped)."""
    long = stack(profile, [f"{family}_{g}" for g in GROUPS], ["nps_category"], "grp", "v", GROUPS)
    return long.groupBy("nps_category", "grp").agg(F.avg("v").alias(f"mean_{family}"))


def rate_gap(profile: DataFrame, family: str = "rate", hi: str = "promoter", lo: str = "detractor") -> DataFrame:
    long = stack(profile, [f"{family}_{g}" for g in GROUPS], ["nps_category"], "grp", "v", GROUPS)
    return long.groupBy("grp").agg(
        (F.avg(F.when(F.col("nps_category") == hi, F.col("v")))
         - F.avg(F.when(F.col("nps_category") == lo, F.col("v")))).alias("diff"))


# ---- D22 ------------------------------------------------------------------------------------
def metric_summary(df: DataFrame, metrics: list[str], by: str = "nps_category", max_groups: int | None = len(CATEGORIES)) -> DataFrame:
    """``max_groups`` bounds the values of ``by``; None if unknown."""
    med = exact_quantiles(df, metrics, [0.5], [by], [f"_q{i}" for i in range(len(metrics))], max_groups)
    stats = df.groupBy(by).agg(*[F.expr(f"{f}(CAST(`{m}` AS DOUBLE)) AS {n}{i}") for i, m in enumerate(metrics)
                                 for f, n in (("avg", "_m"), ("stddev_samp", "_s"), ("count", "_n"))])
    args = ", ".join(f"'{m}', _m{i}, _q{i}, _s{i}, _n{i}" for i, m in enumerate(metrics))
    return stats.join(at_most(med, max_groups), by).select(by, F.expr(f"stack({len(metrics)}, {args}) AS (metric, mean, median, std, n)")).select(
        "metric", by, "mean", "median", "std", "n")


# ---- D23 ------------------------------------------------------------------------------------
def time_profile(sessions: DataFrame, part: str = "hour") -> DataFrame:
    """% of sessions per hour (0-23) or weekday (0-6, Monday = 0) within category."""
    size = 24 if part == "hour" else 7
    s = session_metrics(sessions)
    counts = s.groupBy("nps_category", part).agg(F.count(F.lit(1)).alias("n"))
    cats = counts.select("nps_category").distinct()
    grid = cats.crossJoin(sessions.sparkSession.range(size).select(F.col("id").cast("int").alias(part)))
    m = grid.join(counts, ["nps_category", part], "left").fillna(0, ["n"])
    tot = F.sum("n").over(Window.partitionBy("nps_category"))
    return m.select("nps_category", part, "n", (F.col("n") * 100.0 / tot).cast("double").alias("pct"))


# ---- D24 ------------------------------------------------------------------------------------
def cooccurrence(profile: DataFrame) -> DataFrame:
    """% of answers with sessions in both groups (diagonal: own reach).

    One pass: 121 conditional counts in a single aggregate, then unpivot.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, g1 in enumerate(GROUPS):
        for j, g2 in enumerate(GROUPS):
            aggs.append(F.expr(f"count_if(sessions_{g1} > 0 AND sessions_{g2} > 0) AS c_{i}_{j}"))
    one = profile.agg(*aggs)
    pairs = [(g1, g2, f"c_{i}_{j}") for i, g1 in enumerate(GROUPS) for j, g2 in enumerate(GROUPS)]
    args = ", ".join(f"'{a}', '{b}', CAST({c} AS DOUBLE)" for a, b, c in pairs)
    long = one.select("_n", F.expr(f"stack({len(pairs)}, {args}) AS (group_1, group_2, both)"))
    return long.select("group_1", "group_2", (F.col("both") * 100.0 / F.col("_n")).alias("pct_users"))


# ---- D25, D26 ------------------------------------------------------------------------------
def null_audit(df: DataFrame) -> DataFrame:
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.expr(f"count_if(`{c}` IS NULL) AS _z{i}")
                                                  for i, c in enumerate(cols)])
    args = ", ".join(f"'{c}', _z{i}" for i, c in enumerate(cols))
    long = one.select("_n", F.expr(f"stack({len(cols)}, {args}) AS (column, n_null)"))
    return (long.select("column", F.round(F.col("n_null") * 100.0 / F.col("_n"), 1).cast("double").alias("pct_null"))
            .filter(F.col("pct_null") > 0))


def zero_audit(profile: DataFrame) -> DataFrame:
    long = stack(profile, [f"clicks_{g}" for g in GROUPS], [], "grp", "clicks", GROUPS)
    return long.groupBy("grp").agg(
        (F.avg(F.when(F.col("clicks") == 0, 1.0).otherwise(0.0)) * 100).alias("pct_zero_clicks"))


# ---- B17, D27, D28 ---------------------------------------------------------------------------
def heavy_flag(profile: DataFrame, p: float = 0.99) -> DataFrame:
    cut = exact_quantiles(profile, "total_feature_clicks", [0.95, p], names=["p95", "p99"]).crossJoin(
        _one_row(profile.agg(F.max("total_feature_clicks").alias("max_clicks"))))
    return profile.crossJoin(_one_row(cut)).withColumn("is_power", F.col("total_feature_clicks") > F.col("p99"))


def outlier_summary(profile: DataFrame) -> DataFrame:
    h = heavy_flag(profile)
    return h.agg(F.first("p95").alias("p95"), F.first("p99").alias("p99"), F.first("max_clicks").alias("max_clicks"),
                 F.count_if("is_power").alias("n_outliers"),
                 F.round(F.count_if("is_power") * 100.0 / F.count(F.lit(1)), 1).cast("double").alias("pct_outliers"))


def outlier_categories(profile: DataFrame) -> DataFrame:
    h = heavy_flag(profile)
    return h.groupBy("is_power", "nps_category").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("is_power")), 1).cast("double"))


def heavy_profile(profile: DataFrame) -> DataFrame:
    h = heavy_flag(profile)
    return h.groupBy("is_power").agg(*[F.round(F.avg(c), 1).alias(c) for c in
                                       ("total_feature_clicks", "n_sessions", "n_distinct_features",
                                        "clicks_per_session")])


# ---- D29 -------------------------------------------------------------------------------------
def predictor_summary(profile: DataFrame, families: tuple = ("rate", "intensity")) -> DataFrame:
    cols = [f"{f}_{g}" for f in families for g in GROUPS]
    long = stack(profile, cols, [], "variable", "v").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return long.groupBy("variable").agg(
        F.round(F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0)) * 100, 1).alias("pct_zeros"),
        F.round(F.avg("v"), 5).alias("mean_raw"), F.round(F.stddev_samp("v"), 5).alias("std_raw")).join(
            exact_quantiles(long, "v", [0.99], ["variable"], ["_p99"], len(cols)), "variable").select(
        "variable", "pct_zeros", "mean_raw", "std_raw", F.round("_p99", 5).alias("p99"), (F.col("pct_zeros") > 30).alias("sparse"))


# ---- D30 -------------------------------------------------------------------------------------
def session_length_summary(sessions: DataFrame) -> DataFrame:
    med = exact_quantiles(sessions, "session_length", [0.5], ["nps_category"], ["_med"], len(CATEGORIES))
    return (sessions.groupBy("nps_category").agg(
        F.round(F.avg("session_length"), 2).alias("mean"),
        F.round(F.stddev_samp("session_length"), 2).alias("std"),
        F.count(F.lit(1)).alias("count")).join(med, "nps_category")
        .select("nps_category", "mean", F.round("_med", 2).alias("median"), "std", "count"))


# ---- Q5, Q6 ----------------------------------------------------------------------------------
def box_stats(df: DataFrame, value: str, by: list[str], max_groups: int | None = None) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers (the most extreme points inside the fences); at most ``max_groups`` boxes."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, ["q1", "median", "q3"], max_groups).join(
        at_most(df.groupBy(*by).agg(F.count(value).alias("n")), max_groups), by)
    j = df.join(at_most(q, max_groups), by)
    iqr = F.col("q3") - F.col("q1")
    v = F.col(value)
    return j.groupBy(*by, "q1", "median", "q3", "n").agg(
        F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_hi"))


def rate_boxes(profile: DataFrame, p: float = 0.99) -> DataFrame:
    """Box numbers per (group, category) for rate_* after NULL->0 and a cap at
    the p-quantile of the raw (non-null) values."""
    long = stack(profile, [f"rate_{g}" for g in GROUPS], ["nps_category"], "grp", "v", GROUPS)
    caps = exact_quantiles(long, "v", [p], ["grp"], ["_cap"], len(GROUPS))
    w = (long.join(F.broadcast(caps), "grp")       # 11 rows
         .withColumn("x", X.cap_upper(F.coalesce("v", F.lit(0.0)), "_cap")))
    return box_stats(w, "x", ["grp", "nps_category"], len(GROUPS) * len(CATEGORIES))


def band_boxes(profile: DataFrame) -> DataFrame:
    b = activity_bands(profile)
    b = b.select("band_id", F.least(F.col("total_feature_clicks").cast("double"), F.col("p95") * 1.5).alias("x"))
    return box_stats(b.filter(F.col("band_id").isNotNull()), "x", ["band_id"], len(BANDS))


def session_length_boxes(sessions: DataFrame, cap: int = 20) -> DataFrame:
    s = sessions.withColumn("x", F.least(F.col("session_length"), F.lit(cap)).cast("double"))
    return box_stats(s, "x", ["nps_category"], len(CATEGORIES))


def violin_summary(df: DataFrame, col: str, p: float = 0.99, fill_zero: bool = True,
                   cap_fallback_max: bool = True) -> DataFrame:
    w = winsorize(df, col, p, fill_zero_first=fill_zero, out="x", cap_fallback_max=cap_fallback_max)
    med = exact_quantiles(w, "x", [0.5], ["nps_category"], ["median"], len(CATEGORIES))
    return (w.groupBy("nps_category").agg(
        F.stddev_pop("x").alias("std_pop"), (F.stddev_pop("x") > 0).alias("has_variance"),
        F.count(F.lit(1)).alias("n")).join(med, "nps_category")
        .select("nps_category", "median", "std_pop", "has_variance", "n"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["KEYS"]
