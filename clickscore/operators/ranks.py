"""Rank statistics.

Average ranks without a global sort: rows are first compacted to
(metric, value) -> tie count (a partial aggregate; rates are rounded to 4
decimals, so values repeat a lot), a running count over the *distinct
values* of each metric gives "rows before", and rank = before + (t + 1) / 2.
The rank is joined back on (metric, value) where per-row ranks are needed.

Kruskal-Wallis H comes out of per-(metric, category) rank sums; with the
three score categories the chi-square tail has 2 d.o.f., so p = exp(-H/2)
exactly and stays a column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import CATEGORIES, GROUP_LABELS, GROUPS
from clickscore.functions.distributions import t_pvalue_udf
from clickscore.operators import describe as D
from clickscore.operators._util import at_most, join_on_keys, materialize
from clickscore.operators.base import KEYS


def rank_index(long: DataFrame, metric: str = "metric", group: str = "nps_category", value: str = "value") -> DataFrame:
    """(metric, value, group, ``c``): how often each value occurs in each group, stored.  One scan of the
    long frame; ranks, ties, rank sums and means are all read from this table of distinct values."""
    return materialize(long.filter(F.col(value).isNotNull()).groupBy(metric, value, group).agg(F.count(F.lit(1)).alias("c")))


def value_ranks(long: DataFrame, part: list[str], value: str = "value", ranges: int = 256, max_groups: int | None = None,
                counts: DataFrame | None = None) -> DataFrame:
    """(part..., value, t, rank): tie-averaged rank of each distinct value.  ``max_groups`` is a
    known bound on the combinations of ``part``; tables of one row each are broadcast only with it.
    ``counts`` (part..., value, t) spares the scan of ``long``.

    Distinct values are compacted first (value -> tie count t).  A window over
    all distinct values of a metric would run in one task, so each metric's
    values are cut into ``ranges`` ordered slices at approximate quantiles (one
    mergeable aggregate); the exact rank is the slice's offset (a table of
    metrics x ranges counts) plus the running count inside the slice.
    """
    d = counts if counts is not None else long.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("t"))
    probs = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = d.groupBy(*part).agg(F.percentile_approx(value, probs).alias("_cuts"))
    if ranges <= 1:                                     # one slice
        cuts = cuts.withColumn("_cuts", F.array().cast("array<double>"))
    d = d.join(at_most(cuts, max_groups), part).withColumn("_rg", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    rc = d.groupBy(*part, "_rg").agg(F.sum("t").alias("_c"))
    wo = Window.partitionBy(*part).orderBy("_rg").rowsBetween(Window.unboundedPreceding, -1)
    off = rc.select(*part, "_rg", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*part, "_rg").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("t").over(w), F.lit(0))).join(
        at_most(off, max_groups and max_groups * ranges), [*part, "_rg"])
    return d.select(*part, value, "t", (F.col("_off") + F.col("_in") + (F.col("t") + 1) / 2.0).alias("rank"))


def kruskal(long: DataFrame, metric: str = "metric", group: str = "nps_category", value: str = "value",
            n_groups: int = len(CATEGORIES), max_metrics: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """H and p per metric; NULLs dropped.

    H is NULL when a group has no values; H = 0 and p NULL when all values
    are equal (the notebook catches that case the same way).
    """
    c = index if index is not None else rank_index(long, metric, group, value)
    r = materialize(value_ranks(long, [metric], value, max_groups=max_metrics, counts=c.groupBy(metric, value).agg(F.sum("c").alias("t"))))
    rs = (c.join(r.select(metric, value, "rank"), [metric, value])
          .groupBy(metric, group).agg(F.sum(F.col("c") * F.col("rank")).alias("R"), F.sum("c").alias("n")))
    hs = rs.groupBy(metric).agg(F.sum("n").cast("double").alias("N"),
                                F.sum(F.col("R") * F.col("R") / F.col("n")).alias("S"),
                                F.count(F.lit(1)).alias("k"))
    ties = r.groupBy(metric).agg(F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("tt"))
    j = hs.join(ties, metric)
    N = F.col("N")
    denom = N * N * N - N
    raw = (F.lit(12.0) / (N * (N + 1)) * F.col("S") - 3 * (N + 1)) / (1 - F.col("tt") / denom)
    H = (F.when(F.col("k") < n_groups, F.lit(None).cast("double"))
         .when(F.col("tt") == denom, F.lit(0.0)).otherwise(raw))
    p = F.when(F.col("k") < n_groups, F.lit(None).cast("double")).when(F.col("tt") == denom, F.lit(None)) \
        .otherwise(F.exp(-raw / 2)) if n_groups == 3 else F.lit(None).cast("double")
    return j.select(metric, F.col("N").cast("long").alias("n"), H.alias("H"), p.alias("p_value"))


def group_means(index: DataFrame, metric: str = "metric", group: str = "nps_category",
                value: str = "value") -> DataFrame:
    """Mean per metric and category, from a rank index."""
    return (index.groupBy(metric).pivot(group, CATEGORIES).agg(F.sum(F.col(value) * F.col("c")) / F.sum("c"))
            .select(metric, *[F.col(c).alias(f"mean_{c}") for c in CATEGORIES]))


def kruskal_rates(profile: DataFrame, family: str = "rate") -> DataFrame:
    """K1 table of the notebook: per group means (4 dp), H (2 dp), p (4 dp), stars."""
    long = D.stack(profile, [f"{family}_{g}" for g in GROUPS], ["nps_category"], "grp", "value", GROUPS)
    index = rank_index(long, "grp")
    k = kruskal(long, "grp", max_metrics=len(GROUPS), index=index)
    m = group_means(index, "grp")
    return (k.join(m, "grp")
            .select("grp", D.group_label_map()[F.col("grp")].alias("label"),
                    *[F.round(f"mean_{c}", 4).alias(f"mean_{c}") for c in CATEGORIES],
                    F.round("H", 2).alias("kruskal_H"), F.round("p_value", 4).alias("p_value"),
                    F.when(F.col("p_value").isNull(), F.lit("")).otherwise(X.stars("p_value")).alias("sig")))


def top_discriminating(kr: DataFrame, k: int = 6) -> DataFrame:
    """The k groups with the largest H."""
    return kr.orderBy(F.col("kruskal_H").desc_nulls_last(), F.col("grp")).limit(k)


def profile_metric_tests(profile: DataFrame) -> DataFrame:
    """K1 on the behaviour metrics, each prepared as the notebook does."""
    pm = D.add_metrics(profile)
    pm = D.winsorize(pm, "clicks_per_session", 0.99, fill_zero_first=True, out="cps_w", cap_fallback_max=True)
    pm = D.winsorize(pm, "sessions_per_week", 0.99, out="spw_w")
    cols = ["cps_w", "spw_w", "n_distinct_features", "n_active_groups"]
    names = ["clicks_per_session", "sessions_per_week", "n_distinct_features", "n_active_groups"]
    long = D.stack(pm, cols, ["nps_category"], "metric", "value", names)
    return kruskal(long, max_metrics=len(names))


def session_metric_tests(sessions: DataFrame) -> DataFrame:
    """K1 on session duration (capped at p99) and session length (raw)."""
    s = D.winsorize(D.session_metrics(sessions), "duration_min", 0.99, out="dur_w")
    long = D.stack(s, ["dur_w", "session_length"], ["nps_category"], "metric", "value",
                   ["duration_min", "session_length"])
    return kruskal(long, max_metrics=2)


def _ranked_rows(long: DataFrame, metric: str = "metric", value: str = "value", max_groups: int | None = len(GROUPS)) -> DataFrame:
    """Each row with the average rank of its value.

    Zero is most rows' value (unused groups): its rank is one constant per
    metric, so only the other values meet in a join on (metric, value).
    """
    r = materialize(value_ranks(long, [metric], value, max_groups=max_groups).select(metric, value, "rank"))
    zero = at_most(r.filter(F.col(value) == 0).select(metric, "rank"), max_groups)
    zeros = long.filter(F.col(value) == 0).join(zero, metric)
    rest = long.filter(F.col(value) != 0).join(r, [metric, value])
    return zeros.select(*long.columns, "rank").union(rest.select(*long.columns, "rank"))


def spearman_matrix(profile: DataFrame, family: str = "rate") -> DataFrame:
    """K2: Spearman correlation of the 11 columns (NULL -> 0), long form."""
    cols = [f"{family}_{g}" for g in GROUPS]
    filled = profile.select(*KEYS, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    long = D.stack(filled, cols, KEYS, "metric", "value", GROUPS)
    ranked = _ranked_rows(long)
    wide = ranked.groupBy(*KEYS).pivot("metric", GROUPS).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(GROUPS) for b in GROUPS[i + 1:]]
    one = wide.agg(*[F.expr(f"corr(`{a}`, `{b}`) AS `{a}__{b}`") for a, b in pairs])
    args = ", ".join(f"'{a}', '{b}', `{a}__{b}`, '{b}', '{a}', `{a}__{b}`" for a, b in pairs)
    diag = ", ".join(f"'{g}', '{g}', CAST(1.0 AS DOUBLE)" for g in GROUPS)
    long_out = one.select(F.expr(f"stack({2 * len(pairs) + len(GROUPS)}, {args}, {diag}) AS (metric_1, metric_2, rho)"))
    return long_out.withColumn("rho", F.when(F.isnan("rho"), F.lit(None)).otherwise(F.col("rho")))


def spearman_with_score(profile: DataFrame, family: str = "rate") -> DataFrame:
    """K3: rho of each column (NULL -> 0) with the numeric score, t-test p.

    Rows with a non-numeric score (NULL) are left out pairwise.
    """
    cols = [f"{family}_{g}" for g in GROUPS]
    base = profile.filter(F.col("nps_score").isNotNull()).select(
        *KEYS, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols])
    long = D.stack(base, cols, KEYS, "metric", "value", GROUPS)
    xr = _ranked_rows(long).withColumnRenamed("rank", "rx")
    sc = base.select(*KEYS, F.lit("score").alias("m"), F.col("nps_score").cast("double").alias("value"))
    sr = _ranked_rows(sc.withColumnRenamed("m", "metric")).select(*KEYS, F.col("rank").alias("ry"))
    j = join_on_keys(xr, sr, KEYS)
    g = j.groupBy("metric").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("rho", F.when(F.isnan("rho"), F.lit(None)).otherwise(F.col("rho")))
    return g


def spearman_table(profile: DataFrame, family: str = "rate") -> DataFrame:
    g = spearman_with_score(profile, family)
    dof = F.col("n") - 2
    t = F.col("rho") * F.sqrt(dof / (1 - F.col("rho") * F.col("rho")))
    g = g.withColumn("p_val", t_pvalue_udf(t, dof.cast("double")))
    return g.select(F.col("metric").alias("grp"), D.group_label_map()[F.col("metric")].alias("label"),
                    F.round("rho", 3).alias("rho"), F.round("p_val", 4).alias("p_val"),
                    F.when(F.col("p_val").isNull(), F.lit("")).otherwise(X.stars("p_val")).alias("sig"), "n").orderBy(
                        F.desc_nulls_last("rho"), "grp")                      # 11 rows


__all__ = ["value_ranks", "kruskal", "kruskal_rates", "top_discriminating", "profile_metric_tests",
           "session_metric_tests", "spearman_matrix", "spearman_with_score", "spearman_table", "GROUP_LABELS"]
