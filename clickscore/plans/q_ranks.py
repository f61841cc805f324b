"""Queries for rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickscore.functions.constants import GROUP_LABELS, GROUPS
from clickscore.operators import ranks as R
from clickscore.operators._util import round_doubles
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import register
from clickscore.plans.q_describe import _ACTIVE, _long

_PRE = [O.fixtures_cte(), O.resp_cte(), O.base_cte(), O.profile_cte()]


def _kruskal_sql(long_cte: str, metric: str = "metric") -> str:
    """Plain form: rank() over the whole metric + tie count, rank sums, H."""
    return f"""
{long_cte},
lk AS (SELECT * FROM lraw WHERE v IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY {metric} ORDER BY v)
                 + (COUNT(*) OVER (PARTITION BY {metric}, v) - 1) / 2.0 AS r FROM lk),
cs AS (SELECT {metric}, nps_category, SUM(r) AS rs, COUNT(*) AS n FROM rk GROUP BY 1, 2),
tt AS (SELECT {metric}, SUM(CAST(t AS DOUBLE) * t * t - t) AS tt
       FROM (SELECT {metric}, v, COUNT(*) AS t FROM lk GROUP BY 1, 2) GROUP BY 1),
hs AS (SELECT {metric}, CAST(SUM(n) AS DOUBLE) AS nn, SUM(rs * rs / n) AS s, COUNT(*) AS k FROM cs GROUP BY 1),
kw AS (SELECT {metric}, CAST(nn AS BIGINT) AS n,
              CASE WHEN k < 3 THEN NULL WHEN tt = nn * nn * nn - nn THEN 0.0
                   ELSE (12.0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - tt / (nn * nn * nn - nn)) END AS h,
              CASE WHEN k < 3 OR tt = nn * nn * nn - nn THEN NULL
                   ELSE exp(-((12.0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - tt / (nn * nn * nn - nn))) / 2) END AS p
       FROM hs JOIN tt USING ({metric}))"""


def _rate_long(family: str = "rate") -> str:
    return "lraw AS (" + _long("profile", [f"{family}_{g}" for g in GROUPS], GROUPS, keep="nps_category",
                              name="grp") + ")"


def _kw_select(metric: str = "metric") -> str:
    return f"SELECT {metric}, n, {O.sround('h', 6)} AS H, {O.sround('p', 8)} AS p_value FROM kw"


def _kw_view(df, metric="metric"):
    return df.select(metric, "n", F.round("H", 6).alias("H"), F.round("p_value", 8).alias("p_value"))


@register("k1_kruskal_rates_raw", O.with_(*_PRE, _kruskal_sql(_rate_long(), "grp").strip("\n"))
          + _kw_select("grp"))
def k1_kruskal_rates_raw(spark, sf):
    from clickscore.operators import describe as D
    p = C.profile(spark, sf)
    long = D.stack(p, [f"rate_{g}" for g in GROUPS], ["nps_category"], "grp", "value", GROUPS)
    return _kw_view(R.kruskal(long, "grp"), "grp")


_STARS = "CASE WHEN p IS NULL THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"
_LAB = "lab AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.q(g)}, {O.q(GROUP_LABELS[g])})" for g in GROUPS) + ") t(grp, label))"


@register("k1_kruskal_rates", O.with_(*_PRE, _kruskal_sql(_rate_long(), "grp").strip("\n"), _LAB, """
mm AS (SELECT grp, AVG(CASE WHEN nps_category = 'detractor' THEN v END) AS md,
              AVG(CASE WHEN nps_category = 'passive' THEN v END) AS mp,
              AVG(CASE WHEN nps_category = 'promoter' THEN v END) AS mr FROM lraw GROUP BY 1)""") + f"""
SELECT grp, label, {O.sround('md', 4)} AS mean_detractor, {O.sround('mp', 4)} AS mean_passive,
       {O.sround('mr', 4)} AS mean_promoter, {O.sround('h', 2)} AS kruskal_H, {O.sround('p', 4)} AS p_value,
       {_STARS} AS sig
FROM kw JOIN mm USING (grp) JOIN lab USING (grp)""")
def k1_kruskal_rates(spark, sf):
    return R.kruskal_rates(C.profile(spark, sf))


@register("l6_top_discriminating", O.with_(*_PRE, _kruskal_sql(_rate_long(), "grp").strip("\n")) + """
SELECT grp FROM kw ORDER BY h DESC NULLS LAST, grp LIMIT 6""")
def l6_top_discriminating(spark, sf):
    return R.top_discriminating(R.kruskal_rates(C.profile(spark, sf))).select("grp")


_PM_W = f"""
pm AS (SELECT *, CAST(n_sessions AS DOUBLE) / (CAST(90 AS DOUBLE) / 7) AS sessions_per_week,
              {_ACTIVE} AS n_active_groups FROM profile),
c1 AS (SELECT quantile_cont(COALESCE(clicks_per_session, 0), 0.99) AS c, MAX(COALESCE(clicks_per_session, 0)) AS mx
       FROM pm),
c2 AS (SELECT quantile_cont(sessions_per_week, 0.99) AS c FROM pm),
pw AS (SELECT pm.*, LEAST(COALESCE(clicks_per_session, 0), CASE WHEN c1.c > 0 THEN c1.c ELSE c1.mx END) AS cps_w,
              LEAST(sessions_per_week, c2.c) AS spw_w FROM pm, c1, c2),
lraw AS (SELECT nps_category, 'clicks_per_session' AS metric, cps_w AS v FROM pw
         UNION ALL SELECT nps_category, 'sessions_per_week', spw_w FROM pw
         UNION ALL SELECT nps_category, 'n_distinct_features', CAST(n_distinct_features AS DOUBLE) FROM pw
         UNION ALL SELECT nps_category, 'n_active_groups', CAST(n_active_groups AS DOUBLE) FROM pw)"""


@register("k1_kruskal_profile_metrics", O.with_(*_PRE, _kruskal_sql(_PM_W.strip("\n")).strip("\n")) + _kw_select())
def k1_kruskal_profile_metrics(spark, sf):
    return _kw_view(R.profile_metric_tests(C.profile(spark, sf)))


_S_W = O.sessions_cte("feature_name", 30).strip("\n") + """,
sm AS (SELECT *, CAST(epoch_us(session_end) - epoch_us(session_start) AS DOUBLE) / 60000000.0 AS duration_min FROM seqs),
cd AS (SELECT quantile_cont(duration_min, 0.99) AS c FROM sm),
lraw AS (SELECT nps_category, 'duration_min' AS metric, LEAST(duration_min, c) AS v FROM sm, cd
         UNION ALL SELECT nps_category, 'session_length', CAST(session_length AS DOUBLE) FROM sm)"""


@register("k1_kruskal_session_metrics", O.with_(*_PRE, _kruskal_sql(_S_W).strip("\n")) + _kw_select())
def k1_kruskal_session_metrics(spark, sf):
    return _kw_view(R.session_metric_tests(C.session_rows(spark, sf, "feature_name", 30)))


# ---- K2 ------------------------------------------------------------------------------------
def _rank_cols(src: str, cols: list[str], names: list[str]) -> str:
    rk = ",\n  ".join(
        f"rank() OVER (ORDER BY COALESCE({c}, 0)) + (COUNT(*) OVER (PARTITION BY COALESCE({c}, 0)) - 1) / 2.0 AS r_{n}"
        for c, n in zip(cols, names))
    return f"rk AS (SELECT\n  {rk}\nFROM {src})"


def _k2_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(GROUPS) for b in GROUPS[i + 1:]]
    corr = ", ".join(f"corr(r_{a}, r_{b}) AS c_{a}__{b}" for a, b in pairs)
    rows = []
    for a, b in pairs:
        v = f"CASE WHEN isnan(c_{a}__{b}) THEN NULL ELSE c_{a}__{b} END"
        rows.append(f"SELECT '{a}' AS metric_1, '{b}' AS metric_2, {O.sround(v, 6)} AS rho FROM cc")
        rows.append(f"SELECT '{b}', '{a}', {O.sround(v, 6)} FROM cc")
    rows += [f"SELECT '{g}', '{g}', CAST(1.0 AS DOUBLE) FROM cc" for g in GROUPS]
    return O.with_(*_PRE, _rank_cols("profile", [f"rate_{g}" for g in GROUPS], GROUPS),
                   f"cc AS (SELECT {corr} FROM rk)") + "\nUNION ALL ".join(rows)


@register("k2_spearman_matrix", _k2_sql())
def k2_spearman_matrix(spark, sf):
    return round_doubles(R.spearman_matrix(C.profile(spark, sf)))


# ---- K3 -------------------------------------------------------------------------------------
def _k3_sql() -> str:
    rk = _rank_cols("(SELECT * FROM profile WHERE nps_score IS NOT NULL)",
                    [f"rate_{g}" for g in GROUPS] + ["nps_score"], GROUPS + ["score"])
    rows = [f"SELECT '{g}' AS metric, {O.sround(f'corr(r_{g}, r_score)', 6)} AS rho, COUNT(*) AS n FROM rk"
            for g in GROUPS]
    return O.with_(*_PRE, rk) + "\nUNION ALL ".join(rows)


@register("k3_spearman_score_rho", _k3_sql())
def k3_spearman_score_rho(spark, sf):
    return round_doubles(R.spearman_with_score(C.profile(spark, sf)))


def _k3_table_sql() -> str:
    """The t tail for whole degrees of freedom is a finite sum; its coefficients are ratios of gamma functions."""
    rk = _rank_cols("(SELECT * FROM profile WHERE nps_score IS NOT NULL)",
                    [f"rate_{g}" for g in GROUPS] + ["nps_score"], GROUPS + ["score"])
    each = " UNION ALL ".join(f"SELECT '{g}' AS grp, {O.q(GROUP_LABELS[g])} AS label, corr(r_{g}, r_score) AS r, COUNT(*) AS n FROM rk"
                              for g in GROUPS)
    coef = ("CASE WHEN odd = 0 THEN lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) ELSE lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) END")
    return O.with_(*_PRE, rk, f"raw AS ({each})", "cor AS (SELECT grp, label, CASE WHEN isnan(r) THEN NULL ELSE r END AS r, n FROM raw)",
                   "ang AS (SELECT *, (n - 2) % 2 AS odd, asin(abs(r)) AS th FROM cor)",
                   f"ser AS (SELECT *, list_sum([exp({coef} + 2 * k * ln(cos(th))) for k in range(CAST(floor((n - 2) / 2) AS BIGINT))]) AS s FROM ang)",
                   """tail AS (SELECT *, CASE WHEN odd = 0 THEN 1 - sin(th) * s
       ELSE 1 - 2 / pi() * (th + sin(th) * cos(th) * s) END AS p FROM ser)""") + f"""
SELECT grp, label, {O.sround('r', 3)} AS rho, {O.sround('p', 4)} AS p_val,
       CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig, n
FROM tail"""


@register("k3_spearman_score_table", _k3_table_sql())
def k3_spearman_score_table(spark, sf):
    return R.spearman_table(C.profile(spark, sf))
