"""Queries for descriptive statistics."""

from __future__ import annotations

from clickscore.functions.constants import GROUP_LABELS, GROUPS
from clickscore.operators import describe as D
from clickscore.operators import sessions as S
from clickscore.operators._util import round_doubles
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import register

_PRE = [O.fixtures_cte(), O.resp_cte(), O.base_cte(), O.profile_cte()]
_ACTIVE = " + ".join(f"(CASE WHEN clicks_{g} > 0 THEN 1 ELSE 0 END)" for g in GROUPS)
_PM = f"""
pm AS (SELECT *, CAST(n_sessions AS DOUBLE) / (CAST(90 AS DOUBLE) / 7) AS sessions_per_week,
              {_ACTIVE} AS n_active_groups FROM profile)"""
_SESS30 = O.sessions_cte("feature_name", 30)
_SM = """
sm AS (SELECT *, CAST(epoch_us(session_end) - epoch_us(session_start) AS DOUBLE) / 60000000.0 AS duration_min,
              hour(session_start) AS hour, CAST(isodow(session_start) - 1 AS INTEGER) AS weekday FROM seqs)"""


def _sql(*ctes: str, select: str, rnd: tuple = ()) -> str:
    body = O.with_(*_PRE, *ctes) + select
    if not rnd:
        return body
    rep = ", ".join(f"{O.sround(c, 6)} AS {c}" for c in rnd)
    return f"SELECT * REPLACE ({rep}) FROM ({body}) _t"


def _long(src: str, cols: list[str], labels: list[str], keep: str = "", name: str = "grp", value: str = "v") -> str:
    k = f"{keep}, " if keep else ""
    return " UNION ALL ".join(f"SELECT {k}'{lab}' AS {name}, CAST({c} AS DOUBLE) AS {value} FROM {src}"
                              for c, lab in zip(cols, labels))


def _prof(spark, sf):
    return C.profile(spark, sf)


def _pm(spark, sf):
    return D.add_metrics(C.profile(spark, sf))


def _s30(spark, sf):
    return C.session_rows(spark, sf, "feature_name", 30)


# ---- D13 ----------------------------------------------------------------------------
@register("d13_population_summary", _sql(select="""
SELECT COUNT(*) AS n_teachers, CAST(SUM(total_feature_clicks) AS BIGINT) AS total_events,
       AVG(total_feature_clicks) AS avg_clicks, CAST(MEDIAN(total_feature_clicks) AS DOUBLE) AS median_clicks,
       AVG(n_sessions) AS avg_sessions, AVG(n_distinct_features) AS avg_distinct_features
FROM profile""", rnd=("avg_clicks", "median_clicks", "avg_sessions", "avg_distinct_features")))
def d13_population_summary(spark, sf):
    return round_doubles(D.population_summary(_prof(spark, sf)))


# ---- B18, D14 -------------------------------------------------------------------------
_BANDS_SQL = ", ".join(f"({i}, {O.q(b)})" for i, b in enumerate(D.BANDS))


@register("d14_activity_bands", _sql("""
cuts AS (SELECT quantile_cont(total_feature_clicks, 0.25) AS q1, quantile_cont(total_feature_clicks, 0.75) AS q3,
                quantile_cont(total_feature_clicks, 0.95) AS p95 FROM profile)""", """
b AS (SELECT CASE WHEN total_feature_clicks > -1 AND total_feature_clicks <= q1 THEN 0
                  WHEN total_feature_clicks > q1 AND total_feature_clicks <= q3 THEN 1
                  WHEN total_feature_clicks > q3 AND total_feature_clicks <= p95 THEN 2
                  WHEN total_feature_clicks > p95 THEN 3 END AS band_id FROM profile, cuts)""", f"""
labels AS (SELECT CAST(i AS INTEGER) AS band_id, band FROM (VALUES {_BANDS_SQL}) t(i, band))""", select=f"""
SELECT l.band_id, l.band, COALESCE(c.n, 0) AS n,
       {O.sround('CAST(COALESCE(c.n, 0) AS DOUBLE) * 100.0 / (SELECT COUNT(*) FROM profile)', 1)} AS pct,
       q1, q3, p95
FROM labels l LEFT JOIN (SELECT band_id, COUNT(*) AS n FROM b GROUP BY 1) c USING (band_id), cuts""",
    rnd=("q1", "q3", "p95")))
def d14_activity_bands(spark, sf):
    return round_doubles(D.band_distribution(_prof(spark, sf)))


# ---- Q4 -----------------------------------------------------------------------------------
@register("q4_clicks_histogram", _sql("""
cap AS (SELECT quantile_cont(CAST(total_feature_clicks AS DOUBLE), 0.99) AS c FROM profile)""", """
x AS (SELECT LEAST(CAST(total_feature_clicks AS DOUBLE), c) AS x FROM profile, cap)""", """
r0 AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM x)""", """
r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0)""",
    """
cnt AS (SELECT CAST(LEAST(GREATEST(floor((x - lo) * 60 / (hi - lo)), 0), 59) AS INTEGER) AS bin, COUNT(*) AS n
        FROM x, r GROUP BY 1)""", select="""
SELECT g.bin, lo + g.bin * ((hi - lo) / 60) AS bin_start, lo + (g.bin + 1) * ((hi - lo) / 60) AS bin_end,
       COALESCE(cnt.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(60)) g CROSS JOIN r LEFT JOIN cnt USING (bin)""",
    rnd=("bin_start", "bin_end")))
def q4_clicks_histogram(spark, sf):
    return round_doubles(D.clicks_histogram(_prof(spark, sf)))


# ---- D15, D16 -----------------------------------------------------------------------------
@register("d15_score_histogram", _sql(select=f"""
SELECT s.nps_score, COALESCE(c.n, 0) AS n,
       {O.sround('CAST(COALESCE(c.n, 0) AS DOUBLE) * 100.0 / (SELECT COUNT(*) FROM profile)', 1)} AS pct
FROM (SELECT CAST(range AS INTEGER) AS nps_score FROM range(11)) s
LEFT JOIN (SELECT nps_score, COUNT(*) AS n FROM profile GROUP BY 1) c USING (nps_score)"""))
def d15_score_histogram(spark, sf):
    return D.score_histogram(_prof(spark, sf))


@register("d16_category_share", _sql(f"""
cs AS (SELECT nps_category, COUNT(*) AS n,
              {O.sround('CAST(COUNT(*) AS DOUBLE) * 100.0 / (SELECT COUNT(*) FROM profile)', 1)} AS pct
       FROM profile GROUP BY 1)""", select=f"""
SELECT nps_category, n, pct,
       {O.sround("COALESCE((SELECT pct FROM cs WHERE nps_category = 'promoter'), 0) - COALESCE((SELECT pct FROM cs WHERE nps_category = 'detractor'), 0)", 1)} AS net_score
FROM cs"""))
def d16_category_share(spark, sf):
    return D.category_share(_prof(spark, sf))


# ---- D17, D18 ------------------------------------------------------------------------------
_CLICKS_LONG = "lc AS (" + _long("profile", [f"clicks_{g}" for g in GROUPS], GROUPS) + ")"
_LABELS = "lab AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.q(g)}, {O.q(GROUP_LABELS[g])})" for g in GROUPS) + ") t(grp, label))"


@register("d17_group_usage", _sql(_CLICKS_LONG, _LABELS, f"""
gu AS (SELECT grp, CAST(SUM(v) AS BIGINT) AS total_clicks, {O.sround('AVG(v)', 1)} AS avg_clicks,
              {O.sround('MEDIAN(v)', 1)} AS median_clicks,
              {O.sround('CAST(COUNT_IF(v > 0) AS DOUBLE) * 100.0 / (SELECT COUNT(*) FROM profile)', 1)} AS penetration_pct
       FROM lc GROUP BY 1)""", select=f"""
SELECT grp, label, total_clicks, avg_clicks, median_clicks, penetration_pct,
       {O.sround('SUM(total_clicks) OVER (ORDER BY total_clicks DESC, grp ROWS UNBOUNDED PRECEDING) * 100.0 / SUM(total_clicks) OVER ()', 1)} AS cum_pct
FROM gu JOIN lab USING (grp)"""))
def d17_group_usage(spark, sf):
    return D.group_usage(_prof(spark, sf))


# ---- D19-D21 -----------------------------------------------------------------------------------
def _fam_long(family: str) -> str:
    return f"lf AS (" + _long("profile", [f"{family}_{g}" for g in GROUPS], GROUPS, keep="nps_category") + ")"


@register("d19_intensity_means", _sql(_fam_long("intensity"), select="""
SELECT nps_category, grp, AVG(v) AS mean_intensity FROM lf GROUP BY 1, 2""", rnd=("mean_intensity",)))
def d19_intensity_means(spark, sf):
    return round_doubles(D.family_means(_prof(spark, sf), "intensity"))


@register("d20_rate_means", _sql(_fam_long("rate"), select="""
SELECT nps_category, grp, AVG(v) AS mean_rate FROM lf GROUP BY 1, 2""", rnd=("mean_rate",)))
def d20_rate_means(spark, sf):
    return round_doubles(D.family_means(_prof(spark, sf), "rate"))


@register("d21_rate_gap", _sql(_fam_long("rate"), select="""
SELECT grp, AVG(CASE WHEN nps_category = 'promoter' THEN v END)
            - AVG(CASE WHEN nps_category = 'detractor' THEN v END) AS diff
FROM lf GROUP BY 1""", rnd=("diff",)))
def d21_rate_gap(spark, sf):
    return round_doubles(D.rate_gap(_prof(spark, sf)))


# ---- D22 -----------------------------------------------------------------------------------------
_PM_METRICS = ["clicks_per_session", "sessions_per_week", "n_distinct_features", "n_active_groups"]


@register("d22_metric_summary", _sql(_PM, "lm AS (" + _long("pm", _PM_METRICS, _PM_METRICS, "nps_category",
                                                            "metric") + ")", select="""
SELECT metric, nps_category, AVG(v) AS mean, CAST(MEDIAN(v) AS DOUBLE) AS median, STDDEV_SAMP(v) AS std,
       COUNT(v) AS n
FROM lm GROUP BY 1, 2""", rnd=("mean", "median", "std")))
def d22_metric_summary(spark, sf):
    return round_doubles(D.metric_summary(_pm(spark, sf), _PM_METRICS))


@register("d22_duration_summary", _sql(_SESS30, _SM, select="""
SELECT 'duration_min' AS metric, nps_category, AVG(duration_min) AS mean, CAST(MEDIAN(duration_min) AS DOUBLE) AS median,
       STDDEV_SAMP(duration_min) AS std, COUNT(duration_min) AS n
FROM sm GROUP BY 2""", rnd=("mean", "median", "std")))
def d22_duration_summary(spark, sf):
    return round_doubles(D.metric_summary(D.session_metrics(_s30(spark, sf)), ["duration_min"]))


# ---- D23 -----------------------------------------------------------------------------------------
def _time_sql(part: str, size: int) -> str:
    return _sql(_SESS30, _SM, f"""
tc AS (SELECT nps_category, {part}, COUNT(*) AS n FROM sm GROUP BY 1, 2)""", f"""
tg AS (SELECT c.nps_category, CAST(r.range AS INTEGER) AS {part}
       FROM (SELECT DISTINCT nps_category FROM tc) c CROSS JOIN range({size}) r)""", select=f"""
SELECT tg.nps_category, tg.{part}, COALESCE(tc.n, 0) AS n,
       CAST(COALESCE(tc.n, 0) AS DOUBLE) * 100.0 / SUM(COALESCE(tc.n, 0)) OVER (PARTITION BY tg.nps_category) AS pct
FROM tg LEFT JOIN tc ON tc.nps_category = tg.nps_category AND tc.{part} = tg.{part}""", rnd=("pct",))


@register("d23_hour_profile", _time_sql("hour", 24))
def d23_hour_profile(spark, sf):
    return round_doubles(D.time_profile(_s30(spark, sf), "hour"))


@register("d23_weekday_profile", _time_sql("weekday", 7))
def d23_weekday_profile(spark, sf):
    return round_doubles(D.time_profile(_s30(spark, sf), "weekday"))


# ---- D24 ------------------------------------------------------------------------------------------
@register("d24_cooccurrence", _sql(select=" UNION ALL ".join(
    f"SELECT '{g1}' AS group_1, '{g2}' AS group_2, "
    f"CAST(COUNT_IF(sessions_{g1} > 0 AND sessions_{g2} > 0) AS DOUBLE) * 100.0 / COUNT(*) AS pct_users FROM profile"
    for g1 in GROUPS for g2 in GROUPS), rnd=("pct_users",)))
def d24_cooccurrence(spark, sf):
    return round_doubles(D.cooccurrence(_prof(spark, sf)))


# ---- D25, D26 -------------------------------------------------------------------------------------
_PROFILE_COLS = (["userhasheduuid", "nps_score", "nps_category", "total_feature_clicks", "n_distinct_features",
                  "n_sessions"] + [f"clicks_{g}" for g in GROUPS] + [f"sessions_{g}" for g in GROUPS]
                 + ["clicks_per_session"] + [f"rate_{g}" for g in GROUPS] + [f"intensity_{g}" for g in GROUPS])


@register("d25_null_audit", _sql("na AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {O.sround(f'CAST(COUNT_IF({c} IS NULL) AS DOUBLE) * 100.0 / COUNT(*)', 1)} AS pct_null "
    "FROM profile" for c in _PROFILE_COLS) + ")", select="SELECT * FROM na WHERE pct_null > 0"))
def d25_null_audit(spark, sf):
    return D.null_audit(_prof(spark, sf))


@register("d26_zero_audit", _sql(_CLICKS_LONG, select="""
SELECT grp, AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_zero_clicks FROM lc GROUP BY 1""",
    rnd=("pct_zero_clicks",)))
def d26_zero_audit(spark, sf):
    return round_doubles(D.zero_audit(_prof(spark, sf)))


# ---- D27, D28 -------------------------------------------------------------------------------------
_HEAVY = """
cut AS (SELECT quantile_cont(CAST(total_feature_clicks AS DOUBLE), 0.95) AS p95,
               quantile_cont(CAST(total_feature_clicks AS DOUBLE), 0.99) AS p99,
               MAX(total_feature_clicks) AS max_clicks FROM profile),
hv AS (SELECT profile.*, p95, p99, max_clicks, total_feature_clicks > p99 AS is_power FROM profile, cut)"""


@register("d27_outlier_summary", _sql(_HEAVY, select=f"""
SELECT ANY_VALUE(p95) AS p95, ANY_VALUE(p99) AS p99, ANY_VALUE(max_clicks) AS max_clicks,
       COUNT_IF(is_power) AS n_outliers,
       {O.sround('CAST(COUNT_IF(is_power) AS DOUBLE) * 100.0 / COUNT(*)', 1)} AS pct_outliers
FROM hv""", rnd=("p95", "p99")))
def d27_outlier_summary(spark, sf):
    return round_doubles(D.outlier_summary(_prof(spark, sf)))


@register("d27_outlier_categories", _sql(_HEAVY, select=f"""
SELECT is_power, nps_category, COUNT(*) AS n,
       {O.sround('CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER (PARTITION BY is_power)', 1)} AS pct
FROM hv GROUP BY 1, 2"""))
def d27_outlier_categories(spark, sf):
    return D.outlier_categories(_prof(spark, sf))


@register("d28_heavy_profile", _sql(_HEAVY, select=f"""
SELECT is_power, {O.sround('AVG(total_feature_clicks)', 1)} AS total_feature_clicks,
       {O.sround('AVG(n_sessions)', 1)} AS n_sessions, {O.sround('AVG(n_distinct_features)', 1)} AS n_distinct_features,
       {O.sround('AVG(clicks_per_session)', 1)} AS clicks_per_session
FROM hv GROUP BY 1"""))
def d28_heavy_profile(spark, sf):
    return D.heavy_profile(_prof(spark, sf))


# ---- D29 ------------------------------------------------------------------------------------------
_PRED = [f"{f}_{g}" for f in ("rate", "intensity") for g in GROUPS]


@register("d29_predictor_summary", _sql("lp AS (" + _long("profile", [f"COALESCE({c}, 0)" for c in _PRED], _PRED,
                                                          name="variable") + ")", select=f"""
SELECT variable, {O.sround('AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) * 100', 1)} AS pct_zeros,
       {O.sround('AVG(v)', 5)} AS mean_raw, {O.sround('STDDEV_SAMP(v)', 5)} AS std_raw,
       {O.sround('quantile_cont(v, 0.99)', 5)} AS p99,
       {O.sround('AVG(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END) * 100', 1)} > 30 AS sparse
FROM lp GROUP BY 1"""))
def d29_predictor_summary(spark, sf):
    return D.predictor_summary(_prof(spark, sf))


# ---- D30 ------------------------------------------------------------------------------------------
_D30 = _sql(_SESS30, select=f"""
SELECT nps_category, {O.sround('AVG(session_length)', 2)} AS mean, {O.sround('MEDIAN(session_length)', 2)} AS median,
       {O.sround('STDDEV_SAMP(session_length)', 2)} AS std, COUNT(*) AS count
FROM seqs GROUP BY 1""")


@register("d30_session_length_summary", _D30)
def d30_session_length_summary(spark, sf):
    return D.session_length_summary(_s30(spark, sf))


@register("d30_session_length_summary_chunk4", _D30)
def d30_session_length_summary_chunk4(spark, sf):
    """D30 on 4-item chunks: the same sessions, whatever the chunk size."""
    return D.session_length_summary(S.session_rows(C.sessions(spark, sf, "feature_name", 30, chunk_size=4)))


# ---- Q5, Q6 ------------------------------------------------------------------------------------------
def _box_sql(src_ctes: tuple, src: str, by: str) -> str:
    return _sql(*src_ctes, f"""
bq AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, CAST(MEDIAN(x) AS DOUBLE) AS median,
              quantile_cont(x, 0.75) AS q3, COUNT(x) AS n FROM {src} GROUP BY ALL)""", select=f"""
SELECT {', '.join('bq.' + b.strip() for b in by.split(','))}, q1, median, q3, n,
       MIN(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_lo,
       MAX(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_hi
FROM {src} JOIN bq USING ({by}) GROUP BY ALL""", rnd=("q1", "median", "q3", "whisker_lo", "whisker_hi"))


_RATE_LONG = "lr AS (" + _long("profile", [f"rate_{g}" for g in GROUPS], GROUPS, keep="nps_category") + ")"


@register("q5_rate_boxes", _box_sql((_RATE_LONG, """
caps AS (SELECT grp, quantile_cont(v, 0.99) AS cap FROM lr GROUP BY 1)""", """
bx AS (SELECT grp, nps_category, LEAST(COALESCE(v, 0), cap) AS x FROM lr JOIN caps USING (grp))"""),
    "bx", "grp, nps_category"))
def q5_rate_boxes(spark, sf):
    return round_doubles(D.rate_boxes(_prof(spark, sf)))


@register("q5_session_length_boxes", _box_sql((_SESS30, """
bx AS (SELECT nps_category, CAST(LEAST(session_length, 20) AS DOUBLE) AS x FROM seqs)"""), "bx", "nps_category"))
def q5_session_length_boxes(spark, sf):
    return round_doubles(D.session_length_boxes(_s30(spark, sf)))


@register("q5_band_boxes", _box_sql(("""
cuts AS (SELECT quantile_cont(total_feature_clicks, 0.25) AS q1c, quantile_cont(total_feature_clicks, 0.75) AS q3c,
                quantile_cont(total_feature_clicks, 0.95) AS p95 FROM profile)""", """
bx AS (SELECT CASE WHEN total_feature_clicks > -1 AND total_feature_clicks <= q1c THEN 0
                   WHEN total_feature_clicks > q1c AND total_feature_clicks <= q3c THEN 1
                   WHEN total_feature_clicks > q3c AND total_feature_clicks <= p95 THEN 2
                   WHEN total_feature_clicks > p95 THEN 3 END AS band_id,
              LEAST(CAST(total_feature_clicks AS DOUBLE), p95 * 1.5) AS x FROM profile, cuts)"""),
    "bx", "band_id"))
def q5_band_boxes(spark, sf):
    return round_doubles(D.band_boxes(_prof(spark, sf)))


def _violin_sql(src_ctes: tuple, src: str, col: str, fill: bool, fallback: bool) -> str:
    v = f"COALESCE(CAST({col} AS DOUBLE), 0)" if fill else f"CAST({col} AS DOUBLE)"
    cap = "CASE WHEN c > 0 THEN c ELSE mx END" if fallback else "c"
    return _sql(*src_ctes, f"""
vw AS (SELECT nps_category, {v} AS w FROM {src})""", """
vc AS (SELECT quantile_cont(w, 0.99) AS c, MAX(w) AS mx FROM vw)""", select=f"""
SELECT nps_category, CAST(MEDIAN(x) AS DOUBLE) AS median, STDDEV_POP(x) AS std_pop, STDDEV_POP(x) > 0 AS has_variance,
       COUNT(*) AS n
FROM (SELECT nps_category, CASE WHEN w IS NULL THEN NULL ELSE LEAST(w, {cap}) END AS x FROM vw, vc) GROUP BY 1""",
        rnd=("median", "std_pop"))


@register("q6_violin_clicks_per_session", _violin_sql((), "profile", "clicks_per_session", True, True))
def q6_violin_clicks_per_session(spark, sf):
    return round_doubles(D.violin_summary(_prof(spark, sf), "clicks_per_session"))


@register("q6_violin_sessions_per_week", _violin_sql((_PM,), "pm", "sessions_per_week", False, False))
def q6_violin_sessions_per_week(spark, sf):
    return round_doubles(D.violin_summary(_pm(spark, sf), "sessions_per_week", fill_zero=False,
                                          cap_fallback_max=False))


@register("q6_violin_duration", _violin_sql((_SESS30, _SM), "sm", "duration_min", False, False))
def q6_violin_duration(spark, sf):
    return round_doubles(D.violin_summary(D.session_metrics(_s30(spark, sf)), "duration_min", fill_zero=False,
                                          cap_fallback_max=False))


for _col in ("n_distinct_features", "n_active_groups"):
    @register(f"q6_violin_{_col}", _violin_sql((_PM,), "pm", _col, False, False))
    def _violin(spark, sf, col=_col):
        return round_doubles(D.violin_summary(_pm(spark, sf), col, fill_zero=False, cap_fallback_max=False))
