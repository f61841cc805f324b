"""Queries for the base build and the profiles (A-, B-, C1-C2, D1-D6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickscore.operators import base as B
from clickscore.operators import profile as P
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import register
from clickscore.sources import fixtures as FX

_FX = O.fixtures_cte()
_STD = O.std_prefix()
_PROF = O.profile_prefix()


@register("b1_respondents", O.with_(_FX, O.resp_cte()) + "SELECT * FROM resp")
def b1_respondents(spark, sf):
    return C.resp(spark, sf)


@register("b3_respondents_drop_null",
          O.with_(_FX, O.resp_cte()) + "SELECT * FROM resp WHERE nps_score IS NOT NULL")
def b3_respondents_drop_null(spark, sf):
    return C.resp(spark, sf, null_score="drop")


@register("b4_classify_features", O.with_(_FX) + f"""
SELECT featureid, name AS feature_name, iscoreevent,
       {O.classify_sql('name')} AS feature_group,
       {O.classify_sql('name', 'python')} AS feature_group_py
FROM dim_features
WHERE name IS NOT NULL AND featureid IN (SELECT matchableid FROM feature_events)""")
def b4_classify_features(spark, sf):
    # the dimension is fixed in the fixtures; events decide which rows matter,
    # so classify the features the events actually reference
    ev = FX.feature_events(spark, sf).select("matchableid").distinct()
    dim = FX.dim_features(spark)
    used = dim.join(ev, dim["featureid"] == ev["matchableid"], "left_semi")
    sql_g = B.classify_features(used, "sql")
    py_g = B.classify_features(used, "python").select("featureid", F.col("feature_group").alias("feature_group_py"))
    return sql_g.join(py_g, "featureid")


@register("c1_base_events", _STD + "SELECT * FROM base")
def c1_base_events(spark, sf):
    return C.base(spark, sf)


@register("b6_base_window", _STD + "SELECT * FROM base90")
def b6_base_window(spark, sf):
    return C.base90_lazy(spark, sf)


def _shuffled(spark, sf, only_window: bool):
    survey, ev, dim = FX.sources(spark, sf)
    return B.base_events(B.respondents(survey, FX.APP, FX.ROLE), ev, dim, only_window=only_window, dim_rows=FX.DIM_ROWS, max_broadcast=0)


@register("c2_base_window_shuffle", _STD + "SELECT * FROM base90")
def c2_base_window_shuffle(spark, sf):
    """The look-back join as it runs with more answers than can be broadcast: Bloom filter, then (user, time bin)."""
    return _shuffled(spark, sf, True)


@register("c1_base_events_shuffle", _STD + "SELECT * FROM base")
def c1_base_events_shuffle(spark, sf):
    return _shuffled(spark, sf, False)


@register("b6_base_window_via_flag", _STD + "SELECT * FROM base90")
def b6_base_window_via_flag(spark, sf):
    return B.window_subset(C.base(spark, sf))


@register("d1_base_check", _STD + """
SELECT nps_category, COUNT(*) AS total_events, COUNT(DISTINCT userhasheduuid) AS n_teachers,
       COUNT(DISTINCT feature_name) AS n_distinct_features,
       CAST(SUM(in_window::INT) AS BIGINT) AS events_in_window
FROM base GROUP BY 1""")
def d1_base_check(spark, sf):
    return B.base_check(C.base(spark, sf))


@register("d1_base_window_check", _STD + """
SELECT nps_category, COUNT(*) AS total_events, COUNT(DISTINCT userhasheduuid) AS n_teachers,
       COUNT(DISTINCT feature_name) AS n_distinct_features
FROM base90 GROUP BY 1""")
def d1_base_window_check(spark, sf):
    return B.base_check(C.base90(spark, sf))


@register("b5_window7_check", O.std_prefix(7) + """
SELECT nps_category, COUNT(*) AS total_events, COUNT(DISTINCT userhasheduuid) AS n_teachers,
       COUNT(DISTINCT feature_name) AS n_distinct_features
FROM base90 GROUP BY 1""")
def b5_window7_check(spark, sf):
    return B.base_check(C.base90(spark, sf, window_days=7))


@register("d2_top_features", _STD + """
SELECT feature_name, COUNT(*) AS total_events, COUNT(DISTINCT userhasheduuid) AS unique_users
FROM base90 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def d2_top_features(spark, sf):
    return B.top_features(C.base90(spark, sf))


@register("d3_group_profile", _PROF + "SELECT * FROM profile")
def d3_group_profile(spark, sf):
    return C.profile_lazy(spark, sf)


@register("d4_profile_check", _PROF + f"""
SELECT nps_category, COUNT(*) AS n_teachers,
       {O.sround('AVG(total_feature_clicks)', 1)} AS avg_clicks,
       {O.sround('AVG(n_distinct_features)', 1)} AS avg_distinct_features,
       {O.sround('AVG(n_sessions)', 1)} AS avg_sessions
FROM profile GROUP BY 1""")
def d4_profile_check(spark, sf):
    return P.profile_check(C.profile(spark, sf))


@register("d5_feature_profile", _STD + """
SELECT userhasheduuid, nps_score, nps_category, feature_name, feature_group,
       COUNT(*) AS clicks, COUNT(DISTINCT analyticssessionid) AS sessions_with_feature
FROM base90 GROUP BY 1, 2, 3, 4, 5""")
def d5_feature_profile(spark, sf):
    return P.feature_profile(C.base90(spark, sf))


@register("d6_feature_reach", O.with_(_FX, O.resp_cte(), O.base_cte(), """
fp AS (
  SELECT userhasheduuid, nps_score, nps_category, feature_name, feature_group,
         COUNT(*) AS clicks, COUNT(DISTINCT analyticssessionid) AS sessions_with_feature
  FROM base90 GROUP BY 1, 2, 3, 4, 5)""") + f"""
SELECT feature_name, feature_group, COUNT(DISTINCT userhasheduuid) AS n_teachers,
       {O.sround('CAST(COUNT(DISTINCT userhasheduuid) AS DOUBLE) * 100.0 / (SELECT COUNT(DISTINCT userhasheduuid) FROM fp)', 2)}
         AS pct_teachers,
       SUM(clicks) AS total_clicks
FROM fp GROUP BY 1, 2 ORDER BY n_teachers DESC, feature_name LIMIT 30""")
def d6_feature_reach(spark, sf):
    return P.feature_reach(P.feature_profile(C.base90(spark, sf)))
