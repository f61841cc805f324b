"""Queries for the join validation script."""

from __future__ import annotations

from clickscore.operators import validate as V
from clickscore.functions.constants import DETRACTOR_MAX, PASSIVE_MAX
from clickscore.plans import oracle as O
from clickscore.plans.registry import REGISTRY, register
from clickscore.sources import fixtures as FX

_FX = O.fixtures_cte()
_ANSWERS = "answers AS (SELECT * FROM survey WHERE lower(appname) = 'lms core' AND lower(highestrole) = 'teacher')"
_SEEN = "EXISTS (SELECT 1 FROM feature_events f WHERE f.visitorid = answers.userhasheduuid)"


def _tables(spark, sf):
    return FX.survey_responses(spark, sf), FX.feature_events(spark, sf), FX.APP, FX.ROLE


@register("d10_match_rate", O.with_(_FX, _ANSWERS, f"""
people AS (SELECT userhasheduuid, bool_or({_SEEN}) AS seen FROM answers GROUP BY 1)""") + f"""
SELECT count(*) AS total_nps_teachers, count(*) FILTER (seen) AS matched_in_events,
       {O.sround('count(*) FILTER (seen) / CAST(NULLIF(count(*), 0) AS DOUBLE) * 100', 1)} AS match_rate_pct
FROM people""")
def d10_match_rate(spark, sf):
    return V.match_rate(*_tables(spark, sf))


@register("d11_matched_scores", O.with_(_FX, _ANSWERS, f"""
scores AS (SELECT userhasheduuid, TRY_CAST(npsresponse AS INTEGER) AS nps_score FROM answers WHERE {_SEEN} GROUP BY ALL)""") + """
SELECT nps_score, count(userhasheduuid) AS n,
       CASE WHEN nps_score <= """ + f"{DETRACTOR_MAX} THEN 'detractor' WHEN nps_score <= {PASSIVE_MAX}" + """ THEN 'passive' ELSE 'promoter' END AS category
FROM scores GROUP BY nps_score""")
def d11_matched_scores(spark, sf):
    return V.matched_score_distribution(*_tables(spark, sf))


def _lookback_sql(sample: int | None) -> str:
    chosen = f"ORDER BY md5(CAST(userhasheduuid AS VARCHAR)), datetimeresponded LIMIT {sample}" if sample else ""
    return O.with_(_FX, _ANSWERS, f"""
asked AS (SELECT userhasheduuid AS u, datetimeresponded AS until FROM answers {chosen}),
volume AS (
  SELECT u, count(f.visitorid) AS n
  FROM asked LEFT JOIN feature_events f ON f.visitorid = u AND f.browsertimestamp BETWEEN until - INTERVAL 90 DAY AND until
  GROUP BY u)""") + f"""
SELECT count(*) AS n_teachers_sampled, count(*) FILTER (n > 0) AS with_events, {O.sround('avg(n)', 1)} AS avg_events_90d,
       quantile_cont(n, 0.5) AS median_events_90d, max(n) AS max_events_90d
FROM volume"""


@register("d12_lookback_volume", _lookback_sql(None))
def d12_lookback_volume(spark, sf):
    return V.lookback_volume(*_tables(spark, sf))


@register("d12_lookback_volume_shuffle", _lookback_sql(None))
def d12_lookback_volume_shuffle(spark, sf):
    """D12 as it runs with more answers than can be broadcast."""
    return V.lookback_volume(*_tables(spark, sf), max_broadcast=0)


@register("d10_match_rate_shuffle", REGISTRY["d10_match_rate"].sql)
def d10_match_rate_shuffle(spark, sf):
    return V.match_rate(*_tables(spark, sf), max_broadcast=0)


@register("l3_lookback_sample_1000", _lookback_sql(1000))
def l3_lookback_sample_1000(spark, sf):
    return V.lookback_volume(*_tables(spark, sf), sample=1000)
