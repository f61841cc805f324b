"""Join validation.

The event log is the big side everywhere: it is filtered map-side against
the broadcast (size-checked) respondent keys before any distinct or count,
so only matched users' rows reach a shuffle, and those are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.operators._util import BROADCAST_MAX_ROWS, bounded_broadcast, exact_quantiles
from clickscore.operators.base import USER, between_literals, respondent_filter, window_start
from clickscore.operators.joins import bloom_filter, join_in_window, might_hold


def matched_users(events: DataFrame, users: DataFrame, max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """C4: distinct respondent users that appear in the event log (semi join)."""
    keys = users.select(F.col(USER).alias("_u")).distinct()
    n = keys.count()
    seen = events.select("visitorid")
    if n > max_broadcast:          # the log is reduced at the scan and made distinct before it meets the users
        seen = seen.filter(might_hold(bloom_filter(keys, "_u", n), F.col("visitorid"))).distinct()
    return (seen.join(bounded_broadcast(keys, max_broadcast, known_rows=n), F.col("visitorid") == F.col("_u"), "left_semi")
            .distinct().withColumnRenamed("visitorid", USER))


def match_rate(survey: DataFrame, events: DataFrame, app: str, role: str, max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """D10 (C3): respondents, respondents with events, rounded match %."""
    resp = respondent_filter(survey, app, role, require_response=False)
    total = resp.agg(F.countDistinct(USER).alias("total_nps_teachers"))
    matched = matched_users(events, resp, max_broadcast).agg(F.count(F.lit(1)).alias("matched_in_events"))
    j = total.crossJoin(matched)     # two one-row frames
    return j.select("total_nps_teachers", "matched_in_events",
                    F.round(F.col("matched_in_events").cast("double")
                            / F.nullif(F.col("total_nps_teachers"), F.lit(0)) * 100, 1).alias("match_rate_pct"))


def matched_score_distribution(survey: DataFrame, events: DataFrame, app: str,
                               role: str) -> DataFrame:
    """DISTINCT (user, score) of matched respondents, counted per score."""
    resp = respondent_filter(survey, app, role, require_response=False)
    pairs = resp.select(F.col(USER), X.parse_score(F.col("npsresponse")).alias("nps_score")).distinct()
    m = pairs.join(matched_users(events, resp), USER, "left_semi")
    return (m.groupBy("nps_score").agg(F.count(F.lit(1)).alias("n"))
            .select("nps_score", "n", X.score_category("nps_score").alias("category")).orderBy("nps_score"))


def lookback_volume(survey: DataFrame, events: DataFrame, app: str, role: str, window_days: int = 90,
                    sample: int | None = None, max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """D12 (C5): per respondent user, events in [answer - window, answer]; summary.

    ``sample=n`` reproduces the study's 1000-answer validation sample
    deterministically (first n answers by md5 of the user key); the default
    summarises every respondent.
    """
    resp = respondent_filter(survey, app, role, require_response=False).select(USER, "datetimeresponded")
    if sample is not None:
        resp = resp.orderBy(F.md5(F.col(USER).cast("string")), F.col("datetimeresponded")).limit(sample)
    n, lo, hi = resp.agg(F.count(F.lit(1)), F.min(window_start(window_days)), F.max("datetimeresponded")).first()
    ev = between_literals(events.select("visitorid", "browsertimestamp"), lo, hi)
    if n <= max_broadcast:
        r = F.broadcast(resp)
        cond = ((ev["visitorid"] == r[USER])
                & (ev["browsertimestamp"] >= F.timestamp_add("DAY", F.lit(-window_days), r["datetimeresponded"]))
                & (ev["browsertimestamp"] <= r["datetimeresponded"]))
        met = ev.join(r, cond, "inner")
    else:
        met = join_in_window(ev, resp, window_days, n, USER)
    counts = met.groupBy(USER).agg(F.count(F.lit(1)).alias("events_90d"))
    per_user = (resp.select(USER).distinct().join(counts, USER, "left")
                .select(USER, F.coalesce("events_90d", F.lit(0)).alias("events_90d")))
    totals = per_user.agg(
        F.count(F.lit(1)).alias("n_teachers_sampled"),
        F.sum(F.when(F.col("events_90d") > 0, 1).otherwise(0)).cast("long").alias("with_events"),
        F.round(F.avg("events_90d"), 1).alias("avg_events_90d"), F.max("events_90d").alias("max_events_90d"))
    median = exact_quantiles(per_user, "events_90d", [0.5], names=["median_events_90d"])
    return totals.crossJoin(F.broadcast(median)).select(             # two one-row frames
        "n_teachers_sampled", "with_events", "avg_events_90d", "median_events_90d", "max_events_90d")
