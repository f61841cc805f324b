"""Respondents, feature classification and the base event table.

B1-B7, C1, C2, D1 and the D2 top-features report.

Plan at scale: the survey side (tens of thousands of answers) and the
feature dimension are small and are broadcast behind a row-count bound, so
the event log (hundreds of billions of rows) is joined map-side with no
shuffle; the look-back predicate sits in the join condition and, as literal
bounds derived from the answers, on the event scan (parquet row-group
pruning by timestamp statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import WINDOW_DAYS
from clickscore.operators._util import BROADCAST_MAX_ROWS, bounded_broadcast
from clickscore.operators.joins import join_in_window, join_users

USER = "userhasheduuid"
KEYS = [USER, "nps_score", "nps_category"]


# ---- B1-B3 ------------------------------------------------------------------
def respondent_filter(survey: DataFrame, app: str, role: str,
                      require_response: bool = True) -> DataFrame:
    cond = (F.lower("appname") == app.lower()) & (F.lower("highestrole") == role.lower())
    if require_response:
        cond = cond & F.col("npsresponse").isNotNull()
    return survey.filter(cond)


def respondents(survey: DataFrame, app: str, role: str,
                require_response: bool = True, null_score: str = "promoter",
                dedupe: str | None = None) -> DataFrame:
    """One row per answer: user, nps_score, nps_category, datetimeresponded.

    ``null_score="promoter"`` keeps the study's behaviour (an unparsable score
    lands in the ELSE branch); ``"drop"`` removes such answers.
    ``dedupe="latest"`` keeps only each user's latest answer.
    """
    s = respondent_filter(survey, app, role, require_response)
    score = X.parse_score(F.col("npsresponse"))
    out = s.select(F.col(USER), score.alias("nps_score"),
                   X.score_category(score).alias("nps_category"),
                   F.col("datetimeresponded"))
    if null_score == "drop":
        out = out.filter(F.col("nps_score").isNotNull())
    elif null_score != "promoter":
        raise ValueError("null_score must be 'promoter' or 'drop'")
    if dedupe == "latest":
        w = Window.partitionBy(USER).orderBy(F.col("datetimeresponded").desc(), F.col("nps_score").desc_nulls_last())
        out = out.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    elif dedupe is not None:
        raise ValueError("dedupe must be None or 'latest'")
    return out


# ---- B4, B4p, B7 --------------------------------------------------------------
def classify_features(dim: DataFrame, variant: str = "sql") -> DataFrame:
    """Classify the (small) dimension once; events get their group by join."""
    return dim.filter(F.col("name").isNotNull()).select(
        F.col("featureid"), F.col("name").alias("feature_name"), F.col("iscoreevent"),
        X.feature_group("name", variant).alias("feature_group"))


# ---- B5, C1, C2 ---------------------------------------------------------------
def window_start(days: int):
    return F.timestamp_add("DAY", F.lit(-days), F.col("datetimeresponded"))


def in_window(days: int = WINDOW_DAYS):
    ts = F.col("browsertimestamp")
    return (ts >= window_start(days)) & (ts <= F.col("datetimeresponded"))


def between_literals(ev: DataFrame, lo, hi, ts: str = "browsertimestamp") -> DataFrame:
    """Literal time bounds on the event scan (pushed to parquet); no bounds, no rows."""
    if lo is None:
        return ev.filter(F.lit(False))
    # NTZ literals from text: no Python or session time zone involved
    return ev.filter((F.col(ts) >= F.expr(f"TIMESTAMP_NTZ'{lo.isoformat(sep=' ')}'"))
                     & (F.col(ts) <= F.expr(f"TIMESTAMP_NTZ'{hi.isoformat(sep=' ')}'")))


def base_events(resp: DataFrame, events: DataFrame, dim: DataFrame,
                window_days: int = WINDOW_DAYS, only_window: bool = False,
                variant: str = "sql", scan_bounds: bool = True, dim_rows: int | None = None,
                max_broadcast: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """The base table: one row per (answer, event) with group and window flag.

    ``only_window=True`` returns the look-back subset directly (B6) with the
    range predicate inside the join and literal timestamp bounds on the scan.
    One small job over the answers gives both their count (the broadcast
    bound) and the answer-time range (the scan bounds).  More than
    ``max_broadcast`` answers are joined by a shuffle, behind a Bloom filter at
    the scan and on time bins (see ``joins``).
    """
    feats = bounded_broadcast(classify_features(dim, variant), known_rows=dim_rows)
    ev = events.select("event_id", "visitorid", "browsertimestamp", "matchableid", "analyticssessionid")
    n, lo, hi = resp.agg(F.count(F.lit(1)), F.min(window_start(window_days)), F.max("datetimeresponded")).first()
    if only_window and scan_bounds:
        ev = between_literals(ev, lo, hi)
    j = ev.join(feats, ev["matchableid"] == feats["featureid"], "inner")
    if n <= max_broadcast:
        r = F.broadcast(resp)
        cond = j["visitorid"] == r[USER]
        if only_window:
            cond = cond & (j["browsertimestamp"] >= F.timestamp_add("DAY", F.lit(-window_days), r["datetimeresponded"])) \
                & (j["browsertimestamp"] <= r["datetimeresponded"])
        j = j.join(r, cond, "inner")
    elif only_window:
        j = join_in_window(j, resp, window_days, n, USER)
    else:
        j = join_users(j, resp, n, USER)
    cols = [F.col(USER), F.col("nps_score"), F.col("nps_category"), F.col("datetimeresponded"),
            F.col("event_id"), F.col("browsertimestamp"), F.col("analyticssessionid"),
            F.col("featureid"), F.col("feature_name"), F.col("iscoreevent"), F.col("feature_group")]
    if not only_window:
        cols.append(in_window(window_days).alias("in_window"))
    return j.select(*cols)


def window_subset(base: DataFrame) -> DataFrame:
    """Keep in-window rows, drop the flag."""
    return base.filter(F.col("in_window")).drop("in_window")


# ---- D1 ---------------------------------------------------------------------
def base_check(base: DataFrame) -> DataFrame:
    """Per category: events, distinct users, distinct features (+ in-window events), largest first.

    Counted per (category, user, feature) first, so the distinct counts copy
    those groups, not the events.
    """
    flag = "in_window" in base.columns
    inside = F.sum(F.col("in_window").cast("long")) if flag else F.lit(None)
    first = base.groupBy("nps_category", USER, "feature_name").agg(F.count(F.lit(1)).alias("_n"), inside.alias("_in"))
    aggs = [F.sum("_n").alias("total_events"), F.countDistinct(USER).alias("n_teachers"),
            F.countDistinct("feature_name").alias("n_distinct_features")]
    if flag:
        aggs.append(F.sum("_in").alias("events_in_window"))
    return first.groupBy("nps_category").agg(*aggs).orderBy(F.desc("total_events"), "nps_category")


# ---- D2 -----------------------------------------------------------------------
def top_features(base90: DataFrame, n: int = 50) -> DataFrame:
    return (base90.groupBy("feature_name")
            .agg(F.count(F.lit(1)).alias("total_events"), F.countDistinct(USER).alias("unique_users"))
            .orderBy(F.col("total_events").desc(), F.col("feature_name")).limit(n))
