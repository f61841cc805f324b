"""Per-answer usage profiles.

The study's profile is one GROUP BY with 13 COUNT(DISTINCT ...) terms; Spark
would plan that as an Expand with one copy of every event per distinct
expression.  We aggregate twice instead: first by (answer, tool session)
with conditional counts, then by answer, where "distinct sessions with a
click in group g" becomes a count of level-1 rows with clicks_g > 0.  Both
levels are partial (map-side) aggregates, so a user holding a third of all
events is combined inside each map task before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.functions.constants import GROUPS, GROUP_LABELS
from clickscore.operators._util import join_on_keys
from clickscore.operators.base import KEYS, USER

SESSION = "analyticssessionid"


def group_profile(base90: DataFrame) -> DataFrame:
    """gold group profile: 3 keys + 51 usage columns, one row per (user, score, category)."""
    # wide expressions are written as SQL text: one parse per column instead
    # of several Py4J round trips per operator
    lvl1 = base90.groupBy(*KEYS, SESSION).agg(
        F.count(F.lit(1)).alias("_c"),
        *[F.expr(f"count_if(feature_group = {_q(GROUP_LABELS[g])}) AS _c_{g}") for g in GROUPS])
    lvl2 = lvl1.groupBy(*KEYS).agg(
        F.sum("_c").alias("total_feature_clicks"),
        F.count(SESSION).alias("n_sessions"),
        *[F.expr(f"sum(_c_{g}) AS clicks_{g}") for g in GROUPS],
        *[F.expr(f"count_if(_c_{g} > 0 AND {SESSION} IS NOT NULL) AS sessions_{g}") for g in GROUPS])
    nfeat = base90.groupBy(*KEYS).agg(F.countDistinct("feature_name").alias("n_distinct_features"))
    prof = join_on_keys(lvl2, nfeat, KEYS, never_null=[USER])
    ordered = (KEYS + ["total_feature_clicks", "n_distinct_features", "n_sessions"]
               + [f"clicks_{g}" for g in GROUPS] + [f"sessions_{g}" for g in GROUPS])
    return add_ratios(prof.select(*ordered))


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ratio_sql(num: str, den: str, digits: int, name: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif({den}, 0), {digits}) AS {name}"


def add_ratios(prof: DataFrame) -> DataFrame:
    """clicks_per_session (2 dp), rate_g and intensity_g (4 dp)."""
    return prof.selectExpr(
        "*",
        _ratio_sql("total_feature_clicks", "n_sessions", 2, "clicks_per_session"),
        *[_ratio_sql(f"clicks_{g}", "n_sessions", 4, f"rate_{g}") for g in GROUPS],
        *[_ratio_sql(f"clicks_{g}", f"sessions_{g}", 4, f"intensity_{g}") for g in GROUPS])


def profile_check(profile: DataFrame) -> DataFrame:
    """Per category n and rounded means."""
    return profile.groupBy("nps_category").agg(
        F.count(F.lit(1)).alias("n_teachers"),
        F.round(F.avg("total_feature_clicks"), 1).alias("avg_clicks"),
        F.round(F.avg("n_distinct_features"), 1).alias("avg_distinct_features"),
        F.round(F.avg("n_sessions"), 1).alias("avg_sessions")).orderBy("nps_category")


def feature_profile(base90: DataFrame) -> DataFrame:
    """Long format, one row per (answer keys, feature)."""
    return base90.groupBy(*KEYS, "feature_name", "feature_group").agg(
        F.count(F.lit(1)).alias("clicks"),
        F.countDistinct(SESSION).alias("sessions_with_feature"))


def feature_reach(fprofile: DataFrame, denominator: int | None = None, n: int = 30) -> DataFrame:
    """Users per feature, % of a denominator, total clicks; top n.

    The study hard-codes its population size; here it is a parameter and
    defaults to the number of distinct users in the profile (a one-row
    aggregate cross-joined, so the plan stays lazy).
    """
    agg = fprofile.groupBy("feature_name", "feature_group").agg(
        F.countDistinct(USER).alias("n_teachers"), F.sum("clicks").alias("total_clicks"))
    if denominator is None:
        den = fprofile.agg(F.countDistinct(USER).alias("_den"))
        agg = agg.crossJoin(F.broadcast(den))
    else:
        agg = agg.withColumn("_den", F.lit(denominator))
    return (agg.select("feature_name", "feature_group", "n_teachers",
                       F.round(F.col("n_teachers").cast("double") * 100.0 / F.col("_den"), 2).alias("pct_teachers"),
                       "total_clicks")
            .orderBy(F.col("n_teachers").desc(), F.col("feature_name")).limit(n))
