"""Source tables (A1-A3) derived from the driver's test tables.

The study reads three private warehouse tables (survey answers, feature
events, feature dimension).  Here they are derived, lazily and without any
driver round-trip, from ``customer`` and ``events`` as documented in
FIXTURES.md: every customer row is a survey answer, every event row is a
feature event.  A second survey wave adds answers (it never removes any), so
users with two answers exist as in the real data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


APP, ROLE = "lms core", "teacher"        # the application and role of the fixture survey


def survey_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """survey: userhasheduuid, npsresponse (string), datetimeresponded (NTZ), appname, highestrole."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    app = (F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("Other App"))
           .when(k % 2 == 0, F.lit("LMS Core")).otherwise(F.lit("lms core")))
    role = F.when(F.col("c_nationkey") % 5 == 0, F.lit("Student")).otherwise(F.lit("Teacher"))
    first = c.select(
        k.alias("userhasheduuid"),
        F.when(k % 37 == 0, F.lit(None).cast("string"))
         .when(k % 29 == 0, F.lit("n/a"))
         .otherwise(F.floor((F.col("c_acctbal") + 1000) / 1000).cast("int").cast("string"))
         .alias("npsresponse"),
        F.expr("timestampadd(DAY, c_custkey % 18, TIMESTAMP_NTZ'2024-01-12 00:00:00')")
         .alias("datetimeresponded"),
        app.alias("appname"), role.alias("highestrole"))
    second = c.filter(k % 10 == 3).select(
        k.alias("userhasheduuid"),
        (k % 11).cast("string").alias("npsresponse"),
        F.expr("TIMESTAMP_NTZ'2024-01-20 12:00:00'").alias("datetimeresponded"),
        app.alias("appname"), role.alias("highestrole"))
    return first.unionByName(second)


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature events: event_id, visitorid, browsertimestamp (NTZ), matchableid, analyticssessionid."""
    return events_mapping(read_table(spark, sf_dir, "events"))


def events_mapping(e: DataFrame) -> DataFrame:
    """The event-table mapping; works on batch and streaming frames alike."""
    return e.select(
        F.col("event_id"),
        F.col("user_id").alias("visitorid"),
        F.col("ts").alias("browsertimestamp"),
        (F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)") % 41).alias("matchableid"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("-"),
                             F.col("ts").cast("date").cast("string")))
         .alias("analyticssessionid"),
    )


# ---- fixed values: the 41-row feature dimension of the fixtures -----------
# (id, name) in id order; iscoreevent = id is even; id 40 has no name.
DIM_FEATURE_NAMES = [
    "SpeedGrader | Open", "Gradebook - Filter", "Grade a quiz", "Rubric add", "LMGB toggle",
    "New LMGB view", "Modules - Expand", "RCE Toolbar", "Page> History", "Unpublish quiz",
    "Add Section", "Upload button", "Block Editor open", "Discussion reply",
    "Conversations inbox", "Compose message", "Assignment group", "Submission details",
    "Due Date edit", "NQ | Build", "CQ | Settings", "AMS item bank", "Quiz statistics",
    "Moderation panel", "Global Navigation", "Dashboard card", "Course Home Page Link",
    "Announcement create", "People tab", "Student Analytics", "Attendance roll",
    "Section list", "Analytics chart", "Insight hub", "Report export", "Settings tab",
    "Admin tools", "Account profile", "Outcomes import", "Help menu", None,
]

DIM_SCHEMA = T.StructType([
    T.StructField("featureid", T.LongType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("iscoreevent", T.BooleanType(), False),
])


def dim_features(spark: SparkSession) -> DataFrame:
    """41 literal rows, built JVM-side from ``range`` (no Python worker)."""
    names = F.array(*[F.lit(n).cast("string") for n in DIM_FEATURE_NAMES])
    return spark.range(len(DIM_FEATURE_NAMES)).select(
        F.col("id").alias("featureid"), F.element_at(names, (F.col("id") + 1).cast("int")).alias("name"),
        (F.col("id") % 2 == 0).alias("iscoreevent"))


DIM_ROWS = len(DIM_FEATURE_NAMES)


def sources(spark: SparkSession, sf_dir: str):
    """(survey, events, dim) for one scale-factor folder."""
    return survey_responses(spark, sf_dir), feature_events(spark, sf_dir), dim_features(spark)
