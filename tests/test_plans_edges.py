"""Plan shape assertions and small edge fixtures for the base build, profile
and statistics."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickscore.functions.constants import GROUPS
from clickscore.operators import base as B
from clickscore.operators import describe as D
from clickscore.operators import profile as P
from clickscore.operators import ranks as R
from clickscore.plans import context as C
from clickscore.sources import fixtures as FX
from tests.conftest import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_base_build_is_map_side_with_pushed_bounds(spark):
    p = plan(C.base90_lazy(spark, SF01))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
    assert "Exchange hashpartitioning" not in p
    ex = C.base90_lazy(spark, SF01)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(ts," in ex and "LessThanOrEqual(ts," in ex
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,props:string>" in ex


def test_shuffle_join_equals_broadcast(spark):
    survey, ev, dim = FX.sources(spark, SF01)
    resp = B.respondents(survey, FX.APP, FX.ROLE)
    wide = B.base_events(resp, ev, dim, only_window=True)
    shuffled = B.base_events(resp, ev, dim, only_window=True, max_broadcast=0)
    assert shuffled.columns == wide.columns and shuffled.count() == wide.count() == 4454
    assert shuffled.exceptAll(wide).count() == 0


def test_bloom_filter_stands_below_the_exchange(spark):
    survey, ev, dim = FX.sources(spark, SF01)
    resp = B.respondents(survey, FX.APP, FX.ROLE)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(B.base_events(resp, ev, dim, only_window=True, max_broadcast=0)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = next(i for i, x in enumerate(p) if "SortMergeJoin [visitorid" in x and "_at" in x and "_bin" in x)
    swap = next(i for i, x in enumerate(p) if i > join and "Exchange hashpartitioning(visitorid" in x and "_at" in x)
    kept = next(i for i, x in enumerate(p) if i > swap and "Filter" in x and "bit_get" in x)
    assert join < swap < kept < next(i for i, x in enumerate(p) if i > kept and "Scan parquet" in x)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_bloom_filter_holds_every_key(spark, n):
    from clickscore.operators.joins import bloom_filter, might_hold
    keys = spark.range(n).selectExpr("id * 7 AS k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    bloom = bloom_filter(keys, "k", n)
    held = spark.range(50_000).select(F.col("id"), might_hold(bloom, F.col("id")).alias("h"))
    assert held.filter(f"id % 7 = 0 AND id < {7 * n} AND NOT h").count() == 0
    assert held.filter(f"(id % 7 <> 0 OR id >= {7 * n}) AND h").count() <= 0.02 * 50_000
    assert bloom[0].count() == 1


def test_window_join_on_bins_equals_nested_loops(spark):
    import datetime as dt
    import random
    from clickscore.operators.joins import join_in_window
    rnd = random.Random(12)
    t0 = dt.datetime(2024, 3, 1)
    events = [(rnd.randrange(5), t0 + dt.timedelta(hours=rnd.randrange(24 * 60), seconds=rnd.choice([0, 1])), i) for i in range(400)]
    answers = [(rnd.randrange(6), t0 + dt.timedelta(hours=rnd.randrange(24 * 70))) for _ in range(40)] + [(1, None)]
    e = spark.createDataFrame(events, "visitorid long, browsertimestamp timestamp_ntz, i int")
    a = spark.createDataFrame(answers, "u long, datetimeresponded timestamp_ntz")
    for days in (1, 7, 30):
        got = sorted((r.i, r.datetimeresponded) for r in join_in_window(e, a, days, len(answers), "u").collect())
        assert got == sorted((i, t) for u, ts, i in events for v, t in answers
                             if u == v and t is not None and t - dt.timedelta(days=days) <= ts <= t)


def test_profile_has_no_expand(spark):
    import re
    p = plan(C.profile_lazy(spark, SF01))
    assert re.search(r"[-+:] Expand \[", p) is None     # no Expand node (one feature is named "... Expand")


@pytest.mark.parametrize("build", ["sessions", "ngrams_events", "kruskal", "spearman"])
def test_no_single_partition_exchange(spark, build):
    from clickscore.operators import ngrams as N
    from clickscore.operators import sessions as S
    if build == "sessions":
        df = C.sessions_lazy(spark, SF01, "feature_name", 30)
    elif build == "ngrams_events":
        df = N.ngram_counts(N.ngrams_from_events(C.sessioned_events(spark, SF01), 2), 2)
    elif build == "kruskal":
        df = R.kruskal_rates(C.profile(spark, SF01))
    else:
        df = R.spearman_matrix(C.profile(spark, SF01))
    # a single-partition exchange may only merge partial aggregates (a few
    # rows per task), never feed a sort/window over the data
    lines = plan(df).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1] and "partial_" in lines[i + 1], "\n".join(lines[i - 1:i + 3])


def _survey(spark, rows):
    return spark.createDataFrame(rows, "userhasheduuid long, npsresponse string, datetimeresponded timestamp_ntz, "
                                       "appname string, highestrole string")


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, visitorid long, browsertimestamp timestamp_ntz, "
                                       "matchableid long, analyticssessionid string")


def test_respondent_rules(spark):
    t = dt.datetime(2024, 2, 1)
    s = _survey(spark, [(1, "5", t, "LMS CORE", "TEACHER"), (2, "n/a", t, "lms core", "teacher"),
                        (3, None, t, "lms core", "teacher"), (4, " 9 ", t, "lms core", "teacher"),
                        (5, "8", t, "other", "teacher"), (6, "7", t, "lms core", "student")])
    r = {x["userhasheduuid"]: (x["nps_score"], x["nps_category"]) for x in B.respondents(s, FX.APP, FX.ROLE).collect()}
    assert r == {1: (5, "detractor"), 2: (None, "promoter"), 4: (9, "promoter")}
    assert {x["userhasheduuid"] for x in B.respondents(s, FX.APP, FX.ROLE, null_score="drop").collect()} == {1, 4}


def test_window_bounds_inclusive_and_null_session(spark):
    t = dt.datetime(2024, 4, 1, 12, 0, 0)
    s = _survey(spark, [(1, "9", t, "lms core", "teacher")])
    ev = _events(spark, [(1, 1, t, 0, "s1"),                                      # end: inside
                         (2, 1, t - dt.timedelta(days=90), 13, "s1"),            # start: inside
                         (3, 1, t - dt.timedelta(days=90, microseconds=1), 13, "s2"),  # outside
                         (4, 1, t + dt.timedelta(microseconds=1), 13, "s2"),     # outside
                         (5, 1, t - dt.timedelta(days=1), 27, None),             # NULL tool session
                         (6, 1, t - dt.timedelta(days=1), 40, "s3")])            # feature without name
    b90 = B.base_events(B.respondents(s, FX.APP, FX.ROLE), ev, FX.dim_features(spark), only_window=True)
    assert sorted(r["event_id"] for r in b90.collect()) == [1, 2, 5]
    full = B.base_events(B.respondents(s, FX.APP, FX.ROLE), ev, FX.dim_features(spark))
    assert {r["event_id"]: r["in_window"] for r in full.collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    prof = P.group_profile(b90).first()
    assert prof["total_feature_clicks"] == 3 and prof["n_sessions"] == 1
    assert prof["clicks_grading"] == 1 and prof["clicks_discussions"] == 1 and prof["clicks_announcements"] == 1
    assert prof["sessions_grading"] == 1 and prof["sessions_announcements"] == 0
    assert prof["intensity_announcements"] is None and prof["rate_announcements"] == 1.0


def test_classifier_precedence_traps(spark):
    from clickscore.functions.exprs import feature_group
    names = ["Grade a quiz", "Add Section", "Unpublish quiz", "Assignment group", "Student Analytics",
             "New LMGB view", "Help menu"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["s"], r["p"]) for r in
           df.select("name", feature_group("name").alias("s"), feature_group("name", "python").alias("p")).collect()}
    assert got["Grade a quiz"][0] == "Evaluación y calificación"
    assert got["Add Section"][0] == "Módulos y contenido"
    assert got["Unpublish quiz"][0] == "Módulos y contenido"
    assert got["Assignment group"][0] == "Tareas y entregas"
    assert got["Student Analytics"][0] == "Gestión de estudiantes"
    assert got["New LMGB view"] == ("Otros", "Evaluación y calificación")
    assert got["Help menu"] == ("Otros", "Otros")


def test_kruskal_edge_cases(spark):
    rows = [("m_const", c, 1.0) for c in ("detractor", "passive", "promoter") for _ in range(3)]
    rows += [("m_missing", c, float(i)) for c in ("detractor", "passive") for i in range(3)]
    rows += [("m_null", "promoter", None)]
    long = spark.createDataFrame(rows, "metric string, nps_category string, value double")
    out = {r["metric"]: (r["H"], r["p_value"]) for r in R.kruskal(long).collect()}
    assert out["m_const"] == (0.0, None)
    assert out["m_missing"] == (None, None)


def test_profile_invariants(spark):
    prof = C.profile(spark, SF01)
    tot = sum(F.col(f"clicks_{g}") for g in GROUPS)
    assert prof.filter(tot != F.col("total_feature_clicks")).count() == 0
    for g in GROUPS:
        assert prof.filter(F.col(f"sessions_{g}") > F.col("n_sessions")).count() == 0
    bands = D.band_distribution(prof).agg(F.sum("n")).first()[0]
    assert bands == prof.count()
    assert prof.count() == 102 and prof.agg(F.sum("total_feature_clicks")).first()[0] == 4454
