"""DuckDB oracle texts.

Each oracle is written in the study's *plain* form (one GROUP BY with all
COUNT(DISTINCT ...) terms, LAG + running SUM over the whole user, nested
CTEs) so it checks our rewritten Spark plans independently.  The fixture
mapping (FIXTURES.md) is repeated here as CTEs over the pre-registered views
``customer`` and ``events``.
"""

from __future__ import annotations

from clickscore.functions.constants import (
    CLASSIFIER_RULES, FALLBACK_GROUP, GROUP_LABELS, GROUPS, PYTHON_RULE_OVERRIDES,
)
from clickscore.sources.fixtures import DIM_FEATURE_NAMES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sround(expr: str, n: int) -> str:
    """Spark's ROUND on a double (HALF_UP on the shortest decimal text)."""
    return f"CAST(round(CAST(CAST(CAST({expr} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,28)), {n}) AS DOUBLE)"


def classify_sql(col: str, variant: str = "sql") -> str:
    parts = ["CASE"]
    for g, pats in CLASSIFIER_RULES:
        if variant == "python":
            pats = [PYTHON_RULE_OVERRIDES.get(p, p) for p in pats]
        cond = " OR ".join(f"{col} ILIKE {q(p)}" for p in pats)
        parts.append(f" WHEN {cond} THEN {q(GROUP_LABELS[g])}")
    parts.append(f" ELSE {q(GROUP_LABELS[FALLBACK_GROUP])} END")
    return "".join(parts)


_APP = ("CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Other App' "
        "WHEN c_custkey % 2 = 0 THEN 'LMS Core' ELSE 'lms core' END")
_ROLE = "CASE WHEN c_nationkey % 5 = 0 THEN 'Student' ELSE 'Teacher' END"


def fixtures_cte() -> str:
    dim_rows = ", ".join(
        f"({i}, {q(n) if n is not None else 'NULL'}, {'true' if i % 2 == 0 else 'false'})"
        for i, n in enumerate(DIM_FEATURE_NAMES))
    return f"""
survey AS (
  SELECT c_custkey AS userhasheduuid,
         CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'n/a'
              ELSE CAST(CAST(floor((c_acctbal + 1000) / 1000) AS INTEGER) AS VARCHAR) END AS npsresponse,
         TIMESTAMP '2024-01-12 00:00:00' + INTERVAL '1' DAY * (c_custkey % 18) AS datetimeresponded,
         {_APP} AS appname, {_ROLE} AS highestrole
  FROM customer
  UNION ALL
  SELECT c_custkey, CAST(c_custkey % 11 AS VARCHAR), TIMESTAMP '2024-01-20 12:00:00', {_APP}, {_ROLE}
  FROM customer WHERE c_custkey % 10 = 3
),
feature_events AS (
  SELECT event_id, user_id AS visitorid, ts AS browsertimestamp,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 41 AS matchableid,
         CASE WHEN event_id % 97 = 0 THEN NULL
              ELSE concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(ts AS DATE) AS VARCHAR)) END AS analyticssessionid
  FROM events
),
dim_features AS (
  SELECT CAST(featureid AS BIGINT) AS featureid, name, iscoreevent
  FROM (VALUES {dim_rows}) t(featureid, name, iscoreevent)
)"""


def resp_cte(name: str = "resp", require_response: bool = True) -> str:
    nn = "AND npsresponse IS NOT NULL" if require_response else ""
    return f"""
{name} AS (
  SELECT userhasheduuid, TRY_CAST(npsresponse AS INTEGER) AS nps_score,
         CASE WHEN TRY_CAST(npsresponse AS INTEGER) <= 6 THEN 'detractor'
              WHEN TRY_CAST(npsresponse AS INTEGER) <= 8 THEN 'passive'
              ELSE 'promoter' END AS nps_category,
         datetimeresponded
  FROM survey
  WHERE lower(appname) = 'lms core' AND lower(highestrole) = 'teacher' {nn}
)"""


def base_cte(window_days: int = 90) -> str:
    return f"""
base AS (
  SELECT answer.userhasheduuid, answer.nps_score, answer.nps_category, answer.datetimeresponded,
         click.event_id, click.browsertimestamp, click.analyticssessionid,
         known.featureid, known.name AS feature_name, known.iscoreevent, {classify_sql('known.name')} AS feature_group,
         click.browsertimestamp BETWEEN answer.datetimeresponded - INTERVAL {window_days} DAY AND answer.datetimeresponded AS in_window
  FROM feature_events AS click, resp AS answer, dim_features AS known
  WHERE click.visitorid = answer.userhasheduuid AND click.matchableid = known.featureid AND known.name IS NOT NULL
),
base90 AS (SELECT * EXCLUDE (in_window) FROM base WHERE in_window)"""


def profile_cte() -> str:
    clicks = ",\n    ".join(
        f"COUNT_IF(feature_group = {q(GROUP_LABELS[g])}) AS clicks_{g}" for g in GROUPS)
    sess = ",\n    ".join(
        f"COUNT(DISTINCT CASE WHEN feature_group = {q(GROUP_LABELS[g])} THEN analyticssessionid END) AS sessions_{g}"
        for g in GROUPS)
    rates = ",\n    ".join(
        f"{sround(f'CAST(clicks_{g} AS DOUBLE) / NULLIF(n_sessions, 0)', 4)} AS rate_{g}" for g in GROUPS)
    ints = ",\n    ".join(
        f"{sround(f'CAST(clicks_{g} AS DOUBLE) / NULLIF(sessions_{g}, 0)', 4)} AS intensity_{g}" for g in GROUPS)
    return f"""
agg AS (
  SELECT userhasheduuid, nps_score, nps_category,
    COUNT(*) AS total_feature_clicks,
    COUNT(DISTINCT feature_name) AS n_distinct_features,
    COUNT(DISTINCT analyticssessionid) AS n_sessions,
    {clicks},
    {sess}
  FROM base90 GROUP BY 1, 2, 3
),
profile AS (
  SELECT *,
    {sround('CAST(total_feature_clicks AS DOUBLE) / NULLIF(n_sessions, 0)', 2)} AS clicks_per_session,
    {rates},
    {ints}
  FROM agg
)"""


def sessions_cte(value: str = "feature_name", gap: int = 30, gap_mode: str = "boundary",
                 name: str = "seqs", src: str = "base90") -> str:
    order = "browsertimestamp, event_id, datetimeresponded"
    before, now = "lag(browsertimestamp) OVER line", "browsertimestamp"
    far = (f"date_diff('minute', {before}, {now}) > {gap}" if gap_mode == "boundary"
           else f"(epoch_us({now}) - epoch_us({before})) // 60000000 > {gap}")
    seqname = "feature_sequence" if value == "feature_name" else "group_sequence"
    return f"""
{name}_ev AS (
  SELECT * EXCLUDE (opens), sum(opens) OVER (line ROWS UNBOUNDED PRECEDING) AS session_num
  FROM (SELECT *, CAST(coalesce({far}, TRUE) AS INTEGER) AS opens
        FROM {src} WINDOW line AS (PARTITION BY userhasheduuid ORDER BY {order}))
  WINDOW line AS (PARTITION BY userhasheduuid ORDER BY {order})
),
{name} AS (
  SELECT userhasheduuid, nps_score, nps_category, CAST(session_num AS BIGINT) AS session_num,
         MIN(browsertimestamp) AS session_start, MAX(browsertimestamp) AS session_end,
         COUNT(*) AS session_length,
         list({value} ORDER BY {order}) AS {seqname}
  FROM {name}_ev
  GROUP BY 1, 2, 3, 4
  HAVING COUNT(*) >= 2
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


def std_prefix(window_days: int = 90) -> str:
    return with_(fixtures_cte(), resp_cte(), base_cte(window_days))


def profile_prefix() -> str:
    return with_(fixtures_cte(), resp_cte(), base_cte(), profile_cte())
