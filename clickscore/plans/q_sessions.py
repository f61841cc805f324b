"""Queries for sessions and sequences."""

from __future__ import annotations

from clickscore.operators import sessions as S
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import joined, register

_FX = O.fixtures_cte()


def _seq_sql(value: str, gap: int, gap_mode: str = "boundary", chunk_size: int = S.CHUNK_ITEMS) -> str:
    seq = "feature_sequence" if value == "feature_name" else "group_sequence"
    order = "browsertimestamp, event_id, datetimeresponded"
    return O.with_(_FX, O.resp_cte(), O.base_cte(), O.sessions_cte(value, gap, gap_mode)) + f"""
, pos AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY userhasheduuid, session_num ORDER BY {order}) AS session_pos
  FROM seqs_ev
),
chunks AS (
  SELECT userhasheduuid, nps_score, nps_category, CAST(session_num AS BIGINT) AS session_num,
         CAST(floor((session_pos - 1) / {chunk_size}) AS BIGINT) AS chunk,
         list({value} ORDER BY {order}) AS seq
  FROM pos GROUP BY 1, 2, 3, 4, 5
)
SELECT s.userhasheduuid, s.nps_score, s.nps_category, s.session_num, s.session_start, s.session_end,
       s.session_length, c.chunk, array_to_string(c.seq, ' -> ') AS {seq}, CAST(len(c.seq) AS INTEGER) AS seq_length
FROM seqs s JOIN chunks c
  ON s.userhasheduuid = c.userhasheduuid AND s.nps_score IS NOT DISTINCT FROM c.nps_score
 AND s.nps_category = c.nps_category AND s.session_num = c.session_num"""


def _seq_view(df, seq: str):
    return df.select("userhasheduuid", "nps_score", "nps_category", "session_num", "session_start",
                     "session_end", "session_length", "chunk", joined(seq), "seq_length")


@register("d7_sessions_features_30", _seq_sql("feature_name", 30))
def d7_sessions_features_30(spark, sf):
    return _seq_view(C.sessions_lazy(spark, sf, "feature_name", 30), "feature_sequence")


@register("d7_sessions_features_360", _seq_sql("feature_name", 360))
def d7_sessions_features_360(spark, sf):
    return _seq_view(C.sessions(spark, sf, "feature_name", 360), "feature_sequence")


@register("d7_sessions_groups_360", _seq_sql("feature_group", 360))
def d7_sessions_groups_360(spark, sf):
    return _seq_view(C.sessions(spark, sf, "feature_group", 360), "group_sequence")


@register("d7_sessions_elapsed_30", _seq_sql("feature_name", 30, "elapsed"))
def d7_sessions_elapsed_30(spark, sf):
    return _seq_view(C.sessions(spark, sf, "feature_name", 30, "elapsed"), "feature_sequence")


@register("d7_sessions_features_30_chunk4", _seq_sql("feature_name", 30, chunk_size=4))
def d7_sessions_features_30_chunk4(spark, sf):
    """D7 with 4-item chunks: every session longer than 4 is split (checks the chunking)."""
    return _seq_view(C.sessions(spark, sf, "feature_name", 30, chunk_size=4), "feature_sequence")


@register("d9_session_check_30", O.with_(_FX, O.resp_cte(), O.base_cte(), O.sessions_cte("feature_name", 30))
          + f"SELECT nps_category, COUNT(*) AS n_sessions, {O.sround('AVG(session_length)', 1)} AS avg_len "
            "FROM seqs GROUP BY 1")
def d9_session_check_30(spark, sf):
    return S.session_check(C.sessions(spark, sf, "feature_name", 30))


@register("d9_session_check_30_chunk4", O.with_(_FX, O.resp_cte(), O.base_cte(), O.sessions_cte("feature_name", 30))
          + f"SELECT nps_category, COUNT(*) AS n_sessions, {O.sround('AVG(session_length)', 1)} AS avg_len "
            "FROM seqs GROUP BY 1")
def d9_session_check_30_chunk4(spark, sf):
    """D9 on 4-item chunks: the same sessions, whatever the chunk size."""
    return S.session_check(C.sessions(spark, sf, "feature_name", 30, chunk_size=4))


@register("d9_session_check_groups_360",
          O.with_(_FX, O.resp_cte(), O.base_cte(), O.sessions_cte("feature_group", 360))
          + f"SELECT nps_category, COUNT(*) AS n_sessions, {O.sround('AVG(session_length)', 1)} AS avg_len "
            "FROM seqs GROUP BY 1")
def d9_session_check_groups_360(spark, sf):
    return S.session_check(C.sessions(spark, sf, "feature_group", 360))
