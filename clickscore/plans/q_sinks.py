"""Queries for sinks and gold-table loading (A4-A6, A8, A9): each writes or
registers, then reads the result back so the driver compares the content."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickscore.operators import base as B
from clickscore.operators import profile as P
from clickscore.operators import sessions as S
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import REGISTRY, register
from clickscore.plans.q_ngrams import _cnt, _occ, _pre
from clickscore.plans.q_sessions import _seq_view
from clickscore.sources import sinks as K

_STD = O.std_prefix()


@register("a4_materialize_base_window", _STD + "SELECT * FROM base90")
def a4_materialize_base_window(spark, sf):
    path = K.materialize_base(C.base90_lazy(spark, sf), K.table_path(spark, "base_90d"))
    return K.load_table(spark, path).drop("event_date")


BUCKETS = 8


def _bucketed_base(spark, sf, days: int = 90) -> str:
    return C.memo(spark, sf, ("bucketed_base", days), lambda: K.materialize_base(
        C.base90(spark, sf, days), K.table_path(spark, f"base_{days}d"), BUCKETS))


@register("a4_profile_from_bucketed_base", O.profile_prefix() + "SELECT * FROM profile")
def a4_profile_from_bucketed_base(spark, sf):
    """D3 from the stored base table, bucketed by user: no shuffle of the events."""
    return K.over_parts(spark, _bucketed_base(spark, sf), lambda base: P.group_profile(base))


@register("a4_sessions_from_bucketed_base", REGISTRY["d7_sessions_features_30"].sql)
def a4_sessions_from_bucketed_base(spark, sf):
    """D7 from the stored base table: sessions are numbered where the bucket is read."""
    return _seq_view(K.over_parts(spark, _bucketed_base(spark, sf), lambda base: S.build_sessions(base, "feature_name", 30)), "feature_sequence")


@register("a8_refresh_changed_days", _STD + "SELECT * FROM base90")
def a8_refresh_changed_days(spark, sf):
    """A table of the 60-day look-back, brought up to 90 days: only days whose rows differ are written."""
    root = K.materialize_base(C.base90(spark, sf, 60), K.table_path(spark, "base_refreshed"), BUCKETS)
    K.refresh_days(K.with_day(C.base90(spark, sf)), root)
    return K.load_table(spark, root).drop(K.DAY)


@register("a5_top_features_temp_table", _STD + """
SELECT feature_name, COUNT(*) AS total_events, COUNT(DISTINCT userhasheduuid) AS unique_users
FROM base90 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def a5_top_features_temp_table(spark, sf):
    K.temp_table(B.top_features(C.base90(spark, sf)), "tmp_top_features")
    return spark.sql("SELECT * FROM tmp_top_features")


@register("a6_bigram_view_sql", _pre(extra=(_occ(2), _cnt(2))) + """
SELECT nps_category, a AS feature_a, b AS feature_b, n AS bigram_count FROM ng2""")
def a6_bigram_view_sql(spark, sf):
    K.view(C.sessions(spark, sf, "feature_name", 360), "gold_sequences_features")
    return spark.sql("""
        SELECT nps_category, g[0] AS feature_a, g[1] AS feature_b, COUNT(*) AS bigram_count
        FROM (SELECT nps_category,
                     explode(transform(sequence(1, least(size(feature_sequence), size(s) - 1)),
                                       i -> slice(s, i, 2))) AS g
              FROM (SELECT nps_category, feature_sequence, concat(feature_sequence, next_items) AS s
                    FROM gold_sequences_features)
              WHERE size(s) >= 2)
        GROUP BY 1, 2, 3""")


@register("a8_load_gold_profile", O.profile_prefix() + "SELECT * FROM profile")
def a8_load_gold_profile(spark, sf):
    path = K.write_table(C.profile(spark, sf), K.table_path(spark, "gold_profile"))
    return K.load_table(spark, path)


def _csv_copy(spark, sf, key: str, order: list[str]):
    """Export a registered result table in its order and read it back with its types."""
    df = REGISTRY[key].fn(spark, sf)
    return K.load_csv(spark, K.export_csv(df, K.table_path(spark, key), order))


# Every result table that the study exports, in the order it is written.  What a fit decides has no oracle; the
# same tables at fixed coefficients or after one step (see q_model) have one.
EXPORTS = {
    "k1_kruskal_rates": "kruskal_H DESC, grp", "l6_top_discriminating": "grp", "d13_population_summary": "n_teachers",
    "d17_group_usage": "total_clicks DESC, grp", "d22_metric_summary": "metric, nps_category", "d30_session_length_summary": "nps_category",
    "k2_spearman_matrix": "metric_1, metric_2", "n8_distinctive": "ratio DESC, ngram", "n9_distinctive_extremes": "ratio DESC, ngram",
    "n5_transitions": "nps_category, from_item, to_item", "n6_group_transitions": "nps_category, from_group, to_group",
    "d24_cooccurrence": "group_1, group_2", "k3_spearman_score_table": "rho DESC, grp", "d21_rate_gap": "diff DESC, grp",
    "d26_zero_audit": "pct_zero_clicks DESC, grp", "d28_heavy_profile": "is_power", "d29_predictor_summary": "variable",
    "m4_fixed_vif_rate": "VIF DESC, feature", "m8_fixed_statistics": "model", "m11_one_step_coefficients": "coef DESC, feature",
    "m13_fixed_marginal_effects": "AME_promoter DESC, feature", "m14_fixed_fold_accuracy": "fold", "m15_fixed_accuracy": "accuracy",
    "m19_one_step_parallel_lines": "coef_ordinal DESC, feature",
    "m4_vif_rate": "VIF DESC, feature", "m4_vif_intensity": "VIF DESC, feature", "m8_model_comparison": "model",
    "m11_coefficients_all": "model, coef DESC, feature", "m13_marginal_effects": "AME_promoter DESC, feature", "m14_cv_accuracy": "fold",
    "m15_test_accuracy": "accuracy", "m19_parallel_lines": "coef_ordinal DESC, feature"}


def register_exports():
    """Called by the catalog when all other queries are registered."""
    for key, order in EXPORTS.items():
        name = "a9_export_kruskal_csv" if key == "k1_kruskal_rates" else f"a9_export_{key}"
        terms = [t.split() for t in order.split(", ")]
        sql_order = ", ".join(f'"{t[0]}" {"DESC" if len(t) > 1 else "ASC"} NULLS LAST' for t in terms)
        sql = REGISTRY[key].sql

        @register(name, sql and f"SELECT *, ROW_NUMBER() OVER (ORDER BY {sql_order}) AS position FROM ({sql})")
        def export(spark, sf, key=key, terms=terms):
            return _csv_copy(spark, sf, key, [F.col(t[0]).desc_nulls_last() if len(t) > 1 else F.col(t[0]).asc_nulls_last() for t in terms])
