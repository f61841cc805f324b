"""Queries for n-gram mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickscore.operators import ngrams as N
from clickscore.operators._util import round_doubles
from clickscore.plans import context as C
from clickscore.plans import oracle as O
from clickscore.plans.registry import joined, register

GAP = 360     # the fixture events are sparse; see FIXTURES.md


def _pre(value: str = "feature_name", gap: int = GAP, extra: tuple = ()) -> str:
    return O.with_(O.fixtures_cte(), O.resp_cte(), O.base_cte(), O.sessions_cte(value, gap), *extra)


def _occ(n: int, seq: str = "feature_sequence") -> str:
    names = N.NAMES[:n]
    items = ", ".join(f"{seq}[i + {k}] AS {names[k]}" for k in range(n))
    return f"""
occ{n} AS (
  SELECT nps_category, {items}
  FROM (SELECT nps_category, {seq}, unnest(generate_series(1, len({seq}) - {n - 1})) AS i
        FROM seqs WHERE len({seq}) >= {n})
)"""


def _cnt(n: int) -> str:
    names = ", ".join(N.NAMES[:n])
    return f"""
ng{n} AS (SELECT nps_category, {names}, COUNT(*) AS n FROM occ{n} GROUP BY ALL)"""


def _grp(n: int) -> str:
    names = N.NAMES[:n]
    sel = ", ".join(f"{O.classify_sql(c, 'python')} AS {c}" for c in names)
    return f"""
gg{n} AS (
  SELECT nps_category, {', '.join(names)}, CAST(SUM(n) AS BIGINT) AS n
  FROM (SELECT nps_category, {sel}, n FROM ng{n}) GROUP BY ALL
)"""


def _seqs(spark, sf, gap=GAP, value="feature_name"):
    return C.sessions(spark, sf, value, gap)


def _events(spark, sf, gap=GAP):
    return C.sessioned_events(spark, sf, gap)


# ---- N1, N2 -----------------------------------------------------------------------
@register("n1_bigrams", _pre(extra=(_occ(2), _cnt(2))) + "SELECT * FROM ng2")
def n1_bigrams(spark, sf):
    return N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)


@register("n1_bigrams_from_events", _pre(extra=(_occ(2), _cnt(2))) + "SELECT * FROM ng2")
def n1_bigrams_from_events(spark, sf):
    return N.ngram_counts(N.ngrams_from_events(_events(spark, sf), 2), 2)


@register("n1_bigrams_gap30", _pre(gap=30, extra=(_occ(2), _cnt(2))) + "SELECT * FROM ng2")
def n1_bigrams_gap30(spark, sf):
    return N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf, 30), 2), 2)


@register("n2_trigrams", _pre(extra=(_occ(3), _cnt(3))) + "SELECT * FROM ng3")
def n2_trigrams(spark, sf):
    return N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 3), 3)


@register("n2_trigrams_chunk4", _pre(extra=(_occ(3), _cnt(3))) + "SELECT * FROM ng3")
def n2_trigrams_chunk4(spark, sf):
    """Trigrams from 4-item sequence chunks: grams across chunk edges come from next_items."""
    return N.ngram_counts(N.ngrams_from_sequences(C.sessions(spark, sf, "feature_name", GAP, chunk_size=4), 3), 3)


@register("n2_trigrams_from_events", _pre(extra=(_occ(3), _cnt(3))) + "SELECT * FROM ng3")
def n2_trigrams_from_events(spark, sf):
    return N.ngram_counts(N.ngrams_from_events(_events(spark, sf), 3), 3)


def _arrays_sql(sizes: range, min_count: int) -> str:
    one = "SELECT nps_category, array_to_string(feature_sequence[i:i + {k}], ' -> ') AS gram, CAST({n} AS INTEGER) AS size FROM seqs," \
          " unnest(generate_series(1, len(feature_sequence) - {k})) t(i) WHERE len(feature_sequence) >= {n}"
    return (_pre() + "SELECT nps_category, size, gram, count(*) AS n FROM ("
            + " UNION ALL ".join(one.format(k=n - 1, n=n) for n in sizes) + f") GROUP BY ALL HAVING count(*) >= {min_count}")


@register("s4_long_grams", _arrays_sql(range(9, 10), 1))
def s4_long_grams(spark, sf):
    """9-grams over 4-item chunks: each runs over two chunk edges at least."""
    seqs = C.sessions(spark, sf, "feature_name", GAP, chunk_size=4)
    g = N.gram_arrays(seqs, 9).groupBy("nps_category", "gram").agg(F.count(F.lit(1)).alias("n"))
    return g.select("nps_category", F.lit(9).alias("size"), joined("gram"), "n")


@register("n_frequent_grams", _arrays_sql(range(2, 31), 3))
def n_frequent_grams(spark, sf):
    """All grams of 2 to 30 items that occur three times or more, level by level."""
    return N.frequent_ngrams(_seqs(spark, sf), 30, 3).select("nps_category", "size", joined("gram"), "n")


# ---- C6 / W4 / S3: bigram views ------------------------------------------------------
@register("c6_bigram_view_features", _pre(extra=(_occ(2), _cnt(2))) + """
SELECT nps_category, a AS feature_a, b AS feature_b, n AS bigram_count FROM ng2""")
def c6_bigram_view_features(spark, sf):
    return N.bigram_view(_seqs(spark, sf))


@register("c6_bigram_view_groups",
          _pre("feature_group", extra=(_occ(2, "group_sequence"), _cnt(2))) + """
SELECT nps_category, a AS group_a, b AS group_b, n AS bigram_count FROM ng2""")
def c6_bigram_view_groups(spark, sf):
    return N.bigram_view(_seqs(spark, sf, value="feature_group"), "group_sequence", "group_a", "group_b")


# ---- N3 / D31 -----------------------------------------------------------------------
@register("n3_group_bigrams", _pre(extra=(_occ(2), _cnt(2), _grp(2))) + "SELECT * FROM gg2")
def n3_group_bigrams(spark, sf):
    return N.group_rollup(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2), 2)


@register("n3_group_trigrams", _pre(extra=(_occ(3), _cnt(3), _grp(3))) + "SELECT * FROM gg3")
def n3_group_trigrams(spark, sf):
    return N.group_rollup(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 3), 3), 3)


# ---- N4 / L4 ------------------------------------------------------------------------
def _top_sql(n: int, src: str, annotate: bool) -> str:
    names = N.NAMES[:n]
    ann = "".join(f", {O.classify_sql(c, 'python')} AS group_{c}" for c in names) if annotate else ""
    order = ", ".join(names)
    return f"""
SELECT nps_category, {order}, n, rank{ann}
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY n DESC, {order}) AS rank FROM {src})
WHERE rank <= 10"""


@register("n4_top_bigrams", _pre(extra=(_occ(2), _cnt(2))) + _top_sql(2, "ng2", True))
def n4_top_bigrams(spark, sf):
    return N.top_per_category(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2), 2)


@register("n4_top_trigrams", _pre(extra=(_occ(3), _cnt(3))) + _top_sql(3, "ng3", True))
def n4_top_trigrams(spark, sf):
    return N.top_per_category(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 3), 3), 3)


@register("n4_top_group_bigrams", _pre(extra=(_occ(2), _cnt(2), _grp(2))) + _top_sql(2, "gg2", False))
def n4_top_group_bigrams(spark, sf):
    g = N.group_rollup(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2), 2)
    return N.top_per_category(g, 2, annotate=False)


@register("n4_top_group_trigrams", _pre(extra=(_occ(3), _cnt(3), _grp(3))) + _top_sql(3, "gg3", False))
def n4_top_group_trigrams(spark, sf):
    g = N.group_rollup(N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 3), 3), 3)
    return N.top_per_category(g, 3, annotate=False)


# ---- N5, N6 -------------------------------------------------------------------------
_N5 = f"""
ends AS (SELECT nps_category, a AS item, n FROM ng2 UNION ALL SELECT nps_category, b AS item, n FROM ng2),
tot AS (SELECT nps_category, item, SUM(n) AS t FROM ends GROUP BY 1, 2),
topn AS (SELECT nps_category, item FROM
         (SELECT *, ROW_NUMBER() OVER (PARTITION BY nps_category ORDER BY t DESC, item) AS r FROM tot) WHERE r <= 15),
grid AS (SELECT x.nps_category, x.item AS from_item, y.item AS to_item FROM topn x JOIN topn y USING (nps_category)),
m AS (SELECT g.nps_category, g.from_item, g.to_item, COALESCE(ng2.n, 0) AS n FROM grid g
      LEFT JOIN ng2 ON ng2.nps_category = g.nps_category AND ng2.a = g.from_item AND ng2.b = g.to_item)"""


@register("n5_transitions", _pre(extra=(_occ(2), _cnt(2), _N5)) + f"""
SELECT nps_category, from_item, to_item, n,
       {O.sround('CAST(n AS DOUBLE) / CASE WHEN SUM(n) OVER (PARTITION BY nps_category, from_item) = 0 THEN 1 ELSE SUM(n) OVER (PARTITION BY nps_category, from_item) END', 6)} AS prob
FROM m""")
def n5_transitions(spark, sf):
    bg = N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)
    return round_doubles(N.transition_matrix(bg))


_N6 = """
seen AS (SELECT DISTINCT nps_category, g FROM (SELECT nps_category, a AS g FROM gg2 UNION ALL SELECT nps_category, b FROM gg2)),
ggrid AS (SELECT x.nps_category, x.g AS from_group, y.g AS to_group FROM seen x JOIN seen y USING (nps_category)),
gm AS (SELECT g.nps_category, g.from_group, g.to_group, COALESCE(gg2.n, 0) AS n FROM ggrid g
       LEFT JOIN gg2 ON gg2.nps_category = g.nps_category AND gg2.a = g.from_group AND gg2.b = g.to_group)"""


@register("n6_group_transitions", _pre(extra=(_occ(2), _cnt(2), _grp(2), _N6)) + f"""
SELECT nps_category, from_group, to_group, n,
       {O.sround('CAST(n AS DOUBLE) / CASE WHEN SUM(n) OVER (PARTITION BY nps_category, from_group) = 0 THEN 1 ELSE SUM(n) OVER (PARTITION BY nps_category, from_group) END', 6)} AS prob
FROM gm""")
def n6_group_transitions(spark, sf):
    bg = N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)
    return round_doubles(N.group_transition_matrix(bg))


# ---- N7, N8, N9 -----------------------------------------------------------------------
@register("n7_relative_freq", _pre(extra=(_occ(2), _cnt(2))) + f"""
SELECT nps_category, a, b, n, {O.sround('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY nps_category)', 6)} AS freq
FROM ng2""")
def n7_relative_freq(spark, sf):
    bg = N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)
    return round_doubles(N.relative_freq(bg))


_DIST = f"""
rel AS (SELECT nps_category, a, b, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY nps_category) AS freq
        FROM ng2 WHERE nps_category IN ('promoter', 'detractor')),
pj AS (SELECT COALESCE(p.a, d.a) AS a, COALESCE(p.b, d.b) AS b,
              COALESCE(p.freq, 1e-6) AS freq_prom, COALESCE(d.freq, 1e-6) AS freq_detr
       FROM (SELECT * FROM rel WHERE nps_category = 'promoter') p
       FULL OUTER JOIN (SELECT * FROM rel WHERE nps_category = 'detractor') d ON p.a = d.a AND p.b = d.b),
dist AS (SELECT a || ' -> ' || b AS ngram, a, b,
                {O.classify_sql('a', 'python')} AS group_a, {O.classify_sql('b', 'python')} AS group_b,
                ({O.classify_sql('a', 'python')}) || ' -> ' || ({O.classify_sql('b', 'python')}) AS group_transition,
                freq_prom, freq_detr, freq_prom / freq_detr AS ratio
         FROM pj)"""

_DIST_COLS = ("ngram, a, b, group_a, group_b, group_transition, "
              f"{O.sround('freq_prom', 9)} AS freq_prom, {O.sround('freq_detr', 9)} AS freq_detr, "
              f"{O.sround('ratio', 6)} AS ratio")


def _round_dist(df):
    return df.select(*[F.round(c, 9).alias(c) if c in ("freq_prom", "freq_detr") else
                       (F.round(c, 6).alias(c) if c in ("ratio", "log2_ratio") else F.col(c))
                       for c in df.columns])


@register("n8_distinctive", _pre(extra=(_occ(2), _cnt(2), _DIST)) + f"SELECT {_DIST_COLS} FROM dist")
def n8_distinctive(spark, sf):
    bg = N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)
    return _round_dist(N.distinctive(bg))


def _extremes_sql(k: int) -> str:
    return _pre(extra=(_occ(2), _cnt(2), _DIST)) + f"""
SELECT {_DIST_COLS}, {O.sround('log2(ratio)', 6)} AS log2_ratio FROM (
  (SELECT * FROM dist ORDER BY ratio DESC, ngram LIMIT {k})
  UNION
  (SELECT * FROM dist ORDER BY ratio ASC, ngram LIMIT {k}))"""


def _extremes(spark, sf, k: int):
    bg = N.ngram_counts(N.ngrams_from_sequences(_seqs(spark, sf), 2), 2)
    return _round_dist(N.distinctive_extremes(N.distinctive(bg), k))


@register("n9_distinctive_extremes", _extremes_sql(10))
def n9_distinctive_extremes(spark, sf):
    return _extremes(spark, sf, 10)


@register("l5_distinctive_head_tail_15", _extremes_sql(15))
def l5_distinctive_head_tail_15(spark, sf):
    """The 15 most and 15 least distinctive bigrams."""
    return _extremes(spark, sf, 15)
