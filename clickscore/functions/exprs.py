"""Column expressions (JVM-side, codegen'd) shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickscore.functions.constants import (
    BEHAVIOUR_LABELS, CATEGORIES, CLASSIFIER_RULES, DETRACTOR_MAX, FALLBACK_GROUP, GROUP_LABELS,
    PASSIVE_MAX, PYTHON_RULE_OVERRIDES,
)

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- scores (B2, B3, B11) -------------------------------------------------
def parse_score(c) -> Column:
    """TRY_CAST(string AS INT): NULL when the text is not an integer."""
    return F.expr(f"try_cast({c} AS INT)") if isinstance(c, str) else c.try_cast("int")


def score_category(score, null_as: str | None = "promoter") -> Column:
    """<=6 detractor, <=8 passive, else promoter.

    The study's CASE sends a NULL score to its ELSE branch (promoter);
    ``null_as=None`` yields NULL instead so callers can drop those rows.
    """
    s = col(score)
    e = F.when(s <= DETRACTOR_MAX, F.lit(CATEGORIES[0])).when(s <= PASSIVE_MAX, F.lit(CATEGORIES[1]))
    if null_as is None:
        return e.when(s.isNotNull(), F.lit(CATEGORIES[2]))
    return e.otherwise(F.lit(CATEGORIES[2]))


def ordinal_code(category) -> Column:
    c = col(category)
    return (F.when(c == CATEGORIES[0], F.lit(0)).when(c == CATEGORIES[1], F.lit(1))
            .when(c == CATEGORIES[2], F.lit(2)))


# ---- feature-group classifier (B4, B4p) ------------------------------------
def rule_patterns(variant: str = "sql"):
    if variant not in ("sql", "python"):
        raise ValueError("variant must be 'sql' or 'python'")
    rules = []
    for g, pats in CLASSIFIER_RULES:
        if variant == "python":
            pats = [PYTHON_RULE_OVERRIDES.get(p, p) for p in pats]
        rules.append((g, pats))
    return rules


def feature_group(name, variant: str = "sql", labels: bool = True) -> Column:
    """Ordered first-match classification of a feature name.

    Returns the display label (``labels=True``) or the short group key.
    """
    if isinstance(name, str):
        # one SQL CASE parsed JVM-side: a single Py4J call instead of ~60
        return F.expr(feature_group_sql(f"`{name}`", variant, labels))
    n = col(name)
    out = None
    for g, pats in rule_patterns(variant):
        cond = reduce(lambda a, b: a | b, [n.ilike(p) for p in pats])
        val = F.lit(GROUP_LABELS[g] if labels else g)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(GROUP_LABELS[FALLBACK_GROUP] if labels else FALLBACK_GROUP))


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feature_group_sql(name_sql: str, variant: str = "sql", labels: bool = True) -> str:
    parts = ["CASE"]
    for g, pats in rule_patterns(variant):
        cond = " OR ".join(f"{name_sql} ILIKE {_sql_str(p)}" for p in pats)
        parts.append(f" WHEN {cond} THEN {_sql_str(GROUP_LABELS[g] if labels else g)}")
    fb = GROUP_LABELS[FALLBACK_GROUP] if labels else FALLBACK_GROUP
    parts.append(f" ELSE {_sql_str(fb)} END")
    return "".join(parts)


# ---- time keys (B14, W2) ----------------------------------------------------
def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ from its wall-clock
    fields: no session time zone is involved (``timestampdiff`` would cast the
    NTZ value to a zoned timestamp and daylight-saving jumps would leak in)."""
    t = f"`{ts}`" if isinstance(ts, str) else None
    if t is None:
        raise TypeError("epoch_micros takes a column name")
    return F.expr(f"CAST(unix_date(CAST({t} AS DATE)) AS BIGINT) * 86400000000"
                  f" + CAST(hour({t}) AS BIGINT) * 3600000000 + CAST(minute({t}) AS BIGINT) * 60000000"
                  f" + CAST(date_part('SECOND', {t}) * 1000000 AS BIGINT)")


def minute_index(ts) -> Column:
    """Minute boundary index: DATEDIFF(minute, a, b) == minute_index(b) - minute_index(a)."""
    return F.floor(epoch_micros(ts) / F.lit(60_000_000))


def duration_minutes(start, end) -> Column:
    return (epoch_micros(end) - epoch_micros(start)).cast("double") / F.lit(60_000_000.0)


# ---- misc scalars (B8-B10, B22) -------------------------------------------
def safe_ratio(num, den, digits: int | None = None) -> Column:
    r = col(num).cast("double") / F.nullif(col(den), F.lit(0))
    return F.round(r, digits) if digits is not None else r


def stars(p) -> Column:
    p = col(p)
    return (F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**"))
            .when(p < 0.05, F.lit("*")).otherwise(F.lit("")))


def cap_upper(x, cap) -> Column:
    """pandas ``clip(upper=cap)``: NULL stays NULL (``least`` would skip it)."""
    x = col(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(x, col(cap)))


def predictor_label(feature) -> Column:
    """Label of a model predictor: its group's for rate_ and intensity_, its own for
    the behaviour columns, else the name itself."""
    feature = col(feature)
    groups = F.create_map(*[F.lit(x) for item in GROUP_LABELS.items() for x in item])
    others = F.create_map(*[F.lit(x) for item in BEHAVIOUR_LABELS.items() for x in item])
    return F.coalesce(groups[F.regexp_extract(feature, "^(?:rate|intensity)_(.*)$", 1)], others[feature], feature)
