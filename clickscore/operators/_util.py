"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Largest side we hand to ``broadcast()``: a survey/dimension table of a few
# million narrow rows is tens of MB; anything bigger goes through a shuffle
# join (AQE still converts it at runtime if the real size turns out small).
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when it provably has at most ``max_rows`` rows.

    ``known_rows`` is an upper bound the caller already has (a literal
    table, a count taken together with other statistics); otherwise the
    check is a ``limit(max_rows + 1).count()`` on the (small) side, which
    stops reading as soon as the bound is exceeded.
    """
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder.

    Used for frames that several steps (or Newton iterations) re-read: a lost
    executor then recomputes from the checkpoint, not from the event log.
    """
    from clickscore.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_frame(spark, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small literal table built JVM-side (no Python worker at execution).

    ``schema`` is [(name, spark_sql_type), ...].
    """
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in schema])
    structs = [F.struct(*[(F.lit(v) if not (isinstance(v, float) and v != v) else F.lit(None)).cast(t).alias(n)
                          for v, (n, t) in zip(r, schema)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", never_null: list[str] = ()) -> DataFrame:
    """Join two frames on ``keys`` where some keys may be NULL (score).  A key in ``never_null`` is compared
    plainly, so that a table bucketed by it needs no shuffle."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k] == r[f"__r_{k}"] if k in never_null else left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used by check views that compare engines)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def top_k_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank",
                    salt_of: list[str] | None = None, salts: int = 64) -> DataFrame:
    """Exact top ``k`` rows per ``by`` group with ``row_number`` as ``rank``.

    A plain window over ``by`` sorts a whole group in one task.  Here every
    group is first cut to its top ``k`` inside ``salts`` hash slices (of the
    ``salt_of`` columns), in parallel; the final window then sees at most
    ``salts * k`` rows per group.  ``order`` must be a total order.
    """
    salt_of = salt_of or [c for c in df.columns if c not in by]
    s = F.pmod(F.xxhash64(*[F.col(c) for c in salt_of]), F.lit(salts))
    pre = (df.withColumn("_salt", s)
           .withColumn("_r1", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
           .filter(F.col("_r1") <= k).drop("_salt", "_r1"))
    return (pre.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
            .filter(F.col(rank) <= k))


def at_most(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast ``df`` if the caller knows that it has at most ``rows`` rows (few enough).
    Without such a bound there is no hint, and AQE decides by the real size."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_MAX_ROWS else df


def _join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join on ``by``; with no keys ``right`` is a one-row aggregate (a proven broadcast)."""
    return left.join(at_most(right, rows), by, how) if by else left.crossJoin(F.broadcast(right))


ACCURACY = 10_000        # of the approximate pass: its rank error is at most a group's size / ACCURACY


def exact_quantiles(df: DataFrame, value: str | list[str], probs: list[float], by: list[str] | None = None,
                    names: list[str] | None = None, max_groups: int | None = None, accuracy: int = ACCURACY,
                    approximate: bool = False) -> DataFrame:
    """Linear-interpolated quantiles (Spark ``percentile`` semantics) of one or several columns per ``by`` group.

    ``percentile`` keeps a value -> count map per group and merges it in one
    task, so a group of a third of all sessions lands in one task.  Here two
    passes over ``df`` select instead: the first brackets every quantile by two
    approximate ones, safely apart, with a mergeable sketch; the second counts the
    rows on the bracket's smaller side and keeps only the distinct values inside
    (under a thousandth of a large group, besides ties), whose running counts give
    the two values around (N - 1) * p.  A group of at most ``accuracy`` values is
    its own bracket.  All columns and quantiles share the passes.

    NULLs are skipped; a group with no values gets NULL.  ``max_groups`` is a bound
    on the groups that the caller can prove; the brackets are broadcast only with it.
    ``approximate`` returns the first pass's quantiles (a value of the column at a
    rank within N / ``accuracy``), in one pass.  ``names`` go by column, then by quantile.
    """
    by, values = list(by or []), [value] if isinstance(value, str) else list(value)
    names = names or [f"q{i}" for i in range(len(values) * len(probs))]
    cells = [(k, i, j) for k, (i, j) in enumerate((i, j) for i in range(len(values)) for j in range(len(probs)))]
    d = df.select(*by, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    apart = 4 / accuracy
    cuts = list(probs) if approximate else [min(1.0, max(0.0, p + s)) for p in probs for s in (-apart, apart)]
    first = d.groupBy(*by).agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(values))],
                               *[F.percentile_approx(f"_v{i}", cuts, accuracy).alias(f"_a{i}") for i in range(len(values))])
    if approximate:
        return first.select(*by, *[F.get(f"_a{i}", F.lit(j)).alias(names[k]) for k, i, j in cells])

    def cell(k, i, j):
        lo, hi = f"_a{i}[{2 * j}]", f"_a{i}[{2 * j + 1}]"
        side = f"_v{i} < {lo}" if probs[j] <= 0.5 else f"_v{i} > {hi}"
        return (f"CASE WHEN _v{i} IS NULL THEN NULL WHEN _n{i} <= {accuracy} OR (_v{i} >= {lo} AND _v{i} <= {hi})"
                f" THEN struct({k} AS k, _v{i} AS key) WHEN {side} THEN struct({k} AS k, CAST(NULL AS DOUBLE) AS key) END")

    met = _join_by(d, first, by, rows=max_groups).select(
        *by, F.expr(f"inline(filter(array({', '.join(cell(*c) for c in cells)}), c -> c IS NOT NULL))"))
    held = _join_by(met.groupBy(*by, "k", "key").agg(F.count(F.lit(1)).alias("_t")), first.drop(*[f"_a{i}" for i in range(len(values))]), by, rows=max_groups)
    at = lambda items: F.element_at(F.array(*items), F.col("k") + 1)
    w = Window.partitionBy(*by, "k")
    inside, side = F.when(F.col("key").isNotNull(), F.col("_t")), F.when(F.col("key").isNull(), F.col("_t"))
    total, p = at([F.col(f"_n{i}") for _, i, _ in cells]), at([F.lit(float(probs[j])) for _, _, j in cells])
    beside = F.coalesce(F.max(side).over(w), F.lit(0))
    off = F.when(p <= 0.5, beside).otherwise(total - beside - F.sum(inside).over(w))
    ran = F.coalesce(F.sum(inside).over(w.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*by, "k", "key", "_t", ((total - 1) * p).alias("_pos"), (off + ran).alias("_from")).filter(F.col("key").isNotNull())
    here = lambda r: (F.col("_from") <= r) & (r < F.col("_from") + F.col("_t"))
    low, high, pos = F.floor("_pos"), F.ceil("_pos"), F.col("_pos")
    found = held.groupBy(*by, "k").agg(F.max("_pos").alias("_pos"), F.max(F.when(here(low), F.col("key"))).alias("_lo"),
                                       F.max(F.when(here(high), F.col("key"))).alias("_hi"))
    found = found.select(*by, "k", F.when(low == high, F.col("_lo")).otherwise((high - pos) * F.col("_lo") + (pos - low) * F.col("_hi")).alias("_q"))
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("_q"))).alias(names[k]) for k, _, _ in cells])
    if not by:
        return wide                                     # one row, of NULLs if there is no value
    return first.select(*by).join(at_most(wide, max_groups), by, "left")
