"""Gap-based sessions (W1-W3), session sequences (D7, S1, S2) and checks.

The study numbers sessions with LAG + running SUM over PARTITION BY user.
That is one shuffle and right for nearly every user, but one user may hold a
third of all events, and those may even fall into a single minute.  A user of
more than ``run_rows`` events is therefore cut into runs: the events of such
users are range-partitioned by (user, order), so a run is a contiguous piece of a
timeline of about ``run_rows`` events, wherever they lie in time.  Inside a run
LAG and the running sums are ordinary windows; one summary row per run (first and
last key, starts, rows) is scanned per user, which gives the state carried into
every run.  There are at most two such rows per run edge, so they are broadcast.
The result is the single-partition scan's for any ``run_rows``.

Row order is (ts, event_id, datetimeresponded): a total order, so LAG, the
running sum and the sequence arrays agree even when a user's events are
duplicated for two survey answers.

The sequence table (D7) is one array per session in the study.  A session
has no size bound (a bot may stay in one session for months), so arrays are
cut into chunks of at most ``chunk_size`` items by position in the session
(``chunk`` 0, 1, ...).  A session shorter than ``chunk_size`` is exactly the
study's single row; a longer one is spread over several groups and tasks.
Each chunk row carries the session totals and the first items of the next
chunk (``next_items``), so n-grams across chunk edges stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import MIN_SESSION_LENGTH, SESSION_GAP_MINUTES
from clickscore.operators._util import bounded_broadcast, join_on_keys, materialize
from clickscore.operators.base import KEYS, USER

TS = "browsertimestamp"
ORDER = [TS, "event_id", "datetimeresponded"]
RUN_ROWS = 1_000_000         # most events of a user that one task scans, about
CHUNK_ITEMS = 100_000        # most items in one sequence array
MAX_GRAM = 5                 # longest n-gram that may cross a chunk edge; a parameter of the table


def _gap_key(gap_mode: str):
    if gap_mode == "boundary":        # DATEDIFF(minute): minute boundaries crossed
        return X.minute_index(TS)
    if gap_mode == "elapsed":         # whole elapsed minutes
        return X.epoch_micros(TS)
    raise ValueError("gap_mode must be 'boundary' or 'elapsed'")


def _is_gap(key, prev, gap_minutes: int, gap_mode: str):
    if gap_mode == "boundary":
        return (key - prev) > gap_minutes
    return F.floor((key - prev) / F.lit(60_000_000)) > gap_minutes


def _scan(e: DataFrame, part: list[str], order: list[str], gap_minutes: int, gap_mode: str) -> DataFrame:
    """Starts strictly inside ``part``, their running count, row number, and row number of the latest one."""
    w = Window.partitionBy(*part).orderBy(*[F.col(c) for c in order])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.lag("_k").over(w)
    inner = F.when(prev.isNotNull() & _is_gap(F.col("_k"), prev, gap_minutes, gap_mode), 1).otherwise(0)
    e = e.withColumn("_inner", inner)          # one sort serves all of these windows
    e = e.withColumn("_cum", F.sum("_inner").over(run)).withColumn("_rn", F.row_number().over(w))
    return e.withColumn("_ls", F.max(F.when(F.col("_inner") == 1, F.col("_rn"))).over(run))


def cut_runs(events: DataFrame, parts: int, user: str, order: list[str]) -> DataFrame:
    """``events`` with ``_run``: about ``parts`` even pieces of the order (user, order).  To be stored: only
    then is a row's number the same for everybody who reads it."""
    return events.repartitionByRange(parts, user, *order).withColumn("_run", F.spark_partition_id())


def _carried(runs: DataFrame, gap_minutes: int, gap_mode: str, user: str) -> DataFrame:
    """Per run of a user: rows before it (``_off``), number of the session that its first row is in
    (``_base``), and where that session started (``_from``, a position in the user's timeline)."""
    s = runs.groupBy(user, "_run").agg(
        F.min("_k").alias("_first"), F.max("_k").alias("_last"), F.sum("_inner").alias("_nin"), F.count(F.lit(1)).alias("_cnt"),
        F.max(F.when(F.col("_inner") == 1, F.col("_rn"))).alias("_lir"))
    wu = Window.partitionBy(user).orderBy("_run")
    before = wu.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_plast", F.lag("_last").over(wu))
    s = s.withColumn("_f1", F.when(F.col("_plast").isNull() | _is_gap(F.col("_first"), F.col("_plast"), gap_minutes, gap_mode), 1).otherwise(0))
    s = s.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    own = F.when(F.col("_f1") == 1, F.col("_off") + 1)
    s = s.withColumn("_latest", F.coalesce(F.col("_off") + F.col("_lir"), own))
    return s.select(user, "_run", "_off", (F.coalesce(F.sum(F.col("_f1") + F.col("_nin")).over(before), F.lit(0)) + F.col("_f1")).alias("_base"),
                    F.coalesce(own, F.last("_latest", ignorenulls=True).over(before)).alias("_from"))


def assign_sessions(events: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES,
                    gap_mode: str = "boundary", run_rows: int = RUN_ROWS,
                    user: str = USER, order: list[str] | None = None) -> DataFrame:
    """Add ``session_num`` (1-based, per user) and ``session_pos`` (1-based
    position of the row in its user session, over all of the user's rows)."""
    order = order or ORDER
    e = events.withColumn("_k", _gap_key(gap_mode))
    made = lambda num, pos: (num.cast("long").alias("session_num"), pos.cast("long").alias("session_pos"))
    # one pass over the user column: at most events / run_rows users are large
    large = materialize(events.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > run_rows))
    users, rows = large.agg(F.count(user), F.sum("_n")).first()
    local = lambda df: df.select(*events.columns, *made(F.col("_cum") + 1, F.col("_rn") - F.coalesce("_ls", F.lit(1)) + 1))
    if not users:
        return local(_scan(e, [user], order, gap_minutes, gap_mode))
    names = bounded_broadcast(large.select(user), known_rows=users)
    parts = -(-rows // run_rows)
    cut = materialize(cut_runs(e.join(names, user, "left_semi").select(e.columns), parts, user, order))
    runs = materialize(_scan(cut, [user, "_run"], order, gap_minutes, gap_mode))
    carried = bounded_broadcast(_carried(runs, gap_minutes, gap_mode, user), known_rows=2 * parts + users)
    at = F.col("_off") + F.col("_rn") - F.coalesce(F.col("_off") + F.col("_ls"), F.col("_from")) + 1
    joined = runs.join(carried, [user, "_run"]).select(*events.columns, *made(F.col("_base") + F.col("_cum"), at))
    rest = e.join(names, user, "left_anti").select(e.columns)
    return local(_scan(rest, [user], order, gap_minutes, gap_mode)).union(joined)


def session_stats(sessioned: DataFrame, min_length: int = MIN_SESSION_LENGTH) -> DataFrame:
    """Per session: start, end, length (no array; partial-aggregated, skew-safe)."""
    return (sessioned.groupBy(*KEYS, "session_num")
            .agg(F.min(TS).alias("session_start"), F.max(TS).alias("session_end"),
                 F.count(F.lit(1)).alias("session_length"))
            .filter(F.col("session_length") >= min_length))


def session_sequences(sessioned: DataFrame, value: str = "feature_name", out: str = "feature_sequence",
                      min_length: int = MIN_SESSION_LENGTH, chunk_size: int = CHUNK_ITEMS,
                      max_n: int = MAX_GRAM) -> DataFrame:
    """The gold sequence table, one ordered array per session chunk (sessions of length >= 2).

    Groups are (session, chunk) with at most ``chunk_size`` items each.  The
    chunk table is stored once (a reliable checkpoint).  A session that lies
    in its user session's first chunk is already whole: its totals are its
    own row's.  Only sessions with a later chunk get their totals and
    ``next_items`` (the next ``max_n - 1`` items, for n-grams across chunk edges)
    from other chunks; no array moves after the chunk table.
    """
    tail = max_n - 1
    if chunk_size < tail:
        raise ValueError(f"chunk_size must be >= {tail}")
    G = KEYS + ["session_num"]
    item = F.struct(F.col("session_pos"), F.col(value).alias("_v"))
    chunks = (sessioned.groupBy(*G, F.floor((F.col("session_pos") - 1) / F.lit(chunk_size)).alias("chunk"))
              .agg(F.min(TS).alias("session_start"), F.max(TS).alias("session_end"), F.count(F.lit(1)).alias("session_length"),
                   F.array_sort(F.collect_list(item)).getField("_v").alias(out)))
    chunks = materialize(chunks)
    late = chunks.filter(F.col("chunk") > 0).select(*G).distinct()
    # totals and next items come from a narrow table: arrays are never in a window.  A session with a
    # later chunk has a chunk per ``chunk_size`` items, so the table has few rows and is broadcast
    narrow = chunks.select(*G, "chunk", "session_start", "session_end", "session_length", F.slice(out, 1, tail).alias("_head"))
    ws = Window.partitionBy(*G)
    wn = ws.orderBy("chunk").rowsBetween(1, tail)
    totals = join_on_keys(narrow, bounded_broadcast(late).withColumn("_late", F.lit(True)), G).select(
        *G, "chunk", F.min("session_start").over(ws).alias("_start"), F.max("session_end").over(ws).alias("_end"),
        F.sum("session_length").over(ws).alias("_length"),
        F.slice(F.flatten(F.collect_list("_head").over(wn)), 1, tail).alias("_next"))
    both = join_on_keys(chunks, bounded_broadcast(materialize(totals)), [*G, "chunk"], "left")
    empty = F.array().cast(chunks.schema[out].dataType)
    rows = both.select(*G, F.coalesce("_start", "session_start").alias("session_start"), F.coalesce("_end", "session_end").alias("session_end"),
                       F.coalesce("_length", "session_length").alias("session_length"), "chunk", out, F.coalesce("_next", empty).alias("next_items"))
    return rows.filter(F.col("session_length") >= min_length).withColumn("seq_length", F.size(out))


def session_rows(seqs: DataFrame) -> DataFrame:
    """One row per session with the session totals, whichever chunks it has.

    An answer whose window opens late in a long user session has no chunk 0,
    so the row is an aggregate over the session's chunks, not its first one.
    """
    return seqs.groupBy(*KEYS, "session_num").agg(
        *[F.min(c).alias(c) for c in ("session_start", "session_end", "session_length")])


def build_sessions(base90: DataFrame, value: str = "feature_name", gap_minutes: int = SESSION_GAP_MINUTES,
                   gap_mode: str = "boundary", run_rows: int = RUN_ROWS,
                   chunk_size: int = CHUNK_ITEMS, max_n: int = MAX_GRAM) -> DataFrame:
    out = "feature_sequence" if value == "feature_name" else "group_sequence"
    s = assign_sessions(base90.select(*KEYS, "datetimeresponded", "event_id", TS, value),
                        gap_minutes, gap_mode, run_rows)
    return session_sequences(s, value, out, chunk_size=chunk_size, max_n=max_n)


def session_check(sessions: DataFrame) -> DataFrame:
    """Sessions and mean length per category."""
    return session_rows(sessions).groupBy("nps_category").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.round(F.avg("session_length"), 1).alias("avg_len"))
