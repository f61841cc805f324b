"""Sessionisation and n-grams against brute force on hand-made and random
fixtures, with tiny runs and pieces so sessions cross many of their edges."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickscore.operators import ngrams as N
from clickscore.operators import sessions as S

SCHEMA = ("userhasheduuid long, nps_score int, nps_category string, datetimeresponded timestamp_ntz, "
          "event_id long, browsertimestamp timestamp_ntz, feature_name string")
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _minute_index(ts: dt.datetime) -> int:
    return int((ts - dt.datetime(1970, 1, 1)).total_seconds() // 60)


def brute_sessions(rows, gap, mode):
    by_user = {}
    for r in rows:
        by_user.setdefault(r[0], []).append(r)
    out = {}
    for u, rs in by_user.items():
        rs = sorted(rs, key=lambda r: (r[5], r[4], r[3]))
        num, prev = 0, None
        for r in rs:
            ts = r[5]
            if prev is None:
                num += 1
            elif mode == "boundary" and _minute_index(ts) - _minute_index(prev) > gap:
                num += 1
            elif mode == "elapsed" and int((ts - prev).total_seconds() * 1_000_000) // 60_000_000 > gap:
                num += 1
            prev = ts
            out[(r[0], r[3], r[4])] = num
    return out


def brute_ngrams(rows, sessions, n):
    groups = {}
    for r in rows:
        key = (r[0], r[1], r[2], sessions[(r[0], r[3], r[4])])
        groups.setdefault(key, []).append(r)
    c = Counter()
    for key, rs in groups.items():
        rs = sorted(rs, key=lambda r: (r[5], r[4], r[3]))
        seq = [r[6] for r in rs]
        for i in range(len(seq) - n + 1):
            c[(key[2],) + tuple(seq[i:i + n])] += 1
    return c


def random_rows(seed: int, users: int = 6, per_user: int = 40, partial_dup: bool = False):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for u in range(users):
        answers = [(rnd.choice([None, 3, 7, 9]), T0 + dt.timedelta(days=3))]
        if u % 2 == 0:      # a second answer duplicates every event of the user
            answers.append((rnd.choice([2, 8, 10]), T0 + dt.timedelta(days=4)))
        t = T0
        for _ in range(per_user):
            t = t + dt.timedelta(seconds=rnd.choice([0, 5, 59, 61, 170, 181, 400, 1000, 4000]))
            eid += 1
            name = rnd.choice(["a", "b", "c", "d"])
            for j, (score, resp) in enumerate(answers):
                if partial_dup and j == 1 and rnd.random() < 0.6:
                    continue        # the second answer sees only some of the user's events
                cat = "detractor" if score is not None and score <= 6 else (
                    "passive" if score is not None and score <= 8 else "promoter")
                rows.append((u, score, cat, resp, eid, t, name))
    return rows


@pytest.mark.parametrize("seed,gap,mode,run_rows", [(1, 3, "boundary", 5), (2, 3, "elapsed", 5),
                                                     (3, 10, "boundary", 7), (4, 1, "boundary", 60),
                                                     (5, 30, "boundary", 1000)])
def test_runs_equal_single_scan(spark, seed, gap, mode, run_rows):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r[0], r[1], r[2]): r[3] for r in S.assign_sessions(df, gap, mode, run_rows)
           .select("userhasheduuid", "datetimeresponded", "event_id", "session_num").collect()}
    assert got == brute_sessions(rows, gap, mode)


@pytest.mark.parametrize("n,piece", [(2, 1), (3, 2), (3, 3), (2, 60), (5, 4)])
def test_event_ngrams_equal_brute_force(spark, n, piece):
    rows = random_rows(10 + n + piece, partial_dup=piece % 2 == 0)
    df = spark.createDataFrame(rows, SCHEMA)
    sess = S.assign_sessions(df, 3, "boundary", 20)
    names = N.NAMES[:n]
    got = Counter({tuple(r[:n + 1]): r[n + 1] for r in
                   N.ngram_counts(N.ngrams_from_events(sess, n, piece_rows=piece), n)
                   .select("nps_category", *names, "n").collect()})
    expect = brute_ngrams(rows, brute_sessions(rows, 3, "boundary"), n)
    assert got == expect
    # the array path gives the same counts (sessions of every length, min_length=1)
    seqs = S.session_sequences(sess, min_length=1)
    got2 = Counter({tuple(r[:n + 1]): r[n + 1] for r in
                    N.ngram_counts(N.ngrams_from_sequences(seqs, n), n).select("nps_category", *names, "n").collect()})
    assert got2 == expect


def brute_positions(rows, sessions):
    """Position of each row in its user session, counting all of the user's rows."""
    by_user = {}
    for r in rows:
        by_user.setdefault(r[0], []).append(r)
    out = {}
    for rs in by_user.values():
        rs = sorted(rs, key=lambda r: (r[5], r[4], r[3]))
        cur, pos = None, 0
        for r in rs:
            num = sessions[(r[0], r[3], r[4])]
            pos = pos + 1 if num == cur else 1
            cur = num
            out[(r[0], r[3], r[4])] = pos
    return out


@pytest.mark.parametrize("seed,chunk,run_rows,n", [(21, 4, 5, 5), (22, 5, 13, 3), (23, 4, 1000, 4), (24, 7, 30, 2)])
def test_chunked_sequences_equal_brute_force(spark, seed, chunk, run_rows, n):
    rows = random_rows(seed, partial_dup=True)
    df = spark.createDataFrame(rows, SCHEMA)
    sess = S.assign_sessions(df, 3, "boundary", run_rows)
    brute = brute_sessions(rows, 3, "boundary")
    got_pos = {(r[0], r[1], r[2]): r[3] for r in
               sess.select("userhasheduuid", "datetimeresponded", "event_id", "session_pos").collect()}
    assert got_pos == brute_positions(rows, brute)

    seqs = S.session_sequences(sess, min_length=1, chunk_size=chunk)
    got = {}
    for r in seqs.collect():
        assert 1 <= len(r["feature_sequence"]) <= chunk
        got.setdefault((r[0], r[1], r[2], r["session_num"]), []).append((r["chunk"], r["feature_sequence"]))
    expect = {}
    for r in sorted(rows, key=lambda r: (r[5], r[4], r[3])):
        expect.setdefault((r[0], r[1], r[2], brute[(r[0], r[3], r[4])]), []).append(r[6])
    whole = {k: [x for _, part in sorted(v) for x in part] for k, v in got.items()}
    assert whole == expect
    assert max(len(v) for v in got.values()) > 1          # some sessions really are split
    names = N.NAMES[:n]
    got_ng = Counter({tuple(r[:n + 1]): r[n + 1] for r in
                      N.ngram_counts(N.ngrams_from_sequences(seqs, n), n).select("nps_category", *names, "n")
                      .collect()})
    assert got_ng == brute_ngrams(rows, brute, n)


def test_gap_boundary_vs_elapsed(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 59)
    rows = [(1, 3, "detractor", T0, 1, base, "a"),
            (1, 3, "detractor", T0, 2, dt.datetime(2024, 1, 1, 0, 31, 0), "b"),     # 31 boundaries, 30m01s
            (2, 3, "detractor", T0, 3, base, "a"),
            (2, 3, "detractor", T0, 4, dt.datetime(2024, 1, 1, 0, 30, 59), "b")]    # 30 boundaries, 30m
    df = spark.createDataFrame(rows, SCHEMA)
    b = {r[0]: r[1] for r in S.assign_sessions(df, 30, "boundary").select("event_id", "session_num").collect()}
    e = {r[0]: r[1] for r in S.assign_sessions(df, 30, "elapsed").select("event_id", "session_num").collect()}
    assert b == {1: 1, 2: 2, 3: 1, 4: 1}
    assert e == {1: 1, 2: 1, 3: 1, 4: 1}


def test_equal_timestamps_and_single_event_user(spark):
    rows = [(1, 9, "promoter", T0, 5, T0, "x"), (1, 9, "promoter", T0, 4, T0, "y"),
            (2, 9, "promoter", T0, 6, T0, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    seqs = S.session_sequences(S.assign_sessions(df, 30))
    out = {r["userhasheduuid"]: r["feature_sequence"] for r in seqs.collect()}
    assert out == {1: ["y", "x"]}          # tie broken by event_id; the 1-event user is dropped (length < 2)


def test_ngram_lengths_and_self_loops(spark):
    seqs = spark.createDataFrame(
        [("detractor", ["a"]), ("detractor", ["a", "a"]), ("promoter", ["a", "b", "a"])],
        "nps_category string, feature_sequence array<string>")
    bi = {tuple(r[:3]): r[3] for r in N.ngram_counts(N.ngrams_from_sequences(seqs, 2), 2).collect()}
    tri = {tuple(r[:4]): r[4] for r in N.ngram_counts(N.ngrams_from_sequences(seqs, 3), 3).collect()}
    assert bi == {("detractor", "a", "a"): 1, ("promoter", "a", "b"): 1, ("promoter", "b", "a"): 1}
    assert tri == {("promoter", "a", "b", "a"): 1}
    tm = N.transition_matrix(N.ngram_counts(N.ngrams_from_sequences(seqs, 2), 2))
    d = {(r["nps_category"], r["from_item"], r["to_item"]): r["prob"] for r in tm.collect()}
    assert d[("detractor", "a", "a")] == 1.0
    assert d[("promoter", "a", "b")] == 1.0 and d[("promoter", "a", "a")] == 0.0


def test_distinctive_floor_for_missing_side(spark):
    counts = spark.createDataFrame([("promoter", "a", "b", 2), ("promoter", "b", "c", 2), ("detractor", "b", "c", 4)],
                                   "nps_category string, a string, b string, n long")
    d = {r["ngram"]: (r["freq_prom"], r["freq_detr"], r["ratio"]) for r in N.distinctive(counts).collect()}
    assert d["a -> b"] == (0.5, 1e-6, 0.5 / 1e-6)
    assert d["b -> c"] == (0.5, 1.0, 0.5)


def test_session_invariants_sf001(spark):
    from clickscore.plans import context as C
    ev = C.sessioned_events(spark, "/root/testdata/sf0.01", gap=360)
    n_events = ev.count()
    per = ev.groupBy("userhasheduuid", "nps_score", "nps_category", "session_num").count()
    assert per.agg(F.sum("count")).first()[0] == n_events
    seqs = S.session_sequences(ev, min_length=1)
    bi_total = N.ngrams_from_sequences(seqs, 2).count()
    assert bi_total == seqs.agg(F.sum(F.col("seq_length") - 1)).first()[0]


def test_session_keys_ignore_session_time_zone(spark):
    """NTZ wall-clock minutes: a non-UTC session zone with a DST jump between
    two events must not change the gap (01:59:30 -> 03:00:10 is 61 minute
    boundaries and 60m40s elapsed on the wall clock)."""
    rows = [(1, 3, "detractor", T0, 1, dt.datetime(2024, 3, 10, 1, 59, 30), "a"),
            (1, 3, "detractor", T0, 2, dt.datetime(2024, 3, 10, 3, 0, 10), "b")]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        b = {r[0]: r[1] for r in S.assign_sessions(df, 30).select("event_id", "session_num").collect()}
        e = {r[0]: r[1] for r in S.assign_sessions(df, 59, "elapsed").select("event_id", "session_num").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert b == {1: 1, 2: 2}      # 61 boundaries > 30
    assert e == {1: 1, 2: 2}      # 60 whole wall-clock minutes > 59 (a zoned diff would see 0)


def test_answer_that_starts_after_the_first_chunk(spark):
    """Answer 2 has only the last events of a long user session: it has no chunk 0, but it is a session."""
    first, second = T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2)
    rows = [(1, 9, "promoter", first, i, T0 + dt.timedelta(seconds=10 * i), "abcd"[i % 4]) for i in range(10)]
    rows += [(1, 3, "detractor", second, i, T0 + dt.timedelta(seconds=10 * i), "abcd"[i % 4]) for i in range(6, 10)]
    rows += [(2, 8, "passive", first, 100 + i, T0 + dt.timedelta(seconds=10 * i), "b") for i in range(3)]
    ev = spark.createDataFrame(rows, SCHEMA)
    for chunk in (4, 5, 1000):
        s = S.assign_sessions(ev, 30, run_rows=4)
        got = {(r[0], r["nps_score"]): (r["session_length"], r["session_start"], r["session_end"])
               for r in S.session_rows(S.session_sequences(s, chunk_size=chunk)).collect()}
        want = {(r[0], r["nps_score"]): (r["session_length"], r["session_start"], r["session_end"])
                for r in S.session_stats(s).collect()}
        assert got == want and set(got) == {(1, 9), (1, 3), (2, 8)}
        assert got[1, 9][0] == 10 and got[1, 3][0] == 4


def burst(n: int, same_time: bool):
    """User 1 has ``n`` events within one minute, or at one instant; users 2 to 9 have 40 each."""
    rnd = random.Random(n)
    rows = [(1, 9, "promoter", T0, i, T0 if same_time else T0 + dt.timedelta(microseconds=rnd.randrange(59_000_000)), "abcd"[i % 4]) for i in range(n)]
    return rows + [(u, 3, "detractor", T0, 10 ** 6 * u + i, T0 + dt.timedelta(minutes=17 * i), "xy"[i % 2]) for u in range(2, 10) for i in range(40)]


@pytest.mark.parametrize("same_time", [False, True])
def test_all_events_of_a_user_in_one_minute(spark, same_time):
    rows = burst(20_000, same_time)
    df = spark.createDataFrame(rows, SCHEMA)
    sess = S.assign_sessions(df, 30, run_rows=1_000)
    brute = brute_sessions(rows, 30, "boundary")
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in sess.select(
        "userhasheduuid", "datetimeresponded", "event_id", "session_num", "session_pos").collect()}
    where = brute_positions(rows, brute)
    assert got == {k: (brute[k], where[k]) for k in brute}
    sizes = sorted(c for _, c in S.cut_runs(df.filter("userhasheduuid = 1"), 20, "userhasheduuid", S.ORDER).groupBy("_run").count().collect())
    assert len(sizes) == 20 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_one_session_with_most_events(spark):
    rows = burst(20_000, False)
    sess = S.assign_sessions(spark.createDataFrame(rows, SCHEMA), 30, run_rows=3_000)
    seqs = S.session_sequences(sess, chunk_size=500)
    hot = seqs.filter("userhasheduuid = 1").collect()
    assert len(hot) == 40 and {r["session_length"] for r in hot} == {20_000} and {r["seq_length"] for r in hot} == {500}
    plan = seqs._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan           # arrays stay where the chunk table has them
    expect = brute_ngrams(rows, brute_sessions(rows, 30, "boundary"), 3)
    for grams in (N.ngrams_from_sequences(seqs, 3), N.ngrams_from_events(sess, 3, piece_rows=700)):
        assert Counter({tuple(r[:4]): r[4] for r in N.ngram_counts(grams, 3).select("nps_category", "a", "b", "c", "n").collect()}) == expect


@pytest.mark.parametrize("n,chunk", [(2, 4), (7, 4), (13, 5), (14, 1000), (30, 4)])
def test_grams_of_any_length_equal_brute_force(spark, n, chunk):
    rnd = random.Random(n)
    rows = [(u, 9, "promoter", T0, 1000 * u + i, T0 + dt.timedelta(seconds=i), rnd.choice("ab")) for u in range(4) for i in range(rnd.randrange(20, 90))]
    sess = S.assign_sessions(spark.createDataFrame(rows, SCHEMA), 30, run_rows=17)
    seqs = S.session_sequences(sess, chunk_size=chunk)
    want = brute_ngrams(rows, brute_sessions(rows, 30, "boundary"), n)
    got = N.gram_arrays(seqs, n).groupBy("nps_category", "gram").count().collect()
    assert Counter({(r[0], *r[1]): r[2] for r in got}) == want
    wide = N.ngram_counts(N.ngrams_from_sequences(seqs, n), n)
    assert len(set(wide.columns)) == n + 2 and Counter({tuple(r[:-1]): r[-1] for r in wide.collect()}) == want


@pytest.mark.parametrize("min_count,chunk", [(2, 4), (9, 1000)])
def test_frequent_grams_equal_brute_force(spark, min_count, chunk):
    rows = random_rows(50 + min_count, users=4, per_user=60)
    rows += [(77, 2, "detractor", T0, 10 ** 5 + i, T0 + dt.timedelta(seconds=i), "abc"[i % 3]) for i in range(60)]
    seqs = S.session_sequences(S.assign_sessions(spark.createDataFrame(rows, SCHEMA), 3), chunk_size=chunk, min_length=1)
    got = {(r["nps_category"], *r["gram"]): r["n"] for r in N.frequent_ngrams(seqs, 7, min_count).collect()}
    brute = brute_sessions(rows, 3, "boundary")
    want = {k: c for n in range(2, 8) for k, c in brute_ngrams(rows, brute, n).items() if c >= min_count}
    assert got == want and max(map(len, want)) == 8
    assert N.frequent_ngrams(seqs, 5, 10 ** 6).count() == 0
