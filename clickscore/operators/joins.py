"""Joins of the event log with answers that are too many to broadcast.

Two reductions make the shuffle join bearable.  A Bloom filter of the answering
users is applied where the events are read, so events of other users never reach
the exchange.  What is left meets the answers on (user, time bin): an event is in
one bin, an answer in the few bins that its look-back window touches, and the
exact range is checked on top.  So a user's events are spread over bins, and an
answer is copied a few times instead of once per salt.  Skewed (user, bin) keys
are split by AQE, which an inner join allows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 5
BITS_PER_KEY = 12            # about one false positive in 300
MAX_BITS = 1 << 28           # 32 MB; with more keys the filter lets more pass, never fewer
BINS_PER_WINDOW = 6


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, column: str, n: int) -> tuple[DataFrame, int]:
    """One row with the filter's ``words`` (array<bigint>) for about ``n`` keys, and its number of bits."""
    bits = min(MAX_BITS, 1 << max(10, math.ceil(math.log2(max(1, n) * BITS_PER_KEY))))
    at = keys.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_positions(F.col(column), bits))).alias("p"))
    held = at.groupBy(F.floor(F.col("p") / 64).alias("id")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("w"))
    every = keys.sparkSession.range(bits // 64).join(held, "id", "left")
    words = F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))).getField("w")
    return every.agg(words.alias("words")), bits


def might_hold(bloom: tuple[DataFrame, int], key: Column) -> Column:
    """False only for keys that the filter was not made of.  The filter is a scalar subquery: made once, then a constant."""
    words, bits = bloom[0].scalar(), bloom[1]
    return reduce(lambda a, b: a & b, [F.bit_get(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
                                       for p in _positions(key, bits)])


def _bin(ts: Column, width: int) -> Column:
    return F.floor(F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) / width)


def join_in_window(events: DataFrame, answers: DataFrame, window_days: int, n: int, user: str, visitor: str = "visitorid",
                   ts: str = "browsertimestamp", answered: str = "datetimeresponded") -> DataFrame:
    """Inner join of events and ``n`` answers of the same user, with the event in [answer - window, answer]."""
    width = max(1, math.ceil(window_days / BINS_PER_WINDOW))
    start = F.timestamp_add("DAY", F.lit(-window_days), F.col(answered))
    bins = answers.filter(F.col(answered).isNotNull()).withColumn(
        "_bin", F.explode(F.sequence(_bin(start, width), _bin(F.col(answered), width))))
    e = events.filter(might_hold(bloom_filter(answers, user, n), F.col(visitor))).withColumn("_at", _bin(F.col(ts), width))
    cond = ((e[visitor] == bins[user]) & (e["_at"] == bins["_bin"])
            & (e[ts] >= F.timestamp_add("DAY", F.lit(-window_days), bins[answered])) & (e[ts] <= bins[answered]))
    return e.join(bins, cond, "inner").drop("_bin", "_at")


def join_users(events: DataFrame, answers: DataFrame, n: int, user: str, visitor: str = "visitorid") -> DataFrame:
    """Inner join of events and ``n`` answers of the same user, whatever the time."""
    e = events.filter(might_hold(bloom_filter(answers, user, n), F.col(visitor)))
    return e.join(answers, e[visitor] == answers[user], "inner")
