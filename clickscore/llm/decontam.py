"""Benchmark decontamination by winnowing, in DataFrame operations only.

A benchmark window is ``WINDOW`` consecutive item words (a shorter item is one
window).  Of the ``GRAM``-word hashes inside every ``WINDOW`` words the smallest
is a fingerprint, so a document and an item that share a window share a
fingerprint.  Fingerprints of documents and items are joined; a hit is extended
over every window that contains it, and an extended window counts if all its
words are those of an item's window.  For items of ``m`` words the
same holds with grams of ``m`` words and one gram a window: every gram is a
fingerprint.

The benchmark's fingerprints and windows are broadcast only if they are few
(``MAX_BROADCAST`` windows); otherwise the fingerprints are joined by a shuffle
and the hits meet their documents again by key.

Defined results
---------------
* Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.
* NULL or empty text: no word, not contaminated.  A NULL id is kept.
* An item without a word is nothing; repeated items count once; items without an
  id mark words but are neither counted nor listed.
* Repeated rows: equal rows get equal results, one result per row.
* Empty benchmark: nothing is hit.  Extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import let

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5
MAX_BROADCAST = 200_000      # windows of at most WINDOW words each


_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words ``WORD`` of the text with A-Z lower-cased: one translation makes every separator a
    space and every capital small, and a split at single spaces is many times faster than
    extracting by a pattern."""
    plain = F.translate(F.coalesce(text, F.lit("")), _SEPARATORS + string.ascii_uppercase, " " * len(_SEPARATORS) + string.ascii_lowercase)
    return F.array_remove(F.split(plain, " "), "")


def _span(w: Column, start: Column, n: int | Column) -> Column:
    return F.slice(w, start + 1, F.lit(n) if isinstance(n, int) else n)


def _mark(w: Column, gram: int, per_window: int, length: int) -> Column:
    """array<struct<len, pos, fp>>: the grams that are smallest in some window of ``per_window`` grams."""
    def marks(at, h):
        return F.transform(at, lambda i: F.struct(F.lit(length).alias("len"), i.alias("pos"), F.get(h, i).alias("fp")))

    def smallest(h):
        every = F.sequence(F.lit(0), F.size(h) - 1)
        if per_window == 1:
            return marks(every, h)
        # least and greatest skip the NULLs that get() gives outside an array
        mins = F.transform(F.sequence(F.lit(0), F.size(h) - per_window), lambda i: F.least(*[F.get(h, i + k) for k in range(per_window)]))
        # a gram is the smallest of a window if it equals the largest minimum of the windows over it
        return let(mins, lambda m: marks(F.filter(every, lambda i: F.get(h, i) == F.greatest(
            *[F.get(m, i - k) for k in range(per_window)])), h))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(gram)]))
    return F.when(F.size(w) >= gram + per_window - 1, let(grams, smallest)).otherwise(F.array()).cast(
        "array<struct<len:int,pos:int,fp:bigint>>")


def fingerprints(w: Column, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> Column:
    """Fingerprints for full windows and for items of the given shorter ``lengths``."""
    return F.flatten(F.array(_mark(w, gram, window - gram + 1, window), *[_mark(w, m, 1, m) for m in lengths]))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``words``, ``len`` and the sorted ids (as strings) of their items."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    full = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: _span(F.col("w"), i, window))
    each = items.select("item", F.explode(F.when(F.size("w") >= window, full).when(F.size("w") > 0, F.array("w"))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("words"))


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, gram: int = GRAM, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``digest`` (md5 of the text), ``n_words``,
    ``hits`` (array<struct<start, end>> in words) and ``items`` (sorted ids)."""
    wins = windows(benchmark, item_id, item_text, window)
    counts = {r["len"]: r["count"] for r in wins.groupBy("len").count().collect()}      # at most ``window`` rows
    short = sorted(n for n in counts if n < window)
    small = sum(counts.values()) <= max_broadcast
    marks = wins.select(F.explode(fingerprints(F.col("words"), short, window, gram)).alias("f"), F.size("words").alias("n"))
    # a window is marked by what it alone selects; a mark of another length than the window's says nothing
    marks = marks.where("f.len = n").select("f.len", "f.fp").distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"),
                       words(F.col(text)).alias("w"))
    prints = fingerprints(F.col("w"), short, window, gram)
    if small:
        return _scan_broadcast(rows, prints, marks, wins, window, gram)
    met = rows.select("doc_id", "digest", F.explode(prints).alias("f")).select("doc_id", "digest", "f.len", "f.pos", "f.fp")
    met = met.join(marks, ["len", "fp"]).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("len", "pos")).alias("met"))
    back = rows.dropDuplicates(["doc_id", "digest"]).alias("r").join(met.alias("m"), _same("r", "m")).select("r.*", "m.met")
    found = back.select("doc_id", "digest", "w", F.explode("met").alias("f")).select("doc_id", "digest", "w", "f.len", "f.pos")
    tried = found.select("doc_id", "digest", F.explode(_extended(window, gram)).alias("t")).select("doc_id", "digest", "t.start", "t.words")
    tried = tried.join(wins.select("words", "items"), "words")
    hit = tried.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(_place())).alias("hits"), F.collect_set("items").alias("items"))
    # every row of the table, hit or not: hits are joined to it, so no key stands for the rows without one
    out = rows.select("doc_id", "digest", F.size("w").alias("n_words")).alias("r").join(hit.alias("m"), _same("r", "m"), "left")
    return out.select("r.doc_id", "r.digest", "n_words", F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
                      _ids(F.coalesce("items", F.array().cast("array<array<string>>"))).alias("items"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))


def _place() -> Column:
    return F.struct("start", (F.col("start") + F.size("words")).alias("end"))


def _ids(items: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(items)))


def _extended(window: int, gram: int) -> Column:
    """Of a fingerprint (``len``, ``pos``) in ``w``: every window that holds it, as far as the document goes."""
    around = F.transform(
        F.sequence(F.greatest(F.col("pos") - (window - gram), F.lit(0)), F.least(F.col("pos"), F.size("w") - window)),
        lambda s: F.struct(s.alias("start"), _span(F.col("w"), s, window).alias("words")))
    alone = F.array(F.struct(F.col("pos").alias("start"), F.when(F.col("len") > 0, _span(F.col("w"), F.col("pos"), F.col("len")))
                             .otherwise(F.array().cast("array<string>")).alias("words")))
    return F.when(F.col("len") == window, around).otherwise(alone)


def _scan_broadcast(rows: DataFrame, prints: Column, marks: DataFrame, wins: DataFrame, window: int, gram: int) -> DataFrame:
    """``scan`` with the benchmark's marks and windows in every task, so that texts stay where they are read.
    A row numbers itself and carries a mark of length 0 that always joins; only short rows are grouped by the number."""
    none = rows.sparkSession.range(1)
    marks = F.broadcast(marks.union(none.select(F.lit(0), F.lit(0).cast("bigint"))))
    wins = F.broadcast(wins.select("words", "items").union(none.select(F.array().cast("array<string>"), F.lit(None).cast("array<string>"))))
    mark0 = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("fp")))
    # explode_outer: for a plain explode the optimizer filters on the array's size
    # first and so evaluates the whole expression a second time
    keep = ("row", "doc_id", "digest")
    found = rows.withColumn("row", F.monotonically_increasing_id()).select(*keep, "w", F.explode_outer(F.concat(mark0, prints)).alias("f"))
    found = found.select(*keep, "w", "f.len", "f.pos", "f.fp").join(marks, ["len", "fp"])
    tried = found.select(*keep, F.size("w").alias("n_words"), F.explode_outer(_extended(window, gram)).alias("t"))
    tried = tried.select(*keep, "n_words", "t.start", "t.words").join(wins, "words")
    per_row = tried.groupBy(*keep).agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(
        F.when(F.col("start") >= 0, _place()))).alias("hits"), F.collect_set("items").alias("items"))
    return per_row.select("doc_id", "digest", "n_words", "hits", _ids(F.col("items")).alias("items"))


def covered(hits: Column) -> Column:
    """Number of words in the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(hits, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["end"]).alias("end")), lambda a: a["n"])
