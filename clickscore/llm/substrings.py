"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ``GRAM``-word hashes inside every ``length``
words the smallest is kept, so two documents that share ``length`` words share
an anchor.  Documents are joined on their anchors; an anchor that several
documents have is extended both ways, word by word, over every span of
``length`` words that contains it.  All documents that hold the same extension
are compared at once, through its 128-bit hash and the smallest doc_id that has
it, not pair by pair: a passage in a third of all documents costs a row per
document and extension.  Overlapping matches join to maximal repeats.

Defined results
---------------
* Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  NULL text: no word.
* A word goes if a span of ``length`` words over it also starts in a document with
  a smaller id; spans are judged on the input.  Repeats inside one document and
  between rows of one id stay.
* Ids are numbers (cast to bigint); a text id that is none is a cast error.
* NULL id: nothing is removed, and the row removes nothing elsewhere.
* Repeated rows: each row gets its result.
* Fewer than ``length`` words: nothing is removed.  Empty table: no row.
* Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import Grams, WordIds, add_columns, ascii_space_words, slices, stored

LENGTH = 50              # words of the shortest repeat
GRAM = 16                # words of an anchor
ROWS_OUT = 1 << 18       # rows of a batch of extensions


class Spans:
    """Anchors and extensions of one document."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.words, self.seed, self.left, self.right = WordIds(), Grams(1), Grams(2), Grams(3)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return self.words.of(words)

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors."""
        g = self.seed.spans(self.seed.prefix(ids), self.gram)
        view = np.lib.stride_tricks.sliding_window_view(g, self.length - self.gram + 1)
        at = np.unique(view.argmin(1) + np.arange(len(view)))
        return at, g[at].view(np.int64)

    def extensions(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes (as two numbers) of all spans of ``length`` words."""
        return (self.left.spans(self.left.prefix(ids), self.length).view(np.int64),
                self.right.spans(self.right.prefix(ids), self.length).view(np.int64))

    def reach(self, ids: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """First word of every span of ``length`` words that contains a shared anchor."""
        at, h = self.anchors(ids)
        at = at[np.isin(h, shared)]
        edge = np.zeros(len(ids) - self.length + 2, np.int64)
        np.add.at(edge, np.maximum(at - (self.length - self.gram), 0), 1)
        np.add.at(edge, np.minimum(at + 1, len(edge) - 1), -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _profile(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, digest, n_words, kept_sha256 of the whole text, anchors) of every row."""
    def work(texts):
        s, n, sha, anchors = Spans(length, gram), [], [], []
        for t in texts:
            words = ascii_space_words(t)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            anchors.append(np.unique(s.anchors(s.ids(words))[1]) if len(words) >= length else np.zeros(0, np.int64))
        return [n, sha, anchors]

    return add_columns(docs, ["text"], ["n_words", "sha", "anchors"], ["bigint", "string", "array<bigint>"], work, ["text"])


def _extended(candidates: DataFrame, length: int, gram: int) -> DataFrame:
    """(x1, x2, doc_id, row, at): each distinct extension of a document's shared anchors."""
    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held, rows = Spans(length, gram), [], 0
        for b in slices(it):
            for doc, row, text, shared in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text", "shared"))):
                ids = s.ids(ascii_space_words(text))
                x1, x2 = s.extensions(ids)
                at = s.reach(ids, np.array(shared, np.int64))
                at = at[np.unique(x1[at], return_index=True)[1]]
                held.append((x1[at], x2[at], np.full(len(at), doc), np.full(len(at), row), at))
                rows += len(at)
                if rows >= ROWS_OUT:
                    yield _batch(held)
                    held, rows = [], 0
        if held:
            yield _batch(held)

    return candidates.select("doc_id", "row", "text", "shared").mapInArrow(work, "x1 bigint, x2 bigint, doc_id bigint, row bigint, at bigint")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*held)], names=["x1", "x2", "doc_id", "row", "at"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept
    words, joined by a space) and ``spans`` (array<struct<start, end>>: the removed words)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    profile = stored(_profile(rows, length, gram))

    # a document with the words of a smaller id repeats it from end to end, and whatever it
    # shares with others the smaller one shares too, so it needs no anchors
    firsts = profile.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length)).groupBy("sha").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sha", "first")
    copies = stored(profile.select("doc_id", "digest", "sha").join(firsts, "sha").where("first < doc_id").select(
        "doc_id", "digest", F.lit(True).alias("copy")).distinct())

    seeds = profile.where("doc_id is not null").join(copies, ["doc_id", "digest"], "left_anti")
    seeds = seeds.select("doc_id", "digest", F.explode("anchors").alias("h"))
    several = seeds.groupBy("h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h")
    shared = stored(seeds.join(several, "h").groupBy("doc_id", "digest").agg(F.collect_set("h").alias("shared")))
    # the row number is fixed by storing it
    candidates = stored(rows.join(shared, ["doc_id", "digest"]).withColumn("row", F.monotonically_increasing_id()))

    spans = _extended(candidates, length, gram)
    first = spans.groupBy("x1", "x2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    hits = spans.join(first.select("x1", "x2", "first"), ["x1", "x2"]).where("first < doc_id")
    hits = hits.groupBy("row").agg(F.collect_list(F.col("at").cast("int")).alias("at"))

    def cut(texts, starts):
        s, gone, sha, spans_out = Spans(length, gram), [], [], []
        for t, at in zip(texts, starts):
            words = ascii_space_words(t)
            x1, _ = s.extensions(s.ids(words))
            at = np.flatnonzero(np.isin(x1, x1[np.array(at, int)]))      # equal spans of one document were sent once
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            out = np.cumsum(edge)[:-1] > 0
            turn = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            gone.append(int(out.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, o in zip(words, out.tolist()) if not o)).hexdigest())
            spans_out.append([{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)])
        return [gone, sha, spans_out]

    box = "array<struct<start:int,end:int>>"
    removed = add_columns(candidates.select("doc_id", "digest", "row", "text").join(hits, "row"), ["text", "at"],
                          ["n_removed", "kept", "spans"], ["bigint", "string", box], cut, ["text", "at", "row"])
    removed = removed.dropDuplicates(["doc_id", "digest"])               # rows of one id and text are equal
    out = profile.drop("anchors").join(removed, ["doc_id", "digest"], "left").join(copies, ["doc_id", "digest"], "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(box)
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", F.array().cast(box))).alias("spans"))
