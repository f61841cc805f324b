"""Ranked lexical search of many queries at once, by shared partial sums.

Items (the queries) hold common terms, so most of a document's score for one item
is also part of its score for others.  The term sets that items share are mined
first: terms held by the same items are one class, and pairs of neighbouring
classes that several items hold become nodes of their own, again and again, until
no pair is shared.  That gives a DAG whose sinks are the items.  Every document's
accumulator of every node is then computed once, class sums first, then the merged
nodes level by level, and an item's score is the sum of its few top nodes.

Steps: distinct terms per item; one DAG per block of items; one pass over the texts
that keeps, per document, its length and its counts of the items' terms; N, L and
document frequencies from these postings; accumulators and each task's best ``k``
documents of every item; the best ``k`` of those.  Texts are never shuffled, and a
task returns ``k`` rows an item at most, whatever a term's or a copy group's share of
the documents.  Items are a stated query set: they are dealt to blocks of about
``BLOCK_TERMS`` item terms (an item is never split), so a DAG is bounded and every
block meets all documents.

Scores are integers: with N documents of at least one term, L terms in all, n terms
of the document, document frequency df and count tf of a term,
w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L, and the sum over
the item's terms of w * ((10^9 tf) div (1000 tf + 20 m)).

Defined results
---------------
* NULL, empty or term-less text: no document of the collection; such an item has no row.
* Only scores above 0 are ranked; equal scores by ascending ``doc_id``, NULL last.
* Repeated documents are documents of their own, also with equal ids.
* Rows of one ``item_id`` (NULL is one, too) are one item with the terms of all of them.
* Ids of documents are numbers (cast to bigint); item ids are of any type.
* Very long texts are whole.  An empty table on either side: no row.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscore.llm.common import add_columns, slices, stored, temporary
from clickscore.operators._util import bounded_broadcast, top_k_per_group

BLOCK_TERMS = 200_000             # about so many (item, term) rows share a DAG
CELLS = 1 << 21                   # accumulators that a task holds at once
MAX_ITEMS = 1_000_000             # item ids that are broadcast to their results
# every ASCII byte but letters and digits separates terms; A-Z are lower-cased; other bytes stay
_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEEP else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def term_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``block``, ``item`` (its number in the block), ``item_id`` and ``terms`` of every item that has terms."""
    def work(texts):
        return [[sorted({t.decode("utf-8", "surrogatepass") for t in terms_of(x)}) for x in texts]]

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    found = add_columns(rows, ["text"], ["terms"], ["array<string>"], work, ["text"]).select("item_id", F.explode("terms").alias("term"))
    sets = stored(found.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    total = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_TERMS))
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    return stored(dealt.select("block", F.row_number().over(Window.partitionBy("block").orderBy("item_id")).alias("item"), "item_id", "terms"))


def shared_sums(items: list[list[str]]) -> tuple[list[str], list[int], list[list[int]], list[list[int]]]:
    """The DAG of ``items``: terms, the class of each term, the two parts of every merged
    node (nodes are numbered after the classes), and each item's top nodes."""
    holders = defaultdict(list)
    for i, terms in enumerate(items):
        for t in terms:
            holders[t].append(i)
    classes = defaultdict(list)
    for t in sorted(holders):
        classes[tuple(holders[t])].append(t)
    order = sorted(classes.items(), key=lambda c: (-len(c[0]), c[0]))        # widely shared classes first, so they are neighbours
    terms, class_of, nodes = [], [], [[] for _ in items]
    for c, (held_by, members) in enumerate(order):
        terms += members
        class_of += [c] * len(members)
        for i in held_by:
            nodes[i].append(c)
    merged, count = [], len(order)
    while True:
        often = Counter(p for x in nodes for p in zip(x, x[1:]))
        picks, used = [], Counter()
        for x in nodes:
            at, pick = 0, []
            while at < len(x) - 1:
                here, after = often[x[at], x[at + 1]], often[x[at + 1], x[at + 2]] if at + 2 < len(x) else 0
                if here > 1 and here >= after:
                    pick.append(at)
                    used[x[at], x[at + 1]] += 1
                    at += 1
                at += 1
            picks.append(pick)
        number = {}
        for p in sorted(p for p, n in used.items() if n > 1):
            number[p] = count + len(merged)
            merged.append(list(p))
        if not number:
            return terms, class_of, merged, nodes
        for x, pick in zip(nodes, picks):
            for at in reversed(pick):
                new = number.get((x[at], x[at + 1]))
                if new is not None:
                    x[at: at + 2] = [new]


def query_dags(sets: DataFrame) -> DataFrame:
    """One row per block with its DAG, mined in one task per block."""
    def mine(rows: pa.Table) -> pa.Table:
        x = rows.sort_by("item").to_pydict()
        made = [x["block"][0], *shared_sums(x["terms"])]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(made, (
            pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32()))))],
            names=["block", "terms", "class_of", "merged", "nodes"])

    return sets.select("block", "item", "terms").groupBy("block").applyInArrow(
        mine, "block int, terms array<string>, class_of array<int>, merged array<array<int>>, nodes array<array<int>>")


def postings(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """``doc_id``, ``n`` and the counts ``tfs`` of the ``terms`` (by number, ascending) of every document that has a term."""
    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(terms)}
        for b in slices(it):
            ids, ns, where, found, tfs = [], [], [0], [], []
            for i, words in enumerate(map(terms_of, b.column(1).to_pylist())):
                if words:
                    ids.append(i)
                    ns.append(len(words))
                    held = np.fromiter((v for v in map(number.get, words) if v is not None), np.int32)
                    which, tf = np.unique(held, return_counts=True)
                    where.append(where[-1] + len(which))
                    found.append(which)
                    tfs.append(tf)
            flat = lambda x: pa.array(np.concatenate(x or [[]]).astype(np.int32))                       # noqa: E731
            at = pa.array(where, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int32())), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, flat(found)),
                 pa.ListArray.from_arrays(at, flat(tfs))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(over, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Best:
    """The best ``k`` documents of every item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))     # item, score, NULL id, id
        self.low = np.zeros(items, np.int64)                                                # score, NULL and id of the last place
        self.low_null, self.low_id = np.ones(items, bool), np.zeros(items, np.int64)

    def offer(self, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of items (rows) by documents (columns)."""
        low = self.low[:, None]
        before = (~null & (self.low_null[:, None] | (ids < self.low_id[:, None])))
        item, doc = np.nonzero((scores > low) | ((scores == low) & (low > 0) & before))
        if not len(item):
            return
        new = (item, scores[item, doc], null[doc], ids[doc])
        item, score, none, name = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((name, none, -score, item))
        place = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.rows = item, score, none, name = tuple(x[order] for x in (item, score, none, name))
        last = np.searchsorted(item, np.arange(self.items), side="left") + self.k - 1
        full = np.flatnonzero(np.searchsorted(item, np.arange(self.items), side="right") > last)
        self.low[full], self.low_null[full], self.low_id[full] = score[last[full]], none[last[full]], name[last[full]]


def best_documents(held: DataFrame, class_of: list[int], merged: list[list[int]], nodes: list[list[int]], weights: np.ndarray,
                   n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``item``, ``doc_id``, ``score``: the best ``k`` documents of each item in every partition of the postings."""
    classes = max(class_of) + 1
    levels, depth = defaultdict(list), {}
    for at, (x, y) in enumerate(merged, classes):
        depth[at] = 1 + max(depth.get(x, 0), depth.get(y, 0))
        levels[depth[at]].append((at, x, y))
    steps = [np.array(levels[d], np.int64).T for d in sorted(levels)]
    class_of = np.array(class_of, np.int64)
    tops, starts = np.concatenate(nodes).astype(np.int64), np.cumsum([0] + [len(x) for x in nodes[:-1]])
    size = classes + len(merged)
    width = max(16, min(1024, CELLS // (size + len(tops))))

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(nodes), k)
        for b in slices(it, width):
            rows = b.num_rows
            ids, n, terms, tfs = b.columns
            m = np.array([50 + 50 * x * n_docs // n_terms for x in n.to_pylist()], np.int64)
            row = np.repeat(np.arange(rows), np.diff(terms.offsets.to_numpy()))
            term, tf = terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[row]))
            sums = np.zeros((size, rows), np.int64)
            np.add.at(sums.reshape(-1), class_of[term] * rows + row, part)
            for at, x, y in steps:
                sums[at] = sums[x] + sums[y]
            best.offer(np.add.reduceat(sums[tops], starts, axis=0), ids.is_null().to_numpy(zero_copy_only=False),
                       ids.fill_null(0).to_numpy())
        item, score, none, name = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item + 1, pa.int32()), pa.array(name, mask=none), pa.array(score)],
                                         names=["item", "doc_id", "score"])

    return held.mapInArrow(over, "item int, doc_id bigint, score bigint")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text") -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of every item."""
    spark = docs.sparkSession
    with temporary():
        sets = term_sets(items, item_id, item_text)
        dags = stored(query_dags(sets))
        found = spark.createDataFrame([], "block int, item int, doc_id bigint, score bigint")
        for (block,) in sorted(dags.select("block").collect()):
            dag = dags.where(F.col("block") == block).first()
            held = stored(postings(docs, doc_id, text, dag.terms))
            n_docs, n_terms = held.agg(F.count("*"), F.sum("n")).first()
            if not n_docs:
                continue
            df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            weights = np.zeros(len(dag.terms), np.int64)
            for r in df.collect():                                  # one row a term of the block
                weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
            best = best_documents(held, dag.class_of, dag.merged, dag.nodes, weights, n_docs, n_terms, k)
            found = found.union(best.select(F.lit(block).alias("block"), "item", "doc_id", "score"))
        order: list[Column] = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        top = top_k_per_group(stored(found), ["block", "item"], order, k)
        names = bounded_broadcast(sets.select("block", "item", "item_id"), MAX_ITEMS)
        return stored(top.join(names, ["block", "item"]).select("item_id", "rank", "doc_id", "score"), keep=True)
