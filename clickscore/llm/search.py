"""Exact top-k inner-product search with ball trees.

Vectors are dealt to shards of bounded size; each shard's ball tree is built
once and kept as one packed row.  Queries go in blocks against shards.  In a
task every query walks the tree best node first: a node's upper bound is
``q . centre + |q| * radius``, and the walk ends where the bound falls below the
query's kth score.  A first round searches one home shard per query; its kth
score, a lower bound of the final one, starts the walks in all other shards.

Defined results
---------------
* A component x counts as floor(scale * x).  Scores are exact integers; vectors whose
  scores could leave 64 bits are an error.
* NULL vectors, vectors with a NULL or non-finite component and rows without an
  id take no part.  Only vectors of equal length meet.
* Rows with the query's id are its own and no candidates.  Equal rows (id and
  vector) count once.  Ties go to the smaller id.
* Fewer candidates than k: all of them.  Empty table: no row.  Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscore.llm.common import stored

SHARD = 8192           # vectors of a shard
BLOCK = 256            # queries of a block
GROUP = 64               # blocks that a copy of a tree serves
LEAF = 64              # vectors of a leaf


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(id, dim, v): distinct usable rows with integer components."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    bad = F.exists(F.col(embedding), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(~bad)
    v = F.transform(x, lambda c: F.floor(c * float(scale)))
    return rows.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).distinct().withColumn("dim", F.size("v"))


class BallTree:
    """Points in leaf order and, per node, centre, radius, range and children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        x = points.astype(np.float64)
        order = np.arange(len(x))
        centre, radius, first, last, left = [], [], [], [], []
        todo = [(0, len(x))]
        while todo:                                   # nodes are numbered level by level; children stand together
            nxt = []
            for at, (lo, hi) in enumerate(todo):
                part = x[order[lo:hi]]
                c = part.mean(0)
                far = ((part - c) ** 2).sum(1)
                centre.append(c)
                radius.append(float(np.sqrt(far.max())))
                first.append(lo)
                last.append(hi)
                if hi - lo <= leaf:
                    left.append(-1)
                    continue
                a = part[far.argmax()]
                b = part[((part - a) ** 2).sum(1).argmax()]
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part @ (b - a), mid)]
                left.append(len(centre) + (len(todo) - at - 1) + len(nxt))
                nxt += [(lo, lo + mid), (lo + mid, hi)]
            todo = nxt
        self.ids, self.points = ids[order], points[order]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.first, self.last, self.left = np.array(first), np.array(last), np.array(left)

    ARRAYS = {"ids": "<i8", "points": "<i8", "centre": "<f8", "radius": "<f8", "first": "<i8", "last": "<i8", "left": "<i8"}

    def packed(self) -> dict:
        return {k: np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.ARRAYS.items()}

    @classmethod
    def unpacked(cls, row, dim: int) -> BallTree:
        self = cls.__new__(cls)
        for k, t in cls.ARRAYS.items():
            setattr(self, k, np.frombuffer(row[k], t))
        self.points = self.points.reshape(len(self.ids), dim)
        self.centre = self.centre.reshape(len(self.radius), dim)
        return self

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """For each query the k best (score, id) with a score of ``floor`` or more."""
        dim = queries.shape[1]
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(self.points).max(initial=0)) * max(dim, 1)
        if most >= 2.0 ** 63:
            raise ArithmeticError("scores do not fit in 64 bits")
        kind = np.float64 if most < 2.0 ** 53 else np.int64          # both exact here
        points, q_all = self.points.astype(kind), queries.astype(kind)
        q = queries.astype(np.float64)
        bounds = q @ self.centre.T + np.sqrt((q ** 2).sum(1))[:, None] * self.radius
        bounds += np.abs(bounds) * 1e-9 + 1                            # rounding may only loosen a bound
        for i in range(len(q)):
            bound, kth = bounds[i], floor[i]
            scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heapq.heappop(heap)
                child = self.left[node]
                if child >= 0:
                    for c in (child, child + 1):
                        if bound[c] >= kth:
                            heapq.heappush(heap, (-bound[c], c))
                    continue
                a, b = self.first[node], self.last[node]
                s = (points[a:b] @ q_all[i]).astype(np.int64)
                good = (s >= kth) & (self.ids[a:b] != own[i])
                if good.any():
                    scores, ids = np.concatenate([scores, s[good]]), np.concatenate([ids, self.ids[a:b][good]])
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                    if len(scores) == k:
                        kth = max(kth, scores[-1])
            yield scores, ids


def _search(k: int):
    def run(key, trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "block": []}
        for tree in trees.to_dict("records"):
            tree = BallTree.unpacked(tree, key[0])
            for block in blocks.itertuples():
                own = np.frombuffer(block.ids, "<i8")
                queries = np.frombuffer(block.points, "<i8").reshape(len(own), key[0])
                floor = np.frombuffer(block.floor, "<i8")
                for q, (scores, ids) in zip(own, tree.search(queries, own, floor, k)):
                    out["query_id"] += [int(q)] * len(ids)
                    out["vec_id"] += ids.tolist()
                    out["score"] += scores.tolist()
                    out["block"] += [block.block] * len(ids)
        return pd.DataFrame(out)
    return run


LOWEST = -2 ** 63
_FOUND = "query_id bigint, vec_id bigint, score bigint, block bigint"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: int = 1024, shard: int = SHARD, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's k best candidates.

    ``is_query`` is a condition on ``vec_id``'s column of ``vectors``.
    """
    rows = stored(integers(vectors, vec_id, embedding, scale))
    asked = stored(integers(vectors.where(is_query), vec_id, embedding, scale))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}      # one row per vector length
    wanted = {r["dim"]: r["count"] for r in asked.groupBy("dim").count().collect()}

    def parts(counts: dict, size: int) -> Column:
        n = F.lit(1)
        for dim, count in counts.items():
            n = F.when(F.col("dim") == dim, F.lit(-(-count // size))).otherwise(n)
        return n.cast("bigint")

    def dealt(df: DataFrame, counts: dict, size: int) -> DataFrame:
        n = parts(counts, size)
        return df.select("*", F.pmod(F.xxhash64("id", "v"), n).alias("part"), n.alias("parts"))

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        points = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), key[0])
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "shards": int(frame["parts"].iloc[0]),
                              **BallTree(frame["id"].to_numpy(np.int64), points).packed()}])

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        points = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), key[0])
        return pd.DataFrame([{"dim": key[0], "block": key[1], "ids": frame["id"].to_numpy("<i8").tobytes(),
                              "points": points.astype("<i8").tobytes(), "floor": np.full(len(frame), LOWEST, "<i8").tobytes()}])

    trees = stored(dealt(rows, sizes, shard).groupBy("dim", F.col("part").alias("shard")).applyInPandas(
        build, "dim int, shard bigint, shards bigint, " + ", ".join(f"{a} binary" for a in BallTree.ARRAYS)))
    blocks = stored(dealt(asked, wanted, block).groupBy("dim", F.col("part").alias("block")).applyInPandas(
        pack, "dim int, block bigint, ids binary, points binary, floor binary"))
    # block b meets its home shard first, then every other shard: block and shard numbers are equi-join keys
    shards = trees.select("dim", "shards").distinct()
    placed = blocks.join(F.broadcast(shards), "dim")                                    # one row per vector length

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("dim", "shard", "part").cogroup(right.groupBy("dim", "shard", "part")).applyInPandas(_search(k), _FOUND)

    # a tree is copied once for ``group`` blocks, which it meets in one task
    homes = placed.withColumn("shard", F.col("block") % F.col("shards")).withColumn("part", F.floor(F.col("block") / (F.col("shards") * group)))
    last = parts(wanted, block) - 1
    every_part = lambda size: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / size)))
    tree_homes = trees.where(F.col("shard") <= last).withColumn("part", every_part(F.col("shards") * group))
    near = stored(meet(tree_homes, homes.drop("shards")))
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("query_id", "kth")
    floors = stored(asked.select("dim", F.col("id")).join(kth, F.col("id") == F.col("query_id"), "left").select("dim", "id", "kth"))
    block_of = dealt(asked, wanted, block).select("dim", F.col("part").alias("block"), "id", "v")

    def raise_floor(key, frame: pd.DataFrame, low: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return frame.drop(columns=["shards"])
        known = dict(zip(low["id"], low["kth"].fillna(LOWEST)))
        row = frame.iloc[0]
        ids = np.frombuffer(row["ids"], "<i8")
        floor = np.array([int(known.get(i, LOWEST)) for i in ids.tolist()], "<i8")
        return pd.DataFrame([{"dim": row["dim"], "block": row["block"], "ids": row["ids"], "points": row["points"], "floor": floor.tobytes()}])

    low = block_of.select("dim", "block", "id").distinct().join(floors.select("dim", "id", "kth").distinct(), ["dim", "id"])
    low = low.where("kth is not null")
    raised = placed.groupBy("dim", "block").cogroup(low.groupBy("dim", "block")).applyInPandas(
        raise_floor, "dim int, block bigint, ids binary, points binary, floor binary")
    raised = stored(raised).join(F.broadcast(shards), "dim")
    others = raised.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)))
    others = others.where("shard <> block % shards").drop("shards").withColumn("part", F.floor(F.col("block") / group))
    far = meet(trees.where("shards > 1").withColumn("part", every_part(F.lit(group))), others)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = near.union(far).select("query_id", "vec_id", "score").distinct()
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
