"""Variable-capacity best-fit packing of documents into training sequences.

A document longer than the largest permitted length is cut into pieces of that
length and a rest.  Pieces are dealt evenly to shards of bounded size, and each
shard is packed for itself: pieces go, longest first, into the open bin with the
least room that still fits; if none fits, a bin of the length with the least cost
per word it can expect to hold is opened.  This is planned once with every set of
lengths up to each permitted one, and after each plan every bin is cut down to
the smallest permitted length that holds its contents; the cheapest plan counts.

Defined results
---------------
* Length: number of words ``[^\\x20\\x09-\\x0D]+``.  NULL or empty text: one piece of
  length 0 without a bin.
* Every word of every row is in exactly one piece; pieces never share a place.
* Repeated rows and NULL ids are packed row by row.  Ties: smaller doc_id, then piece.
* Empty table: no row.  Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import stored

SIZES = (256, 512, 1024, 2048, 4096)     # permitted sequence lengths in words
OVERHEAD = 16                            # cost of a sequence besides its length
SHARD = 8192                             # pieces of a shard
BIN_BITS = 20                            # bins of a shard are numbered below 2^BIN_BITS


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def opening(length: int, rest: int, sizes: list[int], overhead: int) -> int:
    """The permitted size for a new bin: least cost per word of what it can expect to hold."""
    fit = [s for s in sizes if s >= length]
    return min(fit, key=lambda s: ((s + overhead) / max(1, min(s, length + rest)), -s))


def plan(lengths: np.ndarray, sizes: list[int], overhead: int) -> tuple[float, np.ndarray, np.ndarray, list[int]]:
    """Best fit over ``lengths`` in decreasing order: cost, bin and offset of each, capacity of each bin."""
    rest = int(lengths.sum())
    free: list[tuple[int, int]] = []            # (room, bin), sorted
    used, bins, offsets = [], np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        rest -= n
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = opening(n, rest, sizes, overhead), len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            insort(free, (room - n, b))
    capacity = [sizes[bisect_left(sizes, u)] for u in used]         # downsized to the contents
    return sum(capacity) + overhead * len(used), bins, offsets, capacity


def pack_lengths(lengths: np.ndarray, sizes: list[int], overhead: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The cheapest of the plans with permitted sizes up to each size that holds the longest piece."""
    longest = int(lengths.max(initial=0))
    plans = [plan(lengths, sizes[:k + 1], overhead) for k in range(len(sizes)) if sizes[k] >= longest]
    return min(plans, key=lambda p: p[0])[1:]


def pieces(docs: DataFrame, doc_id: str, length: Column, largest: int) -> DataFrame:
    """(doc_id, piece, start, length): documents cut at ``largest`` words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), length.cast("int").alias("n"))
    count = F.greatest(F.ceil(F.col("n") / largest), F.lit(1)).cast("int")
    cut = rows.select("doc_id", "n", F.explode_outer(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece") * largest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(largest)).alias("length"))


def pack(docs: DataFrame, doc_id: str = "doc_id", length: Column | None = None, sizes: tuple[int, ...] = SIZES,
         overhead: int = OVERHEAD, shard: int = SHARD, text: str = "text") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``bin_id``, ``offset``, ``capacity`` of every piece."""
    sizes_ = sorted(sizes)
    length = count_words(F.col(text)) if length is None else length
    cut = stored(pieces(docs, doc_id, length, sizes_[-1]))
    shards = max(1, -(-cut.count() // shard))
    # numbered after storing, so the deal is the same when a task runs again, and even whatever the ids
    dealt = cut.where("length > 0").withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    # Arrow all the way: pandas would turn a nullable id into a double
    def place(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        bins, offsets, capacity = pack_lengths(rows["length"].to_numpy().astype(np.int64), sizes_, overhead)
        made = {"bin_id": pa.array((rows["shard"][0].as_py() << BIN_BITS) + bins), "offset": pa.array(offsets, pa.int32()),
                "capacity": pa.array(np.array(capacity, np.int32)[bins])}
        rows = rows.drop_columns("shard")
        for name, column in made.items():
            rows = rows.append_column(name, column)
        return rows

    kind = cut.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInArrow(
        place, f"doc_id {kind}, piece int, start int, length int, bin_id bigint, offset int, capacity int")
    empty = cut.where("length = 0").select("*", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("int").alias("offset"),
                                           F.lit(None).cast("int").alias("capacity"))
    return packed.union(empty)


def assemble(packed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bin_id``, ``capacity``, ``length`` and ``text`` (pieces in order, words joined by a space) of each
    sequence, for documents with distinct ids."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    parts = packed.where("bin_id is not null").join(docs.select(F.col(doc_id).alias("doc_id"), words.alias("w")), "doc_id")
    parts = parts.select("bin_id", "capacity", "offset", "length", F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ").alias("t"))
    rows = parts.groupBy("bin_id", "capacity").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "t"))).alias("p"))
    return rows.select("bin_id", "capacity", "length", F.array_join("p.t", " ").alias("text"))
