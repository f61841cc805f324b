"""Near-duplicates by bottom-k sketches of one hash function.

A document's sketch is the ``K`` smallest hashes of its distinct shingles.
Inverted lists of the retained values bring documents together, the sketch of
the union estimates their Jaccard similarity, and the full shingle sets decide.

Texts with equal shingle sets are one node, so exact copies never meet
pairwise; nodes have their own numbers, ids enter only when components are named.  A similar pair shares at least ``c`` of its retained values (``c`` by
the binomial tail, a miss has probability under 1e-9; exact where the sketch is
the whole set), so a document is listed under its ``size - c + 1`` rarest values
only, and values that many documents share drop out.  A list of up to
``ALL_PAIRS`` nodes gives all its pairs.  A longer one links every node to ``LEADERS``
leaders, and then to further ones as long as that helps (``HELP``); an exact
prefix join of the full sets settles what is left between the components.  Nothing
is capped.  Full sets are made once, and only of nodes that a pair or a long list needs.

Defined results
---------------
* NULL, empty or blank text: empty set, linked with nothing.
* Fewer words than a shingle: the whole sequence is the only shingle.
* NULL id: ``component_id`` NULL, kept, linked with nothing.
* Repeated rows: rows with one id are one document, linked by any of its texts; each
  row is returned.  Ids may be of any type that can be ordered.
* Empty table: no row.  Extra columns are not read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import Grams, U64, WordIds, add_columns, ascii_space_words, mix, small_batches, stored, temporary
from clickscore.llm.graph import components
from clickscore.operators._util import bounded_broadcast

K = 64                   # retained values
MISS = 1e-9              # accepted probability that a pair at the threshold shares too few of them
ALL_PAIRS = 16           # longest list that gives all pairs (120 at most)
LEADERS = 2              # leaders of a longer list
ROUNDS = 2               # further rounds at most; the exact join takes what they leave
HELP = 0.03              # a round of leaders is followed by another one if its links are this share of the components in long lists


def shared_at_least(k: int, percent: int) -> int:
    """Largest c with P(Binomial(k, percent / 100) < c) <= MISS."""
    t, below, c = percent / 100, 0.0, 0
    while True:
        below += comb(k, c) * t ** c * (1 - t) ** (k - c)
        if below > MISS:
            return c
        c += 1


class Shingler:
    def __init__(self, shingle: int):
        self.shingle, self.words, self.grams = shingle, WordIds(), Grams(17)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes (as signed numbers) of the lower-cased words."""
        words = ascii_space_words(text)
        if not words:
            return np.zeros(0, np.int64)
        ids = self.words.of([w.lower() for w in words])
        n = min(self.shingle, len(ids))
        spans = self.grams.spans(self.grams.prefix(ids), n)
        return np.unique(mix(spans + U64(n)).view(np.int64))


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, k: int) -> DataFrame:
    """(doc_id, n, set hash h1 h2, sketch) of every row; the sketch is the k smallest hashes."""
    def work(texts):
        s, n, h1, h2, small = Shingler(shingle), [], [], [], []
        for t in texts:
            x = s.set_of(t)
            h = xxhash.xxh3_128_intdigest(x.tobytes())
            n.append(len(x))
            h1.append((h >> 64) - 2**63)
            h2.append((h & (2**64 - 1)) - 2**63)
            small.append(x[:k])
        return [n, h1, h2, small]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return add_columns(rows, ["text"], ["n", "h1", "h2", "sketch"], ["bigint", "bigint", "bigint", "array<bigint>"], work, ["text"])


def _lists(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, id): every node under its rarest retained values."""
    each = nodes.select("id", "n", F.explode("sketch").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    met = each.join(often, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("shared"))
    # both sketches of a similar pair are whole sets below this size
    whole = k * percent // 100
    size = F.least(F.col("n"), F.lit(k))
    must = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.floor(size * (shared_at_least(k, percent) / k)))
    room = size - must + 1 - (size - F.size("shared"))          # values of one document come first and pair nobody
    return met.select("id", F.explode(F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("s")).select("s.v", "id")


def _estimate(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, certain): pairs whose sizes fit and whose union sketch doesn't rule them out.
    ``certain`` tells that both sketches are whole sets, so that the estimate is exact."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    union = F.array_sort(F.array_union("s_a", "s_b"))
    both = both.select("a", "b", (F.greatest("n_a", "n_b") <= k).alias("certain"), F.array_intersect("s_a", "s_b").alias("both"), union.alias("u"))
    both = both.withColumn("low", F.slice("u", 1, k))
    common = F.size(F.array_intersect("both", "low"))
    return both.where(F.when(F.col("certain"), F.size("both") * 100 >= F.size("u") * percent)
                      .otherwise(common >= shared_at_least(k, percent))).select("a", "b", "certain")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs``: exact Jaccard on the full sets where the sketches weren't whole."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.where("not certain").join(side("b"), "b").join(side("a"), "a")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    exact = both.where(inter * 100 >= (F.size("set_a") + F.size("set_b") - inter) * percent)
    return pairs.where("certain").select("a", "b").union(exact.select("a", "b"))


def _full_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, set) of the nodes ``ids``, from the texts of the documents that name them."""
    wanted = ids.join(nodes.select("id", "h1", "h2", F.col("name").alias("doc_id")), "id")

    def work(texts):
        s = Shingler(shingle)
        made = [s.set_of(t) for t in texts]
        return [made, [(xxhash.xxh3_128_intdigest(x.tobytes()) >> 64) - 2**63 for x in made]]

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id").select("id", "h1", "text")
    made = add_columns(rows, ["text"], ["set", "g1"], ["array<bigint>", "bigint"], work, ["text"])
    return made.where("g1 = h1").select("id", "set").dropDuplicates(["id"])


def _pairs_of(array: str) -> Column:
    return F.expr(f"flatten(transform({array}, (x, i) -> transform(slice({array}, i + 2, size({array})), y ->"
                  " struct(least(x, y) as a, greatest(x, y) as b))))")


def groups(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, shingle: int, percent: int, k: int) -> DataFrame:
    """(id, component) of the nodes that are similar to another one."""
    listed = _lists(nodes, k, percent)
    # leaders by hashes of the id alone, so that lists of the same nodes have the same ones
    leaders = F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(i))) for i in range(LEADERS)]))
    sizes = listed.groupBy("v").agg(F.count("*").alias("size"), leaders.alias("leaders")).where("size > 1")
    listed = stored(listed.join(sizes, "v"))
    few = listed.where(f"size <= {ALL_PAIRS}").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = few.select(F.explode(_pairs_of("ids")).alias("p")).select("p.a", "p.b")
    star = listed.where(f"size > {ALL_PAIRS}").select("id", F.explode("leaders").alias("leader")).where("id <> leader")
    star = star.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    long = listed.where(f"size > {ALL_PAIRS}").select("v", "id")
    fit = stored(_estimate(few.union(star).distinct(), nodes, k, percent))
    need = fit.where("not certain")
    ids = need.select(F.col("a").alias("id")).union(need.select("b")).union(long.select("id")).distinct()
    sets = stored(_full_sets(docs, nodes, ids, doc_id, text, shingle))
    group = joined_groups(None, stored(_confirm(fit, sets, percent)))
    tried, step, helped = fit.select("a", "b"), 0, True
    while True:
        long = stored(_open(long, group))
        if not long.count():
            return group
        if not helped or step == ROUNDS:
            return joined_groups(group, stored(_rest(long, group, sets, percent)))
        fit = stored(_estimate(_leaders(long, group, step).join(tried, ["a", "b"], "left_anti"), nodes, k, percent))
        linked = stored(_confirm(fit, sets, percent))
        # a link joins two components; the prefix join's pairs fall with the square of what is joined before
        helped = linked.count() >= HELP * _with_group(long, group).select("component").distinct().count()
        group, tried, step = joined_groups(group, linked), tried.union(fit.select("a", "b")), step + 1


def joined_groups(group: DataFrame | None, more: DataFrame) -> DataFrame:
    """``group`` (id, component) with the links ``more`` (a, b): only what joins two components is followed."""
    if group is None:
        return stored(components(more))
    of = lambda x: group.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))
    both = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = stored(both.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct())
    if both.isEmpty():
        return group
    new = stored(components(both))
    old = group.join(new.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    fresh = new.join(group.select("id"), "id", "left_anti")
    return stored(old.select("id", F.coalesce("to", "component").alias("component")).union(fresh.select("id", "component")))


def _with_group(long: DataFrame, group: DataFrame) -> DataFrame:
    return long.join(group, "id", "left").select("v", "id", F.coalesce("component", "id").alias("component"))


def _open(long: DataFrame, group: DataFrame) -> DataFrame:
    """The long lists whose nodes are in several components."""
    now = _with_group(long, group)
    several = stored(now.groupBy("v").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("v"))
    return long.join(bounded_broadcast(several), "v", "left_semi")       # a number a list; no list is dealt to one task


def _leaders(long: DataFrame, group: DataFrame, step: int) -> DataFrame:
    """Pairs of each list's pseudo-random leader with the documents of other components."""
    now = _with_group(long, group)
    order = F.struct(F.xxhash64("v", "id", F.lit(step)), F.col("id"), F.col("component"))
    lead = stored(now.groupBy("v").agg(F.min(order).alias("l")).select("v", F.col("l.id").alias("leader"), F.col("l.component").alias("of")))
    return now.join(bounded_broadcast(lead), "v").where("component <> of").select(
        F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b")).distinct()


def _rest(open_: DataFrame, group: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the nodes of lists that leaders didn't settle, exactly and between components only.

    Prefix filter on the full sets: with every set in one order, rarest shingle
    first, the first shingle that a similar pair shares stands among the first
    n - ceil(t n) + 1 of both, and what follows it must still suffice for the
    similarity.  The latter is part of the join's condition, so documents with
    too many shingles of their own meet nobody.
    """
    members = stored(_with_group(open_, group).select("id", "component").distinct())
    each = sets.join(members.select("id"), "id").select("id", F.size("set").alias("n"), F.explode("set").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
    own = F.col("n") - F.size("s")                               # shingles of this document alone come first
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - own
    prefix = F.transform(F.slice("s", F.lit(1), F.greatest(room, F.lit(0)).cast("int")), lambda x: x["v"])
    first = shared.where(room > 0).select("id", "n", own.alias("own"), prefix.alias("prefix")).join(members, "id")
    first = stored(first.select("id", "n", "component", "own", "prefix", F.posexplode("prefix").alias("at", "v")).select(
        "id", "n", "component", "v", (F.col("n") - F.col("own") - F.col("at")).alias("left"), F.slice("prefix", F.lit(1), F.col("at")).alias("before")))
    a = first.select("v", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "left", "component", "before")])
    b = first.select("v", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "left", "component", "before")])
    enough = F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    # a pair meets at the first shingle that both prefixes hold, so once
    once = ~F.arrays_overlap("before_a", "before_b")
    met = a.join(b, (a["v"] == b["v"]) & (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & enough & once)
    return _confirm(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(False).alias("certain")), sets, percent)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
                    k: int = K) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Two documents are linked if the Jaccard similarity of their shingle sets is
    ``percent`` or more; a component's id is its smallest doc_id.
    """
    with temporary(), small_batches(docs.sparkSession):
        rows = stored(sketches(docs, doc_id, text, shingle, k))
        known = rows.where("n > 0 and doc_id is not null")
        nodes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("name"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()))
        group = joined_groups(groups(docs, nodes, doc_id, text, shingle, percent, k), _same_id(known, nodes))
        named = group.join(nodes.select("id", "name"), "id")
        lowest = named.groupBy("component").agg(F.min("name").alias("lowest"))
        of = named.join(lowest, "component").select("id", "lowest")
        label = nodes.select("id", "h1", "h2", "name").join(of, "id", "left").select("h1", "h2", F.coalesce("lowest", "name").alias("component_id"))
        found = rows.select("doc_id", "n", "h1", "h2").join(label, ["h1", "h2"], "left")
        component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
        return stored(found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), keep=True)


def _same_id(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links among the nodes of an id that has several texts."""
    shape = F.struct("h1", "h2")
    several = known.groupBy("doc_id").agg(F.min(shape).alias("x"), F.max(shape).alias("y")).where("x <> y").select("doc_id")
    if several.isEmpty():
        return nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    owned = stored(known.join(several, "doc_id").select("doc_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "id"), ["h1", "h2"]))
    lead = owned.groupBy("doc_id").agg(F.min("id").alias("a"))
    return owned.join(lead, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
