"""N-gram mining over sessions.

Two ways to get n-grams, same counts:

* ``ngrams_from_sequences`` reads the gold sequence table (one array per
  session chunk, the notebooks' input) and cuts each array with
  ``transform(sequence(...), i -> slice(...))`` + ``explode``: per-row work,
  no window and no shuffle until the count.
* ``ngrams_from_events`` never builds per-session arrays.  It partitions
  event rows by session and piece of ``piece_rows`` positions in it and takes
  the next n-1 items with ``lead``; items past a piece's edge come from a small
  "first n-1 items" table shifted with a window over pieces.  A session holding
  a third of all events is thus spread over many tasks, even if all of them
  fall into one minute.

All counting is ``groupBy(...).count()`` with map-side partial aggregation;
group-level roll-ups classify the (small) distinct n-gram table, not events.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import CATEGORIES
from clickscore.operators._util import at_most, join_on_keys, materialize, top_k_per_group
from clickscore.operators.base import KEYS
from clickscore.operators.sessions import CHUNK_ITEMS, MAX_GRAM, ORDER

NAMES = [c for c in string.ascii_lowercase if c != "n"]          # column names of the first items; n is the count
FLOOR = 1e-6          # frequency given to an n-gram missing from one side (N8)


def _cols(n: int):
    """Names of the item columns: letters, then letters with a number."""
    if n < 2:
        raise ValueError("n must be 2 or more")
    return [NAMES[i % len(NAMES)] + (str(i // len(NAMES)) if i >= len(NAMES) else "") for i in range(n)]


# ---- S4 from arrays ---------------------------------------------------------
def ngrams_from_sequences(seqs: DataFrame, n: int = 2, seq_col: str = "feature_sequence",
                          keep: list[str] | None = None, max_n: int = MAX_GRAM) -> DataFrame:
    """One row per n-gram occurrence: keep-columns + a, b[, c].

    On a chunked sequence table, grams start inside the chunk and may run
    into ``next_items`` (the first items of the session's next chunks).  The
    table carries ``max_n - 1`` of them; longer grams fetch more.
    """
    keep = keep if keep is not None else ["nps_category"]
    g = gram_arrays(seqs, n, seq_col, keep, max_n)
    return g.select(*keep, *[F.col("gram")[i].alias(c) for i, c in enumerate(_cols(n))])


def gram_arrays(seqs: DataFrame, n: int, seq_col: str = "feature_sequence", keep: list[str] | None = None,
                max_n: int = MAX_GRAM) -> DataFrame:
    """One row per n-gram occurrence, the items as one array ``gram``: any ``n``."""
    keep = keep if keep is not None else ["nps_category"]
    seqs = with_next_items(seqs, n, seq_col, max_n)
    own = F.col(seq_col)
    s = F.concat(own, F.col("next_items")) if "next_items" in seqs.columns else own
    last = F.least(F.size(own), F.size(s) - (n - 1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(s, i, n))
    return seqs.filter(F.size(s) >= n).select(*keep, F.explode(grams).alias("gram"))


def with_next_items(seqs: DataFrame, n: int, seq_col: str = "feature_sequence", max_n: int = MAX_GRAM) -> DataFrame:
    """``seqs`` with at least ``n - 1`` items of what follows each chunk.  Only the first items of
    the chunks of cut sessions are looked at; the sequences stay where they are."""
    if "next_items" not in seqs.columns or n <= max_n:
        return seqs
    G = KEYS + ["session_num"]
    heads = seqs.select(*G, "chunk", F.slice(seq_col, 1, n - 1).alias("_head"))
    late = heads.filter(F.col("chunk") > 0).select(*G).distinct().withColumn("_late", F.lit(True))
    after = Window.partitionBy(*G).orderBy("chunk").rowsBetween(1, n - 1)
    tails = join_on_keys(heads, late, G).select(*G, "chunk", F.slice(F.flatten(F.collect_list("_head").over(after)), 1, n - 1).alias("_next"))
    both = join_on_keys(seqs, tails, [*G, "chunk"], "left")
    return both.select(*[F.coalesce("_next", "next_items").alias(c) if c == "next_items" else c for c in seqs.columns])


def frequent_ngrams(seqs: DataFrame, max_n: int, min_count: int, seq_col: str = "feature_sequence", by: str = "nps_category",
                    stored_n: int = MAX_GRAM) -> DataFrame:
    """(``by``, ``size``, ``gram`` array, ``n``): the n-grams of 2 to ``max_n`` items that occur ``min_count`` times or more.

    Level by level: a gram is tried only where both of its parts, without the last item and
    without the first, are frequent in its category.  A frequent gram has a number, and a longer one is the pair of
    its parts' numbers, so keys stay two numbers whatever the length, and the occurrences shrink from level to level.
    """
    rows = with_next_items(seqs, max_n, seq_col, stored_n)
    tail = F.col("next_items") if "next_items" in rows.columns else F.array().cast(rows.schema[seq_col].dataType)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), by, F.size(seq_col).alias("own"), F.concat(seq_col, tail).alias("items"))
    rows = rows.select("row", by, "own", F.posexplode("items").alias("pos", "item"))
    rows = materialize(rows)                    # the row numbers must be the same for every level
    mine = F.count_if(F.col("pos") < F.col("own"))           # what starts in the tail is the next chunk's
    found = rows.groupBy(by, "item").agg(mine.alias("n")).filter(F.col("n") >= min_count)
    known = materialize(found.select(by, F.array("item").alias("gram"), "item", "n", F.monotonically_increasing_id().alias("id")))
    level = rows.join(known.select(by, "item", "id"), [by, "item"]).select("row", by, "own", "pos", "id")
    out = None
    for size in range(2, max_n + 1):
        level = materialize(level)
        right = level.select("row", (F.col("pos") - 1).alias("pos"), F.col("id").alias("y"))
        pairs = level.withColumnRenamed("id", "x").join(right, ["row", "pos"])
        found = pairs.groupBy(by, "x", "y").agg(mine.alias("n")).filter(F.col("n") >= min_count)
        x, y = known.select(F.col("id").alias("x"), "gram"), known.select(F.col("id").alias("y"), F.element_at("gram", -1).alias("item"))
        made = found.join(x, "x").join(y, "y").select(by, "x", "y", F.concat("gram", F.array("item")).alias("gram"), "n")
        made = materialize(made.withColumn("id", F.monotonically_increasing_id()))
        part = made.select(by, F.lit(size).alias("size"), "gram", "n")
        out = part if out is None else out.unionByName(part)
        if made.isEmpty():
            break
        level, known = pairs.join(made.select(by, "x", "y", "id"), [by, "x", "y"]).select("row", by, "own", "pos", "id"), made
    return out


# ---- S4 from event rows (skew-safe) ----------------------------------------
def ngrams_from_events(sessioned: DataFrame, n: int = 2, value: str = "feature_name",
                       piece_rows: int = CHUNK_ITEMS,
                       keep: list[str] | None = None) -> DataFrame:
    keep = keep if keep is not None else ["nps_category"]
    names = _cols(n)
    G = KEYS + ["session_num"]
    ordc = [F.col(c) for c in ORDER]
    r = sessioned.withColumn("_b", F.floor((F.col("session_pos") - 1) / F.lit(piece_rows)))
    w = Window.partitionBy(*G, "_b").orderBy(*ordc)
    r = (r.withColumn("_rn", F.row_number().over(w))
          .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy(*G, "_b"))))
    for i in range(1, n):
        r = r.withColumn(f"_n{i}", F.lead(value, i).over(w))
    heads = (r.filter(F.col("_rn") <= n - 1).groupBy(*G, "_b")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), F.col(value).alias("_v"))))
                  .getField("_v").alias("_head")))
    wg = Window.partitionBy(*G).orderBy("_b")
    heads = heads.select(*G, "_b", F.slice(F.flatten(F.collect_list("_head").over(wg.rowsBetween(1, n - 1))),
                                           1, n - 1).alias("_cont"))
    r = join_on_keys(r, heads, G + ["_b"], "left")
    items = [F.col(value)]
    for i in range(1, n):
        items.append(F.when(F.col("_rn") + i <= F.col("_cnt"), F.col(f"_n{i}"))
                     .otherwise(F.get(F.col("_cont"), F.col("_rn") + i - F.col("_cnt") - 1)))
    out = r.select(*keep, *[items[i].alias(names[i]) for i in range(n)])
    return out.filter(F.col(names[-1]).isNotNull())


# ---- N1, N2: counts -----------------------------------------------------------
def ngram_counts(grams: DataFrame, n: int = 2, by: str = "nps_category") -> DataFrame:
    return grams.groupBy(by, *_cols(n)).agg(F.count(F.lit(1)).alias("n"))


# ---- C6/W4: the bigram view (fixed to stay inside one session) ----------------
def bigram_view(seqs: DataFrame, seq_col: str = "feature_sequence", a: str = "feature_a",
                b: str = "feature_b") -> DataFrame:
    g = ngrams_from_sequences(seqs, 2, seq_col)
    return g.groupBy("nps_category", F.col("a").alias(a), F.col("b").alias(b)).agg(
        F.count(F.lit(1)).alias("bigram_count"))


# ---- N3 / D31: group roll-up ----------------------------------------------------
def group_rollup(counts: DataFrame, n: int = 2, variant: str = "python", by: str = "nps_category") -> DataFrame:
    names = _cols(n)
    g = counts.select(by, *[X.feature_group(c, variant).alias(c) for c in names], "n")
    return g.groupBy(by, *names).agg(F.sum("n").alias("n"))


# ---- L4 / N4: top k per category with group annotation ------------------------
def top_per_category(counts: DataFrame, n: int = 2, k: int = 10, annotate: bool = True,
                     variant: str = "python", by: str = "nps_category") -> DataFrame:
    names = _cols(n)
    t = top_k_per_group(counts, [by], [F.col("n").desc(), *[F.col(c) for c in names]], k, salt_of=names)
    if annotate:
        t = t.select("*", *[X.feature_group(c, variant).alias(f"group_{c}") for c in names])
    return t


# ---- N5: feature transition matrix ---------------------------------------------
def transition_matrix(bigrams: DataFrame, top_n: int = 15, by: str = "nps_category") -> DataFrame:
    """Row-normalised transitions among the top_n busiest items of each category.

    Busy = count as source + count as target (a self-loop counts twice);
    ties by name.  Long form (category, from_item, to_item, prob) with the full
    top_n x top_n grid; an all-zero row stays zero.
    """
    ends = (bigrams.select(by, F.col("a").alias("item"), "n")
            .unionByName(bigrams.select(by, F.col("b").alias("item"), "n")))
    tot = ends.groupBy(by, "item").agg(F.sum("n").alias("_t"))
    top = top_k_per_group(tot, [by], [F.col("_t").desc(), F.col("item")], top_n, "_r", ["item"]).select(by, "item")
    grid = (top.select(by, F.col("item").alias("from_item"))
            .join(top.select(by, F.col("item").alias("to_item")), by))
    cells = bigrams.select(by, F.col("a").alias("from_item"), F.col("b").alias("to_item"), "n")
    m = grid.join(cells, [by, "from_item", "to_item"], "left").fillna(0, ["n"])
    rs = F.sum("n").over(Window.partitionBy(by, "from_item"))
    return m.select(by, "from_item", "to_item", "n",
                    (F.col("n") / F.when(rs == 0, F.lit(1)).otherwise(rs)).cast("double").alias("prob"))


# ---- N6: group transition matrix -----------------------------------------------
def group_transition_matrix(bigrams: DataFrame, variant: str = "python", by: str = "nps_category") -> DataFrame:
    g = group_rollup(bigrams, 2, variant, by)
    seen = (g.select(by, F.col("a").alias("g")).unionByName(g.select(by, F.col("b").alias("g"))).distinct())
    grid = (seen.select(by, F.col("g").alias("from_group"))
            .join(seen.select(by, F.col("g").alias("to_group")), by))
    cells = g.select(by, F.col("a").alias("from_group"), F.col("b").alias("to_group"), "n")
    m = grid.join(cells, [by, "from_group", "to_group"], "left").fillna(0, ["n"])
    rs = F.sum("n").over(Window.partitionBy(by, "from_group"))
    return m.select(by, "from_group", "to_group", "n",
                    (F.col("n") / F.when(rs == 0, F.lit(1)).otherwise(rs)).cast("double").alias("prob"))


# ---- N7: relative frequency ------------------------------------------------------
def relative_freq(counts: DataFrame, n: int = 2, by: str = "nps_category", max_groups: int | None = len(CATEGORIES)) -> DataFrame:
    """n / total of the category.  Totals are one row per category, joined
    (by broadcast if ``max_groups`` bounds them) instead of a window that would
    put every distinct n-gram of a category into one task."""
    tot = counts.groupBy(by).agg(F.sum("n").alias("_tot"))
    return (counts.join(at_most(tot, max_groups), by)
            .withColumn("freq", F.col("n") / F.col("_tot")).drop("_tot"))


# ---- N8: distinctive n-grams ------------------------------------------------------
def distinctive(counts: DataFrame, n: int = 2, num: str = "promoter", den: str = "detractor",
                variant: str = "python", by: str = "nps_category") -> DataFrame:
    """freq in ``num`` / freq in ``den`` over the union of keys; missing side = 1e-6.

    Result column names are fixed by the study: freq_prom, freq_detr, ratio, group_transition.
    """
    names = _cols(n)
    rel = relative_freq(counts.filter(F.col(by).isin(num, den)), n, by)
    p = rel.filter(F.col(by) == num).select(*names, F.col("freq").alias("freq_prom"))
    d = rel.filter(F.col(by) == den).select(*names, F.col("freq").alias("freq_detr"))
    j = p.join(d, names, "full_outer").select(
        *names, F.coalesce("freq_prom", F.lit(FLOOR)).alias("freq_prom"),
        F.coalesce("freq_detr", F.lit(FLOOR)).alias("freq_detr"))
    grp = [X.feature_group(c, variant) for c in names]
    return j.select(
        F.concat_ws(" -> ", *[F.col(c) for c in names]).alias("ngram"),
        *names,
        *[grp[i].alias(f"group_{names[i]}") for i in range(n)],
        F.concat_ws(" -> ", *grp).alias("group_transition"),
        "freq_prom", "freq_detr",
        (F.col("freq_prom") / F.col("freq_detr")).alias("ratio"))


# ---- N9: the k most and least distinctive ---------------------------------------
def distinctive_extremes(dist: DataFrame, k: int = 10) -> DataFrame:
    hi = dist.orderBy(F.col("ratio").desc(), F.col("ngram")).limit(k)
    lo = dist.orderBy(F.col("ratio").asc(), F.col("ngram")).limit(k)
    return (hi.unionByName(lo).dropDuplicates(["ngram"])
            .withColumn("log2_ratio", F.log2("ratio")))
