"""Toxic passages as maximum-scoring segments.

A word scores the log-odds of the toxic against the other class with an
informative Dirichlet prior (the words' overall frequencies); a word that is not
significant takes the score of its longest significant prefix, or else the small
negative ``NEUTRAL``.  One linear scan finds all maximal segments.  A segment of score S in a
text of n words is expected E = K n exp(-lambda S) times by chance (extreme-value
statistics of segment scores); lambda solves sum p(s) exp(lambda s) = 1 over the words
of other texts.  A text's evidence is the sum of -ln E over its significant
segments and the largest of them; a logistic curve turns it into a probability.

Learning uses at most about ``FIT_DOCS`` labelled texts (a hash sample); of a group
of copies one counts.  The curve is fitted on texts scored with the words of
the other half.  Everything else reads whole texts and all rows.

Defined results
---------------
* NULL, empty or letterless text: no segment, so the curve's lowest score.
* Rows with a NULL id are scored, not held out, and not learned from.  An id with
  several labels is toxic if one of them is 1; NULL labels are left out.
* Repeated rows are scored one by one.  Empty tables: no row.
* No text of one of the classes: every score is the share of toxic labels.
* Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import add_columns, stored

FIT_DOCS = 20_000        # labelled texts learned from, about
PRIOR = 0.1              # weight of the Dirichlet prior, as a share of the words counted
SIGNIFICANT = 3.0        # |z| of a word with a score of its own
PREFIXES = (5, 4, 3)     # letters of a prefix, longest first
NEUTRAL = -0.1
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)     # word or "prefix*" -> score
    decay: float = 1.0                                        # lambda
    log_k: float = 0.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)       # intercept, largest, sum
    share: float = 0.0


class Scores(dict):
    """Memo of word scores, emptied when full."""

    def __init__(self, terms: dict[str, float], room: int = 1 << 19):
        super().__init__()
        self.terms, self.room = terms, room

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        s = self.terms.get(word)
        for n in PREFIXES:
            if s is None and len(word) > n:
                s = self.terms.get(word[:n] + "*")
        s = self[word] = NEUTRAL if s is None else s
        return s


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in one pass over the positive words.

    A candidate is kept with the sums before and after it.  A new one looks for
    the nearest earlier candidate with a smaller sum before it (links skip the
    ones in between); it is added, or joined with all from there on if the
    sum after that one is smaller than its own.
    """
    after = np.cumsum(scores)
    start, end, low, high, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        r = float(after[i])
        s, e, l = i, i + 1, r - float(scores[i])
        j = len(start) - 1
        while True:
            while j >= 0 and low[j] >= l:
                j = link[j]
            if j < 0 or high[j] >= r:
                break
            s, l = start[j], low[j]                     # join with candidate j
            del start[j:], end[j:], low[j:], high[j:]
            k = link[j]
            del link[j:]
            j = k
        start.append(s)
        end.append(e)
        low.append(l)
        high.append(r)
        link.append(j)
    return [(a, b, h - l) for a, b, l, h in zip(start, end, low, high)]


def evidence(text: str | None, scores: Scores, model: Model) -> tuple[float, float, list]:
    """Largest and summed -ln E of the significant segments, and the segments as (start, end, -ln E) in characters."""
    found = list(WORD.finditer(text.lower())) if text else []
    values = np.fromiter((scores[m.group()] for m in found), float, len(found))
    return _evidence(values, model, lambda a, b: (found[a].start(), found[b - 1].end()))


def _evidence(values: np.ndarray, model: Model, place) -> tuple[float, float, list]:
    best, total, out = 0.0, 0.0, []
    if (values > 0).any():
        base = model.log_k + math.log(len(values))
        for a, b, s in segments(values):
            gain = model.decay * s - base                  # -ln E
            if gain > 0:
                best, total = max(best, gain), total + gain
                out.append((*place(a, b), gain))
    return best, total, out


def _words(text: str | None, scores: Scores) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(scores.__getitem__, words), float, len(words))


def probability(best, total, model: Model):
    a, b, c = model.curve
    x = a + b * np.log1p(best) + c * np.log1p(total)
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _terms(texts: DataFrame, prior: float, z_min: float) -> DataFrame:
    """Significant words and prefixes with their scores.  A text counts once for a
    word, so one text that repeats a word proves nothing.  ``texts`` has at most about
    ``FIT_DOCS`` rows, which bounds the result."""
    words = texts.select("toxic", F.explode_outer("words").alias("w"))
    counts = words.where("w is not null").groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    counts = stored(counts)
    parts = F.concat(F.array("w"), *[F.when(F.length("w") > n, F.array(F.concat(F.substring("w", 1, n), F.lit("*"))))
                                     .otherwise(F.array().cast("array<string>")) for n in PREFIXES])
    units = counts.select(F.explode_outer(parts).alias("term"), "t", "o").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    n = counts.agg(F.sum("t").alias("nt"), F.sum("o").alias("no"))                  # one row
    units = units.join(F.broadcast(n))
    p = F.lit(prior) * (F.col("t") + F.col("o"))                # prior words of this kind
    mass = F.lit(prior) * (F.col("nt") + F.col("no"))
    odds = lambda c, n: F.log((F.col(c) + p) / F.greatest(F.col(n) + mass - F.col(c) - p, F.lit(0.5)))
    score = odds("t", "nt") - odds("o", "no")
    z = score / F.sqrt(1 / (F.col("t") + p) + 1 / (F.col("o") + p))
    return units.select("term", score.alias("score"), z.alias("z")).where(F.abs("z") >= z_min)


def _read(texts: list[str], n: int = 3) -> list[list]:
    """Distinct words, a digest of the word sequence, and the smallest digest of its ``n``-word shingles."""
    out = [], [], []
    for t in texts:
        words = WORD.findall(t.lower())
        out[0].append(sorted(set(words)))
        out[1].append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
        grams = {" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}
        out[2].append(min(xxhash.xxh3_128_hexdigest(g.encode("utf-8", "surrogatepass")) for g in grams))
    return list(out)


def _decay(pairs: list[tuple[float, float]]) -> float:
    """lambda > 0 with sum p exp(lambda s) = 1, by bisection, for (s, p) with a negative mean."""
    lo, hi = 1e-6, 1.0
    f = lambda x: sum(p * math.exp(min(x * s, 700)) for s, p in pairs)
    while f(hi) < 1 and hi < 1e4:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 1 else (lo, mid)
    return (lo + hi) / 2


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", fit_docs: int = FIT_DOCS, prior: float = PRIOR, z_min: float = SIGNIFICANT) -> Model:
    """Learn from the labelled rows that satisfy ``learn``, a condition on ``doc_id``."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    n = known.count()
    if not n:
        return Model()
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    known = known.where(lot < math.ceil(min(1.0, fit_docs / n) * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(known, "id").where("text is not null")
    # of texts with equal words the one with the smallest id is learned from; near copies mostly share their
    # smallest shingle, which puts them into the same half
    rows = stored(add_columns(rows, ["text"], ["words", "copy", "shingle"], ["array<string>", "string", "string"], _read))
    first = rows.groupBy("copy", "toxic").agg(F.min("id").alias("id"))
    rows = rows.join(first, ["copy", "toxic", "id"]).dropDuplicates(["copy", "toxic"])          # rows with one id and equal words
    rows = stored(rows.withColumn("half", F.pmod(F.xxhash64("shingle"), F.lit(2))).drop("copy", "shingle"))
    classes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}        # two rows at most
    share = classes.get(1, 0) / max(1, sum(classes.values()))
    if len(classes) < 2:
        return Model(share=share)
    learn_terms = lambda r: {x["term"]: x["score"] for x in _terms(r, prior, z_min).collect()}  # noqa: E731  bounded by fit_docs
    model = Model(learn_terms(rows), share=share)
    # the curve sees every text as a new one: each half is scored with the other half's words
    crossed = [(rows.where(F.col("half") == h), Model(learn_terms(rows.where(F.col("half") != h)))) for h in (0, 1)]
    scored = stored(reduce(DataFrame.union, [_measured(r, m) for r, m in crossed]))
    bins = scored.where("toxic = 0").select(F.explode_outer("bins").alias("b")).groupBy("b.s").agg(F.sum("b.n").alias("n")).collect()
    total = sum(r["n"] for r in bins if r["s"] is not None) or 1
    top = max([v for v in model.terms.values() if v > 0], default=1.0)
    pairs = [(r["s"], r["n"] / (total + 1)) for r in bins if r["s"] is not None] + [(top, 1 / (total + 1))]    # one unseen toxic word
    model.decay = _decay(pairs)
    # K from the mean of the Gumbel law: E[lambda S - ln n] = ln K + 0.5772 over texts that have a segment
    k = scored.where("toxic = 0 and top > 0").agg(F.avg(F.lit(model.decay) * F.col("top") - F.log("words"))).first()[0]
    model.log_k = (k - 0.5772156649) if k is not None else 0.0
    features = reduce(DataFrame.union, [
        score_rows(r, replace(m, decay=model.decay, log_k=model.log_k), "text", raw=True).select("best", "total", "toxic")
        for r, m in crossed]).toPandas()                                                     # bounded by fit_docs
    x = np.column_stack([np.ones(len(features)), np.log1p(features["best"]), np.log1p(features["total"])])
    model.curve = tuple(float(v) for v in _curve(x, features["toxic"].to_numpy(float)))
    return model


def _measured(rows: DataFrame, model: Model) -> DataFrame:
    """Per text: histogram of word scores (to 1/16), words and the highest segment score."""
    def work(texts):
        scores, bins, words, top = Scores(model.terms), [], [], []
        for t in texts:
            v = _words(t, scores)
            s, n = np.unique(np.round(v * 16) / 16, return_counts=True)
            bins.append([{"s": float(a), "n": int(b)} for a, b in zip(s, n)])
            words.append(max(1, len(v)))
            top.append(max((x[2] for x in segments(v)), default=0.0) if len(v) else 0.0)
        return [bins, words, top]

    return add_columns(rows.select("toxic", "text"), ["text"], ["bins", "words", "top"],
                       ["array<struct<s:double,n:bigint>>", "bigint", "double"], work, ["text"])


def score_rows(docs: DataFrame, model: Model, text: str = "text", score: str = "score", passages: str | None = None,
               raw: bool = False, drop: list[str] = ()) -> DataFrame:
    """``docs`` plus the toxicity probability, and with ``passages`` the significant
    segments (array<struct<start, end, evidence>>, characters of the lower-cased text)."""
    flat = not model.terms

    def work(texts):
        scores, best, total, spans = Scores(model.terms), np.zeros(len(texts)), np.zeros(len(texts)), []
        for i, t in enumerate(texts):
            if passages:
                best[i], total[i], found = evidence(t, scores, model)
                spans.append([{"start": a, "end": b, "evidence": g} for a, b, g in found])
            else:
                best[i], total[i], _ = _evidence(_words(t, scores), model, lambda a, b: (a, b))
        if raw:
            return [best, total]
        p = np.full(len(texts), model.share) if flat else probability(best, total, model)
        return [p, spans] if passages else [p]

    names = ["best", "total"] if raw else [score] + ([passages] if passages else [])
    types = ["double"] + (["double"] if raw else ["array<struct<start:int,end:int,evidence:double>>"] if passages else [])
    return add_columns(docs, [text], names, types, work, drop)
