"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1.  A letter n-gram is the
element-wise product (binding) of its letters' vectors, each rotated by its
place in the n-gram; a text is the sum (bundling) of its n-gram vectors, and a
language's prototype is the sum over its training texts.  A text gets the
language whose prototype has the largest cosine with it.

Defined results
---------------
* NULL, empty or letterless text: ``und`` with score 0.
* Equal cosines: the smaller language name.  Negative cosine: score 0.
* NULL id: not held out and not learned from.  NULL language: not learned from.
* Repeated rows are scored one by one; every input row gives one output row.
* No training row at all: every text is ``und``.
* Extra columns stay out of the result and are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import U64, add_columns, mix, slices

UNDETERMINED = "und"
DIM = 1024                 # components of a vector
GRAM = 3                   # letters of an n-gram
MAX_LANGUAGES = 1000       # bound of what the driver holds: MAX_LANGUAGES x DIM sums
PIECE = 1 << 18            # letters encoded at once
GROUP = 128                # texts encoded at once
VECTORS = 1 << 12          # n-gram vectors held at once


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """The +1/-1 vector of each code point, from a hash of it alone."""
    words = mix(mix(codes.astype(U64) + U64(1))[:, None] + np.arange(1, dim // 64 + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def symbols(text: str | None) -> Iterator[np.ndarray]:
    """Code points of a lower-cased text in pieces; each run of other characters is one 0.

    A text begins and ends with 0; a piece repeats the last ``GRAM - 1``
    symbols of the one before, so that every n-gram stands in one piece.
    """
    if not text:
        return
    letter, tail, seen = _is_letter(), np.zeros(1, np.uint32), False
    for i in range(0, len(text), PIECE):
        s = np.frombuffer(text[i:i + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        s = np.where(letter[s], s, 0).astype(np.uint32)
        if i + PIECE >= len(text):
            s = np.append(s, np.uint32(0))
        whole = np.concatenate([tail, s])
        keep = np.ones(len(whole), bool)
        keep[len(tail):] = (s != 0) | (whole[len(tail) - 1:-1] != 0)
        whole = whole[keep]
        seen = seen or bool(s.any())
        if seen and len(whole) >= GRAM:
            yield whole
        tail = whole[-(GRAM - 1):]


def grams(owner: np.ndarray, syms: np.ndarray, first: np.ndarray, dim: int):
    """Distinct n-grams of concatenated pieces, ``VECTORS`` of them at a time: (owner, n-gram index) pairs and the n-gram vectors.

    ``first`` marks symbols that begin a piece: no n-gram may run over one.
    """
    letters, at = np.unique(syms, return_inverse=True)
    n, size = len(syms) - GRAM + 1, len(letters)
    key = np.zeros(n, np.int64)
    ok = np.ones(n, bool)
    for j in range(GRAM):
        key = key * size + at[j:n + j]
        if j:
            ok &= ~first[j:n + j]
    key, own = key[ok], owner[:n][ok]
    if size ** GRAM <= 1 << 22:
        there = np.zeros(size ** GRAM, bool)
        there[key] = True
        distinct = np.flatnonzero(there)
        index = np.cumsum(there, dtype=np.int64)[key] - 1
    else:
        distinct, index = np.unique(key, return_inverse=True)
    base = letter_vectors(letters, dim)
    for lo in range(0, len(distinct), VECTORS):
        rest = distinct[lo:lo + VECTORS]
        vectors = np.ones((len(rest), dim), np.int8)
        for j in range(GRAM):                   # the last letter is not rotated, the one before by one, ...
            vectors *= np.roll(base, j, axis=1)[rest % size]
            rest = rest // size
        here = slice(None) if len(distinct) <= VECTORS else (index >= lo) & (index < lo + VECTORS)
        yield own[here], index[here] - lo, vectors


def gram_count(text: Column) -> Column:
    """Number of n-grams of a text with a letter: letters and the gaps between their runs (see ``symbols``)."""
    return F.length(F.trim(F.regexp_replace(text, r"\P{L}+", " "))) + 3 - GRAM


def _pieces(texts) -> Iterator[tuple[int, np.ndarray]]:
    for k, t in enumerate(texts):
        for s in symbols(t):
            yield k, s


def _chunks(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces put together up to PIECE symbols and GROUP texts: owner, symbols, piece starts."""
    held, size, texts_in = [], 0, set()
    for k, s in _pieces(texts):
        if held and (size + len(s) > PIECE or len(texts_in | {k}) > GROUP):
            yield _joined(held)
            held, size, texts_in = [], 0, set()
        held.append((k, s))
        size += len(s)
        texts_in.add(k)
    if held:
        yield _joined(held)


def _joined(held):
    lengths = np.array([len(s) for _, s in held])
    first = np.zeros(lengths.sum(), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    return np.repeat(np.array([k for k, _ in held]), lengths), np.concatenate([s for _, s in held]), first


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM,
        max_languages: int = MAX_LANGUAGES) -> dict[str, np.ndarray]:
    """Prototype vector of each language over all rows of ``labelled``.

    Each task bundles its own rows; Spark adds the partial bundles per
    (language, component).  The driver gets languages x components sums, and
    more than ``max_languages`` languages are an error, not a cut.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")

    def bundle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(it):
            names, of = np.unique(np.array(b.column("lang").to_pylist(), str), return_inverse=True)
            for own, syms, first in _chunks(b.column("text").to_pylist()):
                for owner, index, vectors in grams(own, syms, first, dim):
                    for l in np.unique(of[owner]):
                        counts = np.bincount(index[of[owner] == l], minlength=len(vectors)).astype(np.float32)
                        part = counts @ vectors.astype(np.float32)      # exact: a chunk has under 2^24 symbols
                        sums[names[l]] = sums.get(names[l], 0) + part.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([str(n) for n in sums], pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))],
                                             names=["lang", "parts"])

    parts = rows.mapInArrow(bundle, "lang string, parts array<long>").select("lang", F.posexplode("parts").alias("at", "v"))
    got = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).limit((max_languages + 1) * dim).collect()
    out: dict[str, np.ndarray] = {}
    for r in got:
        out.setdefault(r["lang"], np.zeros(dim))[r["at"]] = r["v"]
    if len(out) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return out


def identify(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred",
             score: str = "score", drop: list[str] = (), dim: int = DIM) -> DataFrame:
    """``docs`` (without ``drop``) plus the predicted language and its cosine, 0 to 1."""
    names = sorted(model)
    protos = np.array([model[n] / max(np.linalg.norm(model[n]), 1e-300) for n in names]).reshape(len(names), dim)

    def work(texts: list[str | None]) -> list:
        if not names:
            return [[UNDETERMINED] * len(texts), np.zeros(len(texts))]
        dots, norms, seen = np.zeros((len(texts), len(names))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        part, last = np.zeros(dim), -1              # of a text that runs over several chunks
        for own, syms, first in _chunks(texts):
            lo, n = own[0], own[-1] - own[0] + 1
            bundles = np.zeros((n, dim))
            for owner, index, vectors in grams(own, syms, first, dim):
                counts = np.bincount((owner - lo) * len(vectors) + index, minlength=n * len(vectors)).reshape(n, -1)
                bundles += counts.astype(np.float32) @ vectors.astype(np.float32)
                seen[lo:lo + n] |= np.bincount(owner - lo, minlength=n) > 0
            if lo == last:
                bundles[0] += part
            part, last = bundles[-1], own[-1]
            dots[lo:lo + n] = bundles @ protos.T
            norms[lo:lo + n] = np.sqrt((bundles ** 2).sum(1))
        cosine = dots / np.maximum(norms, 1e-300)[:, None]
        best = cosine.argmax(1)
        return [np.where(seen, np.array(names, object)[best], UNDETERMINED),
                np.where(seen, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)]

    return add_columns(docs, [text], [pred, score], ["string", "double"], work, drop)
