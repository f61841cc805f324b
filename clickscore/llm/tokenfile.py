"""Token-id files: blocks coded by an adaptive context-mixing range coder.

Every document's ids, and an end id after each, follow one another in ascending
order of ``doc_id``; the stream is cut into blocks of at most ``LANES * STEPS``
ids.  A block starts with an empty model and carries a checksum, so any block is
decoded alone and a damaged one is noticed.

*Model.*  It works on the block's own vocabulary: an id's rank among the ids that the
block has.  The order-0 prediction is an adaptive count of every such id.  Order 1 and
order 2 each predict one id, the one that last held its ground after the
preceding id or the preceding two, with a confidence of 0 to 3.  For every pair of
confidences the hit rates seen so far in the block are the mixing weights, so an
id's frequency is the weighted sum of its three predictions.

*Coder.*  A block's ids are dealt to up to ``LANES`` lanes of consecutive ids that
advance together and share the model: a step predicts, codes and learns one id of
every lane with a few array operations.  Each lane has its own carry-less range
coder (64-bit state, 16-bit output words).  Order-0 counts enter the cumulative
table every ``REFRESH`` steps at first and every eighth of the steps later, the
other predictions after every step.

*File format.*  Parquet rows of one block each: ``part`` and ``block`` number,
``first`` (ids of the part before the block), ``n_ids``, ``vocabulary``,
``first_doc`` (ordinal of the block's first document in the part), ``doc_ids`` and
``sizes`` (ids in this block of each document), ``opens`` and ``closes`` (whether the
first document begins and the last one ends here), ``payload`` (which ids the block
has: a length and a compressed bit map; lane lengths, then the lanes' words, little
endian) and ``crc32`` of payload and sizes.  Parquet
splits between blocks, so a reader's memory is a few blocks, whatever the file.

Defined results
---------------
* NULL or empty text: the end id alone.
* NULL ids come first; rows with one id are ordered by a hash of their text, and
  every row is a document of its own.
* Very long texts run over any number of blocks.
* Empty table: no row.  Extra columns are not read.
* A block whose checksum doesn't fit raises ``ValueError``.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from clickscore.llm.common import shared_folder, slices, stored
from clickscore.operators._util import bounded_broadcast

END = 2                           # id after every document; texts may hold it too, so sizes are stored
LANES, STEPS = 4096, 256          # a block has LANES * STEPS ids at most
REFRESH = 4
GAIN = 32                         # what one occurrence adds to an id's order-0 count
PARTS = 1 << 8                    # resolution of the mixing weights
SLOTS = 1 << 17                   # order-2 contexts are hashed to so many slots
GUIDE = 16                        # bits of the decoder's guide to the order-0 counts
WORDS = 1 << 20                   # pieces of text after which a worker forgets their ids
LETTERS_AT_ONCE = 1 << 23         # bytes of text whose pieces are sought together
TOGETHER = 200                    # new pieces that the library gets as one text
MAX_PARTS = 1_000_000             # parts whose offsets are broadcast (two numbers each)
U64 = np.uint64


# -- model and coder (one block in memory) --------------------------------------

class Model:
    """Predictions of the next id of every lane, and what they learn from it.  Ids come as
    places (64 bits, for ``take``) and as values (32 bits, for comparisons)."""

    def __init__(self, lanes: int, vocabulary: int):
        self.size = vocabulary
        self.count = np.ones(vocabulary, np.int64)
        self.seen: list[np.ndarray] = []
        self.steps = 0
        self.refresh()
        self.table = [np.zeros(vocabulary + 1, np.int32), np.zeros(SLOTS, np.int32)]    # 4 * predicted id + confidence
        self.hits = np.tile(np.array([1, 1, 14], np.int64), (16, 1))    # order 2, order 1, neither
        self.last = np.full(lanes, vocabulary, np.int64)
        self.before = np.full(lanes, vocabulary, np.int64)

    def refresh(self) -> None:
        if self.seen:
            self.count += np.bincount(np.concatenate(self.seen), minlength=self.size) * GAIN
            self.seen = []
        self.below = np.zeros(self.size + 1, np.int64)
        self.above = self.below[1:]
        np.cumsum(self.count, out=self.above)
        self.total = int(self.below[-1])
        self.guide: np.ndarray | None = None

    def predict(self) -> None:
        """Mixing weights ``m0``, and the two predicted ids with what each adds to its frequency."""
        self.slot = [self.last, (self.before * 0x9E3779B1 + self.last * 0x85EBCA6B >> 7) & (SLOTS - 1)]
        self.held = [t.take(s, mode="clip") for t, s in zip(self.table, self.slot)]      # no place is out of range
        self.sure, self.guess = [h & 3 for h in self.held], [h >> 2 for h in self.held]
        self.bucket = (self.sure[1] << 2 | self.sure[0]).astype(np.int64)
        share = self.hits[:, :2] * (PARTS - 1) // self.hits.sum(axis=1, keepdims=True)
        self.m0 = (PARTS - share.sum(axis=1)).take(self.bucket, mode="clip")
        self.add = [(share[:, k] * self.total).take(self.bucket, mode="clip") for k in (1, 0)]

    def span(self, x: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative frequency and frequency of the ids ``x``, of ``PARTS * total``."""
        start, many = self.m0 * self.below.take(x, mode="clip"), self.m0 * self.count.take(x, mode="clip")
        self.right = [g == value for g in self.guess]
        for guess, add, right in zip(self.guess, self.add, self.right):
            start += add * (guess < value)
            many += add * right
        return start, many

    def lookup(self, q: np.ndarray) -> np.ndarray:
        """The ids whose order-0 spans hold ``q``: by a guide to every ``1 << shift``-th number, and a search for the rest."""
        if self.guide is None:
            self.shift = max(0, self.total.bit_length() - GUIDE)
            at = self.below + ((1 << self.shift) - 1) >> self.shift
            self.guide = np.repeat(np.arange(self.size, dtype=np.int32), np.diff(at))
        x = self.guide.take(q >> self.shift, mode="clip").astype(np.int64)
        if self.shift:
            rest = np.flatnonzero(self.above.take(x, mode="clip") <= q)
            x[rest] = np.searchsorted(self.below, q[rest], side="right") - 1
        return x

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose spans hold the cumulative frequencies ``at``."""
        (a1, a2), (add1, add2) = self.guess, self.add
        lo, hi = np.minimum(a1, a2).astype(np.int64), np.maximum(a1, a2).astype(np.int64)
        # products with conditions: a choice by np.where takes several times as long here
        add_lo, both = add1 + (add2 - add1) * (a2 < a1), add1 + add2
        end_lo, end_hi = self.above.take(lo, mode="clip"), self.above.take(hi, mode="clip")
        past_lo, past_hi = at >= self.m0 * end_lo + add_lo, at >= self.m0 * end_hi + both
        rest = at - add_lo * past_lo - (both - add_lo) * past_hi
        # exact in doubles: the quotient stays far below 2^53 / m0; what a prediction added belongs to its id's last number
        end = end_lo + (end_hi - end_lo) * past_lo + (self.total - end_hi) * past_hi
        return self.lookup(np.minimum((rest / self.m0).astype(np.int64), end - 1))

    def learn(self, x: np.ndarray, value: np.ndarray) -> None:
        """Learn the ids that ``span`` was asked for last."""
        r1, r2 = (r.view(np.uint8) for r in self.right)
        seen = np.bincount(self.bucket + (r2 << 5 | r1 << 4), minlength=64).reshape(4, 16)
        self.hits += np.array([seen[2] + seen[3], seen[1], seen[0]]).T
        told = value * 4 + 1
        for table, slot, held, sure, ok in zip(self.table, self.slot, self.held, self.sure, self.right):
            made = told + np.minimum(sure, 2) * ok
            made += ((sure > 1) & ~ok) * (held - 1 - made)                   # a sure one only loses confidence
            table[slot] = made
        self.before, self.last = self.last, x
        self.seen.append(x)
        self.steps += 1
        if len(self.seen) >= max(REFRESH, self.steps // 8):
            self.refresh()

    def keep(self, n: int) -> None:
        """Only the first ``n`` lanes have another id."""
        self.before, self.last = self.before[:n], self.last[:n]


def deal(n: int) -> np.ndarray:
    """Sizes of the lanes that ``n`` ids are dealt to, not increasing."""
    lanes = max(1, min(LANES, -(-n // STEPS)))
    return n // lanes + (np.arange(lanes) < n % lanes)


TOP, BOTTOM = U64(48), U64(1 << 40)      # PARTS * Model.total stays below 2^34, so a width holds every frequency


def _narrow(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose highest word is settled (or must be, so that their widths are cut)."""
    settled = (low ^ (low + width)) >> TOP == 0
    go = np.flatnonzero(settled | (width < BOTTOM))
    tight = go[~settled[go]]
    if len(tight):
        width[tight] = (~low[tight] + U64(1)) & (BOTTOM - U64(1))
    return go


def _rows(n: int) -> list[tuple[slice, slice, int]]:
    """For the longer lanes and the others: which lanes, which of the ``n`` ids, how many a lane."""
    sizes = deal(n)
    more = int((sizes > sizes[-1]).sum())
    long, short = int(sizes[0]), int(sizes[-1])
    return [(slice(0, more), slice(0, more * long), long), (slice(more, len(sizes)), slice(more * long, n), short)]


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """The payload of a block of ``ids``: which ids it has, and the lanes of their ranks among these, so that the
    model's tables are as small as the block's own vocabulary."""
    present = np.zeros(vocabulary, bool)
    present[ids] = True
    head = zlib.compress(np.packbits(present).tobytes())
    ranks = np.cumsum(present, dtype=np.int32) - 1
    return np.array([len(head)], "<u4").tobytes() + head + encode_lanes(ranks[ids], int(present.sum()))


def decode(payload: bytes, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids of a block."""
    start = 4 + int(np.frombuffer(payload, "<u4", 1)[0])
    alphabet = np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(payload[4:start]), np.uint8), count=vocabulary))
    return alphabet[decode_lanes(payload[start:], n_ids, len(alphabet))]


def encode_lanes(ids: np.ndarray, vocabulary: int) -> bytes:
    """Lane lengths and lanes of 32-bit ``ids`` below ``vocabulary``."""
    sizes = deal(len(ids))
    lanes = len(sizes)
    dealt = np.zeros((int(sizes[0]), lanes), np.int32)                      # a row for each step
    for which, part, each in _rows(len(ids)):
        dealt[:each, which] = ids[part].reshape(-1, each).T if each else 0
    model = Model(lanes, vocabulary)
    low, width = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    who, words = [], []
    for step, value in enumerate(dealt):
        n = lanes if step < sizes[-1] else int((sizes > step).sum())
        model.keep(n)
        value = value[:n]
        x = value.astype(np.int64)
        model.predict()
        r = width[:n] // U64(PARTS * model.total)
        start, many = model.span(x, value)
        lo, wi = low[:n] + r * start.view(U64), r * many.view(U64)
        go = _narrow(lo, wi)
        while len(go):
            l, w = lo[go], wi[go]
            who.append(go)
            words.append(l >> TOP)
            l <<= U64(16)
            w <<= U64(16)
            more = _narrow(l, w)
            lo[go], wi[go] = l, w
            go = go[more]
        low[:n], width[:n] = lo, wi
        model.learn(x, value)
    # a value inside the last interval with as few words as will do; the reader goes on with zeros
    value, count = low, np.full(lanes, 4)
    for k in (3, 2, 1):
        unit = U64(1 << 64 - 16 * k)
        up = (low + (unit - U64(1))) & ~(unit - U64(1))
        fits = up - low < width
        value, count = np.where(fits, up, value), np.where(fits, k, count)
    for k in range(4):
        at = np.flatnonzero(count > k)
        who.append(at)
        words.append(value[at] >> U64(48 - 16 * k) & U64(0xFFFF))
    who, words = np.concatenate(who), np.concatenate(words)
    words |= (who << 48 | np.arange(len(who)) << 16).view(U64)              # lane, number, word: LANES fit in 16 bits
    words.sort()
    return np.bincount(who, minlength=lanes).astype("<u4").tobytes() + words.astype("<u2").tobytes()


def decode_lanes(payload: bytes, n_ids: int, vocabulary: int) -> np.ndarray:
    """The ids that ``encode_lanes`` got."""
    sizes = deal(n_ids)
    lanes = len(sizes)
    lengths = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(payload, "<u2", offset=4 * lanes), np.uint16(0))
    ends = np.cumsum(lengths)
    at = ends - lengths

    def take(which):
        i = at[which]
        at[which] = i + 1
        return (words.take(i, mode="clip") * (i < ends[which])).astype(U64)

    every = np.arange(lanes)
    low, width, code = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64), np.zeros(lanes, U64)
    for _ in range(4):
        code = (code << U64(16)) | take(every)
    dealt = np.zeros((int(sizes[0]), lanes), np.int32)
    model = Model(lanes, vocabulary)
    for step in range(len(dealt)):
        n = lanes if step < sizes[-1] else int((sizes > step).sum())
        model.keep(n)
        model.predict()
        total = PARTS * model.total
        r = width[:n] // U64(total)
        x = model.find(np.minimum((code[:n] - low[:n]) // r, U64(total - 1)).view(np.int64))
        value = x.astype(np.int32)
        start, many = model.span(x, value)
        lo, wi, co = low[:n] + r * start.view(U64), r * many.view(U64), code[:n]
        go = _narrow(lo, wi)
        while len(go):
            l, w = lo[go] << U64(16), wi[go] << U64(16)
            co[go] = (co[go] << U64(16)) | take(go)
            more = _narrow(l, w)
            lo[go], wi[go] = l, w
            go = go[more]
        low[:n], width[:n], code[:n] = lo, wi, co
        dealt[step, :n] = value
        model.learn(x, value)
    out = np.zeros(n_ids, np.int32)
    for which, part, each in _rows(n_ids):
        out[part] = dealt[:each, which].T.reshape(-1)
    return out


# -- checksums -------------------------------------------------------------------

POLYNOMIAL = 0xEDB88320           # fixed value: crc32's, lowest power in the highest bit


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo crc32's."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a text from (length in bytes, crc32) of its consecutive parts."""
    crc = 0
    for length, part in parts:
        shift, power, bits = 1 << 31, 1 << 23, length       # x^0, x^8
        while bits:
            if bits & 1:
                shift = _times(shift, power)
            power, bits = _times(power, power), bits >> 1
        crc = _times(crc, shift) ^ part
    return crc


def id_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def block_crc(payload: bytes, sizes: list[int]) -> int:
    return zlib.crc32(np.array(sizes, "<u4").tobytes(), zlib.crc32(payload))


# -- files -------------------------------------------------------------------------

LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"           # of Latin-1, in UTF-8
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"      # fixed value: how the known tokenizer cuts normalised text
PLAIN = re.compile(rb"'(?:[stmd]|re|ve|ll)|" + LETTERS + rb"|[0-9]|[\x00-\x08\x0e-\x1f!-/:-@[-`{-\x7f]+").fullmatch
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)

_kinds, _lower = np.full(256, MARK, np.uint8), np.arange(256, dtype=np.uint8)
_kinds[[32, *range(9, 14)]], _kinds[48:58], _kinds[65:91], _kinds[97:123], _kinds[128:] = SPACE, DIGIT, LETTER, LETTER, OTHER
_lower[65:91] += 32
KINDS, LOWER = _kinds.tobytes(), _lower.tobytes()


def pieces(raw: np.ndarray, starts: np.ndarray, added: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts (UTF-8, one after another, beginning at ``starts``) where the tokenizer parts them: their bytes without white
    space and with ASCII and Latin-1 letters in lower case, the pieces' places there, and each text's first piece.
    A word that holds another character, or what ``added`` finds, is one piece, left as it is."""
    data = raw.tobytes()
    kind, low = (np.frombuffer(bytearray(data.translate(t)), np.uint8) for t in (KINDS, LOWER))      # faster than by an index
    lead = np.flatnonzero(raw[:-1] == 0xC3)                                  # the lead byte of U+00C0 to U+00FF
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]           # no letters: the signs of times and division
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[raw[lead + 1] < 0x9F] + 1
    low[upper] += 0x20
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[starts] = True
    part = fresh[:-1].copy()
    part[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    # a contraction at the beginning of a piece is a piece; an apostrophe within a run of marks is just one of them
    quote = np.flatnonzero((raw == 0x27) & part)
    after = np.concatenate([low, np.zeros(2, np.uint8)])
    one, two = after[quote + 1], after[quote + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)      # re, ve, ll
    many = np.where(short, 1, np.where(long & ~fresh[np.minimum(quote + 2, len(raw))], 2, 0)) * ~fresh[quote + 1]
    quote, many = quote[many > 0], many[many > 0]
    part[quote + 1] = False
    ends = quote + many + 1
    part[ends[ends < len(raw)]] = True
    odd = np.flatnonzero(kind == OTHER)
    if added is not None:
        odd = np.concatenate([odd, [m.start() for m in added.finditer(low.tobytes())]]).astype(np.int64)
    if len(odd):
        filled = kind != SPACE
        begin = filled & fresh[:-1]
        begin[1:] |= filled[1:] & ~filled[:-1]
        begin = np.flatnonzero(begin)
        words = np.unique(np.searchsorted(begin, odd, side="right") - 1)
        stop = np.flatnonzero(~filled | fresh[:-1])
        last = np.append(stop, len(raw))[np.searchsorted(stop, begin[words], side="right")]
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[begin[words]] += 1
        np.subtract.at(inside, last, 1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        part[inside] = False
        part[begin[words]] = True
        low = np.where(inside, raw, low)
    space = kind == SPACE
    part &= ~space
    marks = (part | space.view(np.uint8) << 1).tobytes().translate(None, b"\x02")          # without white space, faster than by a mask
    low = np.frombuffer(low.tobytes().translate(None, b" \t\n\v\f\r"), np.uint8)
    return low, np.flatnonzero(np.frombuffer(marks, bool)), np.searchsorted(np.flatnonzero(part), starts)


class Tokens:
    """Texts' ids.  The known tokenizer never joins what white space, or a change between letters, digits and marks, parts,
    so the ids of a text are those of its pieces; the library is asked for each new piece once.  With other rules
    it is asked for every text."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.known = Tokenizer.from_buffer(data), {}
        rules = json.loads(data)
        added = rules.get("added_tokens") or []
        self.parted = (
            [{k: v for k, v in r.items() if k in ("type", "pattern", "content")} for r in (rules.get("normalizer") or {}).get("normalizers", [])]
            == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
            and [(r["type"], r.get("pattern"), r.get("behavior"), r.get("invert"), r.get("add_prefix_space"), r.get("use_regex"))
                 for r in (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])]
            == [("Split", {"Regex": SPLIT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            and rules["model"]["type"] == "BPE" and rules["model"].get("end_of_word_suffix") == "</w>" and not rules["model"].get("dropout")
            and not (rules.get("truncation") or rules.get("padding") or rules.get("post_processor"))
            and all(a["content"].isascii() and not (set(a["content"]) & set(" \t\n\v\f\r") or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in added))
        self.added = re.compile(b"|".join(re.escape(a["content"].lower().encode()) for a in added)) if added else None
        if self.parted:
            # plain pieces are normalised and cut already: the same model, without those two steps
            from tokenizers import pre_tokenizers
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            ascii_, latin = [level.pre_tokenize_str(chr(c))[0][0] for c in range(128)], [level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)]
            ascii_[32] = " "
            none = "\ufffe"                             # bytes that plain pieces don't have
            self.byte_signs = "".join(ascii_ + [c[1] for c in latin] + [none] * 3 + [latin[0][0]] + [none] * 60)
            self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.closes[[i for t, i in rules["model"]["vocab"].items() if t.endswith("</w>")]] = True

    @staticmethod
    @lru_cache(1)
    def held(data: bytes) -> Tokens:
        """One per Python worker, so that what a task has asked serves the next one."""
        return Tokens(data)

    def ask(self, new: list[bytes]) -> None:
        """Learn new pieces: plain ones many at a time, since each ends with an id that closes a word."""
        plain, rest = [], []
        for w in new:
            (plain if PLAIN(w) else rest).append(w)
        for i in range(0, len(plain), TOGETHER):
            some = plain[i:i + TOGETHER]
            text = codecs.charmap_decode(b" ".join(some), "strict", self.byte_signs)[0]
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(some):
                raise ValueError("pieces and words differ")
            data, ends = ids.tobytes(), ends.tolist()
            self.known.update(zip(some, [data[a:b] for a, b in zip([0, *ends], ends)]))
        for w, made in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            self.known[w] = np.array(made.ids, np.uint32).tobytes()

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; NULL has none."""
        if not self.parted:
            for t in texts.to_pylist():
                yield np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32)
            return
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first = 0
        while first < len(texts):                       # texts of LETTERS_AT_ONCE bytes, or a longer one
            last = max(first + 1, int(np.searchsorted(at, at[first] + LETTERS_AT_ONCE, side="right")) - 1)
            if at[first] == at[last]:
                yield from [np.zeros(0, np.uint32)] * (last - first)
            else:
                raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[first]:at[last]]
                yield from self._of(raw, at[first:last] - at[first])
            first = last

    def _of(self, raw: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        low, places, firsts = pieces(raw, starts, self.added)
        edges = pa.py_buffer(np.append(places, len(low)).astype(np.int32))
        words = pa.BinaryArray.from_buffers(pa.binary(), len(places), [None, edges, pa.py_buffer(low)]).dictionary_encode()
        bounds = np.frombuffer(words.dictionary.buffers()[1], np.int32)[:len(words.dictionary) + 1].tolist()
        data = words.dictionary.buffers()[2].to_pybytes() if len(words) else b""
        names = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.known) > WORDS:
            self.known.clear()
        known = self.known
        found = [known.get(w) for w in names]
        self.ask([w for w, f in zip(names, found) if f is None])
        found = [known[w] if f is None else f for w, f in zip(names, found)]
        which = words.indices.to_numpy()
        ids, sizes = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int32, len(found)) // 4
        begins, sizes = (np.cumsum(sizes, dtype=np.int32) - sizes)[which], sizes[which]
        ends = np.cumsum(sizes, dtype=np.int32)                             # a text has fewer than 2^31 bytes, and ids
        place = np.repeat(begins - (ends - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        cuts = np.concatenate([[0], ends])[firsts]
        return np.split(ids[place], cuts[1:])


def _vocabulary(path: str | None) -> bytes:
    if path is None:
        from public_tokenizers import path as place
        path = place("word_bpe_49k.json")
    with open(path, "rb") as f:
        return f.read()


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
          end: int = END) -> None:
    """Write the texts' ids to files in ``folder``, parts in ascending order of ``doc_id``."""
    data = _vocabulary(vocabulary)                      # a few MB; Spark broadcasts it with the task
    kind = docs.schema[doc_id].dataType
    schema = (f"part int, block int, first bigint, n_ids int, vocabulary int, first_doc bigint, doc_ids {ArrayType(kind).simpleString()},"
              " sizes array<int>, opens boolean, closes boolean, payload binary, crc32 bigint")
    ids_type = pa.list_(to_arrow_type(kind))

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, room = TaskContext.get().partitionId(), LANES * STEPS
        tokens = Tokens.held(data)
        size = max(tokens.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        block, first, doc_no, first_doc = 0, 0, 0, 0
        names, sizes, pieces, have, opens = [], [], [], 0, True

        def made(closes: bool) -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            payload = encode(ids, size)
            cells = [part, block, first, len(ids), size, first_doc, names, sizes, opens, closes, payload, block_crc(payload, sizes)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), ids_type, pa.list_(pa.int32()),
                     pa.bool_(), pa.bool_(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)],
                                              names=[f.split()[0] for f in schema.split(", ")])

        for b in it:
            for name, ids in zip(b.column(0).to_pylist(), tokens.of(b.column(1))):
                rest = np.append(ids, np.uint32(end))
                while len(rest):
                    piece, rest = rest[: room - have], rest[room - have:]
                    names.append(name)
                    sizes.append(len(piece))
                    pieces.append(piece)
                    have += len(piece)
                    if have == room:
                        yield made(not len(rest))
                        block, first, first_doc, opens = block + 1, first + have, doc_no + (not len(rest)), not len(rest)
                        names, sizes, pieces, have = [], [], [], 0
                doc_no += 1
        if have:
            yield made(True)

    order = ["doc_id", "tie", "row"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(work, schema).write.option("compression", "none").parquet(folder)


def segments(spark: SparkSession, folder: str, crc: bool = False) -> DataFrame:
    """Decode the files: a row for each document's ids in each block, with ``part``, ``doc_no`` (ordinal in the part),
    ``doc_id``, ``opens`` and ``closes`` (whether the document begins and ends here), ``first``, ``n_ids`` and ``ids``
    (32-bit little endian), or with ``crc`` only their crc32."""
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = f"part int, doc_no bigint, doc_id {kind.simpleString()}, opens boolean, closes boolean, first bigint, n_ids int, {'crc bigint' if crc else 'ids binary'}"

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1):
            r = {n: c[0].as_py() for n, c in zip(b.schema.names, b.columns) if n != "doc_ids"}
            if block_crc(r["payload"], r["sizes"]) != r["crc32"]:
                raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
            ids = decode(r["payload"], r["n_ids"], r["vocabulary"]).astype("<u4")
            sizes = np.array(r["sizes"], np.int32)
            n, ends = len(sizes), np.cumsum(sizes, dtype=np.int64)
            opens, closes = np.ones(n, bool), np.ones(n, bool)
            opens[0], closes[-1] = r["opens"], r["closes"]
            names = b.column(b.schema.get_field_index("doc_ids"))
            at, data = np.concatenate([[0], ends * 4]).astype(np.int32), ids.tobytes()
            if crc:
                cut = pa.array([zlib.crc32(data[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())
            else:
                cut = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["part"], np.int32)), pa.array(r["first_doc"] + np.arange(n)), names.flatten(), pa.array(opens),
                 pa.array(closes), pa.array(r["first"] + ends - sizes), pa.array(sizes), cut],
                names=["part", "doc_no", "doc_id", "opens", "closes", "first", "n_ids", "crc" if crc else "ids"])

    return blocks.mapInArrow(work, schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files."""
    found = stored(segments(spark, folder, crc=True))                   # read twice below, decoded once
    whole = F.col("opens") & F.col("closes")
    one = found.where(whole).select("part", "doc_id", "first", F.col("n_ids").cast("bigint").alias("n"), "crc")
    # a document that runs over blocks: at most two segments of a block take part, so a block is shuffled as two short rows
    cut = found.where(~whole).groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n_ids").alias("n"),
        F.array_sort(F.collect_list(F.struct("first", "n_ids", "crc"))).alias("parts"))
    join = F.udf(lambda parts: joined_crc([(4 * p["n_ids"], p["crc"]) for p in parts]), "bigint")
    both = one.union(cut.select("part", "doc_id", "first", "n", join("parts").alias("crc")))
    parts = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("of"))           # one row a file
    before = F.sum("of").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = bounded_broadcast(parts.select("part", F.coalesce(before, F.lit(0)).alias("offset")), MAX_PARTS)
    return both.join(offsets, "part").select("doc_id", (F.col("offset") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"),
                                             F.col("crc").alias("ids_crc32"))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what is read back from them."""
    folder = shared_folder(docs.sparkSession)
    write(docs, folder, doc_id, text, vocabulary, end)
    return documents(docs.sparkSession, folder)
