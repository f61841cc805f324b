"""Fill-in-the-middle, token files and lexical ranking against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickscore.llm import fim, lexical, tokenfile
from clickscore.llm.common import shared_folder
from clickscore.llm.queries import QUERIES
from tests.conftest import SF01
from tests.llm.test_llm_edges import LONG, ODD, frame

MESSY = [(11, "é😀 naïve İstanbul 'twas 123 áb \x00 tab\tnew\nline\x1c\x85　end"), (12, "a"), (13, "<P> mark"), (14, "<S"), (15, "x<M>y"),
         (16, "😀" * 50), (17, "<" * 30 + "P" * 5), (18, "$1 \\ $2 {3}")] + [(100 + i, f"word{i} and {i} more, of text number {i}.") for i in range(60)]


# -- 11 fill-in-the-middle ------------------------------------------------------------

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, None, text
    d = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 20:
        return n, "spm", x, y, z, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", x, y, z, f"<P>{x}<S>{z}<M>{y}"


def test_fim_equals_brute_force(spark):
    rows = ODD + MESSY + [(200, "q" * 400_000), (201, "1 " * 200_000), (202, LONG)]
    made = fim.transform(frame(spark, rows))
    got = Counter((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back)
                  for r in made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect())
    assert got == Counter((i, *brute_fim(i, t), t or "") for i, t in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fim.transform(frame(spark, [])).count() == 0
    text_ids = spark.createDataFrame([("7", "ab cd"), ("x", "ab cd ef")], "doc_id string, text string")
    assert {(r.doc_id, r.output) for r in fim.transform(text_ids).collect()} == {(i, brute_fim(i, t)[-1]) for i, t in (("7", "ab cd"), ("x", "ab cd ef"))}


def test_fim_stays_in_the_jvm_without_a_shuffle(spark):
    plan = QUERIES["op11_fill_in_middle"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# -- 12 token files -----------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 1000, 70_000])
def test_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 49408, n), np.minimum(r.geometric(0.01, n), 49407), np.full(n, 7), np.arange(n) % 3, np.full(n, 49407)):
        payload = tokenfile.encode(ids, 49408)
        assert (tokenfile.decode(payload, n, 49408) == ids).all()
    if n == 70_000:
        assert len(payload) < n // 20 and len(tokenfile.encode(np.minimum(r.geometric(0.01, n), 49407), 49408)) < 1.2 * n


def test_context_mixing_learns_orders_one_and_two():
    r = np.random.default_rng(5)
    sizes = {}
    for order in (0, 1, 2):
        follows = r.integers(0, 2000, (2000 if order else 1) if order < 2 else 4_000_000)
        ids = np.zeros(60_000, np.int64)
        for i in range(2, len(ids)):
            if order == 0 or r.random() < 0.1:
                ids[i] = r.integers(0, 2000)
            else:
                ids[i] = follows[ids[i - 1]] if order == 1 else (ids[i - 2] * 31 + ids[i - 1] * 17 + 1) % 64
        sizes[order] = len(tokenfile.encode(ids, 49408))
    assert sizes[1] < 0.5 * sizes[0] and sizes[2] < 0.5 * sizes[0]


def test_crc_of_parts():
    r = random.Random(3)
    for _ in range(30):
        parts = [r.randbytes(r.choice((0, 1, 4, 100, 5000))) for _ in range(r.randrange(1, 5))]
        assert tokenfile.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import path
    return Tokenizer.from_file(path("word_bpe_49k.json"))


def brute_files(rows, library):
    out, at = [], 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [tokenfile.END]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


PARTED = ["", None, "it's IT'S we'Re they''re 's 's's x's!'s !'s ''s", "'", "'r", "'re", "'l", "s", "'é 'sé É't É É's", "<|endoftext|> x", "a<|ENDOFTEXT|>b<|endoftext|>c's",
          "H\u0331 \u1e96 E\u0301 x\u2260 \u226e <\u0338", "×÷ a×b c÷d À×À", "ß ẞ \u017f '\u017f İ I\u0307 ΑΣ ς", "a\x85b\xa0c d\x1ce\x1ff\x00g\x7fh", "12½34²Ⅷ", "日本語 's 12 日本's",
          "😀'sx😀", "a\r\n\x0b\x0c b", "'d've don't've", "</w> a</w>b <", "K a\u030a\u200bs \u0345a"]
SIGNS = [*"aAsStTrRevVmMlLdD'''' \t\n.!<|>19éÉ×ßÀÞÿ÷", "\u0301", "\u0338", "\xa0", "\x85", "\x1c", "\u017f", "İ", "½", "日", "😀", "<|endoftext|>", "<|EndOfText|>", "'s", "'re"]


def test_ids_of_pieces_equal_the_library(library, monkeypatch):
    tokens = tokenfile.Tokens(tokenfile._vocabulary(None))
    r = random.Random(12)
    texts = PARTED + ["".join(r.choice(SIGNS[:-14 * (i % 2) or None]) for _ in range(r.randrange(14))) for i in range(4000)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert tokens.parted and [x.tolist() for x in tokens.of(pa.array(texts))] == want
    monkeypatch.setattr(tokenfile, "LETTERS_AT_ONCE", 50)                   # texts over many slices; memo emptied again and again
    monkeypatch.setattr(tokenfile, "WORDS", 10)
    assert [x.tolist() for x in tokens.of(pa.array(["left out", *texts]).slice(1))] == want
    assert not list(tokens.of(pa.array([], pa.string()))) and [x.tolist() for x in tokens.of(pa.array([None, ""], pa.string()))] == [[], []]


def test_the_library_is_asked_once_for_a_piece(monkeypatch):
    tokens, asked = tokenfile.Tokens(tokenfile._vocabulary(None)), []
    ask = tokens.ask
    monkeypatch.setattr(tokens, "ask", lambda new: (asked.extend(new), ask(new)))
    list(tokens.of(pa.array(["Word, word.\nWORD\tword's", "Été word"])))
    list(tokens.of(pa.array(["été. Word"])))
    assert sorted(asked) == sorted(x.encode() for x in ("word", ",", ".", "'s", "été"))


def test_other_tokenizers_get_whole_texts():
    rules = json.loads(tokenfile._vocabulary(None))
    rules["pre_tokenizer"]["pretokenizers"] = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    data = json.dumps(rules).encode()
    tokens, texts = tokenfile.Tokens(data), ["some words, joined", None, "x"]
    assert not tokens.parted
    assert [x.tolist() for x in tokens.of(pa.array(texts))] == [Tokenizer.from_buffer(data).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_block_costs_its_own_vocabulary(monkeypatch):
    ids, asked, real = np.arange(3000) % 50 * 900, [], tokenfile.Model
    monkeypatch.setattr(tokenfile, "Model", lambda lanes, vocabulary: (asked.append(vocabulary), real(lanes, vocabulary))[1])
    assert (tokenfile.decode(tokenfile.encode(ids, 49408), len(ids), 49408) == ids).all()
    assert asked == [50, 50]


def test_token_files_equal_the_tokenizer(spark, library):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF01}/documents.parquet' ORDER BY doc_id").fetchall()
    got = sorted(tuple(r) for r in QUERIES["op12_token_files"](spark, SF01).collect())
    assert got == brute_files(rows, library)


def test_token_file_edges(spark, library):
    over = " ".join(f"{i % 977}" for i in range(450_000))                   # over the edge of a block
    rows = [(1, None), (2, ""), (3, "# ##"), (4, "<|endoftext|> x"), (5, over), (8, "x y")] + MESSY
    rows.sort()
    docs = frame(spark, rows)
    folder = shared_folder(spark)
    tokenfile.write(docs, folder)
    want = brute_files(rows, library)
    assert sorted(tuple(r) for r in tokenfile.documents(spark, folder).collect()) == want
    blocks = spark.read.parquet(folder)
    assert blocks.agg(F.max("n_ids")).first()[0] == tokenfile.LANES * tokenfile.STEPS and blocks.count() >= 2
    ids = {}
    for r in tokenfile.segments(spark, folder).orderBy("part", "first").collect():
        ids.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4"))
    assert all(zlib.crc32(np.concatenate(ids[i]).astype("<u4").tobytes()) == crc for i, _, _, crc in want)
    # NULL and repeated ids: every row is a document, NULL first; rows with one id may come in any order
    odd = frame(spark, ODD)
    got = tokenfile.round_trip(odd).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, n, c) for i, _, n, c in brute_files(ODD, library))
    assert tokenfile.round_trip(frame(spark, [])).count() == 0
    names = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    assert [r.doc_id for r in tokenfile.round_trip(names).orderBy("start").collect()] == ["a", "b"]


def test_damaged_block_is_noticed(spark):
    folder, bad = shared_folder(spark), shared_folder(spark)
    tokenfile.write(frame(spark, MESSY), folder)
    spark.read.parquet(folder).withColumn("payload", F.concat(F.lit(b"\x01"), F.expr("substring(payload, 2)"))).write.parquet(bad)
    with pytest.raises(Exception, match="is damaged"):
        tokenfile.documents(spark, bad).collect()


# -- 13 lexical ranking --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_rank(rows, items, k):
    docs = [(i, Counter(w), len(w)) for i, t in rows if (w := terms(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, c, n in docs:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def corpus(seed, n, size=60):
    r = random.Random(seed)
    return [(i, " ".join(f"W{r.randrange(size) ** 2 // size}" for _ in range(r.randrange(1, 40)))) for i in range(n)]


@pytest.mark.parametrize("block_terms", [200_000, 40])
def test_ranking_equals_brute_force(spark, monkeypatch, block_terms):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block_terms)
    docs = corpus(1, 120) + ODD + [(i, "w1 w2 w3") for i in range(500, 540)] + [(None, "w1 w2 w3"), (600, LONG), (601, "Ünter w1 Ü"), (602, "\x00 ,.")]
    items = corpus(2, 20) + [(70, None), (71, "  ,"), (72, "nothere"), (73, "w1 w2 W3"), (73, "w9"), (None, "w4 ünter"), (74, LONG), (75, "w1 w2 w3"), (76, "Ünter")]
    got = Counter(tuple(r) for r in lexical.rank(frame(spark, docs), spark.createDataFrame(
        [(i, t, 1, "x") for i, t in items], "item_id long, text string, rank int, terms string"), k=7).collect())
    assert got == brute_rank(docs, items, 7)


def test_ranking_of_nothing(spark):
    some, none = frame(spark, corpus(3, 5)), frame(spark, [])
    items = spark.createDataFrame([("a", "w1 w2")], "item_id string, text string")
    assert lexical.rank(none, items).count() == 0 and lexical.rank(some, items.where("false")).count() == 0
    assert {r.item_id for r in lexical.rank(some, items).collect()} == {"a"}


def test_shared_sums_are_the_items():
    r = random.Random(7)
    for trial in range(20):
        common = [f"c{i}" for i in range(12)]
        items = [sorted(set(r.sample(common, r.randrange(1, 12)) + [f"t{r.randrange(40)}" for _ in range(r.randrange(8))])) for _ in range(15)]
        if trial % 2:
            items += items[:4]
        names, class_of, merged, nodes = lexical.shared_sums(items)
        held = {c: {t for t, k in zip(names, class_of) if k == c} for c in set(class_of)}
        for at, (x, y) in enumerate(merged, len(held)):
            assert not held[x] & held[y] and max(x, y) < at
            held[at] = held[x] | held[y]
        assert [sorted(set().union(*(held[n] for n in x))) for x in nodes] == items
        assert all(sum(len(held[n]) for n in x) == len(t) for x, t in zip(nodes, items))         # no term twice
        assert len(merged) + sum(map(len, nodes)) <= sum(map(len, items))
