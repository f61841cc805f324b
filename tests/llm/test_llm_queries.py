"""Registered queries against their DuckDB text at sf0.01, and against brute force where SQL can't say them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

from clickscore.llm import tokencount
from clickscore.llm.queries import ORACLES, QUERIES
from scripts.check_oracle import rows_of
from tests.conftest import SF01

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_oracle(spark, con, key):
    df = QUERIES[key](spark, SF01)
    res = con.execute(ORACLES[key])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, res.fetchall())


def test_language_id_is_right_on_held_out_texts(spark, con):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF01).collect()}
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    assert got.keys() == lang.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [r.lang_pred == lang[i] for i, r in got.items() if r.held_out]
    assert sum(held) / len(held) > 0.97


def test_toxicity_orders_held_out_texts(spark, con):
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, SF01).collect()}
    toxic = dict(con.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, t) for i, t in toxic.items() if got[i].held_out]
    wins = [(a > b) + (a == b) / 2 for a, s in held if s for b, t in held if not t]
    assert sum(wins) / len(wins) > 0.95


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text: str):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_secret_scan_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_secret_scan"](spark, SF01).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        base = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i].spans.split(","))
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]


def test_packing_holds_every_word_once(spark, texts):
    rows = QUERIES["op6_best_fit_packing"](spark, SF01).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert dict(total) == words
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    filled = room = 0
    for b, rs in bins.items():
        if b is None:
            continue
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= rs[0].capacity and len({r.capacity for r in rs}) == 1
        filled, room = filled + at, room + rs[0].capacity
    assert filled / room > 0.98


def test_token_counts_equal_the_tokenizer(spark, texts):
    rows = QUERIES["op8_token_counts"](spark, SF01).collect()
    encode = tokencount._encoder(open(tokencount.VOCABULARY, "rb").read()).encode_ordinary
    assert Counter(r.n_tokens for r in rows) == Counter(len(encode(t or "")) for t in texts.values())
    assert all(r.terminated for r in rows)
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append(r)
    for rs in by_file.values():
        rs.sort(key=lambda r: r.doc_no)
        assert [r.doc_no for r in rs] == list(range(len(rs)))
        assert all(y.start == x.start + x.n_tokens + 1 for x, y in zip(rs, rs[1:]))
