"""Large and awkward inputs: wide ids, several texts of one id, many spans, many letters, brute-force models."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from clickscore.llm import chat, langid, neardup, packing, secrets, toxicity
from clickscore.llm.common import running_max, stored
from tests.llm.test_llm_edges import brute_groups, frame, letters, words


# -- 1 language vectors ------------------------------------------------------------------

def brute_bundle(text):
    spaced = " " + re.sub(r"[^\w]|[\d_]", " ", text.lower()) + " "
    syms = [0 if c == " " else ord(c) for c in re.sub(" +", " ", spaced)]
    vector = lambda c, j: np.roll(langid.letter_vectors(np.array([c], np.uint32), langid.DIM)[0].astype(np.int64), j)
    total = np.zeros(langid.DIM, np.int64)
    for i in range(len(syms) - 2):
        total += vector(syms[i], 2) * vector(syms[i + 1], 1) * vector(syms[i + 2], 0)
    return total


def test_language_scores_equal_brute_force(spark):
    learn = [("en", "the cat sat on the mat"), ("de", "die katze sitzt auf der matte"), ("en", "a dog ran"), ("ru", "кошка сидит")]
    model = langid.fit(spark.createDataFrame([(t, l) for l, t in learn], "text string, lang string"))
    protos = {l: sum(brute_bundle(t) for x, t in learn if x == l) for l in ("en", "de", "ru")}
    assert all((model[l] == protos[l]).all() for l in protos)
    texts = ["the matte cat", "Кошка!", "hund, katze; dog 12", "x"]
    for r in langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect():
        v = brute_bundle(r.text)
        cosine = {l: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for l, p in protos.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert r.lang_pred == best and abs(r.score - max(0, cosine[best])) < 1e-6


def test_language_vectors_are_made_in_slices(monkeypatch):
    r = random.Random(4)
    text = " ".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(6)) for _ in range(300))
    (own, syms, first), = langid._chunks([text])
    whole = sum(np.bincount(i, minlength=len(v)) @ v.astype(np.int64) for _, i, v in langid.grams(own, syms, first, langid.DIM))
    monkeypatch.setattr(langid, "VECTORS", 50)
    parts = [(np.bincount(i, minlength=len(v)) @ v.astype(np.int64), len(v)) for _, i, v in langid.grams(own, syms, first, langid.DIM)]
    assert (sum(p for p, _ in parts) == whole).all() and max(n for _, n in parts) == 50


# -- 5 toxicity ----------------------------------------------------------------------------

def test_toxic_terms_equal_brute_force(spark):
    r = random.Random(8)
    texts = [(i % 3 == 0, " ".join(letters(25, i, 120) + (["vilest", "vile", "scum½kill", "x²"] if i % 3 == 0 and r.random() < 0.8 else []))) for i in range(150)]
    found = [(t, toxicity._read([s])[0][0]) for t, s in texts]
    got = {x.term: x.score for x in toxicity._terms(spark.createDataFrame([(int(t), w) for t, w in found], "toxic int, words array<string>"), 0.1, 1.5).collect()}
    tox, other = Counter(w for t, ws in found if t for w in ws), Counter(w for t, ws in found if not t for w in ws)
    nt, no = sum(tox.values()), sum(other.values())
    units = Counter(), Counter()
    for side, counts in zip(units, (tox, other)):
        for w, n in counts.items():
            for u in [w] + [w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k]:
                side[u] += n
    want = {}
    for u in units[0].keys() | units[1].keys():
        t, o = units[0][u], units[1][u]
        p, mass = 0.1 * (t + o), 0.1 * (nt + no)
        score = math.log((t + p) / max(nt + mass - t - p, 0.5)) - math.log((o + p) / max(no + mass - o - p, 0.5))
        if abs(score / math.sqrt(1 / (t + p) + 1 / (o + p))) >= 1.5:
            want[u] = score
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)
    assert {"vilest", "scum½kill", "x²"} <= want.keys()                      # learned as scoring reads them


def test_toxic_evidence_and_curve():
    model = toxicity.Model({"bad": 2.0, "good": -1.0}, decay=0.7, log_k=-1.5)
    text = "good good bad bad x bad good good good good good bad"
    best, total, found = toxicity.evidence(text, toxicity.Scores(model.terms), model)
    v = [{"bad": 2.0, "good": -1.0}.get(w, toxicity.NEUTRAL) for w in text.split()]
    gains = [0.7 * s - (-1.5 + math.log(len(v))) for s in (sum(v[2:6]), v[11])]      # the maximal segments
    kept = [g for g in gains if g > 0]
    assert abs(best - max(kept)) < 1e-9 and abs(total - sum(kept)) < 1e-9 and len(found) == len(kept)
    pairs = [(-1.0, 0.6), (-0.1, 0.3), (2.0, 0.1)]
    x = toxicity._decay(pairs)
    assert x > 0 and abs(sum(p * math.exp(x * s) for s, p in pairs) - 1) < 1e-9
    r = np.random.default_rng(2)
    a = np.column_stack([np.ones(300), r.normal(size=(300, 2))])
    y = (r.random(300) < 1 / (1 + np.exp(-(a @ [0.3, 1.0, -2.0])))).astype(float)
    w = toxicity._curve(a, y)
    assert np.abs(a.T @ (1 / (1 + np.exp(-(a @ w))) - y) + w).max() < 1e-6           # stationary with ridge 1


def test_toxicity_learns_copies_once(spark):
    rows = [(i, "mild words here " + ("vile scum" if i % 2 else "nice day")) for i in range(40)] + [(100, "other words then"), (101, "vile talk then")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 0), (101, 1)], "doc_id long, toxic int")
    models = {tuple(sorted(toxicity.fit(frame(spark, r).repartition(n), labels).terms.items())) for r, n in ((rows, 1), (rows[::-1], 7))}
    assert len(models) == 1                                                # also whatever the layout


# -- 6 packing -------------------------------------------------------------------------------

def naive_best_fit(lengths, sizes, overhead):
    rest, bins, place = sum(lengths), [], []
    for n in lengths:
        rest -= n
        fit = [(size - used, b) for b, (size, used) in enumerate(bins) if size - used >= n]
        if fit:
            b = min(fit)[1]
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / max(1, min(s, n + rest)), -s))
            bins.append([size, 0])
            b = len(bins) - 1
        place.append((b, bins[b][1]))
        bins[b][1] += n
    return place, [min(s for s in sizes if s >= used) for _, used in bins]


@pytest.mark.parametrize("seed", range(8))
def test_packing_equals_naive_best_fit(seed):
    r = random.Random(seed)
    sizes = sorted(r.sample([16, 32, 48, 64, 128, 200], r.randrange(1, 5)))
    lengths = sorted((r.randrange(1, sizes[-1] + 1) for _ in range(r.randrange(1, 120))), reverse=True)
    cost, bins, offsets, capacity = packing.plan(np.array(lengths), sizes, 5)
    place, caps = naive_best_fit(lengths, sizes, 5)
    assert list(zip(bins.tolist(), offsets.tolist())) == place and capacity == caps and cost == sum(caps) + 5 * len(caps)


def test_packing_keeps_wide_ids(spark):
    rows = [(2 ** 60 + 1, "a b"), (2 ** 60 + 3, "c d e"), (None, "f"), (-2 ** 62 - 1, None)]
    got = packing.pack(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, len((t or "").split())) for i, t in rows)
    named = spark.createDataFrame([("a", "x y"), ("b", "z"), (None, "w w w")], "doc_id string, text string")
    assert Counter((r.doc_id, r.length) for r in packing.pack(named).collect()) == Counter([("a", 2), ("b", 1), (None, 3)])


# -- 7 secrets ---------------------------------------------------------------------------------

def test_linking_equals_brute_force(spark):
    r = random.Random(6)
    bits = ["user=bobby", "password=short1", "http://h.x/y", "token=abcdefghijklmnop", "AKIA" + "A" * 16, "pwd=abcd", "host=db.x.org", "x" * 30, "y " * 60, "z " * 110]
    rows = [(i % 50 if i % 9 else None, " ".join(r.choices(bits, k=r.randrange(1, 12)))) for i in range(80)]
    rows += rows[:20]
    parts = {(x.doc_id, x.key): x.all for x in secrets.parts(frame(spark, rows)).collect()}
    role = lambda k: "secret" if k in ("assign", "hex", "weak_secret") else "id" if k in ("access", "weak_id") else "endpoint"
    for x in secrets.find(frame(spark, rows)).collect():
        every = {(s.kind, s.start, s.end) for s in parts[x.doc_id, x.key]}
        want = set()
        for k, a, b in every:
            near = [role(q) for q, c, d in every if max(c - b, a - d) <= secrets.SCOPE]
            if k in ("assign", "access", "hex") or any((q == "secret") != (role(k) == "secret") for q in near):
                want.add((k, a, b))
        assert [(s.kind, s.start, s.end) for s in x.spans] == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_many_spans_in_one_text(spark):
    n = 100_000
    text = " ".join(f"{i:016x}" for i in range(n))
    x = secrets.find(frame(spark, [(1, text)]))
    row = x.select(F.size("spans").alias("n"), F.get("spans", F.lit(n - 1)).alias("s")).first()
    assert row.n == n and (row.s.start, row.s.end) == (17 * (n - 1), 17 * n - 1)
    clean = frame(spark, [(1, text)]).crossJoin(x.select(F.col("spans").alias("found"))).select(secrets.redact(F.col("text"), F.col("found"), "*")).first()[0]
    assert clean == " ".join("*" * n)
    rows = frame(spark, [(None, "user=bob password=short1 http://h.x/y")] * 3000)
    assert {x.c for x in secrets.find(rows).select(F.size("spans").alias("c")).collect()} == {3}


def test_running_max(spark):
    r = random.Random(1)
    rows = [([r.randrange(9999) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 4097, 9000)]
    for x in spark.createDataFrame(rows, "a array<int>").select("a", running_max(F.col("a")).alias("m")).collect():
        assert x.m == np.maximum.accumulate(np.array(x.a, int)).tolist()


def test_redaction_merges_what_overlaps(spark):
    r = random.Random(2)
    for _ in range(3):
        text = "".join(r.choices("abc😀 ", k=300))
        spans = [(k, k + r.randrange(1, 30)) for k in r.sample(range(270), 20)]
        hidden = sorted({p for a, b in spans for p in range(a, b)})
        runs = [p for p in hidden if p - 1 not in hidden and not any(b == p for _, b in spans)]
        want = "".join("*" if p in runs else "" if p in hidden else c for p, c in enumerate(text))
        got = spark.createDataFrame([(text, [("k", a, b) for a, b in spans])], "t string, s array<struct<kind:string,start:int,end:int>>")
        assert got.select(secrets.redact(F.col("t"), F.col("s"), "*")).first()[0] == want


# -- 10 near-duplicates and the pipeline ---------------------------------------------------------

def test_an_id_with_several_texts(spark):
    a, b, c = (" ".join(words(60, s, 9000)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (3, b + " end"), (4, c), (9, a + " end"), (9, None), (12, c + " x"), (20, ""), (20, c)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    by = {(x.doc_id, x.n_shingles): x.component_id for x in got if x.n_shingles}
    assert {by[k] for k in by if k[0] in (1, 3, 9)} == {1} and {by[k] for k in by if k[0] in (4, 12, 20)} == {4} and len(got) == len(rows)
    r = random.Random(9)
    rows = [(r.randrange(30), " ".join(words(40, r.randrange(25), 9000)[:r.choice((40, 39))])) for _ in range(60)]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == brute_groups(rows, 5, 80)
    named = spark.createDataFrame([("b", a), ("a", a + " end"), ("c", c)], "doc_id string, text string")
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(named).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_pipeline_knows_rows_by_id_and_text(spark):
    a, b, c = (" ".join(letters(40, s, 2000)) for s in (1, 2, 3))
    rows = [(1, a), (1, b), (None, c), (None, c), (None, c), (None, c + " end"), (5, a), (6, b), (6, b), (7, None), (7, None)]
    docs = stored(frame(spark, rows))
    got = [(x.doc_id, x.text) for x in pipeline.near_duplicates(spark, docs, "").collect()]
    assert Counter(got) in (Counter([(1, a), (1, b), (None, c), (7, None)]), Counter([(1, a), (1, b), (None, c + " end"), (7, None)]))
    hot = stored(frame(spark, [(2, c)] * 2000 + [(3, a)]))
    assert Counter((x.doc_id, x.text) for x in pipeline.near_duplicates(spark, hot, "").collect()) == Counter([(2, c), (3, a)])


# -- 8 token counts -----------------------------------------------------------------------------------

def test_flat_files_are_bounded(spark, tmp_path):
    import glob
    import os

    from clickscore.llm import tokencount
    rows = [(i, " ".join(words(60, i))) for i in range(300)] + [(None, "null id"), (900, None), (901, ""), (902, " ".join(words(30_000, 5)))]
    docs = frame(spark, rows).coalesce(1)
    tokencount.write_flat(docs, str(tmp_path / "flat"), file_bytes=20_000)
    files = glob.glob(str(tmp_path / "flat" / "part-*"))
    assert len(files) > 5 and sorted(map(os.path.getsize, files))[-2] < 40_000          # but for the one with the long text
    for block in (tokencount.BLOCK, 1000):
        got = tokencount.count(tokencount.blocks(spark, str(tmp_path / "flat"), block), block=block)
        whole = got.where("terminated")
        encoder = tokencount._encoder(open(tokencount.VOCABULARY, "rb").read())
        assert Counter(r.n_tokens for r in whole.collect()) == Counter(len(encoder.encode_ordinary(t or "")) for _, t in rows)
        assert got.where("not terminated").count() == 0


# -- 9 chat -------------------------------------------------------------------------------------------

def test_long_conversations_and_texts(spark):
    r = random.Random(3)
    rows = [(1, i, r.choice(["user", "assistant"]), f"turn {i} {chat.OPEN} \\e") for i in range(3000)]
    rows += [(2, 0, "user", "é😀" * 200_000 + chat.CLOSE), (2, 1, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.format_conversations(turns).select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()
    for conv in out:
        assert [(t.role, t.text) for t in conv.turns] == [(role, text) for i, _, role, text in rows if i == conv.conv_id]
    assert len(out) == 2
