"""The pipeline against a brute-force version on a small corpus."""

from __future__ import annotations

import random
import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from clickscore.llm import langid
from clickscore.llm.common import stored
from tests.conftest import SF01
from tests.llm.test_llm_edges import ASSIGN_MIN, base_secret_text, brute_groups, brute_hits, letters

LONG = " ".join(letters(60_000, 1, 2000))
ROWS = ([(i, " ".join(letters(40, i, 2000))) for i in range(30)]
        + [(100, " ".join(letters(40, 3, 2000))), (101, " ".join(letters(40, 3, 2000)[:39] + ["end"])), (102, "12 34 %&"), (103, None), (104, ""),
           (105, "wab wbc: password=abcdefghijkl0123 wde wabc"), (106, LONG), (7, " ".join(letters(40, 7, 2000))),
           (None, "wab wbc wcd wde")])
ITEMS = [(0, " ".join(letters(40, 5, 2000)[10:25])), (1, None)]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in ROWS],
                                 "doc_id long, text string, lang string, source string, n_chars long, digest string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    got = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        got[name] = docs.collect()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "digest"]
    rows = [(i, t) for i, t in ROWS if t and any(c.isalpha() for c in t)]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text) for r in got["language_id"]), key=key) == sorted(rows, key=key)
    groups = {i: c for i, _, c in brute_groups(rows, 5, 80)}
    rows = sorted({(i, t) for i, t in rows if i is None or groups[str(i)] == str(i)}, key=key)      # one row of a repeated id
    assert sorted(((r.doc_id, r.text) for r in got["near_duplicates"]), key=key) == rows
    hit = {i for i, _, n, _ in brute_hits(rows, ITEMS) if n}
    rows = [(i, t) for i, t in rows if str(i) not in hit]
    assert hit == {"5"} and sorted(((r.doc_id, r.text) for r in got["decontamination"]), key=key) == rows
    rows = [(i, base_secret_text(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.text) for r in got["redacted_secrets"]), key=key) == rows
    assert all(r.n_chars == len(r.text) for r in got["redacted_secrets"])
    total = {}
    for r in got["best_fit_packing"]:
        total[str(r.doc_id)] = total.get(str(r.doc_id), 0) + r.length
    assert total == {str(i): len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows}
    again = pipeline.run(spark, str(tmp_path))
    assert again.count() == len(got["best_fit_packing"]) and ASSIGN_MIN == 12 and langid.UNDETERMINED == "und"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_drops_what_it_never_learned(spark):
    learned = spark.read.parquet(f"{SF01}/documents.parquet")
    r = random.Random(11)
    alphabets = {"cyrillic": [chr(c) for c in range(0x430, 0x450)], "cjk": [chr(c) for c in range(0x4E00, 0x5A00)],
                 "latin": list("abcdefghijklmnopqrstuvwxyz")}
    noise = [(f"{k} {n} {i}", " ".join("".join(r.choices(a, k=r.randint(3, 8))) for _ in range(n)))
             for k, a in alphabets.items() for n in (12, 60, 200) for i in range(20)]
    clean = [t for (t,) in learned.where("length(text) > 400").select("text").orderBy("doc_id").limit(60).collect()]
    short = [(f"short {n} {i}", " ".join(t.split()[:n])) for n in (1, 3) for i, t in enumerate(clean)]
    short = [(i, t) for i, t in short if any(c.isalpha() for c in t) and len(t) < pipeline.FEW_GRAMS]
    whole = [(f"whole {i}", t) for i, t in enumerate(clean)]
    rows = spark.createDataFrame([(t, None, i) for i, t in noise + short + whole], "text string, lang string, source string")
    docs = learned.select("text", "lang", F.lit(None).cast("string").alias("source")).union(rows)
    kept = {s for (s,) in pipeline.language_id(spark, docs, "").where("source is not null").select("source").collect()}
    assert kept == {i for i, _ in short + whole} and len(short) > 60


def test_gram_count(spark):
    texts = ["the hat", " 1a-b2 ", "Ünter den Linden, 12 Bäume!", "漢字", "a"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", langid.gram_count(F.col("t")).alias("n")).collect()
    assert {x.t: x.n for x in got} == {t: sum(len(s) - langid.GRAM + 1 for s in langid.symbols(t)) for t in texts}
