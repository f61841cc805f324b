"""The corpus pipeline: language ID, near-duplicates, benchmark passages, secrets, packing.

Every stage gets the documents its predecessor kept and returns the columns of
``documents``; the last one returns the packed pieces.  Rows with a NULL id take part
in every stage by their text; rows with one id and different texts are different
documents; extra columns are handed on untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickscore.llm import decontam, langid, neardup, packing, secrets
from clickscore.llm.common import stored, table, temporary, unused
from clickscore.operators._util import bounded_broadcast

# Cosines of unrelated vectors have a standard deviation of 1 / sqrt(DIM).  Four of them and a margin: on sf0.1 gibberish
# of 12 to 200 words scored at most 0.177, held-out documents of FEW_GRAMS or more at least 0.232.
MIN_LANGUAGE_SCORE = 4 / langid.DIM ** 0.5 + 0.075
FEW_GRAMS = 32                   # a text of fewer n-grams has scores within the noise, so its score doesn't count
MAX_BROADCAST = 500_000          # rows of (id, digest) broadcast at most


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that resemble no known language; a text
    of fewer than ``FEW_GRAMS`` n-grams can't be told from noise and stays."""
    model = langid.fit(docs)
    pred, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    found = langid.identify(docs, model, pred=pred, score=score)
    known = (F.col(score) >= MIN_LANGUAGE_SCORE) | (langid.gram_count(F.col("text")) < FEW_GRAMS)
    return found.where((F.col(pred) != langid.UNDETERMINED) & known).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the one with the smallest doc_id, NULL last.

    A row is known by id and text, so rows with one id and different texts are different
    documents, and rows with a NULL id take part like others.
    """
    key, of = unused(docs, "__key"), unused(docs, "__of")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"))
    named = docs.withColumn(key, name)
    found = neardup.near_duplicates(named, doc_id=key)
    drop = stored(found.where("not kept").select(F.col("doc_id").alias(of)).distinct())
    again = stored(found.where("kept").groupBy(F.col("doc_id").alias(of)).count().where("count > 1").select(of))
    kept = named.join(bounded_broadcast(drop, MAX_BROADCAST), F.col(key) == F.col(of), "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    repeated = bounded_broadcast(again, MAX_BROADCAST)
    # equal rows are reduced inside every task first; a map can't be ordered, so it has no say in which row stays
    order = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    one = kept.join(repeated, F.col(key) == F.col(of), "left_semi").groupBy(key).agg(
        F.min_by(F.struct(*docs.columns), F.struct(*order)).alias("row")).select("row.*")
    return kept.join(repeated, F.col(key) == F.col(of), "left_anti").select(docs.columns).union(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") > 0)
    id_, digest = unused(docs, "__id"), unused(docs, "__digest")
    hit = stored(found.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.md5(F.coalesce("text", F.lit("")).cast("binary")) == F.col(digest))
    return docs.join(bounded_broadcast(hit, MAX_BROADCAST), same, "left_anti")


def redacted_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span; ``n_chars`` follows the text."""
    key_, spans_ = unused(docs, "__key"), unused(docs, "__spans")
    found = secrets.find(docs).where(F.size("spans") > 0).select(F.col("key").alias(key_), F.col("spans").alias(spans_))
    spans = stored(found.dropDuplicates([key_]))
    count = spans.agg(F.sum(F.size(spans_))).first()[0] or 0             # the bound is on spans, not rows
    spans = bounded_broadcast(spans, MAX_BROADCAST, known_rows=count)
    joined = docs.join(spans, secrets.row_key("doc_id", F.coalesce("text", F.lit(""))) == F.col(key_), "left")
    clean = F.col(key_).isNull()
    text = F.when(clean, F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans_)))
    made = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return made.select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into sequences of the permitted lengths."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("redacted_secrets", redacted_secrets), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None            # a learned model and a packing heuristic: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with temporary():                                   # what the stages store goes when the result is stored
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
        return stored(STAGES[-1][1](spark, docs, sf_dir), keep=True)
