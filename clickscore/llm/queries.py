"""The registered query of each operator, and its DuckDB text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickscore.llm import chat, decontam, fim, langid, lexical, neardup, packing, search, secrets, substrings, tokencount, tokenfile, toxicity
from clickscore.llm.common import crc_mod, literal_rows, stored, table, temporary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tidy(fn):
    """Register ``fn`` so that the tables it stores on its way go as soon as its result is stored."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with temporary():
            return stored(fn(spark, sf_dir), keep=True)

    return query(run)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, drop=["text"])


PROBE = "</s>[INST] ok [/INST]"


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = literal_rows(spark, [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
                         [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")])
    out = chat.format_conversations(turns.unionByName(probe))
    back = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                      F.array_join(chat.loss_texts(), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))


def _escaped_length(c: str) -> str:
    for s, t in [("\\", "\\e")] + [(k, k[0] + "\\z" + k[1:]) for k in chat.CONTROL]:
        c = f"replace({c}, '{s}', '{t}')"
    return f"length({c})"


ORACLES["op9_chat_formatting"] = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
         {_escaped_length("replace(role, chr(10), '??')")} AS role_len, {_escaped_length("text")} AS text_len
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_len + CASE WHEN same THEN {len(chat.JOINT)} ELSE {len(chat.OPEN) + 1 + len(chat.CLOSE)} + role_len END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


@tidy
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.covered(F.col("hits")).cast("bigint")
    return found.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, 10 AS m FROM b, unnest(range(1, len(w) - 8)) t(i) WHERE len(w) >= 10
  UNION ALL SELECT DISTINCT item, array_to_string(w, ' '), len(w) FROM b WHERE len(w) BETWEEN 1 AND 9),
dw AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM d, (SELECT DISTINCT m FROM bw) ms, unnest(range(1, len(w) - m + 2)) t(i)),
hits AS (SELECT dw.doc_id, i, m, item FROM dw JOIN bw USING (g, m)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + m)) t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLES["op10_near_duplicates"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low.c, w.doc_id) AS component_id, coalesce(low.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = w.doc_id
"""


@tidy
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op2_substring_dedup"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM w, unnest(range(1, len(w) - 48)) t(i) WHERE len(w) >= 50),
low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT win.doc_id, i FROM win JOIN low USING (g) WHERE low.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + 50)) t(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, p, w[p] AS word FROM w, unnest(range(1, len(w) + 1)) t(p)) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone WHERE gone.doc_id = w.doc_id)::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@tidy
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@tidy
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    rows = docs.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score_rows(rows, model, drop=["text"]).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@tidy
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@tidy
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"),
                       F.length("middle").cast("bigint").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (
  SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
         ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 OR doc_id IS NULL THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n::BIGINT AS n, form, text, CASE WHEN form <> 'plain' THEN array_to_string(u[1:a], '') END AS x,
         CASE WHEN form <> 'plain' THEN array_to_string(u[a + 1:b], '') END AS y,
         CASE WHEN form <> 'plain' THEN array_to_string(u[b + 1:], '') END AS z FROM c)
SELECT doc_id, n, form, length(x) AS prefix_chars, length(y) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@tidy
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


@query
def op13_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
          " '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
ORACLES["op13_lexical_ranking"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM d, unnest(w) u(t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
v AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, c),
p AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN v USING (t), c),
s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM p JOIN q USING (t) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s QUALIFY rank <= 50
"""
