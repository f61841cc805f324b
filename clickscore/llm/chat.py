"""Chat formatting with Spark expressions only.

Turns are cut into runs of ``CHUNK`` turn numbers.  A run's turn structs are
collected and sorted, adjacent turns of one role are merged into a block by
array aggregation, and the blocks are concatenated; then the runs of a
conversation are glued in order.  So a conversation with very many turns is
formatted by many tasks, and the last step sees one row per run.

Control strings inside a text are broken by an escape mark, so that the
formatted text can be read back exactly.  ``loss_spans`` are the code-point
ranges of the assistant texts (one per turn, end exclusive).

Defined results
---------------
* Order: turn (NULL first), then role, then text.  Repeated rows are kept as turns.
* NULL text or role: empty.  A NULL conversation id is a conversation of its own.
* Adjacent turns of one role share one block; the joint between them lets a
  reader tell them apart and is outside the loss mask.
* Empty table: no row.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscore.llm.common import cut_out, running_sums

OPEN, CLOSE, JOINT = "<|im_start|>", "<|im_end|>\n", "<|im_next|>\n"
# control strings of this template and of other common chat templates (fixed values)
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CHUNK = 64
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    """Backslash to ``\\e``, then a mark after the first character of every control string."""
    c = F.replace(c, F.lit("\\"), F.lit("\\e"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\z" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\z"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = ASSISTANT, chunk: int = CHUNK) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` array<struct<start, end>> per conversation."""
    rows = df.select(F.col(conv_id).alias("conv_id"), F.floor(F.col(turn) / chunk).alias("run"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = rows.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # a block starts where the role changes; blocks hold the merged texts
    runs = runs.withColumn("starts", F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)"))
    runs = runs.withColumn("blocks", F.expr(
        "transform(starts, (s, k) -> struct(t[s].role as role, transform(slice(t, s + 1,"
        " coalesce(get(starts, k + 1), size(t)) - s), x -> x.text) as texts))"))
    escaped = F.transform("blocks", lambda b: F.struct(
        b["role"].alias("role"), F.concat(F.lit(OPEN), _escape_role(b["role"]), F.lit("\n")).alias("head"),
        F.transform(b["texts"], escape).alias("texts")))
    runs = runs.withColumn("blocks", escaped)
    # lengths of everything in writing order: for each turn what stands before its text, then the text
    runs = runs.withColumn("parts", F.expr(
        "flatten(transform(blocks, (b, k) -> transform(b.texts, (x, j) -> struct("
        f"case when j > 0 then {len(JOINT)} when k > 0 then {len(CLOSE)} + length(b.head) else 0 end as gap,"
        " length(x) as len, b.role as role))))"))
    runs = runs.select(
        "conv_id", "run", F.expr("blocks[0].role").alias("first_role"), F.expr("element_at(blocks, -1).role").alias("last_role"),
        F.expr("blocks[0].head").alias("head"), "parts",
        # the body lacks the first block's head and the last block's close: the glue below decides about them
        F.array_join(F.transform("blocks", lambda b, k: F.concat(
            F.when(k > 0, F.concat(F.lit(CLOSE), b["head"])).otherwise(""), F.array_join(b["texts"], JOINT))), "").alias("body"))
    order = Window.partitionBy("conv_id").orderBy("run")
    glue = (F.when(F.lag("first_role").over(order).isNull(), F.col("head"))
            .when(F.lag("last_role").over(order) == F.col("first_role"), F.lit(JOINT))
            .otherwise(F.concat(F.lit(CLOSE), F.col("head"))))
    runs = runs.withColumn("body", F.concat(glue, "body")).withColumn("glued", F.length("body"))
    before = F.coalesce(F.sum("glued").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("at", before)
    runs = runs.withColumn("ends", running_sums(F.transform("parts", lambda p: p["gap"] + p["len"])))
    runs = runs.withColumn("glue_len", F.col("glued") - F.element_at("ends", -1))
    runs = runs.withColumn("spans", F.expr(
        "transform(filter(arrays_zip(parts, ends), z -> z.parts.role = '" + loss_role + "'),"
        " z -> struct(at + glue_len + z.ends - z.parts.len as start, at + glue_len + z.ends as end))"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "body", "spans"))).alias("r"))
    return whole.select("conv_id", F.concat(F.array_join("r.body", ""), F.lit(CLOSE)).alias("formatted"),
                        F.flatten("r.spans").alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted text."""
    blocks = F.split(F.regexp_replace(formatted, r"^\Q" + OPEN + r"\E", ""), r"\Q" + OPEN + r"\E")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, "\n") + F.lit(1), F.length(b) - F.instr(b, "\n") - F.lit(len(CLOSE))), r"\Q" + JOINT + r"\E"),
        lambda x: F.struct(_unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(x).alias("text")))))


def loss_texts(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the mask, one per assistant turn."""
    return F.transform(cut_out(F.col(formatted), F.col(spans)), unescape)
