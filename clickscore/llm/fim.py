"""Fill-in-the-middle transformation by counted, possessive regular expressions.

A text is a row of units (tokens); ``regexp_count`` says how many.  A hash of the
id draws two cuts a <= b.  One match of a pattern made for the row, unit{a} and
unit{b - a} with possessive quantifiers and then the rest, captures prefix, middle
and suffix: a possessive group runs as a loop, so neither backtracking nor the
Java stack grows with the text.  Only Spark expressions; no shuffle.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle,
``plain`` is the text itself.  The marks are sentinels: a text that holds one stays
plain, so the form and the output give back the exact text.

Defined results
---------------
* NULL text is an empty one; an empty text is plain, with no unit.
* NULL id: its hashes are NULL, so nothing is drawn and the row stays plain.
* One unit, or equal cuts: prefix, middle or suffix may be empty.
* Repeated rows have equal results; equal ids draw alike.  Very long texts are whole.
* Empty table: no row.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]++|[^A-Za-z]"
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20     # per cent: stay plain, and spm among the others


def draws(doc_id: str, seed: int = 1) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def split_pattern(a: Column, b: Column, unit: str = UNIT) -> Column:
    """The pattern whose groups are the first ``a`` units, those up to ``b``, and the rest."""
    def counted(k):
        return F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))

    return F.concat(F.lit("(?s)\\A"), counted(a), counted(b - a), F.lit("(.*)\\z"))


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, unit: str = UNIT) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix``, ``middle``, ``suffix`` (NULL if plain) and ``output`` of every row."""
    t, (p, s, m) = F.coalesce(F.col(text), F.lit("")), map(F.lit, MARKS)
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), draws(doc_id, seed).alias("h"))
    counted = rows.withColumn("n", F.regexp_count("t", F.lit(unit)).cast("bigint"))
    h = lambda i: F.get("h", F.lit(i))                                                  # noqa: E731
    held = F.contains("t", p) | F.contains("t", s) | F.contains("t", m)
    form = (F.when((F.col("n") == 0) | held | F.coalesce(h(2) % 100 >= PLAIN_FROM, F.lit(True)), "plain")
            .when(h(3) % 100 < SPM_BELOW, "spm").otherwise("psm"))
    x, y = h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)
    pattern = split_pattern(F.least(x, y), F.greatest(x, y), unit)
    cut = F.regexp_replace("t", pattern, F.lit("$1<P>$2<S>$3"))
    drawn = counted.withColumn("form", form).withColumn("parts", F.when(F.col("form") != "plain", F.split(cut, "<[PS]>", -1)))
    prefix, middle, suffix = (F.get("parts", F.lit(i)) for i in range(3))
    made = (F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
            .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("t")))
    return drawn.select("doc_id", "n", "form", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), made.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``form`` was made from."""
    psm = F.regexp_replace(output, F.lit("(?s)\\A<P>(.*?)<S>(.*?)<M>(.*)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit("(?s)\\A<S>(.*?)<P>(.*?)<M>(.*)\\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
