"""Secret scan with multipart credential linking, in DataFrame operations only.

Certain findings (assignments, access identifiers, long hex strings) are always
reported.  Weak candidates (short or unlabelled secrets, account names,
endpoints) are reported only if a complementary part lies within ``SCOPE`` code
points: a secret needs an identifier or an endpoint, an identifier or an
endpoint needs a secret.  The parts meet in an interval join on (document, bucket of positions).

A match's place is found from the pieces between the matches: the split text and
the extracted matches alternate, so running sums of their lengths are offsets.

Defined results
---------------
* NULL or empty text: no span.  A NULL id is kept.
* Offsets are code points of the whole text, end exclusive.
* Repeated rows are equal texts with equal spans: each row gets its result.
* Spans may overlap (a hex string inside an assignment); they are ordered by
  start, then by kind as in ``KINDS``, then by end.
* Extra columns are not read and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscore.llm.common import cut_out, let, running_max, running_sums, stored

KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")
SCOPE = 200

_SET = r"""["']?\x20*[:=]\x20*["']?"""
# patterns of the certain kinds (fixed values); group 2 of an assignment is its value
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)" + _SET + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"          # 18 characters or more
HEX = r"[0-9a-f]{16,}"
MIN_VALUE, MIN_WEAK_VALUE = 12, 4

WEAK_SECRET = (r"(?i)(?:\b(?:pass|pwd|passphrase|auth|credential|private_?key|secret_?access_?key)" + _SET
               + r"[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-]))")
WEAK_ID = r"(?:(?i:\b(?:user|username|login|client_?id|account|access_?key_?id))" + _SET + r"[A-Za-z0-9_.@-]{3,}|AKIA[A-Z0-9]{8,13}(?![A-Z0-9]))"
ENDPOINT = (r"(?i)(?:(?:https?|ftps?|sftp|ssh|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x00-\x20\"'<>]+"
            r"|\b(?:host|server|endpoint)" + _SET + r"[A-Za-z0-9_.:-]{3,})")

SPAN = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, pattern: str, kind: Column | str, keep=None) -> Column:
    """Spans of all non-overlapping matches; ``keep`` gets group 2 of each and gives its kind or NULL."""
    kind_of = keep or (lambda value: F.lit(kind))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else matches

    def placed(m, p, v):
        lengths = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        return let(running_sums(lengths), lambda ends: F.filter(
            F.transform(m, lambda x, i: F.struct(kind_of(F.get(v, i)).alias("kind"),
                                                 (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"))),
            lambda s: s["kind"].isNotNull()))

    found = let(matches, lambda m: let(F.split(text, pattern, -1), lambda p: let(values, lambda v: placed(m, p, v))))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _assign_kind(value: Column) -> Column:
    return (F.when(F.length(value) >= MIN_VALUE, F.lit("assign"))
            .when(F.length(value) >= MIN_WEAK_VALUE, F.lit("weak_secret")))


def _role(kind: Column) -> Column:
    return F.when(kind.isin("assign", "hex", "weak_secret"), "secret").when(kind.isin("access", "weak_id"), "id").otherwise("endpoint")


def _is_weak(kind: Column) -> Column:
    return kind.isin("weak_secret", "weak_id", "endpoint")


def _ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.transform(_once(keyed), plain)


def _once(items: Column) -> Column:
    """Sorted and without repeats: neighbours are compared, so linear after the sort."""
    return let(F.array_sort(items), lambda a: F.filter(a, lambda s, i: (i == 0) | (s != F.get(a, i - 1))))


def row_key(doc_id: str, text: Column) -> Column:
    """Names a row by id and (non-NULL) text: rows with equal keys have equal spans."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(text.cast("binary")))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``doc_id`` and all spans, weak candidates included, of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"))
    found = F.flatten(F.array(
        _spans(F.col("t"), ASSIGN, "assign", _assign_kind), _spans(F.col("t"), ACCESS, "access"), _spans(F.col("t"), HEX, "hex"),
        _spans(F.col("t"), WEAK_SECRET, "weak_secret"), _spans(F.col("t"), WEAK_ID, "weak_id"), _spans(F.col("t"), ENDPOINT, "endpoint")))
    return rows.select(row_key("doc_id", F.col("t")).alias("key"), "doc_id", found.alias("all"))


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, weak): the weak spans that have a complementary part within ``scope`` code points.

    Interval join: a weak span spreads over the buckets within its reach, a
    part over the buckets it covers; they meet on (key, bucket).  A bucket of
    ``scope`` positions holds at most ``scope`` parts, whatever the document.
    """
    has = lambda *roles: F.exists("all", lambda s: _role(s["kind"]).isin(*roles))
    able = rows.where(F.exists("all", lambda s: _is_weak(s["kind"])) & has("secret") & has("id", "endpoint"))
    each = able.select("key", "all").dropDuplicates(["key"]).select("key", F.explode(_once(F.col("all"))).alias("s"))    # equal rows once
    each = each.select("key", "s", _role(F.col("s.kind")).alias("role"))
    bucket = lambda c: F.floor(c / scope)
    weak = each.where(_is_weak(F.col("s.kind"))).select(
        "key", "s", "role", F.explode(F.sequence(bucket(F.col("s.start") - scope), bucket(F.col("s.end") + scope))).alias("bucket"))
    other = each.select(
        F.col("key"), F.explode(F.sequence(bucket(F.col("s.start")), bucket(F.col("s.end")))).alias("bucket"),
        F.col("s.start").alias("p_start"), F.col("s.end").alias("p_end"), F.col("role").alias("p_role"))
    gap = F.greatest(F.col("p_start") - F.col("s.end"), F.col("s.start") - F.col("p_end"))
    fits = (F.col("role") == "secret") != (F.col("p_role") == "secret")
    linked = weak.join(other, ["key", "bucket"]).where(fits & (gap <= scope))
    return linked.select("key", "s").distinct().groupBy("key").agg(F.collect_list("s").alias("weak"))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``doc_id``, ``base`` and ``spans`` (ordered span arrays)."""
    rows = stored(parts(docs, doc_id, text))
    base = F.filter("all", lambda s: ~_is_weak(s["kind"]))
    joined = rows.select("key", "doc_id", base.alias("base")).join(link(rows, scope), "key", "left")
    every = F.concat(F.col("base"), F.coalesce(F.col("weak"), F.array().cast(SPAN)))
    return joined.select("key", "doc_id", _ordered(F.col("base")).alias("base"), _ordered(every).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of overlapping spans replaced by ``mark``."""
    def between(a, reach):
        first = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["start"] > F.get(reach, i - 1)))
        gap = lambda f, r: F.struct(                                                                # noqa: E731
            F.when(r == 0, 0).otherwise(F.get(reach, F.coalesce(F.get(f, r), F.size(a)) - 1)).alias("start"),
            F.coalesce(F.get(a, F.get(f, r))["start"], F.length(text)).alias("end"))
        return let(first, lambda f: F.transform(F.sequence(F.lit(0), F.size(f)), lambda r: gap(f, r)))

    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    gaps = let(places, lambda a: let(running_max(F.transform(a, lambda s: s["end"])), lambda reach: between(a, reach)))
    return F.when(F.size(spans) > 0, F.array_join(cut_out(text, gaps), mark)).otherwise(text)
