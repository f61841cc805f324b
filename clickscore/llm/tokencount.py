"""Token counts of documents in flat token files, by separator scan.

A flat file is nothing but token ids of two bytes each (little endian), one
end-of-document id after every document: no index says where documents begin.
Files are read in blocks.  A task finds a block's separators with one vectorised
comparison; running sums and running maxima over the block summaries then say, for
every block, how many documents ended before it and where the last of them ended.
So a document that runs over any number of blocks is counted exactly.

Defined results
---------------
* A document without tokens counts 0; so does a NULL text when files are written.
* Tokens after a file's last separator are a document with ``terminated`` false.
* An empty file has no document; an empty table gives files without documents.
* Repeated documents are counted one by one.  Only the text column is read.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickscore.llm.common import add_columns, shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256                       # a free id of this vocabulary
WIDTH = 2                         # bytes of an id
BLOCK = 1 << 20                   # ids of a block
FILE_BYTES = 1 << 27              # text that a flat file is made of, about: a file is read as one row, far below Spark's 2 GB


def _encoder(vocabulary: bytes):
    import tiktoken
    from public_tokenizers import PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, folder: str, text: str = "text", vocabulary: str = VOCABULARY, end: int = END,
               file_bytes: int = FILE_BYTES) -> None:
    """Write the texts' token ids to flat files through Spark's text writer: a row is the ids' bytes and
    the line separator is the end-of-document id.  A partition makes a new file after as many texts as
    have ``file_bytes`` on average, so a file's size doesn't grow with the partition."""
    data = open(vocabulary, "rb").read()               # under a megabyte, sent with the task
    held = []

    def work(texts):
        if not held:
            held.append(_encoder(data))
        return [[np.array(held[0].encode_ordinary(t or ""), "<u2").tobytes() for t in texts]]

    mark = end.to_bytes(WIDTH, "little").decode("latin-1")
    mean = docs.agg(F.avg(F.octet_length(F.col(text)))).first()[0] or 1
    made = add_columns(docs.select(F.col(text).alias("text")), ["text"], ["ids"], ["binary"], work, ["text"])
    made.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", mark).option("encoding", "ISO-8859-1").option(
        "compression", "none").option("maxRecordsPerFile", max(1, int(file_bytes / max(mean, 1)))).text(folder)


def blocks(spark: SparkSession, folder: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data): the files of ``folder`` cut into blocks of ``block`` ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    size = block * WIDTH
    cut = files.where("length > 0").select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content", F.explode_outer(
            F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))).alias("block"))
    return cut.select("file", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("data"))


def count(cut: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """``file``, ``doc_no``, ``start``, ``n_tokens``, ``terminated`` of every document in the blocks."""
    def scan(data):
        sizes, at = [], []
        for d in data:
            ids = np.frombuffer(d, "<u2")
            sizes.append(len(ids))
            at.append(np.flatnonzero(ids == end).astype(np.int32))
        return [sizes, at]

    found = add_columns(cut, ["data"], ["size", "at"], ["int", "array<int>"], scan, ["data"])
    base = F.col("block").cast("bigint") * block
    found = found.select("file", "block", base.alias("base"), "size", F.transform("at", lambda x: x + base).alias("ends"))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.select(
        "file", "base", "size", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before) + 1, F.lit(0)).alias("open"),
        F.lead("block").over(order).isNull().alias("last"))
    starts = F.concat(F.array("open"), F.transform("ends", lambda x: x + 1))
    docs = found.select("file", "docs_before", "base", "size", "last", "ends", starts.alias("starts"))
    whole = docs.select("file", "docs_before", F.posexplode(F.arrays_zip("ends", F.slice("starts", F.lit(1), F.size("ends")).alias("from"))).alias("i", "d"))
    whole = whole.select("file", (F.col("docs_before") + F.col("i")).alias("doc_no"), F.col("d.from").alias("start"),
                         (F.col("d.ends") - F.col("d.from")).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = docs.where("last").select("file", (F.col("docs_before") + F.size("ends")).alias("doc_no"), F.element_at("starts", -1).alias("start"),
                                     (F.col("base") + F.col("size") - F.element_at("starts", -1)).alias("n_tokens"), F.lit(False).alias("terminated"))
    return whole.union(rest.where("n_tokens > 0"))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, end: int = END, block: int = BLOCK) -> DataFrame:
    """Write ``docs`` to flat token files in the shared folder and count every document's tokens from them."""
    folder = shared_folder(docs.sparkSession)
    write_flat(docs, folder, text, vocabulary, end)
    return count(blocks(docs.sparkSession, folder, block), end, block)
