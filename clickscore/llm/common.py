"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from clickscore.session import ensure_checkpoint_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession, keep: bool = False) -> str:
    """A fresh folder below the checkpoint folder that driver and executors share.
    Inside ``temporary()`` it goes when the block ends; with ``keep`` when the block around that one does, if any."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    blocks = _tables[:-1] if keep else _tables
    if blocks:
        blocks[-1].append((spark, path))
    return path


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder as Parquet and read it back.

    Columnar and compressed, so smaller than ``checkpoint()``; a lost executor
    costs a re-read of these files, never the upstream work.  Inside
    ``temporary()`` the table goes when the block ends, unless ``keep``.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary():
    """Tables ``stored`` in this block are deleted at its end: only a result stored
    with ``keep`` may leave it."""
    _tables.append([])
    try:
        yield
    finally:
        for spark, path in _tables.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Whole texts travel to Python ``rows`` at a time in this block: Spark's default of 10,000 rows takes
    a hundred MB outside the heap for every running task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: list[tuple[str, str]]) -> DataFrame:
    """A small literal table that needs no Python worker."""
    cells = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, schema)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id's decimal text modulo ``m`` (NULL for a NULL id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


# -- word hashing inside Python tasks -----------------------------------------

class WordIds(dict):
    """Memo of 64-bit word hashes; emptied when it has ``room`` words, so a
    worker's memory stays bounded whatever the vocabulary."""

    def __init__(self, room: int = 1 << 18):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64)


def ascii_space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` cuts at exactly these characters."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that minima and low bits of a hash are even."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Grams:
    """Hashes of all ``n``-word spans by a rolling polynomial modulo 2^64."""

    def __init__(self, seed: int):
        self.base = U64((2 * seed + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
        self.powers = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            self.powers = np.concatenate([np.ones(1, U64), np.cumprod(np.full(2 * n + 64, self.base, U64), dtype=U64)])

    def prefix(self, ids: np.ndarray) -> np.ndarray:
        self._grow(len(ids))
        return np.concatenate([np.zeros(1, U64), np.cumsum(ids * self.powers[: len(ids)], dtype=U64)])

    def spans(self, prefix: np.ndarray, n: int) -> np.ndarray:
        """Hash of each span of ``n`` words, independent of where it stands."""
        count = len(prefix) - n
        if count <= 0:
            return np.zeros(0, U64)
        top = len(self.powers) - 1
        raw = prefix[n:] - prefix[:-n]
        return mix(raw * self._inverse(top)[:count])

    def _inverse(self, top: int) -> np.ndarray:
        if getattr(self, "_inv", None) is None or len(self._inv) != top + 1:
            inv = U64(pow(int(self.base), -1, 2**64))
            self._inv = np.concatenate([np.ones(1, U64), np.cumprod(np.full(top, inv, U64), dtype=U64)])
        return self._inv


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


SLICE = 512              # rows that a Python task holds as Python objects at once


def slices(it: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def add_columns(df: DataFrame, read: list[str], names: list[str], types: list[str],
                work: Callable[..., list], drop: list[str] = ()) -> DataFrame:
    """``df`` with the columns ``names`` that ``work`` makes, Arrow batch by Arrow batch.

    ``work`` gets the ``read`` columns as Python lists and returns one list (or
    array) per new column.  The other columns pass through untouched.
    """
    kept = [c for c in df.columns if c not in drop]
    fields = [df.schema[c] for c in kept]
    schema = StructType(fields + [StructField(n, _parse(t)) for n, t in zip(names, types)])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(kept):]]

    def over(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            made = work(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in read])
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index(c)) for c in kept] + [pa.array(m, k) for m, k in zip(made, kinds)],
                names=kept + names)

    return df.mapInArrow(over, schema)


def _parse(kind: str):
    return StructType.fromDDL(f"x {kind}").fields[0].dataType


# -- array expressions ---------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, all_of: Callable[[Column], Column], both: Callable[[Column, Column], Column], block: int, levels: int) -> Column:
    """Inclusive running totals of an int array.  Blocks are totalled first and their totals
    run through the same way, so that only ``block`` items or few totals meet item by item."""
    def cut(a, b):
        return F.slice(a, b * block + 1, F.lit(block))

    def plain(a):
        return F.transform(a, lambda x, i: all_of(F.slice(a, F.lit(1), i + 1)))

    def blocks(a):
        count = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        return let(_running(F.transform(count, lambda b: all_of(cut(a, b))), all_of, both, block, levels - 1), lambda done: F.flatten(F.transform(
            count, lambda b: let(cut(a, b), lambda part: F.when(b == 0, plain(part)).otherwise(
                let(F.get(done, b - 1), lambda base: F.transform(plain(part), lambda x: both(base, x))))))))

    if not levels:
        return let(values, plain)
    return let(values, lambda a: F.when(F.size(a) > 0, blocks(a)).otherwise(F.array().cast("array<int>")))


def running_sums(lengths: Column, block: int = 64) -> Column:
    """Inclusive running sums of an int array."""
    return _running(lengths, lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x), lambda a, b: a + b, block, 2)


def running_max(values: Column, block: int = 64) -> Column:
    """Inclusive running maxima of an int array."""
    return _running(values, F.array_max, F.greatest, block, 2)


def cut_out(text: Column, spans: Column, block: int = 4096) -> Column:
    """The substrings [start, end) of ``text`` in code points.  The text is cut
    into blocks first, so that a span costs its own length, not its offset."""
    def one(b, s):
        first, last = F.floor(s["start"] / block).cast("int"), F.floor(s["end"] / block).cast("int")
        return F.substr(F.array_join(F.slice(b, first + 1, last - first + 1), ""),
                        (s["start"] % block).cast("int") + 1, (s["end"] - s["start"]).cast("int"))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0))
    return let(blocks, lambda b: F.transform(spans, lambda s: one(b, s)))
