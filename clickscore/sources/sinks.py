"""Sinks and gold-table loading.

A stored table is a folder of versions and a pointer file, ``CURRENT``, that
names the folders readers use.  A rewrite adds new folders and replaces the
pointer last, in one rename, so a rewrite that dies leaves the old table as it
was, and readers never see half a table.

Layout.  A table may be partitioned by day, and its rows bucketed by user and
sorted by time, so aggregates and windows per user need no shuffle.  A bucket is
read by one task; users with more than ``heavy_rows`` rows are therefore kept in an
unbucketed part of their own, and ``over_parts`` runs a per-user operator on both
parts.  A partitioned table keeps a fingerprint of every day;
``refresh_days`` writes only days whose fingerprint changed.

Tables live under the session's shared checkpoint folder or an explicit path.  The
cluster names that folder; only a local master falls back to a scratch folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickscore.operators._util import bounded_broadcast, materialize
from clickscore.operators.base import USER
from clickscore.session import ensure_checkpoint_dir

POINTER = "CURRENT"
HEAVY_ROWS = 10_000_000      # rows of a user that are too many for one bucket
DAY = "event_date"


def table_path(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex[:8]}"


# ---- the pointer ----------------------------------------------------------------
def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def read_pointer(spark: SparkSession, root: str) -> dict | None:
    """What the table's pointer says; None if the folder has no pointer."""
    _, _, at, fs = _files(spark, f"{root}/{POINTER}")
    if not fs.exists(at):
        return None
    return json.loads(_load_text(spark, at.toString()))


def _load_text(spark: SparkSession, path: str) -> str:
    jvm, _, at, fs = _files(spark, path)
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _save_text(spark: SparkSession, path: str, text: str):
    _, _, at, fs = _files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    return at


def _switch(spark: SparkSession, root: str, pointer: dict) -> None:
    """Replace the pointer by one rename.  A pointer is small: a few strings a day of data."""
    jvm, conf, _, _ = _files(spark, root)
    new = _save_text(spark, f"{root}/{POINTER}.{uuid.uuid4().hex[:8]}", json.dumps(pointer))
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), options)


# ---- writing ----------------------------------------------------------------------
def _write_part(df: DataFrame, root: str, partition_by: list[str], bucket_by: list[str], sort_by: list[str], buckets: int) -> str:
    """Write a new folder below ``root`` and return its name."""
    name = f"v-{uuid.uuid4().hex}"
    if bucket_by:
        df = df.repartition(buckets, *bucket_by)          # a bucket is one task's, so one file a day and bucket
    w = df.write.format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        table = "clickscore_" + name[2:]
        w.bucketBy(buckets, *bucket_by).sortBy(*sort_by).option("path", f"{root}/{name}").saveAsTable(table)
        df.sparkSession.sql(f"DROP TABLE {table}")         # the files stay; readers register them as they need
    else:
        w.save(f"{root}/{name}")
    return name


def _days(df: DataFrame, day: str) -> dict[str, str]:
    """Fingerprint of every day: rows and an order-free sum of row hashes."""
    rows = df.groupBy(F.col(day).cast("string").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[c for c in df.columns if c != day]).cast("decimal(38,0)")).alias("h"))
    return {r["d"]: f"{r['n']}:{r['h']}" for r in rows.collect()}          # one row a day


def write_table(df: DataFrame, root: str, partition_by: list[str] | None = None, bucket_by: list[str] | None = None,
                sort_by: list[str] | None = None, buckets: int = 64, heavy_rows: int = HEAVY_ROWS) -> str:
    """A4: CREATE OR REPLACE TABLE AS.  ``partition_by`` may name one column, the day."""
    spark, partition_by = df.sparkSession, list(partition_by or [])
    layout = {"schema": df.schema.json(), "partition_by": partition_by, "bucket_by": list(bucket_by or []), "sort_by": list(sort_by or []),
              "buckets": buckets, "heavy_rows": heavy_rows}
    pointer = {"layout": layout, "parts": []}
    for part, rows in _split(df, layout).items():
        place = _write_part(rows, root, partition_by, layout["bucket_by"] if part == "light" else [], layout["sort_by"], buckets)
        days = {d: place for d in _days(spark.read.parquet(f"{root}/{place}"), partition_by[0])} if partition_by and not _empty(spark, root, place) else {}
        pointer["parts"].append({"name": part, "place": place, "days": days})
    pointer["fingerprints"] = _days(df, partition_by[0]) if partition_by else {}
    _switch(spark, root, pointer)
    return root


def _empty(spark: SparkSession, root: str, place: str) -> bool:
    _, _, at, fs = _files(spark, f"{root}/{place}")
    return not any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(at))


def _split(df: DataFrame, layout: dict) -> dict[str, DataFrame]:
    """``light`` rows, and the ``heavy`` ones of users that would make a bucket one task's burden."""
    if not layout["bucket_by"]:
        return {"light": df}
    by = layout["bucket_by"]
    large = materialize(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > layout["heavy_rows"]).select(*by))
    n = large.count()                                     # at most rows / heavy_rows
    if not n:
        return {"light": df}
    names = bounded_broadcast(large, known_rows=n)
    return {"light": df.join(names, by, "left_anti").select(df.columns), "heavy": df.join(names, by, "left_semi").select(df.columns)}


def refresh_days(df: DataFrame, root: str) -> list[str]:
    """Bring a table partitioned by day up to date with ``df``: days that changed are written anew, days that
    are gone leave the pointer, all others keep their files.  Returns the days written."""
    spark, pointer = df.sparkSession, read_pointer(df.sparkSession, root)
    layout, (day,) = pointer["layout"], pointer["layout"]["partition_by"]
    now, old = _days(df, day), pointer["fingerprints"]
    changed = sorted(d for d in now if now[d] != old.get(d))
    parts = {p["name"]: p for p in pointer["parts"]}
    for p in parts.values():
        p["days"] = {d: place for d, place in p["days"].items() if d in now and d not in changed}
    if changed:
        fresh = df.filter(F.col(day).isin([F.lit(d).cast(df.schema[day].dataType) for d in changed]))
        for part, rows in _split(fresh, layout).items():
            place = _write_part(rows, root, [day], layout["bucket_by"] if part == "light" else [], layout["sort_by"], layout["buckets"])
            p = parts.setdefault(part, {"name": part, "place": place, "days": {}})
            if not _empty(spark, root, place):
                p["days"].update({d: place for d in _days(spark.read.parquet(f"{root}/{place}"), day)})
    _switch(spark, root, {**pointer, "parts": list(parts.values()), "fingerprints": now})
    return changed


def drop_old_versions(spark: SparkSession, root: str) -> int:
    """Delete the folders that the pointer no longer names (for when no reader of an older pointer runs)."""
    pointer = read_pointer(spark, root)
    used = {p["place"] for p in pointer["parts"] if not pointer["layout"]["partition_by"]} | {v for p in pointer["parts"] for v in p["days"].values()}
    _, _, at, fs = _files(spark, root)
    gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in used]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def materialize_base(base: DataFrame, path: str, buckets: int = 64, heavy_rows: int = HEAVY_ROWS) -> str:
    """A4 for the base table: partitioned by event date, bucketed by user, sorted by time."""
    return write_table(with_day(base), path, [DAY], [USER], ["browsertimestamp", "event_id"], buckets, heavy_rows)


def with_day(base: DataFrame) -> DataFrame:
    return base.withColumn(DAY, F.to_date("browsertimestamp"))


# ---- reading ------------------------------------------------------------------------
def load_parts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current parts of a table, with what Spark needs to know of their layout."""
    pointer = read_pointer(spark, root)
    return {p["name"]: _read_part(spark, root, p, pointer["layout"]) for p in pointer["parts"]}


def _read_part(spark: SparkSession, root: str, part: dict, layout: dict) -> DataFrame:
    columns, bucketed = layout["schema"], layout["bucket_by"] and part["name"] == "light"
    if not layout["partition_by"] and not bucketed:
        return spark.read.parquet(f"{root}/{part['place']}")
    schema = StructType.fromJson(json.loads(columns))
    table = "clickscore_" + hashlib.md5(json.dumps([root, part], sort_keys=True).encode()).hexdigest()
    if not spark.catalog.tableExists(table):
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        names = lambda cols: ", ".join(f"`{c}`" for c in cols)
        by = f"PARTITIONED BY ({names(layout['partition_by'])})" if layout["partition_by"] else ""
        cut = f"CLUSTERED BY ({names(layout['bucket_by'])}) SORTED BY ({names(layout['sort_by'])}) INTO {layout['buckets']} BUCKETS" if bucketed else ""
        spark.sql(f"CREATE TABLE {table} ({ddl}) USING parquet {by} {cut} LOCATION '{root}/{part['place']}'")
        if part["days"]:
            (day,) = layout["partition_by"]
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS " + " ".join(
                f"PARTITION (`{day}`='{d}') LOCATION '{root}/{place}/{day}={d}'" for d, place in sorted(part["days"].items())))
    return spark.table(table).select([f.name for f in schema])


def load_table(spark: SparkSession, root: str) -> DataFrame:
    """Read a gold table back (no collect)."""
    if read_pointer(spark, root) is None:
        return spark.read.parquet(root)
    return reduce(DataFrame.unionByName, load_parts(spark, root).values())


def over_parts(spark: SparkSession, root: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A per-user operator on each part of a table: all rows of a user are in one part, so the results add up."""
    return reduce(DataFrame.unionByName, [operator(df) for df in load_parts(spark, root).values()])


def temp_table(df: DataFrame, name: str) -> DataFrame:
    """A5: CREATE OR REPLACE TEMP TABLE ... then SELECT *."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def view(df: DataFrame, name: str) -> DataFrame:
    """CREATE OR REPLACE VIEW: a named lazy plan."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(f"SELECT * FROM `{name}`")


NULL_TEXT = "NULL"       # keeps NULL and the empty string apart in CSV files


def ranked(df: DataFrame, order: list[Column], position: str = "position") -> DataFrame:
    """``df`` in ``order`` with each row's place from 1, without bringing it into one task: rows are
    range-partitioned and sorted, and a partition's place is the count of the rows before it."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(parts.select("*", F.monotonically_increasing_id().alias("_at")))       # partition number and row in it
    of, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(of.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))                  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return parts.join(offsets, of == F.col("_part")).select(*df.columns, (F.col("_before") + row + 1).alias(position))


def export_csv(df: DataFrame, path: str, order: list[Column] | None = None) -> str:
    """Result table to CSV files with a header.  With ``order`` the files, read by name, hold the rows in
    that order, and a ``position`` column says so; a small report is one file anyhow.  The manifest
    ``_manifest`` beside them names the files with their rows, and the columns' types."""
    df = df if order is None else ranked(df, order)
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL_TEXT).csv(path)
    spark = df.sparkSession
    written = spark.read.schema(df.schema).option("header", True).option("nullValue", NULL_TEXT).csv(path)
    files = written.groupBy(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file")).count().collect()     # one row a file
    _save_text(spark, f"{path}/_manifest", json.dumps({"schema": df.schema.json(), "files": dict(sorted((r["file"], r["count"]) for r in files))}))
    return path


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(_load_text(spark, f"{path}/_manifest"))


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported table with its column types."""
    schema = StructType.fromJson(json.loads(read_manifest(spark, path)["schema"]))
    return spark.read.schema(schema).option("header", True).option("nullValue", NULL_TEXT).csv(path)
