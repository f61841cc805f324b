"""Stored tables: atomic replacement, day refresh, and plans over the bucketed base table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickscore.operators import profile as P
from clickscore.operators import sessions as S
from clickscore.plans import context as C
from clickscore.sources import sinks as K
from tests.conftest import SF01


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def base(spark):
    return C.base90(spark, SF01)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("heavy", [10 ** 9, 60])
def test_bucketed_base_needs_no_shuffle_of_users(spark, base, tmp_path, heavy):
    root = K.materialize_base(base, str(tmp_path / "base"), buckets=4, heavy_rows=heavy)
    parts = K.load_parts(spark, root)
    assert sorted(parts) == (["light"] if heavy > 60 else ["heavy", "light"])
    if "heavy" in parts:
        many = {r[0] for r in base.groupBy("userhasheduuid").count().filter("count > 60").collect()}
        assert many and {r[0] for r in parts["heavy"].select("userhasheduuid").distinct().collect()} == many
    assert rows(K.load_table(spark, root).drop(K.DAY)) == rows(base)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        light = P.group_profile(parts["light"])
        assert "Exchange" not in plan(light) and "SelectedBucketsCount: 4 out of 4" in plan(light)
        numbered = S.assign_sessions(parts["light"])
        assert "Window" in plan(numbered) and "Exchange" not in plan(numbered)
        assert rows(K.over_parts(spark, root, P.group_profile)) == rows(P.group_profile(base))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_days_prune_files(spark, base, tmp_path):
    root = K.materialize_base(base, str(tmp_path / "base"), buckets=2)
    day = base.select(F.to_date("browsertimestamp")).first()[0]
    one = K.load_table(spark, root).filter(F.col(K.DAY) == F.lit(day))
    assert one.count() == base.filter(F.to_date("browsertimestamp") == F.lit(day)).count() > 0
    assert f"PartitionFilters: [isnotnull({K.DAY}" in plan(one)


def test_a_rewrite_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    K.write_table(spark.range(10), root)
    with pytest.raises(Exception, match="no disk left"):
        K.write_table(spark.range(20).select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("no disk left"))).alias("id")), root)
    assert K.load_table(spark, root).count() == 10
    held = K.load_table(spark, root)                             # a reader that began before the rewrite

    def killed(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(K, "_switch", killed)
        with pytest.raises(KeyboardInterrupt):
            K.write_table(spark.range(30), root)
    assert K.load_table(spark, root).count() == 10
    K.write_table(spark.range(40), root)
    assert K.load_table(spark, root).count() == 40 and held.count() == 10
    assert K.drop_old_versions(spark, root) == 3                    # the first one and the two unfinished
    assert K.load_table(spark, root).count() == 40


def test_only_changed_days_are_written(spark, base, tmp_path):
    old = K.with_day(base)
    days = sorted(r[0] for r in old.select(K.DAY).distinct().collect())
    gone, more, same = days[0], days[1], days[2:]
    extra = old.filter(F.col(K.DAY) == F.lit(more)).limit(1).withColumn("event_id", F.lit(-1).cast("bigint"))
    new = old.filter(F.col(K.DAY) != F.lit(gone)).unionByName(extra)
    root = K.write_table(old, str(tmp_path / "t"), [K.DAY], ["userhasheduuid"], ["browsertimestamp"], buckets=2)
    before = {d: v for p in K.read_pointer(spark, root)["parts"] for d, v in p["days"].items()}
    assert K.refresh_days(new, root) == [str(more)]
    after = {d: v for p in K.read_pointer(spark, root)["parts"] for d, v in p["days"].items()}
    assert all(after[str(d)] == before[str(d)] for d in same) and after[str(more)] != before[str(more)] and str(gone) not in after
    assert rows(K.load_table(spark, root).select(new.columns)) == rows(new)
    assert K.refresh_days(new, root) == []
    assert rows(K.load_table(spark, root).select(new.columns)) == rows(new)


def test_empty_tables(spark, base, tmp_path):
    root = K.materialize_base(base.limit(0), str(tmp_path / "t"), buckets=2)
    assert K.load_table(spark, root).count() == 0
    assert K.refresh_days(K.with_day(base), root) and rows(K.load_table(spark, root).drop(K.DAY)) == rows(base)
    assert K.refresh_days(K.with_day(base.limit(0)), root) == [] and K.load_table(spark, root).count() == 0


def test_exports_are_ordered_without_one_task(spark, tmp_path):
    import glob
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.when(F.col("id") % 50 > 0, F.col("id") % 7).alias("w")).repartition(5)
    order = [F.col("w").desc_nulls_last(), F.col("v").asc()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = K.export_csv(df, str(tmp_path / "csv"), order)
        plan_ = K.ranked(df, order)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 3 and "coalesce" not in plan_.lower().replace("coalesce(", "")
    want = sorted((-1 if r.w is None else r.w, -r.v) for r in df.collect())[::-1]
    lines = [x.rstrip("\n").split(",") for f in files for x in list(open(f))[1:]]
    assert [(-1 if w == K.NULL_TEXT else int(w), -int(v)) for v, w, _ in lines] == want
    assert [int(p) for *_, p in lines] == list(range(1, 5001))
    manifest = K.read_manifest(spark, path)
    assert sum(manifest["files"].values()) == 5000 and max(manifest["files"].values()) < 2 * 5000 / len(files)
    back = K.load_csv(spark, path)
    assert back.schema.simpleString() == "struct<v:bigint,w:bigint,position:bigint>" and back.count() == 5000
    assert K.load_csv(spark, K.export_csv(df.limit(0), str(tmp_path / "none"), order)).count() == 0


def test_tables_that_the_study_sorts(spark):
    from clickscore.operators import ranks as R
    prof = C.profile(spark, SF01)
    assert [r[0] for r in P.profile_check(prof).collect()] == sorted(r[0] for r in prof.select("nps_category").distinct().collect())
    rho = [r["rho"] for r in R.spearman_table(prof).collect()]
    assert rho == sorted(rho, key=lambda x: (x is None, -(x or 0)))


def test_modules_can_be_imported_alone():
    import subprocess
    import sys
    for name in ("q_ranks", "q_sinks", "catalog"):
        subprocess.run([sys.executable, "-c", f"import clickscore.plans.{name}"], check=True, timeout=120)
