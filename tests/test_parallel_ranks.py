"""Parallel exact ranks equal their single-window definitions."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from clickscore.operators import design as M
from clickscore.operators._util import top_k_per_group


def test_salted_top_k_equals_window(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["x", "y", "z"]), f"i{rnd.randrange(300)}", f"j{rnd.randrange(50)}", rnd.randrange(20))
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "cat string, a string, b string, n int").dropDuplicates(["cat", "a", "b"])
    order = [F.col("n").desc(), F.col("a"), F.col("b")]
    for k, salts in [(1, 4), (10, 8), (25, 64)]:
        got = top_k_per_group(df, ["cat"], order, k, salt_of=["a", "b"], salts=salts)
        ref = (df.withColumn("rank", F.row_number().over(Window.partitionBy("cat").orderBy(*order)))
               .filter(F.col("rank") <= k))
        assert sorted(got.collect()) == sorted(ref.collect())


def test_stratum_rank_equals_window(spark):
    rows = [(u, 9 if u % 3 else 2, "promoter" if u % 3 else "detractor") for u in range(2000)]
    df = spark.createDataFrame(rows, "userhasheduuid long, nps_score int, nps_category string")
    for ranges in (1, 16, 256):
        got = {r[0]: (r[1], r[2]) for r in
               M._stratum_rank(df, 42, "nps_category", ranges).select("userhasheduuid", "_rank", "_n").collect()}
        w = Window.partitionBy("nps_category").orderBy(M._shuffle_key(42), F.col("userhasheduuid"))
        ref = {r[0]: (r[1], r[2]) for r in
               df.select("userhasheduuid", F.row_number().over(w),
                         F.count(F.lit(1)).over(Window.partitionBy("nps_category"))).collect()}
        assert got == ref


def test_exact_quantiles_equal_percentile(spark):
    from clickscore.operators._util import exact_quantiles
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", "y", "z"]), None if rnd.random() < 0.05 else float(rnd.choice([rnd.randrange(30),
                                                                                            rnd.random() * 100])))
            for _ in range(4000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "cat string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    for accuracy, groups in ((20, None), (200, 4), (10_000, None)):
        got = {r[0]: tuple(r[1:]) for r in
               exact_quantiles(df, "v", probs, ["cat"], [f"p{i}" for i in range(len(probs))], groups, accuracy).collect()}
        ref = {r[0]: tuple(r[1:]) for r in
               df.groupBy("cat").agg(*[F.percentile("v", p) for p in probs]).collect()}
        assert got.keys() == ref.keys()
        for k in ref:
            for a, b in zip(got[k], ref[k]):
                assert (a is None and b is None) or abs(a - b) <= 1e-9 * max(1.0, abs(b))
    one = exact_quantiles(df, "v", [0.5], names=["m"]).collect()
    assert len(one) == 1 and abs(one[0]["m"] - df.agg(F.median("v")).first()[0]) < 1e-9


def test_value_ranks_slices_equal_one_slice(spark):
    from clickscore.operators.ranks import value_ranks
    rnd = random.Random(5)
    rows = [(rnd.choice(["m1", "m2"]), float(rnd.randrange(200)) / 7) for _ in range(3000)]
    df = spark.createDataFrame(rows, "metric string, value double")
    ref = {(r[0], r[1]): r[3] for r in value_ranks(df, ["metric"], ranges=1).collect()}
    for ranges in (4, 256):
        got = {(r[0], r[1]): r[3] for r in value_ranks(df, ["metric"], ranges=ranges).collect()}
        assert got == ref
    # brute force for one metric
    vals = sorted(v for m, v in rows if m == "m1")
    for v in set(vals):
        first = vals.index(v) + 1
        t = vals.count(v)
        assert ref[("m1", v)] == first + (t - 1) / 2.0


def test_ranked_rows_with_mostly_zeros(spark):
    """90 % of the values are one key; ranks equal the plain average ranks."""
    import random

    from clickscore.operators import ranks as R
    rnd = random.Random(9)
    rows = [(m, i, 0.0 if rnd.random() < 0.9 else float(rnd.randrange(-5, 20))) for m in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "metric string, id int, value double")
    got = {(r["metric"], r["id"]): r["rank"] for r in R._ranked_rows(df).collect()}
    for m in ("a", "b"):
        vals = [v for k, _, v in rows if k == m]
        for k, i, v in rows:
            if k == m:
                assert got[m, i] == sum(x < v for x in vals) + (sum(x == v for x in vals) + 1) / 2
    plan = R._ranked_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_quantiles_of_several_columns_and_heavy_ties(spark):
    from clickscore.operators._util import exact_quantiles
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), 7.0 if rnd.random() < 0.9 else rnd.random() * 20, float(i), None, float("inf") if i == 3 else -float(i % 13))
            for i in range(30_000)]
    df = spark.createDataFrame(rows, "g string, tied double, even double, none double, odd double")
    cols, probs = ["tied", "even", "none", "odd"], [0.01, 0.5, 0.9, 0.99]
    names = [f"{c}_{i}" for c in cols for i in range(len(probs))]
    for by in ([], ["g"]):
        got = exact_quantiles(df, cols, probs, by, names, 2 if by else None, accuracy=100).orderBy(*(by or [F.lit(1)])).collect()
        ref = df.groupBy(*by).agg(*[F.percentile(c, p) for c in cols for p in probs]).orderBy(*(by or [F.lit(1)])).collect()
        for g, r in zip(got, ref, strict=True):
            for a, b in zip(g[len(by):], r[len(by):]):
                assert (a is None and b is None) or a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b))
    near = exact_quantiles(df, "even", probs, names=["a", "b", "c", "d"], accuracy=1000, approximate=True).first()
    assert all(abs(x - p * 30_000) <= 31 for x, p in zip(near, probs))


def test_quantiles_read_their_input_twice(spark, tmp_path):
    from clickscore.operators._util import exact_quantiles
    spark.range(1000).selectExpr("id % 3 AS g", "id * 1.0 AS a", "id * 2.0 AS b").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.99])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 3 and "BroadcastHashJoin" not in plan      # the counts meet the first pass's one row again
    one = exact_quantiles(df, "a", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in one.lower()                                          # no bound, no hint, whatever the column's name
