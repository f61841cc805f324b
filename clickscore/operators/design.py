"""Design-matrix preparation, collinearity and sample splits (M1-M6).

Column statistics (caps, means, standard deviations) are one-row aggregates
cross-joined back, so preparing a design is two Spark passes regardless of
the number of columns.  VIF needs the inverse of a k x k correlation matrix
(k <= 15): the moments are one Spark aggregate, the inverse is constant-size
driver algebra.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickscore.functions import exprs as X
from clickscore.functions.constants import GROUPS
from clickscore.operators._util import exact_quantiles, local_frame
from clickscore.operators.base import KEYS

RATE_COLS = [f"rate_{g}" for g in GROUPS]
INTENSITY_COLS = [f"intensity_{g}" for g in GROUPS]
BEHAV_COLS = ["clicks_per_session", "n_sessions", "n_distinct_features"]
SCALE_COL = "total_feature_clicks"


def with_target(profile: DataFrame) -> DataFrame:
    """Ordinal target nps_ord (detractor 0, passive 1, promoter 2)."""
    return profile.withColumn("nps_ord", X.ordinal_code("nps_category"))


# Wide per-column expressions are SQL text (one parse each) rather than chains
# of Column operators (several Py4J round trips each).
def _zscore_sql(cols: list[str]) -> list[str]:
    return [f"(`{c}` - _mu{i}) / (CASE WHEN _sd{i} = 0 OR _sd{i} IS NULL THEN 1.0 ELSE _sd{i} END) AS `{c}`"
            for i, c in enumerate(cols)]


def prepare_design(df: DataFrame, cols: list[str], p: float = 0.99, keep: list[str] | None = None) -> DataFrame:
    """M1: cap each column at its p-quantile (non-NULL values), then NULL -> 0,
    then z-score with the population standard deviation (zero sd -> 1)."""
    keep = keep if keep is not None else KEYS + ["nps_ord"]
    caps = exact_quantiles(df, cols, [p], names=[f"_cap{i}" for i in range(len(cols))])
    clipped = df.crossJoin(F.broadcast(caps)).selectExpr(
        *[f"`{k}`" for k in keep],
        *[f"coalesce(CASE WHEN `{c}` IS NULL THEN NULL ELSE least(CAST(`{c}` AS DOUBLE), _cap{i}) END, 0.0) AS `{c}`"
          for i, c in enumerate(cols)])
    return _standardise(clipped, cols, keep)


def _standardise(df: DataFrame, cols: list[str], keep: list[str], stats_from: DataFrame | None = None) -> DataFrame:
    src = stats_from if stats_from is not None else df
    stats = src.agg(*[F.expr(f"avg(`{c}`) AS _mu{i}") for i, c in enumerate(cols)],
                    *[F.expr(f"stddev_pop(`{c}`) AS _sd{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(stats))
    return j.selectExpr(*[f"`{k}`" for k in keep], *_zscore_sql(cols))


def prepare_design_pair(train: DataFrame, test: DataFrame, cols: list[str], p: float = 0.99,
                        keep: list[str] | None = None):
    """M2: NULL -> 0 first, caps and mean/sd from ``train`` applied to both."""
    keep = keep if keep is not None else KEYS + ["nps_ord"]
    fill = [f"`{k}`" for k in keep] + [f"coalesce(CAST(`{c}` AS DOUBLE), 0.0) AS `{c}`" for c in cols]
    tr, te = train.selectExpr(*fill), test.selectExpr(*fill)
    caps = F.broadcast(exact_quantiles(tr, cols, [p], names=[f"_cap{i}" for i in range(len(cols))]))

    def clip(d):
        return d.crossJoin(caps).selectExpr(*[f"`{k}`" for k in keep],
                                            *[f"least(`{c}`, _cap{i}) AS `{c}`" for i, c in enumerate(cols)])
    tr_c, te_c = clip(tr), clip(te)
    return _standardise(tr_c, cols, keep), _standardise(te_c, cols, keep, stats_from=tr_c)


def log_volume(df: DataFrame, keep: list[str] | None = None, col: str = SCALE_COL) -> DataFrame:
    """M3: z-scored log1p(total clicks), no capping."""
    keep = keep if keep is not None else KEYS + ["nps_ord"]
    d = df.select(*keep, F.log1p(F.coalesce(F.col(col).cast("double"), F.lit(0.0))).alias("log_total_clicks"))
    return _standardise(d, ["log_total_clicks"], keep)


# ---- M4 ---------------------------------------------------------------------------------
def centred_products(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """n and the cross-products of the centred columns, in two one-row aggregates.

    Centring first keeps columns with a large mean and a small spread exact.
    """
    k = len(cols)
    if not k:
        return df.count(), np.zeros((0, 0))
    means = df.agg(*[F.expr(f"avg(`{c}`) AS _m{i}") for i, c in enumerate(cols)])
    centred = df.crossJoin(F.broadcast(means)).selectExpr(*[f"`{c}` - _m{i} AS x{i}" for i, c in enumerate(cols)])
    r = centred.agg(F.count(F.lit(1)).alias("n"),
                    *[F.expr(f"sum(x{i} * x{j}) AS p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = r[f"p{i}_{j}"] or 0.0
    return r["n"], out


def _correlations(design: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the columns that vary, and their correlation matrix."""
    _, cross = centred_products(design, cols)
    spread = np.sqrt(np.clip(np.diag(cross), 0, None))
    varies = np.flatnonzero(spread > 1e-12 * max(1.0, float(spread.max(initial=0.0))))
    return varies, cross[np.ix_(varies, varies)] / np.outer(spread[varies], spread[varies])


def variance_inflation(corr: np.ndarray) -> list[float]:
    """1 / (1 - R^2) of each column on the others, from their correlation matrix.

    A column that takes part in a linear dependency (it has weight in the null
    space) is reproduced exactly by the others: infinity.
    """
    values, vectors = np.linalg.eigh(corr)
    null = values < 1e-10 * len(values)
    weight = (vectors[:, null] ** 2).sum(1)
    part = (vectors[:, ~null] ** 2 / values[~null]).sum(1)
    return [float("inf") if w > 1e-8 else float(v) for w, v in zip(weight, part)]


def vif(design: DataFrame, cols: list[str]) -> DataFrame:
    """M4: VIF per column (regression with intercept), largest first.

    Infinity for a column that is a linear combination of others, NULL for a
    constant column.
    """
    varies, corr = _correlations(design, cols)
    found = dict(zip(varies.tolist(), variance_inflation(corr))) if len(varies) else {}
    return (local_frame(design.sparkSession, [(c, found.get(i)) for i, c in enumerate(cols)],
                        [("feature", "string"), ("VIF", "double")])
            .orderBy(F.col("VIF").desc_nulls_last(), F.col("feature")))


def high_vif(vif_df: DataFrame, limit: float = 10.0) -> list[str]:
    return [r["feature"] for r in vif_df.filter(F.col("VIF") > limit).collect()]


def independent(design: DataFrame, cols: list[str]) -> list[str]:
    """``cols`` in order, without constant columns and without columns that the ones before them determine."""
    varies, corr = _correlations(design, cols)
    kept: list[int] = []
    for a in range(len(varies)):
        chosen = corr[np.ix_(kept + [a], kept + [a])]
        if np.linalg.eigvalsh(chosen)[0] > 1e-10 * len(chosen):
            kept.append(a)
    return [cols[varies[a]] for a in kept]


# ---- M5, M6 -------------------------------------------------------------------------------
def _shuffle_key(seed: int):
    sid = F.concat_ws("|", F.lit(str(seed)), F.col("userhasheduuid").cast("string"),
                      F.coalesce(F.col("nps_score").cast("string"), F.lit("")), F.col("nps_category"))
    return F.md5(sid)


def _stratum_rank(df: DataFrame, seed: int, strata: str, ranges: int = 256) -> DataFrame:
    """Adds ``_rank`` (1-based, seeded hash order inside the stratum) and ``_n``.

    No window over a whole stratum (a third of the rows each): the md5 order
    key's first byte cuts a stratum into ``ranges`` ordered slices; a slice's
    offset (from a table of strata x ranges counts) plus the row number inside
    the slice is the global rank, exactly.
    """
    d = (df.withColumn("_key", _shuffle_key(seed))
         .withColumn("_rg", F.floor(F.conv(F.substring("_key", 1, 2), 16, 10).cast("int") * ranges / 256)))
    cnt = d.groupBy(strata, "_rg").agg(F.count(F.lit(1)).alias("_c"))
    wo = Window.partitionBy(strata).orderBy("_rg")            # <= ranges rows per stratum
    off = cnt.select(strata, "_rg",
                     F.coalesce(F.sum("_c").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                     .alias("_off"), F.sum("_c").over(Window.partitionBy(strata)).alias("_n"))
    w = Window.partitionBy(strata, "_rg").orderBy("_key", F.col("userhasheduuid"))
    d = d.withColumn("_r", F.row_number().over(w)).join(off, [strata, "_rg"])
    return d.withColumn("_rank", F.col("_off") + F.col("_r")).drop("_key", "_rg", "_r", "_off")


def stratified_split(df: DataFrame, train_frac: float = 0.8, seed: int = 42, strata: str = "nps_category") -> DataFrame:
    """Adds ``is_train``: exactly round(frac * n) rows of each stratum, chosen by
    a seeded hash order (deterministic, engine-independent)."""
    r = _stratum_rank(df, seed, strata)
    return (r.withColumn("is_train", F.col("_rank") <= F.round(F.col("_n") * train_frac))
            .drop("_rank", "_n").select(*df.columns, "is_train"))


def stratified_folds(df: DataFrame, k: int = 5, seed: int = 42, strata: str = "nps_category") -> DataFrame:
    """Adds ``fold`` in 0..k-1, dealt round-robin inside each stratum in hash order."""
    r = _stratum_rank(df, seed, strata)
    return r.select(*df.columns, ((F.col("_rank") - 1) % k).cast("int").alias("fold"))
