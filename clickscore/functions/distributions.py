"""Scalar distribution tails used on constant-size result tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_two_sided(t: float, dof: int) -> float:
    """P(|T| > |t|) for Student's t with a whole number of degrees of freedom.

    With theta = atan(|t| / sqrt(dof)) the probability inside +-t is a finite sum:
    for even dof   sin(theta) * (1 + c/2 + (1*3)/(2*4) c^2 + ...), dof/2 terms,
    for odd dof    2/pi * (theta + sin(theta) cos(theta) * (1 + 2/3 c + (2*4)/(3*5) c^2 + ...)),
    (dof-1)/2 terms, where c = cos(theta)^2.  The terms fall geometrically, so the
    sum ends early for large dof.
    """
    if t is None or dof is None or math.isnan(t) or dof <= 0 or dof != int(dof):
        return float("nan")
    if math.isinf(t):
        return 0.0
    dof = int(dof)
    theta = math.atan2(abs(t), math.sqrt(dof))
    c = math.cos(theta) ** 2
    odd = dof % 2
    terms, term, total = dof // 2, 1.0, 0.0
    for k in range(terms):
        total += term
        term *= c * (2 * k + 1 + odd) / (2 * k + 2 + odd)
        if term < 1e-18 * total:
            break
    if odd:
        inside = 2 / math.pi * (theta + math.sin(theta) * math.cos(theta) * total)
    else:
        inside = math.sin(theta) * total
    return min(1.0, max(0.0, 1.0 - inside))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Arrow-batched two-sided t tail; applied to small result tables only."""
    out = [None if (pd.isna(a) or pd.isna(b)) else t_two_sided(float(a), float(b)) for a, b in zip(t, dof)]
    return pd.Series([None if (v is None or math.isnan(v)) else v for v in out], dtype="float64")


__all__ = ["t_two_sided", "normal_two_sided", "t_pvalue_udf"]
