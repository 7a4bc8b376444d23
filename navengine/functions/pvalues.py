"""p values of chi-square and t statistics, for tables that are already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi_square_tail(x: float, dof: int) -> float:
    """Chance of a value above x: the finite sums for whole degrees of freedom."""
    if dof < 1 or x <= 0:
        return 1.0
    h = x / 2
    first = 0.5 if dof % 2 else 0.0
    terms = [math.exp(a * math.log(h) - h - math.lgamma(a + 1)) for a in np.arange(first, dof / 2 - 0.5, 1.0)]
    return min(1.0, math.fsum(terms) + (math.erfc(math.sqrt(h)) if dof % 2 else 0.0))


def student_tail(t: float, dof: int, normal_from: int = 100_000) -> float:
    """Two-sided chance of a value at least as far from 0 as t; many degrees of freedom count as a normal distribution."""
    if dof < 1:
        return math.nan
    if dof >= normal_from:
        return math.erfc(abs(t) / math.sqrt(2))
    angle = math.atan(abs(t) / math.sqrt(dof))
    sine, square = math.sin(angle), math.cos(angle) ** 2
    odd = dof % 2
    k = np.arange(1, (dof - 1) // 2 if odd else dof // 2)
    ratio = (2 * k / (2 * k + 1) if odd else (2 * k - 1) / (2 * k)) * square
    total = 1.0 + float(np.cumprod(ratio).sum())
    inside = 2 / math.pi * (angle + (sine * math.cos(angle) * total if dof > 1 else 0.0)) if odd else sine * total
    return max(0.0, 1.0 - inside)


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi_square_tail(a, int(k)) for a, k in zip(x, dof, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else student_tail(a, int(k)) for a, k in zip(t, dof, strict=True)], dtype="float64")
