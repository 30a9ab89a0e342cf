"""Statistical column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0, of whole arrays.

    Below 2 by the series of erf in positive terms, beyond by the continued
    fraction; both are good to some units in the last place.
    """
    out = np.empty_like(x)
    low = x < 2
    y = x[low]
    term = 2 / math.sqrt(math.pi) * y * np.exp(-y * y)
    total = term.copy()
    for n in range(1, 60):
        term = term * (2 * y * y / (2 * n + 1))
        total += term
    out[low] = 1 - total
    z = np.minimum(x[~low], 40.0)
    f = z.copy()
    for n in range(120, 0, -1):
        f = z + n / 2 / f
    out[~low] = np.exp(-z * z) / math.sqrt(math.pi) / f
    return out


@F.pandas_udf(DoubleType())
def chi2_sf1(z2: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution with one degree of freedom; neither Spark nor SQL has erfc."""
    return pd.Series(erfc(np.sqrt(z2.to_numpy(np.float64, na_value=0.0) / 2))).where(z2.notna().to_numpy())


def near_zero(c: Column, tolerance: float = 1e-8) -> Column:
    return F.abs(c) <= tolerance


#: z squared at the default p-value cutoff of 0.05.
Z2_AT_005 = 3.841458820694124


def alphas() -> list[float]:
    """The penalty grid, 10^-2 to 10^10 in half powers."""
    return [10.0 ** (-2 + i / 2) for i in range(25)]
