"""Standard normal density and distribution as column expressions (Spark SQL has neither erf nor a CDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published double-precision rational approximation (Hart 1968; West 2005),
# highest power first; the last pair belongs to the tail.
UPPER = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
LOWER = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
TAIL_FROM = 7.07106781186547
ROOT_TWO_PI = 2.506628274631000502


def _poly(x, coeffs):
    out = coeffs[0]
    for c in coeffs[1:]:
        out = x * out + c
    return out


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / ROOT_TWO_PI


def cdf(x: Column) -> Column:
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near = bell * _poly(a, UPPER) / _poly(a, LOWER)
    far = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TWO_PI
    low = F.when(a > 37, 0.0).when(a < TAIL_FROM, near).otherwise(far)
    return F.when(x > 0, 1 - low).otherwise(low)


def cdf_array(x):
    """numpy twin of ``cdf`` for Arrow batches."""
    import numpy as np

    a = np.minimum(np.abs(x), 38.0)
    bell = np.exp(-a * a / 2)
    near = bell * _poly(a, UPPER) / _poly(a, LOWER)
    far = bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / ROOT_TWO_PI
    low = np.where(a > 37, 0.0, np.where(a < TAIL_FROM, near, far))
    return np.where(x > 0, 1 - low, low)
