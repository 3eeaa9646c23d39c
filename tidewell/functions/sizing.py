"""How many rows a sample needs, and how moments of a table and a batch merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles by confidence in percent.
Z = {80: 1.282, 85: 1.44, 90: 1.645, 95: 1.96, 99: 2.576, 99.5: 2.807, 99.9: 3.291}
#: Most that a relative bound allows as an absolute error.
MAX_ERROR = 100_000.0

#: With chance value / size a stratum of at least that many rows keeps about ten. Rows: least size, factor, rows.
GUARD = [
    (100, 0.203759, 100), (50, 0.376508, 50), (40, 0.452739, 40), (30, 0.566406, 30), (20, 0.749565, 20), (15, 0.881575, 15),
    (14, 0.910660, 14), (13, 0.939528, 13), (12, 0.966718, 12), (11, 0.989236, 11),
]


def error_bound(avg: Column, relative: float, absolute: float | None = None) -> Column:
    """The error allowed: the absolute bound if given, else the share of the mean, at most MAX_ERROR."""
    return F.lit(float(absolute)) if absolute is not None else F.least(F.abs(avg) * relative, F.lit(MAX_ERROR))


def needed(s2: Column, rows: Column, e: Column, z: float) -> Column:
    """Cochran's size with the correction for a finite table: n0 = z2 s2 / e2, n = n0 rows / (n0 + rows).

    An error of 0, where any sample is too small, needs all rows; a variance of 0 needs none.
    """
    n0 = F.try_divide(F.lit(z * z) * s2, e * e)
    return F.when(s2 == 0, F.lit(0.0)).when(n0.isNull(), rows.cast("double")).otherwise(n0 * rows / (n0 + rows))


def whole_below(n: Column) -> Column:
    """The whole number below n; one less if n is whole itself."""
    return F.when(n == F.floor(n), F.floor(n) - 1).otherwise(F.floor(n))


def merged_variance(n: Column, var: Column, avg: Column, m: Column, var2: Column, avg2: Column) -> Column:
    """The population variance of two parts together, from their sizes, variances and means."""
    mean = (n * avg + m * avg2) / (n + m)
    return (n * (var + (mean - avg) * (mean - avg)) + m * (var2 + (mean - avg2) * (mean - avg2))) / (n + m)


def guard(size: Column) -> Column:
    """The chance with which rows of a stratum are kept so that about ten stay; 1 for ten rows or fewer."""
    out = None
    for least, factor, rows in GUARD:
        value = F.lit(factor) * rows / size
        out = F.when(size >= least, value) if out is None else out.when(size >= least, value)
    return out.otherwise(F.lit(1.0))


def guard_sql(size: str) -> str:
    return "CASE " + " ".join(f"WHEN {size} >= {a} THEN {b}::DOUBLE * {c} / {size}" for a, b, c in GUARD) + " ELSE 1.0 END"
