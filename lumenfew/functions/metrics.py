"""Aggregate expressions over (prediction, truth) rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def r2(pred: Column, y: Column) -> Column:
    """1 - SSres / SStot; null where the truth hardly varies. Not the squared correlation."""
    spread = F.regr_syy(y, y)
    return F.when(spread > TINY, 1 - F.sum((pred - y) * (pred - y)) / spread)


def rmse(pred: Column, y: Column) -> Column:
    return F.sqrt(F.avg((pred - y) * (pred - y)))


def rpd(pred: Column, y: Column) -> Column:
    """Sample deviation over RMSE; infinite for a perfect fit."""
    e = rmse(pred, y)
    return F.when(e <= TINY, F.lit(float("inf"))).otherwise(F.stddev_samp(y) / e)


def coverage(low: Column, high: Column, y: Column) -> Column:
    return F.avg(y.between(low, high).cast("double"))


def width(low: Column, high: Column) -> Column:
    return F.avg(high - low)


def accuracy(pred: Column, y: Column) -> Column:
    return F.avg((pred == y).cast("double"))


def catastrophic(r2_: Column) -> Column:
    return (r2_ < -1).cast("int")


def winsorised(r2_: Column) -> Column:
    """R2 with its floor at -1, at report time only."""
    return F.greatest(r2_, F.lit(-1.0))


def blank_limits(pred: Column, level: Column) -> tuple[Column, Column, Column, Column]:
    """Mean and population deviation of blank predictions, detection and quantitation limits."""
    blank = F.when(level == 0, pred)
    m, s = F.avg(blank), F.stddev_pop(blank)
    return m, s, m + 3.3 * s, m + 10 * s


def order_free_digest(*columns: str) -> Column:
    """A digest of rows in any order: sums of 64-bit hashes as text."""
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string")), 256)
