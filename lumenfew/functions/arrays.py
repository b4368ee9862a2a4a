"""Array columns as spectra, in higher-order functions. Null arrays give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def doubles(x: Column | str) -> Column:
    """``array<float>`` widened before any arithmetic."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` made once, however often it is used."""
    return F.element_at(F.transform(F.array(x), use), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def sd_pop(x: Column) -> Column:
    """Population standard deviation, in two passes."""
    return F.element_at(F.transform(F.array(mean(x)), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.size(x))), 1)


def snv(x: Column) -> Column:
    """Standard normal variate: each row by its own mean and population deviation."""
    return F.element_at(F.transform(F.array(F.struct(mean(x).alias("m"), sd_pop(x).alias("s"))), lambda k: F.transform(x, lambda v: (v - k["m"]) / (k["s"] + EPS))), 1)


def min_max(x: Column) -> Column:
    """To [0, 1]: the least value taken off, then by the largest of what is left."""
    low = F.array_min(x)
    return F.transform(x, lambda v: (v - low) / (F.array_max(x) - low + EPS))


def resample(x: Column, n: int) -> Column:
    """Piecewise linear onto ``n`` points over the row's own range; both ends stay. ``x`` is made once."""

    def whole(x: Column) -> Column:
        def at(j: Column) -> Column:
            pos = j.cast("double") * (F.size(x) - 1) / float(max(n - 1, 1))
            low = F.floor(pos).cast("int")
            a = F.get(x, low)
            b = F.get(x, F.least(low + 1, F.size(x) - 1))
            return a + (pos - low) * (b - a)

        return F.when(x.isNotNull() & (F.size(x) > 0), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))

    return bound(x, whole)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def project(x: Column, columns: list[list[float]]) -> Column:
    """Row times matrix; ``columns`` holds the matrix by column (bounded by channels x outputs). ``x`` is made once."""
    return bound(x, lambda v: F.array(*[dot(v, F.array(*map(F.lit, map(float, c)))) for c in columns]))


def centred_scores(x: Column, centre: list[float], columns: list[list[float]]) -> Column:
    """Scores of ``x - centre``, as principal components need."""
    return project(F.zip_with(x, F.array(*map(F.lit, map(float, centre))), lambda a, m: a - m), columns)


def channel_sort(axis: Column, x: Column) -> tuple[Column, Column]:
    """Axis (a reciprocal in units of 1e7) ascending, and the values in its order."""
    pairs = F.array_sort(F.zip_with(axis, x, lambda w, v: F.struct((F.lit(1e7) / w).alias("w"), v.alias("v"))))
    return F.transform(pairs, lambda p: p["w"]), F.transform(pairs, lambda p: p["v"])


def masked(x: Column, mask: Column) -> Column:
    """The channels whose mask is true, in order."""
    return F.filter(x, lambda v, i: F.get(mask, i))


def standardised(x: Column, centre: Column, spread: Column, clip: float | None = 5.0, shift: bool = True) -> Column:
    """By a support set's channel means and deviations; clamped at +-``clip``; ``shift=False`` scales only."""
    z = F.zip_with(F.zip_with(x, centre, lambda v, m: v - m) if shift else x, spread, lambda v, s: v / (s + EPS))
    return z if clip is None else F.transform(z, lambda v: F.greatest(F.lit(-clip), F.least(F.lit(clip), v)))


def blended(x: Column, y: Column, share: Column) -> Column:
    """``share`` of ``x`` and the rest of ``y``."""
    return F.zip_with(x, y, lambda a, b: share * a + (1 - share) * b)


def polynomial(coefficients: Column, u: Column) -> Column:
    """Horner's scheme, highest degree first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda a, c: a * u + c)


def complete(x: Column) -> Column:
    """No null and no NaN."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))


def any_present(x: Column) -> Column:
    return F.exists(x, lambda v: v.isNotNull() & ~F.isnan(v))


def inverted_cdf(x: Column, share: float) -> Column:
    """The least value whose empirical distribution reaches ``share``."""
    return F.element_at(F.array_sort(x), F.greatest(F.lit(1), F.ceil(F.size(x) * F.lit(share) - 1e-9).cast("int")))


def log_grid(low: float, high: float, n: int) -> Column:
    """``n`` powers of ten between the exponents."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit((high - low) / (n - 1))))
