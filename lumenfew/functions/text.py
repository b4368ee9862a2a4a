"""Text coercion at the edge of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_id(c: Column) -> Column:
    """Trim, take off double quotes at both ends, trim again."""
    return F.trim(F.regexp_replace(F.trim(c), '^"+|"+$', ""))


def number(c: Column) -> Column:
    """A double, or null where the text is no number (NaN counts as null)."""
    d = F.expr("try_cast(null as double)") if c is None else c.try_cast("double")
    return F.when(~F.isnan(d), d)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns whose names are numbers, by value."""

    def value(name: str) -> float | None:
        try:
            return float(name)
        except ValueError:
            return None

    return sorted((c for c in df.columns if value(c) is not None), key=float)


def registry_id(c: Column) -> Column:
    """``C`` and the digits of a registry number."""
    return F.concat(F.lit("C"), F.translate(c, "-", ""))


def oil_id(kind: Column, value: Column) -> Column:
    """A sample's name from its class and its value at three digits."""
    return F.concat(F.lit("c"), kind.cast("int").cast("string"), F.lit("_pv"), F.round(value, 3).cast("string"))


def arm_of(path: Column) -> tuple[Column, Column, Column]:
    """(generation, representation, task) from a result file's name, parted by double underscores."""
    name = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    parts = F.split(name, "__")
    return F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)


def fit_rows(name: Column) -> Column:
    """Rows to fit on, where a representation's name ends with ``-fit-M``."""
    return F.when(name.contains("-fit-"), F.substring_index(name, "-fit-", -1).try_cast("int"))
