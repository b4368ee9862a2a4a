"""Tables of spectra: channel statistics, class means, channel masks, representations."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A

#: Seed of the random projection.
PROJECTION_SEED = 20260915


def channel_stats(df: DataFrame, x: str, by: list[str], spread: str = "pop") -> DataFrame:
    """``centre`` and ``spread`` arrays of each group: partial sums by channel before the shuffle."""
    each = df.select(*by, F.posexplode(A.doubles(x)).alias("pos", "v"))
    deviation = F.stddev_pop("v") if spread == "pop" else F.stddev_samp("v")
    stats = each.groupBy(*by, "pos").agg(F.avg("v").alias("m"), deviation.alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m", "s")))  # one entry a channel
    return stats.groupBy(*by).agg(ordered.alias("c")).select(*by, F.transform("c", lambda p: p["m"]).alias("centre"), F.transform("c", lambda p: p["s"]).alias("spread"))


def class_means(df: DataFrame, x: str, by: list[str], least: int = 1) -> DataFrame:
    """The mean spectrum of each class with ``least`` rows or more."""
    n = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return channel_stats(df, x, by).join(n, by).select(*by, "n", F.col("centre").alias("spectrum"))


def standardise_by_support(df: DataFrame, x: str, by: list[str], clip: float | None = 5.0, shift: bool = True) -> DataFrame:
    """``z``: each row by the channel statistics of its cell's support rows (``role``)."""
    stats = channel_stats(df.where("role = 'support'"), x, by)
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # without cells: one row
    return joined.withColumn("z", A.standardised(A.doubles(x), F.col("centre"), F.col("spread"), clip, shift)).drop("centre", "spread")


def complete_channels(df: DataFrame, x: str) -> list[bool]:
    """Which channels are present in every row; one boolean a channel reaches the driver."""
    each = df.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg(F.min((F.col("v").isNotNull() & ~F.isnan("v")).cast("int")).alias("ok"))
    return [bool(r.ok) for r in each.orderBy("pos").collect()]


def drop_incomplete(df: DataFrame, x: str) -> DataFrame:
    """Channels with any gap go, then rows without any value."""
    mask = complete_channels(df, x)
    kept = df.withColumn(x, A.masked(F.col(x), F.array(*map(F.lit, mask))))
    return kept.where(A.any_present(F.col(x)))


def exact_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of groups with exactly ``n`` members: counted first, so that no group meets in one task."""
    own = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n")).where(F.col("__n") == n)
    return df.join(own, F.col(key) == F.col("__k"), "left_semi")


def random_projection(channels: int, outputs: int = 100, seed: int = PROJECTION_SEED) -> list[list[float]]:
    """A Gaussian matrix over sqrt(channels), by column."""
    return (np.random.default_rng(seed).standard_normal((channels, outputs)) / np.sqrt(channels)).T.tolist()


def representation(name: str, channels: int, corpus: DataFrame | None = None, x: str = "spectrum") -> Callable[[Column], Column]:
    """A named representation as a column function: ``raw-spectra-N``, ``random-projection-N``, ``corpus-pca-N[-fit-M]``, ``wavelet-scattering``."""
    if m := re.fullmatch(r"raw-spectra-(\d+)", name):
        return lambda c: A.snv(A.resample(A.doubles(c), int(m[1])))
    if m := re.fullmatch(r"random-projection-(\d+)", name):
        matrix = random_projection(channels, int(m[1]))
        return lambda c: A.project(A.doubles(c), matrix)
    if m := re.fullmatch(r"corpus-pca-(\d+)(?:-fit-(\d+))?", name):
        from lumenfew.operators import pca

        if corpus is None:
            raise FileNotFoundError("the corpus table is missing: build it first")
        rows = corpus if not m[2] else corpus.orderBy(F.md5(F.to_json(F.struct(*corpus.columns)))).limit(int(m[2]))
        model = pca.fit(rows, x, int(m[1]))
        return lambda c: A.centred_scores(A.doubles(c), model.centre, model.columns)
    if name == "wavelet-scattering":
        from lumenfew.operators.wavelet import scattering

        return lambda c: scattering(A.doubles(c))
    raise KeyError(f"no representation is called {name}")
