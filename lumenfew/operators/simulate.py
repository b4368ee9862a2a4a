"""Generators: component spectra, mixtures, perturbations, and the assembled corpus.

Each generated row draws from its own generator, keyed by (seed, row number), so rows can
be made anywhere and made again after a lost task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.operators.heads import nnls

PEAK_WIDTH = 7.0
POINTS = 512


def component_basis(peaks: DataFrame, axis: DataFrame, width: float = PEAK_WIDTH) -> DataFrame:
    """(compound, wavenumber, value): sums of Gaussians over an axis; peak tables are small and go to every task."""
    near = axis.crossJoin(F.broadcast(peaks.select("compound", F.col("wavenumber").alias("p"), "intensity")))
    return near.groupBy("compound", "wavenumber").agg(F.sum(F.col("intensity") * F.exp(-0.5 * F.pow((F.col("wavenumber") - F.col("p")) / width, 2))).alias("value"))


def baseline_of(rng: np.random.Generator, n: int, degree: int = 3, scale: float = 0.3) -> np.ndarray:
    """A random polynomial over [-1, 1]; the coefficient of the highest degree has half the scale."""
    spread = np.full(degree + 1, scale)
    spread[0] /= 2
    return np.polyval(rng.normal(0, spread), np.linspace(-1, 1, n))


# Ranges of the perturbation chain.
SHIFT, STRETCH, BLUR, BLUR_WIDTH = 3.0, 0.01, 0.3, (0.5, 2.0)
SLOPE, TILT, BASELINE, SNR = (0.9, 1.1), 0.05, 0.15, (30, 60)


def perturbed(rng: np.random.Generator, x: np.ndarray) -> np.ndarray:
    """Shift and stretch about the middle, sometimes blur, tilted scatter, a baseline by the largest value, then noise at a signal-to-noise ratio in decibels."""
    n = len(x)
    at = np.arange(n)
    moved = at + rng.uniform(-SHIFT, SHIFT) + rng.uniform(-STRETCH, STRETCH) * (at - n / 2)
    out = np.interp(at, moved, x)
    if rng.random() < BLUR:
        width = rng.uniform(*BLUR_WIDTH)
        half = (int(6 * width) | 1) // 2
        kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / width) ** 2)
        out = np.convolve(out, kernel / kernel.sum(), "same")
    out = out * (rng.uniform(*SLOPE) + rng.uniform(-TILT, TILT) * np.linspace(-1, 1, n))
    out = out + baseline_of(rng, n, int(rng.integers(2, 4)), BASELINE) * (np.abs(out).max() + 1e-8)
    level = np.sqrt(np.mean(out**2)) / 10 ** (rng.uniform(*SNR) / 20)
    return out + rng.normal(0, level, n)


def mixtures(spark: SparkSession, library: np.ndarray, n: int, seed: int = 42, components: tuple[int, int] = (2, 4), perturb: bool = True, partitions: int | None = None) -> DataFrame:
    """``idx, weights (map), spectrum``: Dirichlet mixtures of 2 to 4 min-max scaled library rows.

    ``library`` is a small matrix (one row a component); rows come from ``spark.range``.
    """
    low = library.min(1, keepdims=True)
    scaled = (library - low) / ((library - low).max(1, keepdims=True) + 1e-8)
    shared = spark.sparkContext.broadcast(scaled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lib = shared.value
        for b in batches:
            out = []
            for i in b.id:
                rng = np.random.default_rng([seed, int(i)])
                own = rng.choice(len(lib), min(int(rng.integers(components[0], components[1] + 1)), len(lib)), replace=False)
                w = rng.dirichlet(np.ones(len(own)))
                x = w @ lib[own]
                out.append((i, {str(k): float(v) for k, v in zip(own, w, strict=True)}, (perturbed(rng, x) if perturb else x).astype(np.float32)))
            yield pd.DataFrame(out, columns=["idx", "weights", "spectrum"])

    return spark.range(0, n, 1, partitions).mapInPandas(run, "idx long, weights map<string,double>, spectrum array<float>")


def compositions(df: DataFrame, x: str, basis: np.ndarray, axis: np.ndarray | None = None) -> DataFrame:
    """``weights``: non-negative least squares on a small basis, and ``residual``: what it leaves of the squared length.

    With ``axis``, a constant and a line along it are fitted too (they have no weight in the result).
    """
    design = basis.T if axis is None else np.column_stack([basis.T, np.ones(len(axis)), (axis - axis.mean()) / 1000])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [np.asarray(v, float) for v in b[x]]
            w = [nnls(design, v) for v in rows]
            left = [float(((v - design @ k) ** 2).sum() / max((v**2).sum(), 1e-12)) for v, k in zip(rows, w, strict=True)]
            yield b.assign(weights=[k[: len(basis)].tolist() for k in w], residual=left)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{own}, weights array<double>, residual double")


# Ranges of the fuel simulation.
PRESENT, ABSENT, BUMP, BUMP_WIDTH, SCALE, NOISE = (0.7, 1.3), 0.01, (0.02, 0.10), (300, 900), (0.6, 1.4), 0.01


def fuel(spark: SparkSession, axis: np.ndarray, basis: np.ndarray, prior: np.ndarray, n: int, seed: int = 66007, partitions: int | None = None) -> DataFrame:
    """``idx, spectrum``: compositions near rows of a small ``prior``, two broad bumps, a scale and noise.

    Components that a row has are multiplied, those it lacks get a little of its largest.
    """
    shared = spark.sparkContext.broadcast((axis, basis, prior))

    def made(rng: np.random.Generator, axis: np.ndarray, basis: np.ndarray, prior: np.ndarray) -> np.ndarray:
        c = prior[rng.integers(len(prior))]
        c = np.where(c > 0, c * rng.uniform(*PRESENT, len(c)), np.abs(rng.normal(0, ABSENT, len(c))) * (c * (c > 0)).max())
        base = c @ basis
        bumps = sum(rng.uniform(*BUMP) * base.max() * np.exp(-0.5 * ((axis - rng.uniform(axis.min(), axis.max())) / rng.uniform(*BUMP_WIDTH)) ** 2) for _ in range(2))
        return rng.uniform(*SCALE) * (base + bumps) + rng.normal(0, NOISE * max(base.max(), 1e-9), len(axis))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [made(np.random.default_rng([seed, int(i)]), *shared.value).astype(np.float32) for i in b.id]
            yield pd.DataFrame({"idx": b.id.to_numpy(), "spectrum": rows})

    return spark.range(0, n, 1, partitions).mapInPandas(run, "idx long, spectrum array<float>")


def corpus(blocks: dict[str, DataFrame], simulated: DataFrame | None = None, points: int = POINTS) -> DataFrame:
    """All blocks on ``points`` channels: ``source, block, ordinal, spectrum``; the order of blocks is fixed, simulated rows last.

    Blocks have ``ordinal`` and ``spectrum`` of any length.
    """
    parts = [*blocks.items(), *([("simulated", simulated)] if simulated is not None else [])]
    out = None
    for i, (name, df) in enumerate(parts):
        own = df.select(F.lit(name).alias("source"), F.lit(i).alias("block"), F.col("ordinal").cast("long").alias("ordinal"), A.resample(A.doubles("spectrum"), points).cast("array<float>").alias("spectrum"))
        out = own if out is None else out.unionByName(own)
    return out


def checked_size(df: DataFrame, expected: int, what: str) -> DataFrame:
    """``df``, or an error if it hasn't the expected number of rows."""
    if (n := df.count()) != expected:
        raise ValueError(f"{what}: {n} rows instead of {expected}")
    return df
