"""Scattering coefficients of a spectrum with complex Morlet wavelets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import pandas_udf

SCALES = (2, 4, 8, 16, 32)
BANDWIDTH, CENTRE = 1.5, 1.0


def morlet(scale: float) -> np.ndarray:
    """The sampled wavelet at a scale, from -4 to 4 bandwidths, of unit energy."""
    t = np.arange(-int(4 * scale), int(4 * scale) + 1) / scale
    return np.exp(-t * t / BANDWIDTH + 2j * np.pi * CENTRE * t) / np.sqrt(np.pi * BANDWIDTH * scale)


def scattered(x: np.ndarray) -> np.ndarray:
    """Mean moduli of rows at 5 scales, and of the moduli at the 10 pairs of a finer and a coarser scale."""
    width = x.shape[1]
    first, means = {}, []
    for s in SCALES:
        kernel = np.fft.fft(morlet(s), n := width + 8 * s)
        full = np.fft.ifft(np.fft.fft(x, n, axis=1) * kernel, axis=1)
        first[s] = np.abs(full[:, 4 * s : 4 * s + width])
        means.append(first[s].mean(1))
    for a, b in combinations(SCALES, 2):
        kernel = np.fft.fft(morlet(b), n := width + 8 * b)
        full = np.fft.ifft(np.fft.fft(first[a], n, axis=1) * kernel, axis=1)
        means.append(np.abs(full[:, 4 * b : 4 * b + width]).mean(1))
    return np.stack(means, 1)


def scattering(x: Column) -> Column:
    @pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rows), dtype=object)
        sizes = rows.map(lambda r: -1 if r is None else len(r))
        for n in sizes[sizes > 0].unique():  # rows of one width together
            at = np.flatnonzero(sizes == n)
            for i, v in zip(at, scattered(np.stack(rows.iloc[at].to_list()).astype(float)), strict=True):
                out.iloc[i] = v
        return out

    return run(x)


def with_scattering(df: DataFrame, x: str = "x") -> DataFrame:
    """``df`` with the coefficients in place of its array column; rows of one width only."""
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == x else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(**{x: list(scattered(np.stack(b[x].to_list()).astype(float)))})

    return df.mapInPandas(run, schema)
