"""Principal components with centring.

Rows of up to ``NARROW`` channels: MLlib's covariance (channels x channels numbers on the driver). Wider
rows, such as raw spectra of 11,618 channels: a randomised range finder. Each pass multiplies the rows'
covariance with a sketch of ``k + MORE`` columns: a task sends one channels x columns sum, sums meet
``FAN`` by ``FAN``, and the driver looks for the components in the space of all sketches so far (a block Krylov space,
orthonormal throughout), until they stay where they are. Nothing is rows x rows or channels x channels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A


#: Channels up to which the covariance is formed.
NARROW = 1024
#: Columns of a sketch beyond the components, passes at most, and the angle (sine) at which passes end.
MORE = 20
PASSES = 60
STEADY = 1e-7
#: Sums that meet at once.
FAN = 16
#: Rows of a block of a pass.
BLOCK = 256


@dataclass
class Model:
    centre: list[float]
    columns: list[list[float]]  #: components, one a column of the projection
    variances: list[float]  #: share of the variance

    def scores(self, x: Column) -> Column:
        return A.centred_scores(x, self.centre, self.columns)

    def rebuilt(self, x: Column) -> Column:
        """The row from its scores."""
        rows = np.array(self.columns).T.tolist()
        return F.zip_with(A.project(self.scores(x), rows), F.array(*map(F.lit, self.centre)), lambda v, m: v + m)

    def error(self, x: Column) -> Column:
        """Squared distance of the rebuilt row over the row's squared length."""
        return A.bound(x, lambda v: A.squared_distance(v, self.rebuilt(v)) / A.dot(v, v))


    def transformed(self, df: DataFrame, x: str, name: str, error: str | None = None) -> DataFrame:
        """``df`` with the scores of column ``x`` as ``name``, and the relative error of the rebuilt row: by matrix products in Arrow batches.

        For wide rows, whose components are too many for a plan's literals.
        """
        sent = df.sparkSession.sparkContext.broadcast((np.array(self.centre), np.array(self.columns)))
        made = [(name, "array<double>"), *([(error, "double")] if error else [])]
        kept = [c for c in df.columns if c not in dict(made)]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"`{n}` {t}" for n, t in made)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, columns = sent.value
            for b in batches:
                for part in (b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)):
                    rows = _matrix(part.column(len(kept)), len(centre))
                    scores = (rows - centre) @ columns.T
                    out = [pa.array(list(scores), pa.list_(pa.float64()))]
                    if error:
                        out.append(pa.array(((rows - centre - scores @ columns) ** 2).sum(axis=1) / (rows**2).sum(axis=1)))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *out], names=[*kept, *dict(made)])

        return df.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], A.doubles(x).alias("__x")).mapInArrow(run, schema)


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


def fit(df: DataFrame, x: str, k: int) -> Model:
    """``k`` components of an array column; rows must be of one length."""
    wide = df.select(F.max(F.size(x))).first()[0] or 0
    return fit_wide(df, x, k) if wide > NARROW else fit_narrow(df, x, k)


def summed(df: DataFrame, x: str, make, size: int) -> np.ndarray:
    """``make(rows)``, ``size`` doubles, over all blocks of rows, added up: within a task, then ``FAN`` sums by ``FAN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                column = b.column(0).slice(i, BLOCK)
                total += make(_matrix(column, len(column[0])))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sum"])

    def meet(group: pa.Table) -> pa.Table:
        return pa.table({"sum": [sum(np.frombuffer(v) for v in group.column("sum").to_pylist()).tobytes()]})

    sums = df.select(A.doubles(x).alias("x")).mapInArrow(run, "sum binary")
    parts = df.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.groupBy(F.pmod(F.spark_partition_id(), F.lit(parts)).alias("g")).applyInArrow(meet, "sum binary")
    return sum((np.frombuffer(r.sum) for r in sums.collect()), np.zeros(size))


def fit_wide(df: DataFrame, x: str, k: int, seed: int = 20260915) -> Model:
    """``k`` components of rows of any width, by subspace steps from a random sketch."""
    spark = df.sparkSession
    wide = df.select(F.max(F.size(x))).first()[0] or 0
    k = min(k, wide)
    first = summed(df, x, lambda rows: np.concatenate([rows.sum(axis=0), [len(rows)]]), wide + 1)
    centre = first[:-1] / max(first[-1], 1)
    columns = min(wide, k + MORE)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, columns)))[0]
    before, every, images = None, np.zeros((wide, 0)), np.zeros((wide, 0))
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast((centre, basis))

        def both(rows: np.ndarray, sent=sent) -> np.ndarray:
            """The covariance times the sketch, and the rows' squared length."""
            own, sketch = rows - sent.value[0], sent.value[1]
            return np.concatenate([(own.T @ (own @ sketch)).ravel(), [(own * own).sum()]])

        total = summed(df, x, both, wide * basis.shape[1] + 1)
        moved = total[:-1].reshape(wide, -1)
        every, images = np.hstack([every, basis]), np.hstack([images, moved])
        # within all sketches: the covariance is columns x columns
        inner = every.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        found, values = every @ turn[:, order], values[order]
        if before is not None and np.sqrt(max(0.0, 1 - np.linalg.svd(before.T @ found, compute_uv=False).min() ** 2)) < STEADY:
            break
        before = found
        rest = moved - every @ (every.T @ moved)
        rest -= every @ (every.T @ rest)
        fresh, size, _ = np.linalg.svd(rest, full_matrices=False)
        fresh = fresh[:, size > 1e-10 * max(np.abs(values).max(initial=0.0), 1e-300)][:, : wide - every.shape[1]]
        if not fresh.shape[1]:  # the space is the covariance's own
            break
        basis = np.linalg.qr(fresh - every @ (every.T @ fresh))[0]
    return Model(centre.tolist(), found.T.tolist(), (values / total[-1] if total[-1] else values).tolist())


def fit_narrow(df: DataFrame, x: str, k: int) -> Model:
    """``k`` components as MLlib finds them (its covariance is summed in the executors)."""
    from pyspark.ml.feature import PCA

    rows = df.select(array_to_vector(A.doubles(x)).alias("v"))
    centre = rows.select(Summarizer.mean(F.col("v")).alias("m")).first().m.toArray()
    model = PCA(k=min(k, len(centre)), inputCol="v", outputCol="s").fit(rows)
    return Model(centre.tolist(), model.pc.toArray().T.tolist(), model.explainedVariance.toArray().tolist())


def principal_angles(a: Model, b: Model) -> np.ndarray:
    """Cosines between two component spaces: singular values of a k x k matrix."""
    return np.linalg.svd(np.array(a.columns) @ np.array(b.columns).T, compute_uv=False)
