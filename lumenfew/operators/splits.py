"""Deterministic, paired and group-aware splits.

``mode="hash"`` orders by md5 of (family, k, rep, id): any engine can repeat it. The
``numpy_*`` functions build index vectors on the driver from published seeds, for tasks
of at most ``SMALL`` rows, and return them as a table to join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a task that a driver-side split takes at most.
SMALL = 100_000


def code(family: str, k: int, rep: int, id_: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(family), F.lit(k), F.lit(rep), id_.cast("string")))


def support(df: DataFrame, id_: str, k: int, rep: int, family: str = "eval") -> DataFrame:
    """The first ``k`` rows by hash: a bounded top-k, without ordering the table."""
    return df.withColumn("__code", code(family, k, rep, F.col(id_))).orderBy("__code", id_).limit(k).drop("__code")


def with_roles(df: DataFrame, chosen: DataFrame, id_: str) -> DataFrame:
    """``role``: support for the (few) chosen ids, query for the rest."""
    picked = F.broadcast(chosen.select(F.col(id_).alias("__id")))
    return df.join(picked, F.col(id_) == F.col("__id"), "left").withColumn("role", F.when(F.col("__id").isNotNull(), "support").otherwise("query")).drop("__id")


def eval_split(df: DataFrame, id_: str, k: int, rep: int) -> DataFrame:
    """K rows support, all others query."""
    return with_roles(df, support(df, id_, k, rep), id_)


def group_support(df: DataFrame, group: str, k: int, rep: int, family: str) -> DataFrame:
    """The first ``k`` groups by hash, as a column ``__group``."""
    groups = df.select(group).distinct()
    return support(groups, group, k, rep, family).select(F.col(group).alias("__group"))


def grouped_eval_split(df: DataFrame, id_: str, group: str, k: int, rep: int) -> DataFrame:
    """One member of each of K groups is support; those groups' other members take no part; the rest is query."""
    chosen = F.broadcast(group_support(df, group, k, rep, "group"))
    inside = df.join(chosen, F.col(group) == F.col("__group"), "left_semi")
    first = inside.groupBy(group).agg(F.min_by(id_, F.struct(code("member", k, rep, F.col(id_)), F.col(id_))).alias(id_)).select(id_, group, F.lit("support").alias("role"))
    rest = df.join(chosen, F.col(group) == F.col("__group"), "left_anti").select(id_, group, F.lit("query").alias("role"))
    return first.unionByName(rest)


def whole_group_split(df: DataFrame, group: str, k: int, rep: int) -> DataFrame:
    """K whole groups are support, all other rows query."""
    chosen = F.broadcast(group_support(df, group, k, rep, "whole"))
    joined = df.join(chosen, F.col(group) == F.col("__group"), "left")
    return joined.withColumn("role", F.when(F.col("__group").isNotNull(), "support").otherwise("query")).drop("__group")


def first_by_hash(df: DataFrame, by: list[str], code_: Column, id_: str, wanted: Callable[[Column], Column], name: str) -> DataFrame:
    """``name``: whether a row is among the first ``wanted(n)`` of its cell's ``n`` rows by hash.

    Rows are ranked within the cell's hashes of one three-digit beginning (a 4096th of the
    cell); how many come before is counted, so no window holds a whole cell.
    """
    coded = df.withColumn("__code", code_).withColumn("__p", F.substring("__code", 1, 3))
    parts = coded.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    cell = Window.partitionBy(*by)
    # at most 4096 rows a cell
    parts = parts.withColumn("__before", F.sum("__c").over(cell.orderBy("__p")) - F.col("__c")).withColumn("__wanted", wanted(F.sum("__c").over(cell))).drop("__c")
    keys = [*by, "__p"]
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__before", "__wanted")
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__code", id_))
    return coded.withColumn("__r", rank).join(parts, on).select(*df.columns, (F.col("__before") + F.col("__r") <= F.col("__wanted")).alias(name))


def share_split(df: DataFrame, id_: str, share: float, rep: int | Column, by: list[str], family: str = "candidate") -> DataFrame:
    """Within each cell ``by``: the first round-half-even(share * n) rows are candidates, the rest test."""
    code_ = F.md5(F.concat_ws("-", F.lit(family), F.lit(0), F.lit(rep) if isinstance(rep, int) else rep, F.col(id_).cast("string")))
    some = first_by_hash(df, by, code_, id_, lambda n: F.bround(n * share), "__first")
    return some.withColumn("role", F.when(F.col("__first"), "candidate").otherwise("test")).drop("__first")


def halves(df: DataFrame, id_: str, k: int, rep: int, by: list[str]) -> DataFrame:
    """Within each cell: ``is_calibration`` for the first half (rounded down)."""
    return first_by_hash(df, by, code("half", k, rep, F.col(id_)), id_, lambda n: F.floor(n / 2), "is_calibration")


def capped(df: DataFrame, id_: str, most: int, by: list[str], rep: int = 0) -> DataFrame:
    """A sample of at most ``most`` rows of each cell, by hash (query caps)."""
    order = Window.partitionBy(*by).orderBy(code("cap", most, rep, F.col(id_)), id_)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")


# -- index vectors with numpy's generator -------------------------------------------


def _checked(n: int) -> int:
    if n > SMALL:
        raise ValueError(f"a driver-side split takes at most {SMALL} rows; use the hash mode")
    return n


def numpy_eval_split(n: int, k: int, rep: int, seed: int = 42, groups: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Support indices, in the order of their draw, and query indices by numpy's default generator.

    With ``groups``, one member of each of ``k`` groups is support and all others of those groups are left out.
    """
    rng = np.random.default_rng(seed * 1000 + k * 100 + rep)
    _checked(n)
    if groups is None:
        drawn = rng.choice(n, k, replace=False)
        return drawn, np.delete(np.arange(n), drawn)
    _, which = np.unique(np.asarray(groups), return_inverse=True)
    drawn = rng.permutation(which.max() + 1)[:k]
    support = []
    for g in drawn:
        own = np.flatnonzero(which == g)
        rng.shuffle(own)
        support.append(own[0])
    return np.array(support, int), np.flatnonzero(~np.isin(which, drawn))


def numpy_group_split(groups: list, k: int, rep: int, seed: int = 66) -> tuple[np.ndarray, np.ndarray]:
    """All rows of ``k`` drawn groups as support, the others as query."""
    _checked(len(groups))
    names = np.unique(np.asarray(groups))
    drawn = np.random.default_rng(seed * 1000 + k * 100 + rep).choice(names, min(k, len(names)), replace=False)
    inside = np.isin(np.asarray(groups), drawn)
    return np.flatnonzero(inside), np.flatnonzero(~inside)


def numpy_fusion_split(n: int, k: int, rep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of a permutation as support, the rest as query."""
    order = np.random.default_rng(66_000 + k * 100 + rep).permutation(_checked(n))
    return order[:k], order[k:]


def numpy_candidate_split(n: int, rep: int, share: float = 0.6, groups: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidates and test rows; with ``groups``, whole groups on either side."""
    rng = np.random.default_rng(66_900 + rep)
    if groups is None:
        order = rng.permutation(_checked(n))
        cut = round(share * n)
        return order[:cut], order[cut:]
    names = np.unique(np.asarray(groups))
    inside = np.isin(np.asarray(groups), names[rng.permutation(len(names))[: round(share * len(names))]])
    return np.flatnonzero(inside), np.flatnonzero(~inside)


def split_table(spark: SparkSession, task: str, k: int, rep: int, chosen: np.ndarray, rest: np.ndarray) -> DataFrame:
    """(task, support_size, repetition, idx, role), to broadcast against features."""
    rows = [(task, k, rep, int(i), "support") for i in chosen] + [(task, k, rep, int(i), "query") for i in rest]
    return spark.createDataFrame(rows, "task string, support_size int, repetition int, idx long, role string")
