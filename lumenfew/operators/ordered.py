"""Sums in value order and exact quantiles of groups of any size.

A group of up to ``GATHERED`` rows is one task's: windows and percentiles do. Larger groups
are never gathered:

* ``running``. Rows are dealt to ranges of (group, order) by Spark's range partitioner and written
  once, with the number of their range. Each range is summed, the ranges' totals are carried along,
  and a window within each range gives the rest. No window holds more than a range.
* ``quantiles``. A value's rank is looked for by buckets: each group's values are counted in ``BUCKETS``
  buckets of equal width, the bucket that holds the rank has least and greatest values of its own,
  and is cut again, until it holds one value. Only counts move; a round cuts the span of values by
  ``BUCKETS``, so a billion evenly spread values take three or four.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfew.sources.sinks import stored

#: Rows of a group that one task may hold.
GATHERED = 100_000
#: Buckets of a round.
BUCKETS = 1024


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])


def by_size(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that one task may hold, and those of larger ones (None if there are none)."""
    large = df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > GATHERED).drop("__n")
    if large.isEmpty():
        return df, None
    if not by:
        return df.limit(0), df
    large = stored(large, "large")
    return joined(df, large, by, "left_anti"), joined(df, large, by, "left_semi")


def running(df: DataFrame, by: list[str], order: list, sums: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, ``before_<c>`` (of the group's rows that come earlier in ``order``) and ``total_<c>`` (of the group).

    ``order`` (columns, or pairs of a column and True where it descends) must tell the rows of a group apart:
    count equal ones together first. Large groups are cut into ``ranges`` (shuffle partitions by default).
    """
    df = df.withColumns({f"__o{i}": c[0] if isinstance(c, tuple) else c for i, c in enumerate(order)})
    keys = [f"__o{i}" for i in range(len(order))]
    small, large = by_size(df, by)
    out = _windows(small, by, keys, order, sums)
    if large is not None:
        out = out.unionByName(_ranges(large, by, keys, order, sums, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return out.drop(*keys)


def _sorts(keys: list[str], order: list) -> list[Column]:
    return [F.col(k).desc() if isinstance(c, tuple) and c[1] else F.col(k).asc() for k, c in zip(keys, order, strict=True)]


def _windows(df: DataFrame, by: list[str], keys: list[str], order: list, sums: list[str]) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(*_sorts(keys, order)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return df.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums} | {f"total_{c}": F.sum(c).over(whole) for c in sums})


def _ranges(df: DataFrame, by: list[str], keys: list[str], order: list, sums: list[str], ranges: int) -> DataFrame:
    # written once: sampled bounds would differ if the ranges were made again
    cut = stored(df.repartitionByRange(ranges, *by, *_sorts(keys, order)).withColumn("__range", F.spark_partition_id()), "ranges")
    own = [*by, "__range"]
    totals = cut.groupBy(*own).agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = totals.select(*own, *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__c_{c}") for c in sums], *[F.sum(f"__s_{c}").over(Window.partitionBy(*by)).alias(f"total_{c}") for c in sums])
    inside = Window.partitionBy(*own).orderBy(*_sorts(keys, order)).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined(cut, carried, own).withColumns({f"before_{c}": F.col(f"__c_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return rows.drop("__range", *[f"__c_{c}" for c in sums])


def quantiles(df: DataFrame, by: list[str], value: Column | str, shares: list[float], name: str = "q") -> DataFrame:
    """Each group with ``name``: the array of its values' exact quantiles at ``shares``, linear between ranks. Nulls don't count.

    Groups without a value have none (null).
    """
    rows = df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v"))
    small, large = by_size(rows, by)
    out = small.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, shares))).alias(name))
    if large is None:
        return out
    if not by:
        return _by_buckets(large.withColumn("__all", F.lit(1)), ["__all"], shares, name).drop("__all")
    return out.unionByName(_by_buckets(large, by, shares, name))


def _by_buckets(rows: DataFrame, by: list[str], shares: list[float], name: str) -> DataFrame:
    rows = stored(rows, "values")
    groups = rows.groupBy(*by).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    # of a share two ranks: the place between which its quantile lies
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), F.lit(up).alias("up")) for i, s in enumerate(shares) for up in (False, True)])).alias("a")
    place = (F.col("n") - 1) * F.col("share")
    left = groups.where("n > 0").select(*by, "n", "low", "high", asked).select(*by, "n", "low", "high", "a.*")
    left = left.withColumn("rank", F.when(F.col("up"), F.ceil(place)).otherwise(F.floor(place))).withColumn("part", place - F.floor(place))
    ready = None
    while True:
        left = stored(left, "asked")
        now = left.where(_equal("low", "high")).select(*by, "i", "up", "part", F.col("low").alias("v"))
        ready = now if ready is None else ready.unionByName(now)
        left = left.where(~_equal("low", "high"))
        if left.isEmpty():
            break
        left = _narrowed(rows, left, by)
    side = lambda up: F.max(F.when(F.col("up") == up, F.col("v")))
    each = ready.groupBy(*by, "i", "part").agg(side(False).alias("a"), side(True).alias("b"))
    mixed = F.when(_equal("a", "b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    made = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", mixed.alias("q")))), lambda s: s["q"]).alias(name))  # one entry a share
    return joined(groups.select(*by), made, by, "left").select(*by, name)


def _equal(a: str, b: str) -> Column:
    return F.col(a) == F.col(b)  # a NaN equals itself here


def _narrowed(rows: DataFrame, left: DataFrame, by: list[str]) -> DataFrame:
    """Each asked rank's bounds cut to those of the bucket that holds it."""
    spans = left.select(*by, "low", "high").distinct()
    inside = joined(rows, spans, by).where((F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high")))
    # halves keep the span of any two numbers finite; infinities and NaN have buckets of their own
    finite = lambda c: F.greatest(F.least(F.col(c), F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)) / 2
    at = F.floor((F.col("__v") / 2 - finite("low")) / (finite("high") - finite("low")) * BUCKETS)
    odd = F.isnan("__v") | (F.abs("__v") == float("inf"))
    bucket = F.when(F.isnan("__v"), BUCKETS + 2).when(odd, F.when(F.col("__v") > 0, BUCKETS + 1).otherwise(-1)).when(finite("high") == finite("low"), F.when(F.col("__v") <= F.col("low"), 0).otherwise(1)).otherwise(F.least(at, F.lit(BUCKETS)))
    counts = inside.groupBy(*by, "low", "high", bucket.alias("bucket")).agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("greatest"))
    span = Window.partitionBy(*by, "low", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(span), F.lit(0)))
    found = joined(left, counts, [*by, "low", "high"]).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
    return found.select(*by, "n", F.col("least").alias("low"), F.col("greatest").alias("high"), "i", "share", "up", (F.col("rank") - F.col("before")).alias("rank"), "part")
