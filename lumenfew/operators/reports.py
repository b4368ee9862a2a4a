"""Report queries over result tables: (task, support_size, repetition, arm) rows. Relational throughout."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfew.functions import metrics as M
from lumenfew.operators.ordered import joined, quantiles, running

CELL = ["task", "support_size", "repetition"]


def with_quantiles(df: DataFrame, by: list[str], value: Column | str, shares: dict[str, float], *aggregates: Column) -> DataFrame:
    """Each group's exact quantiles by name, and plain aggregates. Neither gathers a group."""
    q = quantiles(df, by, value, list(shares.values()), "__q")
    named = q.select(*by, *[F.get("__q", i).alias(n) for i, n in enumerate(shares)])
    return joined(named, df.groupBy(*by).agg(*aggregates), by)


def medians(df: DataFrame, by: list[str], value: str = "r2") -> DataFrame:
    """Median of winsorised R2 and its units."""
    return with_quantiles(df, by, M.winsorised(F.col(value)), {"median_r2": 0.5}, F.count("*").alias("n"))


def iqr_then_median(df: DataFrame, inner: list[str], outer: list[str], value: str = "r2") -> DataFrame:
    """Interquartile range of each inner group, then their median."""
    ranges = quantiles(df, inner, M.winsorised(F.col(value)), [0.25, 0.75]).withColumn("iqr", F.get("q", 1) - F.get("q", 0))
    return with_quantiles(ranges, outer, "iqr", {"median_iqr": 0.5}, F.count("*").alias("n_groups"))


def paired(df: DataFrame, a: str, b: str, cell: list[str], value: str = "r2", arm: str = "arm") -> DataFrame:
    """Cells that have both arms: ``a`` and ``b``, by one conditional aggregation instead of a self join."""
    pick = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    return df.where(F.col(arm).isin(a, b)).groupBy(*cell).agg(pick(a).alias("a"), pick(b).alias("b")).where("a is not null and b is not null")


def win_rates(pairs: DataFrame, by: list[str]) -> DataFrame:
    return with_quantiles(pairs, by, F.col("a") - F.col("b"), {"median_difference": 0.5}, F.avg((F.col("a") > F.col("b")).cast("double")).alias("win_rate"), F.count("*").alias("n"))


def ratio_medians(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Median of the pair's ratio; pairs with a zero below are left out."""
    return with_quantiles(pairs.where("b <> 0"), by, F.col("a") / F.col("b"), {"median_ratio": 0.5}, F.count("*").alias("n"))


def roc_auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Rank statistic with mid-ranks; null where a class is missing. Equal scores are counted first, ranks come from running counts."""
    counted = df.groupBy(*by, score).agg(F.sum(positive.cast("long")).alias("p"), F.count("*").alias("c"))
    mid = F.col("before_c") + (F.col("c") + 1) / 2
    sums = running(counted, by, [F.col(score)], ["c"]).withColumn("r", mid * F.col("p")).groupBy(*by).agg(F.sum("r").alias("r"), F.sum("p").alias("np"), (F.sum("c") - F.sum("p")).alias("nn"))
    return sums.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), (F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"), F.col("np").alias("n_positive"), F.col("nn").alias("n_negative"))


def signed_ranks(df: DataFrame, by: list[str], difference: Column) -> DataFrame:
    """Wilcoxon's sums of ranks, zeros dropped, mid-ranks for ties; and the ties' correction."""
    d = df.select(*by, difference.alias("d")).where("d <> 0")
    counted = d.groupBy(*by, F.abs("d").alias("m")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count("*").alias("c"))
    ranked = running(counted, by, [F.col("m")], ["c"]).withColumn("r", F.col("before_c") + (F.col("c") + 1) / 2)
    ties = F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")) / 48
    return ranked.groupBy(*by).agg(F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum("c").alias("n"), ties.alias("tie_term"))


#: Pairs up to which the null distribution of the rank sum is worked out.
EXACT_PAIRS = 50


def exact_signed_rank_p(w_plus: float, n: int) -> float:
    """Two-sided p of a sum of ranks without ties: of the 2**n equally likely signs, those as far out or further.

    The numbers of sign patterns with each sum grow rank by rank; Python's whole numbers hold them exactly.
    """
    ways = [1] + [0] * (n * (n + 1) // 2)
    for rank in range(1, n + 1):
        for total in range(len(ways) - 1, rank - 1, -1):
            ways[total] += ways[total - rank]
    low = min(w_plus, n * (n + 1) / 2 - w_plus)
    tail = sum(ways[: math.floor(low + 1e-9) + 1])
    return min(1.0, 2 * tail / 2**n)


def normal_signed_rank_p(w_plus: float, n: int, tie_term: float = 0.0) -> float:
    """Two-sided p by the normal approximation."""
    spread = n * (n + 1) * (2 * n + 1) / 24 - tie_term
    return math.erfc(abs(w_plus - n * (n + 1) / 4) / math.sqrt(2 * spread)) if spread > 0 else 1.0


def wilcoxon_p(w_plus: float, n: int, tie_term: float = 0.0) -> float:
    """Two-sided p: exact for up to ``EXACT_PAIRS`` pairs without ties, else by the normal approximation."""
    if not n:
        return 1.0
    return exact_signed_rank_p(w_plus, n) if n <= EXACT_PAIRS and not tie_term else normal_signed_rank_p(w_plus, n, tie_term)


def paired_test(df: DataFrame, by: list[str], difference: Column) -> DataFrame:
    """``signed_ranks`` with its p. Few rows are left by then: one a group."""

    @F.pandas_udf("double")
    def p(w: pd.Series, n: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([wilcoxon_p(*r) for r in zip(w, n, t, strict=True)])

    return signed_ranks(df, by, difference).withColumn("p_value", p(F.col("w_plus").cast("double"), F.col("n").cast("long"), F.col("tie_term").cast("double")))


def released(df: DataFrame, by: list[str], score: str, value: str, tie: list[str], share: float = 0.2) -> DataFrame:
    """Reject the highest-scoring ``share`` of each group; failure rates before and after. ``tie`` tells rows of one score apart."""
    ranked = running(df.withColumn("__one", F.lit(1)), by, [(F.col(score), True), *[F.col(t) for t in tie]], ["__one"])
    rows = ranked.withColumn("kept", F.col("before___one") + 1 > F.floor(F.col("total___one") * share + 1e-9))
    bad = lambda c: F.avg((c < 0).cast("double"))
    stay = F.when(F.col("kept"), F.col(value))
    return with_quantiles(rows, by, stay, {"median_released": 0.5}, F.count("*").alias("n"), F.count(stay).alias("n_released"), bad(F.col(value)).alias("bad_before"), bad(stay).alias("bad_after"))


def crossover(df: DataFrame, k: str, a: str, b: str, by: list[str]) -> DataFrame:
    """Where curve ``a - b`` changes sign between neighbouring ``k``, by a straight line."""
    order = Window.partitionBy(*by).orderBy(k)
    d = F.col(a) - F.col(b)
    rows = df.withColumn("d", d).withColumn("next_k", F.lead(k).over(order)).withColumn("next_d", F.lead("d").over(order))
    return rows.where("d * next_d < 0 or (d = 0 and next_d is not null)").select(*by, (F.col(k) + (F.col("next_k") - F.col(k)) * F.col("d") / (F.col("d") - F.col("next_d"))).alias("crossing"))


def best_arms(df: DataFrame, k: str, arm: str, value: str) -> DataFrame:
    """For each ``k`` the arm of the greatest median, the mean breaks ties, then the name."""
    each = with_quantiles(df, [k, arm], value, {"median": 0.5}, F.avg(value).alias("mean"))
    return each.groupBy(k).agg(F.max_by(F.struct(arm, "median", "mean"), F.struct("median", "mean", arm)).alias("b")).select(k, f"b.{arm}", "b.median", "b.mean")


def baseline_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the measures, repetitions, and mean test rows."""
    each = [f(F.col(c)).alias(f"{c}_{n}") for c in ("r2", "rmse", "rpd") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return df.groupBy(*by).agg(*each, F.count("*").alias("n_repetitions"), F.avg("n_test").alias("n_test_mean"))


def gate_against_audit(gate: DataFrame, audit: DataFrame) -> DataFrame:
    """Gate rows with their audit row at the native posterior's 90 % level: one to one once both are fixed."""
    own = audit.where((F.col("method") == "native-posterior") & (F.col("nominal") == 90)).select(*CELL, "empirical_coverage", "mean_interval_width")
    return gate.join(own, CELL)


def aligned(families: dict[str, DataFrame], value: str = "r2") -> DataFrame:
    """Cells that all families have, one column a family."""
    names = list(families)
    every = None
    for name, df in families.items():
        own = df.select(*CELL, F.lit(name).alias("family"), F.col(value).alias("v"))
        every = own if every is None else every.unionByName(own)
    picks = [F.max(F.when(F.col("family") == n, F.col("v"))).alias(n) for n in names]
    return every.groupBy(*CELL).agg(*picks, F.countDistinct("family").alias("__n")).where(F.col("__n") == len(names)).drop("__n")


def seconds(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("n"))


def error_quantiles(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """Median and 90 % point of errors, linear between ranks."""
    return with_quantiles(df, by, error, {"median_error": 0.5, "p90_error": 0.9}, F.count("*").alias("n"))
