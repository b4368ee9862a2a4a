"""Sums in value order and exact quantiles: large groups by ranges and buckets equal plain windows, numpy and DuckDB."""

import math
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfew.operators import ordered, reports, trust


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ordered, "GATHERED", 40)


def sample(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"g": np.where(np.arange(n) < n - 60, "hot", "cold"), "h": rng.integers(0, 2, n), "i": rng.permutation(n), "v": np.round(rng.normal(size=n), 3), "w": rng.integers(0, 50, n)})
    df.loc[df.index % 97 == 0, "g"] = None
    return df, spark.createDataFrame(df.astype({"g": object}).where(df.notna(), None)).repartition(5)


def test_running_sums_of_a_large_group_are_cut_into_ranges(spark, small):
    df, frame = sample(spark)
    found = ordered.running(frame, ["g"], [(F.col("v"), True), F.col("i")], ["w", "h"], ranges=16).toPandas()
    assert len(found) == len(df) and set(found.columns) == {*df.columns, "before_w", "before_h", "total_w", "total_h"}
    for g, own in found.groupby("g", dropna=False):
        own = own.sort_values(["v", "i"], ascending=[False, True])
        for c in ("w", "h"):
            assert (own[f"before_{c}"].to_numpy() == np.concatenate([[0], own[c].cumsum().to_numpy()[:-1]])).all(), g
            assert (own[f"total_{c}"] == own[c].sum()).all()


def test_no_window_holds_more_than_a_range(spark, small, monkeypatch):
    seen = []
    plain = ordered.stored

    def watch(df, name):
        out = plain(df, name)
        if name == "ranges":
            seen.append(out.groupBy("__range").count().toPandas()["count"])
        return out

    monkeypatch.setattr(ordered, "stored", watch)
    frame = spark.range(20_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 20_011).alias("v"), F.lit(1).alias("c"))
    found = ordered.running(frame, ["g"], [F.col("v")], ["c"], ranges=16).agg(F.max("before_c"), F.countDistinct("before_c"), F.min("total_c")).first()
    assert tuple(found) == (19_999, 20_000, 20_000)
    (sizes,) = seen
    assert len(sizes) == 16 and sizes.max() < 3 * 20_000 / 16


@pytest.mark.parametrize("by", [["g"], ["g", "h"], []])
def test_quantiles_by_buckets_equal_duckdb(spark, small, by):
    df, frame = sample(spark)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = ordered.quantiles(frame, by, "v", shares).collect()
    keys = ", ".join(by)
    con = duckdb.connect()
    con.register("df", df)
    want = con.execute(f"SELECT {keys + ',' if by else ''} quantile_cont(v, {shares}) AS q FROM df {'GROUP BY ' + keys if by else ''}").fetchall()
    plain = lambda k: "" if k is None or k != k else str(k)
    have = {tuple(plain(r[k]) for k in by): r.q for r in found}
    assert len(have) == len(want)
    for *key, q in want:
        assert have[tuple(map(plain, key))] == pytest.approx(q, abs=1e-12)


def test_quantiles_of_one_key_over_a_whole_table(spark, sf, monkeypatch):
    monkeypatch.setattr(ordered, "GATHERED", 500)
    found = ordered.quantiles(spark.read.parquet(f"{sf}/lineitem.parquet"), [], "l_extendedprice", [0.5, 0.9]).first().q
    want = duckdb.sql(f"SELECT quantile_cont(l_extendedprice, [0.5, 0.9]) FROM '{sf}/lineitem.parquet'").fetchall()[0][0]
    assert found == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("values", [[5.0] * 100, [1.0] * 60 + [2.0] * 60, [5e-324 * i for i in range(90)], [-1.7e308, 1.7e308, 0.0] * 30, [float("inf")] * 30 + [float("-inf")] * 30 + [1.0] * 30, [10.0**i for i in range(-300, 300, 6)], [None] * 30 + [3.0] * 50])
def test_quantiles_of_odd_values(spark, small, values):
    frame = spark.createDataFrame([(1, v) for v in values] + [(2, None)] * 50 + [(3, 1.5)], "g int, v double")
    found = {r.g: r.q for r in ordered.quantiles(frame, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    own = sorted(v for v in values if v is not None)
    want = []
    for s in (0.25, 0.5, 0.75):
        place = (len(own) - 1) * s
        a, b = own[math.floor(place)], own[math.ceil(place)]
        want.append(a if a == b else a + (b - a) * (place - math.floor(place)))
    assert found[1] == pytest.approx(want) and found[2] is None and found[3] == [1.5] * 3


def test_reports_are_the_same_for_large_groups(spark, monkeypatch):
    _, frame = sample(spark, 1500)
    frame = frame.withColumn("y", F.col("w") / 7)
    made = {
        "roc": lambda: reports.roc_auc(frame, ["g"], "w", F.col("h") == 1),
        "ranks": lambda: reports.signed_ranks(frame, ["g"], F.col("w") - 25),
        "released": lambda: reports.released(frame, ["g"], "v", "y", ["i"]),
        "medians": lambda: reports.medians(frame, ["g"], "v"),
        "iqr": lambda: reports.iqr_then_median(frame, ["g", "h"], ["g"], "v"),
        "conformal": lambda: trust.conformal_quantile(frame.withColumn("nominal", F.lit(90)), ["g"], "v", "nominal"),
        "risk": lambda: trust.risk_coverage(frame, ["g"], "v", pred="w", tie="i"),
    }
    plain = {k: sorted(map(tuple, f().collect()), key=str) for k, f in made.items()}
    monkeypatch.setattr(ordered, "GATHERED", 40)
    for k, f in made.items():
        found = sorted(map(tuple, f().collect()), key=str)
        assert len(found) == len(plain[k]) == 3
        for a, b in zip(found, plain[k], strict=True):
            assert a[0] == b[0] and list(a[1:]) == pytest.approx(list(b[1:])), k


@pytest.mark.parametrize("n", range(1, 13))
def test_exact_p_equals_full_enumeration(n):
    sums = np.array([sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)])
    for w in range(n * (n + 1) // 2 + 1):
        low = min(w, n * (n + 1) // 2 - w)
        want = min(1.0, ((sums <= low).sum() + (sums >= n * (n + 1) // 2 - low).sum()) / 2**n)
        assert reports.wilcoxon_p(w, n) == pytest.approx(want)


def test_exact_p_meets_the_normal_one():
    for w in (200, 400, 500, 637):
        spread = 50 * 51 * 101 / 24
        assert reports.exact_signed_rank_p(w, 50) == pytest.approx(math.erfc(abs(w - 637.5) / math.sqrt(2 * spread)), abs=0.01)
    assert reports.wilcoxon_p(3, 60) == pytest.approx(math.erfc(abs(3 - 915) / math.sqrt(2 * 60 * 61 * 121 / 24)))


def test_paired_test_gives_p_for_each_group(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(d)) for k, n in ((1, 9), (2, 80)) for d in rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1, 1], n)]
    got = {r.k: r for r in reports.paired_test(spark.createDataFrame(rows, "k int, d double"), ["k"], F.col("d")).collect()}
    for k, r in got.items():
        own = np.array([d for g, d in rows if g == k])
        w = np.abs(own)[own > 0].sum()
        assert r.w_plus == w and r.p_value == pytest.approx(reports.wilcoxon_p(w, len(own)))
