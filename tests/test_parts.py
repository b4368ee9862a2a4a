"""Heads, splits, grids, components, generators, readers and sinks against plain numpy or a round trip."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.operators import experiments as X
from lumenfew.operators import heads, pca, reports, simulate, spectra, splits, trust, wavelet
from lumenfew.plans import models
from lumenfew.sources import readers, sinks

RNG = np.random.default_rng(12)
XS, YS = RNG.normal(size=(14, 5)), RNG.normal(size=14)
XQ = RNG.normal(size=(9, 5))


def solved(phi, y, penalty):
    d = np.eye(phi.shape[1]) * penalty
    d[0, 0] = 0
    return np.linalg.solve(phi.T @ phi + d, phi.T @ y)


# -- heads ----------------------------------------------------------------------------------


def test_ridge_and_leave_one_out_equal_refits():
    phi = heads.with_one(XS)
    w, _, leverage = heads.ridge_fit(phi, YS, 0.3)
    assert np.allclose(w, solved(phi, YS, 0.3)) and 0 < leverage.min() and leverage.max() < 1
    _, _, residual = heads.loo_residuals(phi, YS, 0.3)
    for i in range(len(YS)):
        keep = np.arange(len(YS)) != i
        assert abs(residual[i] - (YS[i] - phi[i] @ solved(phi[keep], YS[keep], 0.3))) < 1e-9
    errors = [np.mean([(YS[i] - phi[i] @ solved(np.delete(phi, i, 0), np.delete(YS, i), g)) ** 2 for i in range(len(YS))]) for g in heads.LOO_GRID]
    assert heads.best_penalty(phi, YS) == heads.LOO_GRID[int(np.argmin(errors))]
    assert heads.Ridge(heads.RIDGE_GRID).fit(XS, YS).penalty in heads.RIDGE_GRID


@pytest.mark.parametrize("signed", [True, False])
def test_jackknife_equals_refits(signed):
    phi, q = heads.with_one(XS), heads.with_one(XQ)
    low, high = heads.jackknife_plus(phi, YS, q, 0.8, 0.3, signed)
    ends = []
    for i in range(len(YS)):
        w = solved(np.delete(phi, i, 0), np.delete(YS, i), 0.3)
        r = YS[i] - phi[i] @ w
        ends.append((q @ w - (r if signed else abs(r)), q @ w + (r if signed else abs(r))))
    assert np.allclose(low, np.quantile([e[0] for e in ends], 0.2, axis=0, method="inverted_cdf"))
    assert np.allclose(high, np.quantile([e[1] for e in ends], 0.8, axis=0, method="inverted_cdf"))


def test_pls_with_all_components_is_least_squares():
    z = heads.with_one(XS)
    assert np.allclose(heads.PLS(5).fit(XS, YS).predict(XQ), heads.with_one(XQ) @ np.linalg.lstsq(z, YS, rcond=None)[0])
    one = heads.PLS(1).fit(XS, YS)
    a, b = (XS - XS.mean(0)) / XS.std(0, ddof=1), (YS - YS.mean()) / YS.std(ddof=1)
    t = a @ (a.T @ b)
    assert np.allclose(one.predict(XS), (t @ b) / (t @ t) * t * YS.std(ddof=1) + YS.mean())
    # one row out: the errors that choose the components
    errors = []
    for n in range(1, 6):
        errors.append(sum((heads.PLS(n).fit(np.delete(XS, i, 0), np.delete(YS, i)).predict(XS[i : i + 1])[0] - YS[i]) ** 2 for i in range(14)))
    assert heads.best_components(XS, YS) == int(np.argmin(errors)) + 1
    assert len(heads.folds_of(40)) == 40 and len(heads.folds_of(41)) == 5 and heads.folds_of(10, 3)[0].tolist() == [0, 1, 2, 3]
    # a shuffle of 0..n-1 by the legacy generator seeded with 0, cut into five consecutive parts
    rows = np.arange(53)
    np.random.RandomState(0).shuffle(rows)
    assert [f.tolist() for f in heads.folds_of(53)] == [rows[a:b].tolist() for a, b in ((0, 11), (11, 22), (22, 33), (33, 43), (43, 53))]


def test_cars_finds_the_channels_that_matter():
    x = RNG.normal(size=(30, 40))
    y = 3 * x[:, 7] - 2 * x[:, 21] + 0.01 * RNG.normal(size=30)
    mask = heads.cars(x, y, seed=1)
    assert mask[7] and mask[21] and 2 <= mask.sum() < 15
    assert (heads.cars(x, y, seed=1) == mask).all()
    assert heads.cars(x[:3], y[:3]).all() and heads.cars(x, np.zeros(30)).sum() >= 2


def test_nnls_keeps_the_conditions_of_its_optimum():
    a, b = RNG.normal(size=(20, 6)), RNG.normal(size=20)
    w = heads.nnls(a, b)
    gradient = a.T @ (a @ w - b)
    assert (w >= 0).all() and (gradient >= -1e-8).all() and np.abs(gradient * w).max() < 1e-8


def test_heads_by_name():
    with pytest.raises(FileNotFoundError, match="no head is called tabular"):
        heads.head("tabular")
    heads.register("mean", lambda: heads.NearestMean())
    assert isinstance(heads.head("mean"), heads.NearestMean)
    del heads.HEADS["mean"]


# -- splits ----------------------------------------------------------------------------------


def test_numpy_splits():
    tr, te = splits.numpy_eval_split(50, 5, 3)
    assert tr.tolist() == np.random.default_rng(42 * 1000 + 503).choice(50, 5, replace=False).tolist()
    assert sorted([*tr, *te]) == list(range(50))
    groups = [f"g{i % 7}" for i in range(40)]
    tr, te = splits.numpy_eval_split(40, 3, 1, groups=groups)
    own = {groups[i] for i in tr}
    assert len(own) == 3 and {groups[i] for i in te} == {f"g{i}" for i in range(7)} - own
    tr, te = splits.numpy_group_split(groups, 3, 1)
    assert {groups[i] for i in tr} == set(np.random.default_rng(66 * 1000 + 301).choice(sorted(set(groups)), 3, replace=False)) and len(tr) + len(te) == 40
    tr, te = splits.numpy_fusion_split(20, 4, 2)
    assert [*tr, *te] == np.random.default_rng(66_402).permutation(20).tolist()
    a, b = splits.numpy_candidate_split(21, 2)
    assert len(a) == 13 and [*a, *b] == np.random.default_rng(66_902).permutation(21).tolist()
    a, b = splits.numpy_candidate_split(40, 2, groups=groups)
    assert not {groups[i] for i in a} & {groups[i] for i in b} and len({groups[i] for i in a}) == 4
    with pytest.raises(ValueError):
        splits.numpy_eval_split(splits.SMALL + 1, 5, 0)


# -- grids over whole tables -----------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    y = x @ np.array([1, -2, 0.5, 0, 0, 3]) + 0.2 * rng.normal(size=90)
    rows = [("t", i, f"g{i % 9}", x[i].tolist(), float(y[i])) for i in range(90)]
    return spark.createDataFrame(rows, "task string, idx long, label string, x array<double>, y double").repartition(5).cache(), x, y


def md5(*parts):
    import hashlib

    return hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()


def measured(pred, y):
    error = np.mean((pred - y) ** 2)
    return 1 - error * len(y) / ((y - y.mean()) ** 2).sum(), math.sqrt(error), y.std(ddof=1) / math.sqrt(error)


def test_grid_scores_equal_numpy(small):
    df, x, y = small
    got = {(r.support_size, r.repetition): r for r in X.scores(df, [5, 10, 88], 2, X.one_head("ridge")).collect()}
    assert set(got) == {(k, r) for k in (5, 10) for r in range(2)}  # 88 leaves too few queries
    for (k, rep), r in got.items():
        tr = sorted(sorted(range(90), key=lambda i: (md5("eval", k, rep, i), i))[:k])
        te = np.setdiff1d(np.arange(90), tr)
        a, b = heads.scaled(x[tr], x[te])
        m, sd = y[tr].mean(), y[tr].std() + 1e-8
        want = measured(heads.Ridge().fit(a, (y[tr] - m) / sd).predict(b) * sd + m, y[te])
        assert np.allclose((r.r2, r.rmse, r.rpd), want) and r.n_query == 90 - k


def test_grouped_grid_keeps_groups_apart(small):
    df, _, _ = small
    support = X.support_rows(df, [4], 1, "group", "label").collect()
    assert len(support) == 4 == len({r.label for r in support})
    names = sorted({f"g{i}" for i in range(9)}, key=lambda g: (md5("group", 4, 0, g), g))[:4]
    assert {r.label for r in support} == set(names)
    for r in support:
        assert r.idx == min((i for i in range(90) if f"g{i % 9}" == r.label), key=lambda i: (md5("member", 4, 0, i), i))
    found = X.predictions(df, [4], 1, X.one_head("ridge"), "group", "label").collect()
    assert {r.idx for r in found} == {i for i in range(90) if f"g{i % 9}" not in names}


def test_jackknife_and_posteriors_equal_numpy(small):
    df, x, y = small
    tr = sorted(sorted(range(90), key=lambda i: (md5("eval", 10, 0, i), i))[:10])
    te = np.setdiff1d(np.arange(90), tr)
    spread = x[tr].std(0) + 1e-8
    a, b = np.clip(x[tr] / spread, -5, 5), np.clip(x[te] / spread, -5, 5)
    phi, q = heads.with_one(a), heads.with_one(b)
    penalty = heads.best_penalty(phi, y[tr])
    got = {r.nominal: r for r in trust.jackknife_audit(df, [10], 1).collect()}
    assert set(got) == {50, 68, 80, 90, 95}
    for n, r in got.items():
        low, high = heads.jackknife_plus(phi, y[tr], q, n / 100, penalty)
        assert np.isclose(r.empirical_coverage, ((low <= y[te]) & (y[te] <= high)).mean()) and np.isclose(r.mean_interval_width, (high - low).mean()) and r.ridge_penalty == penalty
        assert np.isclose(r.r2_evaluation, measured(q @ solved(phi, y[tr], penalty), y[te])[0])
    found = {r.idx: r for r in trust.posteriors(df, [10], 1).collect()}
    a, b = heads.scaled(x[tr], x[te])
    m, sd = y[tr].mean(), y[tr].std() + 1e-8
    want = heads.Ridge().fit(a, (y[tr] - m) / sd).quantiles(b) * sd + m
    assert set(found) == set(te.tolist()) and np.allclose(np.array([found[i].quantiles for i in te]).T, want)
    levels = trust.native_levels()
    assert levels == [0.5, 0.68, 0.8, 0.9, 0.95]


def test_audit_equals_numpy(small):
    df, _, _ = small
    found = splits.halves(trust.posteriors(df, [10], 1), "idx", 0, 0, X.BY).cache()
    rows = found.collect()
    cal, ev = [r for r in rows if r.is_calibration], [r for r in rows if not r.is_calibration]
    assert len(cal) == 40 == len(ev)
    got = {(r.method, r.nominal): r for r in trust.audit(found, X.BY).collect()}
    y, q = np.array([r.y for r in ev]), np.array([r.quantiles for r in ev])
    for n, i, j in trust.LEVELS:
        r = got["native-posterior", n]
        assert np.isclose(r.empirical_coverage, ((q[:, i] <= y) & (y <= q[:, j])).mean()) and np.isclose(r.mean_interval_width, (q[:, j] - q[:, i]).mean())
        errors = sorted(abs(c.y - c.quantiles[5]) for c in cal)
        radius = errors[min(math.ceil(41 * n / 100 - 1e-9), 40) - 1]
        r = got["split-conformal-absolute", n]
        assert np.isclose(r.empirical_coverage, (np.abs(y - q[:, 5]) <= radius + 1e-12).mean()) and np.isclose(r.mean_interval_width, 2 * radius)
        scale = lambda v: v[8] - v[2] + 1e-12
        local = sorted(abs(c.y - c.quantiles[5]) / scale(c.quantiles) for c in cal)[min(math.ceil(41 * n / 100 - 1e-9), 40) - 1]
        assert np.isclose(got["split-conformal-locally-adaptive", n].mean_interval_width, (2 * local * (q[:, 8] - q[:, 2] + 1e-12)).mean())
    mean = {(r.method, r.nominal): r.mean_coverage for r in trust.mean_coverage(trust.audit(found, X.BY)).collect()}
    assert mean["native-posterior", 90] == got["native-posterior", 90].empirical_coverage


def test_gate_equals_numpy(small):
    df, x, y = small
    tr = sorted(r.idx for r in X.support_rows(df, [6], 1).collect())
    te = sorted(r.idx for r in X.capped_ids(df, [6], 1, 20).collect())
    assert len(tr) == 6 and len(te) == 20 and not set(tr) & set(te)
    made = trust.gate(df, [6], 1, 20)
    got = sorted(made.collect(), key=lambda r: r.idx)
    assert [r.idx for r in got] == te and [r.control for r in got] == [r.control for r in sorted(trust.gate(df.repartition(3), [6], 1, 20).collect(), key=lambda r: r.idx)]
    a, b = heads.scaled(x[tr], x[te])
    m, sd = y[tr].mean(), y[tr].std() + 1e-8
    model = heads.Ridge().fit(a, (y[tr] - m) / sd)
    low, mid, high = model.quantiles(b, (0.1, 0.5, 0.9)) * sd + m
    refs = np.random.default_rng(55_000 + 600).choice(6, 4, replace=False)
    for i, r in enumerate(got):
        off = 0.0
        for c in (0.3, 0.5, 0.7):
            off += np.mean([abs(model.predict((c * a[k] + (1 - c) * b[i])[None])[0] * sd + m - (c * (model.predict(a[k : k + 1])[0] * sd + m) + (1 - c) * mid[i])) for k in refs])
        assert np.isclose(r.gate, off / 3 / sd) and np.isclose(r.pred, mid[i]) and np.isclose(r.width, high[i] - low[i])


def test_selection_draws_differ_by_repetition(small):
    df, _, _ = small
    rows = X.pool_cells(df, 2, 40, 30)
    sizes = {(r.repetition, r.role): r["count"] for r in rows.groupBy("repetition", "role").count().collect()}
    assert sizes == {(0, "candidate"): 40, (1, "candidate"): 40, (0, "test"): 30, (1, "test"): 30}
    got = trust.selection(rows, ["task", "repetition"]).toPandas()
    assert len(got) == 2 * 3 * 5
    start = got[got.support_size == 2].groupby("repetition").r2.agg(["min", "max"])
    assert (start["min"] == start["max"]).all()  # strategies share their first two rows
    assert start["min"][0] != start["min"][1]
    best = got[(got.support_size == 20)].r2
    assert best.min() > start["min"].max()


def selected_by_numpy(x, y, xt, yt, rep, steps=trust.STEPS):
    """The three strategies with plain loops over a small pool."""
    seed = np.random.default_rng(66_900 + rep).choice(len(y), 2, replace=False).tolist()
    out = {}
    for strategy in ("random", "k-center", "interval-width"):
        rng, own = np.random.default_rng(67_000 + rep), list(seed)
        for size in steps:
            if strategy == "random" and size > len(own):
                own += rng.choice(np.setdiff1d(np.arange(len(y)), own), size - len(own), replace=False).tolist()
            while strategy == "k-center" and len(own) < size:
                rest = np.setdiff1d(np.arange(len(y)), own)
                own.append(int(rest[np.argmax(((x[rest][:, None] - x[own][None]) ** 2).sum(2).min(1))]))
            if strategy == "interval-width" and size > len(own):
                rest = np.setdiff1d(np.arange(len(y)), own)
                a, b = heads.scaled(x[own], x[rest])
                low, high = heads.Ridge().fit(a, y[own]).quantiles(b, (0.1, 0.9))
                own += rest[np.argsort(-(high - low), kind="stable")[: size - len(own)]].tolist()
            a, b = heads.scaled(x[own], xt)
            m, sd = y[own].mean(), y[own].std() + 1e-8
            out[strategy, size] = measured(heads.Ridge().fit(a, (y[own] - m) / sd).predict(b) * sd + m, yt)[:2]
    return out


def test_selection_equals_numpy_on_a_small_pool(small):
    df, x, y = small
    rows = X.pool_cells(df, 2, 40, 30)
    held = rows.collect()
    got = {(r.repetition, r.strategy, r.support_size): (r.r2, r.rmse) for r in trust.selection(rows, ["task", "repetition"]).collect()}
    assert len(got) == 2 * 3 * 5
    for rep in range(2):
        pool = sorted(r.idx for r in held if r.repetition == rep and r.role == "candidate")
        test = sorted(r.idx for r in held if r.repetition == rep and r.role == "test")
        for (strategy, size), want in selected_by_numpy(x[pool], y[pool], x[test], y[test], rep).items():
            assert np.allclose(got[rep, strategy, size], want), (strategy, size)


def test_sums_are_one_row_a_task_and_cell(small):
    df, _, _ = small
    models = X.fit_cells(df, [5, 10], 3, X.one_head("ridge"))
    each = lambda _, made, c, x, part: {("ridge",): X.summed(made["ridge"].predict(x), part.y.to_numpy(float), c, 0)}
    plan = X.combined(df, models, each, "arm string")
    rows = {(r.support_size, r.repetition): r for r in plan.collect()}
    assert len(rows) == 6 and all(r.n == 90 - k for (k, _), r in rows.items())
    flat = df.unionByName(df).unionByName(df).coalesce(1)  # three batches' worth, one task: still a row a cell
    assert {r.n for r in X.combined(flat, models, each, "arm string").collect()} == {3 * 85, 3 * 80}


def test_decoupling_and_cars_run_on_whole_tables(small):
    df, _, _ = small
    got = X.decoupling(df, [12], 1).collect()
    assert len(got) == 1 and got[0].n_components == 5 and min(got[0].r2_pls, got[0].r2_pls_scores_ridge) > 0.8
    got = X.cars_scores(df, [12], 1, runs=10).collect()
    assert len(got) == 1 and 2 <= got[0].n_features <= 6


# -- components, scattering ------------------------------------------------------------------


def test_components_equal_a_decomposition(spark, small):
    df, x, _ = small
    model = pca.fit(df, "x", 3)
    centred = x - x.mean(0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(np.abs(np.array(model.columns) @ v[:3].T), np.eye(3), atol=1e-6)
    assert np.allclose(model.variances, s[:3] ** 2 / (s**2).sum())
    got = {r.idx: r for r in df.select("idx", model.scores(F.col("x")).alias("s"), model.error(F.col("x")).alias("e")).collect()}
    back = centred @ v[:3].T @ v[:3] + x.mean(0)
    for i in range(90):
        assert np.allclose(np.abs(got[i].s), np.abs(centred[i] @ v[:3].T)) and np.isclose(got[i].e, ((x[i] - back[i]) ** 2).sum() / (x[i] ** 2).sum())
    assert np.allclose(pca.principal_angles(model, model), 1)


def decaying(n, wide, rank, seed):
    """Rows around a centre with ``rank`` directions that matter and a little of all others."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, rank)) * 2.0 ** -np.arange(rank) @ rng.normal(size=(rank, wide)) + 1e-3 * rng.normal(size=(n, wide)) + rng.normal(size=wide)


@pytest.mark.parametrize(("n", "wide", "k"), [(400, 64, 8), (120, 11_618, 5)])
def test_wide_components_span_the_exact_space(spark, n, wide, k, monkeypatch):
    monkeypatch.setattr(pca, "FAN", 2)
    x = decaying(n, wide, k + 2, wide)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, x array<double>").repartition(5)
    model = pca.fit_wide(df, "x", k)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    cosines = np.linalg.svd(np.array(model.columns) @ v[:k].T, compute_uv=False)
    assert np.sqrt(max(0, 1 - cosines.min() ** 2)) < 1e-6 and np.allclose(model.columns @ np.array(model.columns).T, np.eye(k))
    assert np.allclose(model.variances, s[:k] ** 2 / (s**2).sum()) and np.allclose(model.centre, x.mean(0))
    got = {r.i: (r.s, r.e) for r in model.transformed(df, "x", "s", "e").collect()}
    for i in range(0, n, 37):
        scores = np.array(model.columns) @ (x[i] - x.mean(0))
        rest = x[i] - x.mean(0) - scores @ np.array(model.columns)
        assert np.allclose(got[i][0], scores) and np.isclose(got[i][1], (rest**2).sum() / (x[i] ** 2).sum())
    if wide > pca.NARROW:
        assert np.allclose(pca.fit(df, "x", k).variances, model.variances)


def test_components_of_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "i long, x array<double>")
    model = pca.fit_wide(one.unionByName(one), "x", 2)
    assert model.centre == [1.0, 2.0, 3.0] and np.allclose(model.variances, 0)


def test_scattering_equals_direct_sums(spark):
    x = RNG.normal(size=(3, 50))

    def direct(rows, scale):
        w = wavelet.morlet(scale)
        half = len(w) // 2
        out = np.zeros(rows.shape, complex)
        for i in range(50):
            for k in range(-half, half + 1):
                if 0 <= i - k < 50:
                    out[:, i] += rows[:, i - k] * w[half + k]
        return np.abs(out)

    first = {s: direct(x, s) for s in wavelet.SCALES}
    want = [first[s].mean(1) for s in wavelet.SCALES] + [direct(first[a], b).mean(1) for i, a in enumerate(wavelet.SCALES) for b in wavelet.SCALES[i + 1 :]]
    assert np.allclose(wavelet.scattered(x), np.stack(want, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<double>")
    for got in (df.select("i", wavelet.scattering(F.col("x")).alias("x")), wavelet.with_scattering(df)):
        assert np.allclose([r.x for r in got.orderBy("i").collect()], np.stack(want, 1))


def test_representations_by_name(spark):
    x = RNG.normal(size=30)
    df = spark.createDataFrame([(x.tolist(),)], "spectrum array<double>")
    value = lambda name, **k: df.select(spectra.representation(name, 30, **k)(F.col("spectrum")).alias("v")).first().v
    at = np.interp(np.linspace(0, 1, 12), np.linspace(0, 1, 30), x)
    assert np.allclose(value("raw-spectra-12"), (at - at.mean()) / (at.std() + 1e-8))
    matrix = np.random.default_rng(20260915).standard_normal((30, 8)) / np.sqrt(30)
    assert np.allclose(value("random-projection-8"), x @ matrix)
    corpus = spark.createDataFrame([(RNG.normal(size=30).tolist(),) for _ in range(40)], "spectrum array<double>")
    assert len(value("corpus-pca-5", corpus=corpus)) == 5 and len(value("corpus-pca-4-fit-20", corpus=corpus)) == 4
    assert len(value("wavelet-scattering")) == 15
    with pytest.raises(KeyError):
        value("encoder")
    with pytest.raises(FileNotFoundError):
        value("corpus-pca-5")


# -- generators ------------------------------------------------------------------------------


def test_mixtures_are_mixtures_and_repeat(spark):
    library = RNG.normal(size=(5, 32))
    scaled = library - library.min(1, keepdims=True)
    scaled = scaled / (scaled.max(1, keepdims=True) + 1e-8)
    clean = simulate.mixtures(spark, library, 60, perturb=False, partitions=3).collect()
    for r in clean:
        w = np.zeros(5)
        for k, v in r.weights.items():
            w[int(k)] = v
        assert 2 <= len(r.weights) <= 4 and abs(w.sum() - 1) < 1e-9 and np.allclose(r.spectrum, w @ scaled, atol=1e-6)
    again = simulate.mixtures(spark, library, 60, perturb=False, partitions=7).collect()
    assert sorted((r.idx, tuple(r.spectrum)) for r in clean) == sorted((r.idx, tuple(r.spectrum)) for r in again)


def test_perturbation_stays_in_its_ranges():
    x = np.exp(-0.5 * ((np.arange(512) - 200) / 30) ** 2)
    rng = np.random.default_rng(0)
    made = np.array([simulate.perturbed(rng, x) for _ in range(300)])
    near = np.corrcoef(np.vstack([x, made]))[0, 1:]
    assert np.isfinite(made).all() and np.median(near) > 0.8 and (made.max(1) > 0.3).all() and (made.max(1) < 3).all()
    # a quiet end: what is left after a cubic is noise of at most a 30th of the signal
    tail = made[:, 400:]
    u = np.linspace(-1, 1, 112)
    rest = tail - np.array([np.polyval(np.polyfit(u, r, 5), u) for r in tail])
    assert (rest.std(1) < np.sqrt((made**2).mean(1)) / 10**1.4).all()
    bases = np.array([simulate.baseline_of(rng, 2, 3, 0.3) for _ in range(4000)])
    assert abs(bases[:, 1].std() - 0.3 * math.sqrt(3.25)) < 0.03


def test_fuels_and_their_compositions(spark):
    axis = np.linspace(600, 1800, 120)
    basis = np.stack([np.exp(-0.5 * ((axis - c) / 40) ** 2) for c in (800, 1000, 1300)])
    prior = np.array([[2.0, 0.0, 1.0]])
    rows = simulate.compositions(simulate.fuel(spark, axis, basis, prior, 200), "spectrum", basis, axis).collect()
    w = np.array([r.weights for r in rows])
    assert len(rows) == 200 and (w >= 0).all() and max(r.residual for r in rows) < 0.05
    ratio = w[:, 0] / w[:, 2]
    assert 0.9 < np.median(ratio) / 2 < 1.1 and ratio.max() < 2 * 1.3 / 0.7 * 1.3 and w[:, 1].max() < 0.35


def test_corpus_order_and_size(spark):
    block = lambda n, p: spark.createDataFrame([(i, RNG.normal(size=p).tolist()) for i in range(n)], "ordinal long, spectrum array<double>")
    every = simulate.corpus({"a": block(4, 20), "b": block(3, 70)}, block(2, 10), 16)
    assert [(r.source, r.block, r["count"]) for r in every.groupBy("source", "block").count().orderBy("block").collect()] == [("a", 0, 4), ("b", 1, 3), ("simulated", 2, 2)]
    assert {len(r.spectrum) for r in every.collect()} == {16}
    assert simulate.checked_size(every, 9, "rows") is every
    with pytest.raises(ValueError, match="9 rows instead of 10"):
        simulate.checked_size(every, 10, "corpus")


# -- readers ---------------------------------------------------------------------------------


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_diesel(spark, tmp_path):
    write(tmp_path / "diesel/spectra.csv", 'made by,x\nAxisscale,,750,752,754\n1,"s1",0.1,0.2,0.3\n2, "s2" ,0.4,,0.6\n3,s3,0.1,oops,0.3\n4,,1,2,3\n5,s5,1,2\n6,s6,7,8,9\n')
    write(tmp_path / "diesel/properties.csv", 'about\nLabel,,BP50,CN\n1,"s1",1.5,40\n2,s2,,41\n3,s2,2.5,43\n')
    rows = {r.sample_id: r for r in readers.load_diesel(spark, str(tmp_path)).collect()}
    assert set(rows) == {"s1", "s2", "s6"}
    assert rows["s1"].wavelengths == [750, 752, 754] and rows["s1"].spectrum == [0.1, 0.2, 0.3] and rows["s2"].spectrum == [0.4, None, 0.6]
    assert rows["s1"].targets == {"BP50": 1.5, "CN": 40} and rows["s2"].targets == {"BP50": 2.5, "CN": 43}  # the last row wins
    assert rows["s6"].targets is None
    task = readers.named_task(spark, str(tmp_path), "diesel-cetane-number").collect()
    assert sorted(r.y for r in task) == [40, 43] and {len(r.x) for r in task} == {512} and {r.task for r in task} == {"diesel-cetane-number"}
    with pytest.raises(KeyError):
        readers.named_task(spark, str(tmp_path), "diesel-colour")


def test_archives(spark, tmp_path):
    (tmp_path / "processed").mkdir()
    nir = RNG.normal(size=(60, 401))
    np.savez(tmp_path / "processed/gasoline_arrays.npz", RNG.normal(size=60) + 88, nir.reshape(-1, order="F"))
    rows = sorted(readers.load_gasoline(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert np.allclose([r.spectrum for r in rows], nir) and rows[0].sample_id == "gas1" and rows[0].wavelengths[:3] == [900, 902, 904] and rows[0].wavelengths[-1] == 1700
    assert all(80 < r.targets["octane"] < 96 for r in rows)
    mayo = RNG.normal(size=(12, 7))
    np.savez(tmp_path / "processed/mayonnaise_arrays.npz", mayo, np.arange(12) % 6)
    rows = sorted(readers.load_mayonnaise(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert np.allclose([r.spectrum for r in rows], mayo) and [r.label for r in rows] == [str(i % 6) for i in range(12)] and rows[0].targets == {} and rows[0].wavelengths[1] == 1104
    (tmp_path / "in-house-pentane-ccl4").mkdir()
    np.savez(tmp_path / "in-house-pentane-ccl4/pentane_ccl4_FTIR.npz", X=mayo, wavelength_nm=np.arange(7.0), y=np.linspace(0, 1, 12), name=[f"n{i}" for i in range(12)], sample_id=[f"b{i // 4}" for i in range(12)], rep=np.arange(12) % 4, meta=np.array({"a": 1}, dtype=object))
    rows = sorted(readers.load_pentane(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert [r.group_id for r in rows] == [f"b{i // 4}" for i in range(12)] and rows[3].sample_id == "n3" and np.isclose(rows[11].targets["phi_pentane"], 1) and rows[0].wavelengths == list(range(7))
    raw = readers.named_task(spark, str(tmp_path), "pentane-ccl4-volume-fraction").orderBy("idx").collect()
    assert np.allclose(raw[2].x, np.interp(np.linspace(0, 1, 512), np.linspace(0, 1, 7), mayo[2]), atol=1e-5)  # not normalised


def test_tables_that_are_converted(spark, tmp_path):
    lines = ["instrument,moisture,oil,protein,starch,10,12,14"] + [f"{m},{i},{i + 1},{'x' if i == 2 else i + 2},{i + 3},{i}.5,{i},{i}" for m in ("m5", "mp6") for i in range(3)]
    write(tmp_path / "corn/corn.csv", "\n".join(lines))
    df = spark.read.option("header", True).csv(str(tmp_path / "corn/corn.csv"))
    with_place = readers.with_ordinal(df, [F.col("instrument"), F.col("moisture")])
    assert [r.ordinal for r in with_place.orderBy("ordinal").collect()] == list(range(6))
    (tmp_path / "corn/corn.csv").write_text("\n".join([lines[0].replace("instrument", "ordinal,instrument")] + [f"{i},{x}" for i, x in enumerate(lines[1:])]))
    rows = sorted(readers.load_corn(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert len(rows) == 3 and rows[0].wavelengths == [1100, 1102, 1104] and rows[1].targets == {"moisture": 1, "oil": 2, "protein": 3, "starch": 4} and rows[2].targets["protein"] is None and rows[0].spectrum == [0.5, 0, 0]
    write(tmp_path / "EVOO_NIR_HSI/data/Raw_A.csv", "ordinal,sample_id,class_1,adulteration_level,950.5,940\n0,a,pure,0,1,2\n1,a,pure,none,3,4\n")
    rows = sorted(readers.load_evoo(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert rows[0].wavelengths == [940, 950.5] and rows[0].spectrum == [2, 1] and rows[0].group_id == "a" and rows[1].targets == {"adulteration_level": None}
    (tmp_path / "sugar_raman/High SNR").mkdir(parents=True)
    np.savez(tmp_path / "sugar_raman/High SNR/data.npz", X=np.arange(6.0).reshape(3, 2))
    write(tmp_path / "sugar_raman/High SNR/metadata.csv", "samp,Sucrose [ul],Fructose [ul],Maltose [ul],Glucose [ul],Total Volume [ul]\nw1,10,20,0,,100\nw1,30,0,0,5,100\nw2,1,1,1,1,0\n")
    rows = sorted(readers.load_sugar_raman(spark, str(tmp_path)).collect(), key=lambda r: r.ordinal)
    assert rows[0].targets == {"Sucrose": 0.1, "Fructose": 0.2, "Maltose": 0.0, "Glucose": None} and rows[1].targets["Glucose"] == 0.05 and rows[2].targets["Sucrose"] is None and [r.group_id for r in rows] == ["w1", "w1", "w2"] and rows[2].spectrum == [4, 5]


def test_edible_oil(spark, tmp_path):
    lines = ["class,pv,5000,4000,2500"]
    for kind, value, n in ((1, 2.5, 3), (2, 3.14159, 3), (3, 9.0, 2)):
        lines += [f"{kind},{value},{kind},{kind + i},{i}" for i in range(n)]
    lines.append("1,,1,2,3")
    write(tmp_path / "edible_oil/nir.csv", "\n".join(lines))
    rows = readers.load_edible_oil(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and {r.group_id for r in rows} == {"c1_pv2.5", "c2_pv3.142"} and rows[0].wavelengths == [2000, 2500, 4000]
    assert sorted(r.spectrum for r in rows if r.label == "1") == [[1, 1, 0], [1, 2, 1], [1, 3, 2]]
    with pytest.raises(ValueError, match="2 oils instead of 5"):
        readers.edible_oil(spark, str(tmp_path / "edible_oil/nir.csv"), oils=5)


def test_modalities(spark, tmp_path):
    nir = readers.modality(spark, write(tmp_path / "nir.csv", "class,pv,a,b\n" + "\n".join(f"{i // 3},{i // 3},{i},{'' if i == 4 else 1}" for i in range(9))))
    mir = readers.modality(spark, write(tmp_path / "mir.csv", "class,pv,a\n0,0,5\n1,1,6\n2,2,7"))
    raman = readers.modality(spark, write(tmp_path / "raman.csv", "class,pv,a\n0,0,8\n1,1,9\n2,2,10"))
    rows = {r.oil: r for r in readers.modalities(nir, mir, raman).collect()}
    assert set(rows) == {0, 2} and rows[0].nir == [1, 1] and rows[2].nir == [7, 1] and rows[2].mir == [7] and rows[2].raman == [10] and rows[2].label == 2
    off = readers.modality(spark, write(tmp_path / "off.csv", "class,pv,a\n0,0,8\n1,5,9\n2,2,10"))
    with pytest.raises(ValueError, match="1 rows"):
        readers.modalities(nir, mir, off)


def test_fuel_raman(spark, tmp_path):
    for name, rows in (("train", [(1.0, 0.5, None, 4.0)]), ("test", [(2.0, 1.5, 3.0, 2.0), (3.0, float("nan"), 1.0, 1.0)])):
        spark.createDataFrame(rows, "`y` double, `300.5` double, `100` double, `200` double").write.parquet(f"{tmp_path}/{name}")
    df, axis = readers.fuel_raman(spark, [f"{tmp_path}/train", f"{tmp_path}/test"])
    assert axis == [200.0] and sorted(r.spectrum[0] for r in df.collect()) == [1, 2, 4]


JCAMP = "##TITLE=acid\n##XUNITS=1/CM\n##FIRSTX=10\n##LASTX=50\n##NPOINTS=5\n##XFACTOR=2\n##YFACTOR=0.5\n##XYDATA=(X++(Y..Y))\n10 1 2\n20 3 4 x\n30 3\n40 4 5\n##END=\n"


def test_jcamp(spark, tmp_path):
    got = readers.parse_jcamp(JCAMP)
    assert got == {"title": "acid", "x": [20, 40, 60, 80, 100], "y": [0.5, 1, 1.5, 2, 2.5]}
    assert readers.parse_jcamp(JCAMP.replace("NPOINTS=5", "NPOINTS=8")) is None and readers.parse_jcamp(JCAMP.replace("##FIRSTX=10\n", "")) is None and readers.parse_jcamp("##TITLE=x") is None
    pairs = readers.parse_jcamp("##TITLE=p\n##FIRSTX=1\n##LASTX=3\n##NPOINTS=3\n##XYPOINTS=(XY..XY)\n1 4\n2 5\n3 6\n$$ end\n9 9\n")
    assert pairs["x"] == [1, 2, 3] and pairs["y"] == [4, 5, 6]
    write(tmp_path / "a.jdx", JCAMP)
    write(tmp_path / "b.jdx", "nothing")
    rows = readers.jcamp(spark, f"{tmp_path}/*.jdx").collect()
    assert len(rows) == 1 and rows[0].title == "acid" and rows[0].x[-1] == 100


def test_library_results_peaks_and_pixels(spark, tmp_path):
    measured_ = spark.createDataFrame([("long", [1.0] * 100), ("short", [1.0] * 99), ("gap", [float("nan")] + [1.0] * 100)], "title string, y array<double>")
    classes = spark.createDataFrame([(1, [1.0, 2.0])] * 3 + [(2, [5.0, 5.0])] * 2, "label int, spectrum array<double>")
    assert {r.name: len(r.y) for r in readers.pure_library(measured_, classes).collect()} == {"long": 100, "class-1": 2}
    write(tmp_path / "head-a__pca-10__corn.csv", "task,r2\ncorn,0.5\n")
    row = readers.results(spark, f"{tmp_path}/*.csv", "task string, r2 double").first()
    assert (row.file_family, row.file_arm, row.file_task, row.r2) == ("head-a", "pca-10", "corn", 0.5)
    got = readers.peaks(spark, write(tmp_path / "peaks.csv", 'compound,wavenumber,intensity\n"2,2,4-x",700,10\n')).first()
    assert got.compound == "2,2,4-x" and got.wavenumber == 700
    curve = readers.calibrated(readers.top_pixels(spark.createDataFrame([(3, 0, 10), (5, 0, 0), (9, 1, 0), (2, 1, 200)], "row int, col int, val int")), 400.0, 2.0, 1, 9)
    assert {r.col: (r.x, r.percent) for r in curve.collect()} == {0: (400, 75), 1: (402, 0)}
    targets = spark.createDataFrame([({"a": 1.0, "b": None},)] * 30 + [({"a": float("nan"), "b": 2.0},)], "targets map<string,double>")
    assert [r.target for r in readers.usable_targets(targets).collect()] == ["a"]


def test_task_pools(spark):
    tasks = readers.task_table(spark)
    assert tasks.count() == 15 and readers.task_pool(tasks, benchmark=True).count() == 13 and readers.task_pool(tasks, without=("corn-oil", readers.RAW)).count() == 13
    assert set(readers.LOADERS) >= {d for d, _ in readers.TASKS.values()}


# -- sinks, reports --------------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [2.0])], "k int, arm string, x array<double>")
    path = f"{tmp_path}/t"
    assert sinks.pending(df, spark, path, ["k"]).count() == 2  # nothing is there yet
    sinks.append(df.where("k = 1"), path)
    assert [r.k for r in sinks.pending(df, spark, path, ["k"]).collect()] == [2]
    sinks.append(df.where("k = 2"), path)
    assert sinks.pending(df, spark, path, ["k"]).isEmpty()
    assert sinks.digest(spark.read.parquet(path)) == sinks.digest(df.repartition(2)) and len(sinks.digest(df)) == 16
    assert sinks.digest(df) != sinks.digest(df.where("k = 1"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.create(df, path)
    sinks.create(df, path, force=True)
    sinks.replace(df.where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    sinks.manifest(df, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == ["k", "arm"]
    with pytest.raises(FileNotFoundError, match="build it"):
        sinks.corpus(spark, f"{tmp_path}/none")
    assert sinks.corpus(spark, path).count() == 1
    assert sinks.checked(df, "k > 0", "bad") is df
    with pytest.raises(ValueError, match="bad"):
        sinks.checked(df, "k > 1", "bad")


def test_wilcoxon_p():
    assert reports.wilcoxon_p(0, 0) == 1 and reports.wilcoxon_p(27.5, 10) == 1
    z = (50 - 27.5) / math.sqrt(10 * 11 * 21 / 24)
    assert np.isclose(reports.normal_signed_rank_p(50, 10), math.erfc(z / math.sqrt(2)))
    assert abs(reports.wilcoxon_p(50, 10) - reports.normal_signed_rank_p(50, 10)) < 0.01  # exact for so few


def test_bound_makes_a_value_once(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],)], "x array<double>")
    assert df.select(A.bound(F.col("x"), lambda v: A.dot(v, v)).alias("v")).first().v == 21
    plan = df.select(pca.Model([0.0] * 3, [[1.0, 0, 0]] * 3, []).error(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_registered_grid_has_the_published_sizes(spark, sf):
    assert models.REPS == 10 and models.BUDGET == [5, 10, 20, 50, 100]
    rows = models.label_budget(spark, sf).collect()
    assert len(rows) == 50 and all(1 <= r.n_components_pls <= 15 for r in rows)
    assert json.dumps(sorted({r.support_size for r in rows})) == "[5, 10, 20, 50, 100]"


def test_wide_components_take_few_passes(spark, monkeypatch):
    """Rows without structure, on which a sketch alone converges slowly."""
    passes, summed = [], pca.summed
    monkeypatch.setattr(pca, "summed", lambda *a: passes.append(1) or summed(*a))
    x = np.random.default_rng(8).normal(size=(600, 200))
    model = pca.fit_wide(spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>"), "x", 10)
    exact = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:10]
    assert np.linalg.svd(np.array(model.columns) @ exact.T, compute_uv=False).min() > 1 - 1e-9
    assert len(passes) < 20


def test_nearest_mean_holds_no_rows_by_classes():
    import tracemalloc

    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(4000, 64)), rng.integers(0, 40, 4000).astype(float)
    made = heads.NearestMean().fit(x, y)
    plain = np.concatenate([made.names[((p[:, None] - made.means[None]) ** 2).sum(2).argmin(1)] for p in np.array_split(x, 40)])
    tracemalloc.start()
    assert (made.predict(x) == plain).all()
    assert tracemalloc.get_traced_memory()[1] < 4 * x.nbytes
    tracemalloc.stop()


def test_resample_makes_its_array_once(spark):
    ids = F.array(F.monotonically_increasing_id(), F.monotonically_increasing_id()).cast("array<double>")
    got = spark.range(3).coalesce(1).select("id", A.resample(ids, 5).alias("y")).collect()
    # an array that is made anew for each use counts on within a row
    assert [(r.id, r.y) for r in got] == [(i, [float(i)] * 5) for i in range(3)]
