"""Trust analyses: posterior audit, mixture gate, detection limit, sample selection.

Heads run per cell; what follows them is relational.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.functions import metrics as M
from lumenfew.operators import experiments, heads
from lumenfew.operators.ordered import joined, quantiles, running
from lumenfew.sources.sinks import stored

#: Nominal coverage and the places of the interval's ends among the 11 quantiles.
LEVELS = ((50, 4, 6), (68, 3, 7), (80, 2, 8), (90, 1, 9), (95, 0, 10))
FRACTIONS = (0.3, 0.5, 0.7)
STEPS = (2, 5, 10, 15, 20)


def posteriors(rows: DataFrame, sizes: list[int], reps: int, name: str = "ridge") -> DataFrame:
    """``idx, y, quantiles`` of each query row of each cell, in the target's units."""
    models = experiments.fit_cells(rows, sizes, reps, experiments.one_head(name))

    def each(_, made, x, part):
        return pd.DataFrame({"idx": part.idx.to_numpy(), "y": part.y.to_numpy(float), "quantiles": list(made[name].quantiles(x).T)})

    return experiments.predicted(rows, models, each, "idx long, y double, quantiles array<double>")


def conformal_quantile(df: DataFrame, by: list[str], score: str, nominal: str) -> DataFrame:
    """``radius``: the ceil((n + 1) * nominal / 100)-th least score of each cell and level, n at most.

    ``nominal`` is a column that the cells' rows have already; ``radii`` makes one from a level table.

    Equal scores are counted first; the counts run on in order of the score.
    """
    counted = running(df.groupBy(*by, nominal, score).agg(F.count("*").alias("__c")), [*by, nominal], [F.col(score)], ["__c"])
    n = F.col("total___c")
    rank = F.least(F.ceil((n + 1) * F.col(nominal) / 100 - 1e-9), n)
    return counted.where(F.col("before___c") + F.col("__c") >= rank).groupBy(*by, nominal).agg(F.min(score).alias("radius"))


def radii(df: DataFrame, by: list[str], score: str, name: str) -> DataFrame:
    """``conformal_quantile`` at all of ``LEVELS`` from one run over the scores: ``nominal`` and ``name``."""
    levels = F.explode(F.array(*[F.lit(n) for n, _, _ in LEVELS])).alias("nominal")
    counted = running(df.groupBy(*by, score).agg(F.count("*").alias("__c")), by, [F.col(score)], ["__c"])
    each = counted.select(*by, score, "__c", F.col("before___c").alias("__b"), F.col("total___c").alias("__n"), levels)
    rank = F.least(F.ceil((F.col("__n") + 1) * F.col("nominal") / 100 - 1e-9), F.col("__n"))
    return each.where((F.col("__b") < rank) & (rank <= F.col("__b") + F.col("__c"))).select(*by, "nominal", F.col(score).alias(name))


def audit(found: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and width of three intervals at five levels, from ``quantiles`` and ``is_calibration``.

    ``found`` is written once: the radii and the intervals read it.
    """
    spark = found.sparkSession
    levels = F.broadcast(spark.createDataFrame(list(LEVELS), "nominal int, a int, b int"))
    at = lambda i: F.get("quantiles", i)
    rows = stored(found.select(*by, "y", "quantiles", "is_calibration", at(F.lit(5)).alias("pred"), (at(F.lit(8)) - at(F.lit(2)) + 1e-12).alias("scale")), "posteriors")
    error = F.abs(F.col("y") - F.col("pred"))
    scored = rows.where("is_calibration").select(*by, error.alias("e"), (error / F.col("scale")).alias("e_local"))
    both = joined(radii(scored, by, "e", "flat"), radii(scored, by, "e_local", "local"), [*by, "nominal"])  # a row a cell and level
    held = joined(rows.where("not is_calibration").crossJoin(levels), both, [*by, "nominal"])
    ends = F.array(
        F.struct(F.lit("native-posterior").alias("method"), at(F.col("a")).alias("low"), at(F.col("b")).alias("high")),
        F.struct(F.lit("split-conformal-absolute").alias("method"), (F.col("pred") - F.col("flat")).alias("low"), (F.col("pred") + F.col("flat")).alias("high")),
        F.struct(F.lit("split-conformal-locally-adaptive").alias("method"), (F.col("pred") - F.col("local") * F.col("scale")).alias("low"), (F.col("pred") + F.col("local") * F.col("scale")).alias("high")),
    )
    each = held.select(*by, "nominal", "y", "pred", F.explode(ends).alias("i")).select(*by, "nominal", "y", "pred", "i.method", "i.low", "i.high")
    y, pred = F.col("y"), F.col("pred")
    out = each.groupBy(*by, "method", "nominal").agg(M.coverage(F.col("low"), F.col("high"), y).alias("empirical_coverage"), M.width(F.col("low"), F.col("high")).alias("mean_interval_width"), M.r2(pred, y).alias("r2_evaluation"))
    return out.withColumn("catastrophic_failure", M.catastrophic(F.col("r2_evaluation")))


class JackknifeHead(heads.Ridge):
    """Ridge that gives jackknife+ interval ends."""

    def ends(self, x: np.ndarray, level: float, signed: bool) -> tuple[np.ndarray, np.ndarray]:
        return heads.jackknife_plus(self.phi, self.y, heads.with_one(x), level, self.penalty, signed)


def jackknife_audit(rows: DataFrame, sizes: list[int], reps: int, signed: bool = True) -> DataFrame:
    """Jackknife+ coverage and width at five levels; features are scaled only, targets stay in their units."""
    models = experiments.fit_cells(rows, sizes, reps, lambda _, x, y: {"ridge": heads.fitted(JackknifeHead(), x, y, shift=False, scale_y=False)})

    def each(_, made, centre, x, part):
        m = made["ridge"]
        z, pred, y = m.inputs(x), m.predict(x), part.y.to_numpy(float)
        out = {}
        for nominal, _a, _b in LEVELS:
            low, high = m.head.ends(z, nominal / 100, signed)
            out[nominal, m.head.penalty] = experiments.summed(pred, y, centre, (low <= y) & (y <= high), high - low)
        return out

    made = experiments.combined(rows, models, each, "nominal int, ridge_penalty double")
    mean = lambda c: (F.col(c) / F.col("n")).alias
    out = made.where(F.col("n") > experiments.LEAST_QUERY)
    return out.select(*experiments.BY, "nominal", "ridge_penalty", mean("hits")("empirical_coverage"), mean("width")("mean_interval_width"), experiments.r2_of_sums().alias("r2_evaluation"))


def mean_coverage(df: DataFrame) -> DataFrame:
    """Mean empirical coverage and width of each method and nominal level, over tasks and repetitions."""
    return df.groupBy("method", "nominal").agg(F.avg("empirical_coverage").alias("mean_coverage"), F.avg("mean_interval_width").alias("mean_width"), F.count("*").alias("n"))


@dataclass
class GateHead:
    """A cell's fitted head, its references among the support and what it predicts for them."""

    model: heads.Fitted
    references: np.ndarray
    known: np.ndarray
    seed: int

    def scores(self, x: np.ndarray, idx: np.ndarray) -> dict[str, np.ndarray]:
        b, spread = self.model.inputs(x), self.model.y_spread
        low, median, high = self.model.quantiles(x, (0.1, 0.5, 0.9))
        off = np.zeros(len(b))
        for c in FRACTIONS:
            mixed = (c * self.references[None] + (1 - c) * b[:, None]).reshape(-1, b.shape[1])
            got = (self.model.head.predict(mixed) * spread + self.model.y_centre).reshape(len(b), -1)
            off += np.abs(got - (c * self.known[None] + (1 - c) * median[:, None])).mean(1)
        control = [np.random.default_rng([self.seed, abs(int(i)), int(i < 0)]).random() for i in idx]
        return {"pred": median, "gate": off / len(FRACTIONS) / spread, "width": high - low, "control": np.array(control)}


def gate(rows: DataFrame, sizes: list[int], reps: int, most: int = 100, name: str = "ridge", references: int = 4, seed: int = 55_000) -> DataFrame:
    """Per query row: how far predictions of mixtures with support rows stray from the mixed predictions.

    A cell's queries are a sample of at most ``most`` rows. They are standardised as queries (the second result of the
    scaling); references are at most ``references`` support rows at random, and the straight
    line runs between what the head predicts for them and for the query. A large score means
    distrust. Heads are fitted on supports and sent to all tasks; query rows meet them batch by
    batch, so no task holds a cell. A row's random control follows from its id.
    """

    def fit(keys, x, y):
        made = heads.fitted(heads.head(name), x, y)
        own = seed + keys["support_size"] * 100 + keys["repetition"]
        refs = np.random.default_rng(own).choice(len(y), min(references, len(y)), replace=False)
        a = made.inputs(x)
        return {"gate": GateHead(made, a[refs], made.predict(x)[refs], own)}

    models = experiments.fit_cells(rows, sizes, reps, fit)
    few = experiments.capped_ids(rows, sizes, reps, most)
    by_cell = rows.select("task", "idx", "x", "y").join(few, ["task", "idx"])  # at most grid x most rows

    def run(batches):
        cells = {(o[0]["task"], o[0]["support_size"], o[0]["repetition"]): o[2]["gate"] for own in models.value.values() for o in map(pickle.loads, own)}
        for frame in batches:
            for keys, part in frame.groupby(experiments.BY, sort=False):
                found = cells[keys].scores(np.stack(part.x.to_list()).astype(float), part.idx.to_numpy())
                yield pd.DataFrame({c: part[c].to_numpy() for c in [*experiments.BY, "idx", "y"]} | found)

    return by_cell.select(*experiments.BY, "idx", "x", "y").mapInPandas(run, f"{experiments.SCHEMA}, idx long, y double, pred double, gate double, width double, control double")


def risk_coverage(df: DataFrame, by: list[str], score: str, pred: str = "pred", y: str = "y", tie: str = "idx") -> DataFrame:
    """Area under 1 - R2 of the best-scored rows, for kept shares from a half to all in eleven steps.

    Errors and spreads run on in order of the score; each share reads the row at its end.
    """
    # sums around the cell's middle lose fewer digits
    own = df.select(*by, F.col(score), F.col(tie), F.pow(F.col(pred) - F.col(y), 2).alias("__e"), F.col(y).alias("__y"), F.lit(1).alias("__one"))
    centred = joined(own, own.groupBy(*by).agg(F.avg("__y").alias("__m")), by).withColumn("__d", F.col("__y") - F.col("__m")).withColumn("__dd", F.pow("__d", 2))
    run = running(centred, by, [F.col(score), F.col(tie)], ["__one", "__e", "__d", "__dd"])
    upto = lambda c: F.col(f"before_{c}") + F.col(c)
    run = run.select(*by, upto("__one").alias("m"), F.col("total___one").alias("n"), upto("__e").alias("sse"), upto("__d").alias("s1"), upto("__dd").alias("s2"))
    shares = F.broadcast(df.sparkSession.range(11).select((0.5 + F.col("id") * 0.05).alias("f")))
    ends = run.crossJoin(shares).where(F.col("m") == F.greatest(F.lit(2), F.bround(F.round(F.col("n") * F.col("f"), 9)).cast("long")))
    spread = F.col("s2") - F.col("s1") * F.col("s1") / F.col("m")
    risk = ends.withColumn("risk", F.when(spread > M.TINY, F.col("sse") / spread))
    before = lambda c: F.lag(c).over(Window.partitionBy(*by).orderBy("f"))  # noqa: E731  eleven rows a cell
    pieces = risk.withColumn("piece", (F.col("f") - before("f")) * (F.col("risk") + before("risk")) / 2)
    return pieces.groupBy(*by).agg(F.sum("piece").alias("auc"))


def gate_cells(found: DataFrame, by: list[str]) -> DataFrame:
    """One row a cell: the three areas, the mean gate score, R2 and the failure flag. ``found`` is written once."""
    found = stored(found, "gates")
    out = found.groupBy(*by).agg(F.avg("gate").alias("mean_physics_gate_score"), M.r2(F.col("pred"), F.col("y")).alias("r2_evaluation"))
    for score, name in (("gate", "auc_physics_gate"), ("width", "auc_interval_width"), ("control", "auc_random_control")):
        out = out.join(risk_coverage(found, by, score).withColumnRenamed("auc", name), by)
    return out.withColumn("catastrophic_failure", M.catastrophic(F.col("r2_evaluation")))


def detection_limits(df: DataFrame, by: list[str], pred: str, level: str, least: int = 5) -> DataFrame:
    """Limits from blank predictions, and per level the share above them; cells need ``least`` blanks."""
    m, s, lod, loq = M.blank_limits(F.col(pred), F.col(level))
    limits = df.groupBy(*by).agg(m.alias("blank_mean"), s.alias("blank_sd"), lod.alias("lod"), loq.alias("loq"), F.count_if(F.col(level) == 0).alias("blanks")).where(F.col("blanks") >= least)
    above = lambda c: F.avg((F.col(pred) > F.col(c)).cast("double"))
    rows = joined(df, limits, by)
    q = quantiles(rows, [*by, level], pred, [0.5], "__q")
    shares = rows.groupBy(*by, level).agg(F.count("*").alias("n_test_spectra"), above("lod").alias("detection_rate_at_lod"), above("loq").alias("detection_rate_at_loq"), F.first("blank_mean").alias("blank_mean"), F.first("blank_sd").alias("blank_sd"))
    return joined(shares, q.select(*by, level, F.get("__q", 0).alias("median_prediction")), [*by, level])


def farthest(pool: DataFrame, chosen: DataFrame, id_: str, x: str) -> DataFrame:
    """The pool row whose nearest chosen row is farthest (one step of k-centre); ``chosen`` is a small set."""
    near = pool.crossJoin(F.broadcast(chosen.select(F.col(x).alias("__c")))).groupBy(id_).agg(F.min(A.squared_distance(F.col(x), F.col("__c"))).alias("distance"))
    return near.orderBy(F.col("distance").desc(), id_).limit(1)


Cell = tuple
#: Chosen rows of all cells at most: they are sent to every task at every step.
MOST_CHOSEN = 100_000


def nearer(pool: DataFrame, by: list[str], fresh: dict[Cell, list[tuple]]) -> DataFrame:
    """``pool`` with ``nearest`` brought down to the squared distance of the nearest of ``fresh``, the cell's newly chosen rows; theirs is -1."""
    sent = pool.sparkSession.sparkContext.broadcast(fresh)

    def run(batches):
        for frame in batches:
            for keys, part in frame.groupby(by, sort=False, dropna=False):
                new = sent.value.get(keys)
                if new:
                    x = np.stack(part.x.to_list()).astype(float)
                    own = part.nearest.to_numpy(float)
                    for _, c, _ in new:
                        own = np.minimum(own, ((x - c) ** 2).sum(1))
                    part = part.assign(nearest=np.where(part.idx.isin([i for i, _, _ in new]), -1.0, own))
                yield part

    return pool.mapInPandas(run, pool.schema)


def k_centre(pool: DataFrame, by: list[str], chosen: dict[Cell, list[tuple]], size: int) -> tuple[DataFrame, dict[Cell, list[tuple]]]:
    """Bring every cell's chosen rows (``idx, x, y``) to ``size``, the farthest first; ``pool`` has ``nearest`` to those chosen.

    A step is one aggregate: the greatest ``nearest`` a cell, summed up in parts before the shuffle. Between two
    sizes only the rows chosen since are compared; then ``nearest`` is written anew, which ends the lineage.
    """
    fresh: dict[Cell, list[tuple]] = {}
    now = pool
    while any(len(v) < size for v in chosen.values()):
        best = now.groupBy(*by).agg(F.max_by(F.struct("idx", "x", "y"), F.struct("nearest", -F.col("idx"))).alias("b"))
        for r in best.collect():  # one row a cell
            key = tuple(r[c] for c in by)
            if len(chosen.get(key, [None] * size)) < size:
                chosen[key].append((r.b.idx, np.array(r.b.x, float), r.b.y))
                fresh.setdefault(key, []).append(chosen[key][-1])
        now = nearer(pool, by, fresh)
    return stored(now, "nearest"), chosen


def widest(pool: DataFrame, by: list[str], chosen: dict[Cell, list[tuple]], size: int, name: str) -> dict[Cell, list[tuple]]:
    """Bring every cell's chosen rows to ``size`` by the rows whose interval, by a head fitted to those chosen, is widest."""
    need = {k: size - len(v) for k, v in chosen.items()}
    sent = pool.sparkSession.sparkContext.broadcast({k: ([i for i, _, _ in v], np.stack([x for _, x, _ in v]), np.array([y for _, _, y in v])) for k, v in chosen.items() if need[k] > 0})

    def run(batches):
        made = {}
        for frame in batches:
            for keys, part in frame.groupby(by, sort=False, dropna=False):
                if keys not in sent.value:
                    continue
                ids, x, y = sent.value[keys]
                if keys not in made:
                    made[keys] = heads.fitted(heads.head(name), x, y, scale_y=False)
                part = part[~part.idx.isin(ids)]
                if len(part):
                    low, high = made[keys].quantiles(np.stack(part.x.to_list()).astype(float), (0.1, 0.9))
                    yield part.assign(nearest=high - low)

    order = Window.partitionBy(*by).orderBy(F.col("nearest").desc(), "idx")
    most = max(need.values(), default=0)
    top = pool.mapInPandas(run, pool.schema).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)  # limited before the shuffle
    for r in top.orderBy("__n").collect():
        key = tuple(r[c] for c in by)
        if len(chosen[key]) < size:
            chosen[key].append((r.idx, np.array(r.x, float), r.y))
    return chosen


def selection(rows: DataFrame, by: list[str], name: str = "ridge", steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Grow a support set from two rows that the strategies share by three strategies; score a fixed test set at each size.

    ``rows`` has ``role`` candidate or test; ``by`` ends in the repetition. Each repetition has its own draws, and each
    strategy its own stream of them. All cells take a step together, each step a job over the pool; what a
    cell has chosen is at most ``max(steps)`` rows, kept on the driver. Pools with fewer rows than that give nothing.
    """
    pool = stored(rows.where("role = 'candidate'").select(*by, "idx", "x", "y", F.lit(float("inf")).alias("nearest")), "pool")
    placed = running(pool.select(*by, "idx").withColumn("one", F.lit(1)), by, [F.col("idx")], ["one"])
    counts = {tuple(r[c] for c in by): r.n for r in pool.groupBy(*by).agg(F.count("*").alias("n")).collect()}  # one row a cell
    counts = {k: n for k, n in counts.items() if n >= max(steps)}
    if 3 * max(steps) * len(counts) > MOST_CHOSEN:
        raise ValueError(f"{len(counts)} cells choose more than {MOST_CHOSEN} rows: use a smaller grid")
    wanted = []
    for key, n in counts.items():
        rep = int(key[-1])
        seed = np.random.default_rng(66_900 + rep).choice(n, 2, replace=False).tolist()
        rng, own = np.random.default_rng(67_000 + rep), list(seed)
        for size in steps:
            rest = np.setdiff1d(np.arange(n), own)
            own += rng.choice(rest, size - len(own), replace=False).tolist() if size > len(own) else []
        wanted += [(*key, place, nth) for nth, place in enumerate(own)]
    spark = rows.sparkSession
    types = heads.types(rows, by)
    places = spark.createDataFrame(wanted, f"{types}, place long, nth int")
    drawn = joined(joined(placed.withColumnRenamed("before_one", "place"), places, [*by, "place"]), pool.select(*by, "idx", "x", "y"), [*by, "idx"])
    random: dict[Cell, list[tuple]] = {k: [] for k in counts}
    for r in drawn.orderBy("nth").collect():
        random[tuple(r[c] for c in by)].append((r.idx, np.array(r.x, float), r.y))
    kept = {"random": random, "k-center": {k: v[:2] for k, v in random.items()}, "interval-width": {k: v[:2] for k, v in random.items()}}
    near = nearer(pool, by, kept["k-center"])
    found = []
    for size in steps:
        near, kept["k-center"] = k_centre(near, by, kept["k-center"], size)
        kept["interval-width"] = widest(pool, by, kept["interval-width"], size, name)
        found += [(strategy, size, key, own[:size]) for strategy, cells in kept.items() for key, own in cells.items()]
    return _scored(rows.where("role = 'test'"), by, found, name, types)


def _scored(test: DataFrame, by: list[str], found: list[tuple], name: str, types: str) -> DataFrame:
    """R2 and RMSE of every chosen support on its cell's test rows: sums a task, merged."""
    per: dict[Cell, list] = {}
    for strategy, size, key, own in found:
        per.setdefault(key, []).append((strategy, size, np.stack([x for _, x, _ in own]), np.array([y for _, _, y in own])))
    sent = test.sparkSession.sparkContext.broadcast(per)
    names = [*by, "strategy", "support_size", *experiments.SUMS]

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        made: dict[tuple, heads.Fitted] = {}
        for frame in batches:
            for keys, part in frame.groupby(by, sort=False, dropna=False):
                x, y = np.stack(part.x.to_list()).astype(float), part.y.to_numpy(float)
                for strategy, size, xs, ys in sent.value.get(keys, []):
                    own = (*keys, strategy, size)
                    if own not in made:
                        made[own] = heads.fitted(heads.head(name), xs, ys)
                    pred = made[own].predict(x)
                    total[own] = total.get(own, 0.0) + experiments.summed(pred, y, float(ys.mean()), pred == y)
        if total:
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=names)

    schema = ", ".join([types, "strategy string, support_size int", *(f"{c} double" for c in experiments.SUMS)])
    keys = [*by, "strategy", "support_size"]
    sums = test.select(*by, "x", "y").mapInPandas(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in experiments.SUMS])
    return sums.select(*keys, experiments.r2_of_sums().alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def native_levels() -> list[float]:
    """The nominal coverages that the quantile grid holds."""
    return [round(heads.QUANTILES[b] - heads.QUANTILES[a], 10) for _, a, b in LEVELS]
