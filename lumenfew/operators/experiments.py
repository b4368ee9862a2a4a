"""Whole experiments: grids of cells from a table of features to result rows.

A cell is (task, support size, repetition). Its support is the first rows by hash: ids meet
the small grid, and a ranked limit leaves ``max(sizes)`` rows a cell before anything is
shuffled. Heads are fitted on supports alone (``applyInPandas`` over a few rows a cell), and
what they found goes to every task: cells times a head, bounded by the grid and checked.
Then the whole table passes once, in batches; each row is predicted by the cells of its task
whose support it isn't in, and partial aggregates make the measures. No window, group or
task holds a table.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfew.functions import metrics as M
from lumenfew.operators import heads, splits
from lumenfew.sources.sinks import stored

BY = ["task", "support_size", "repetition"]
#: Query rows a cell needs more than.
LEAST_QUERY = 5
SCHEMA = "task string, support_size int, repetition int"
#: Rows of a batch that are a matrix at once.
BLOCK = 1024
#: Bytes of all fitted heads at most.
MOST = 256 << 20

Fit = Callable[[dict, np.ndarray, np.ndarray], dict[str, heads.Fitted]]


def grid(rows: DataFrame, sizes: list[int], reps: int) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame([(k, r) for k in sizes for r in range(reps)], "support_size int, repetition int"))


def coded(family: str, id_: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(family), "support_size", "repetition", id_.cast("string")))


def support_rows(rows: DataFrame, sizes: list[int], reps: int, family: str = "eval", group: str | None = None) -> DataFrame:
    """The support of each cell: ``task, support_size, repetition, idx, x, y`` and ``group``.

    With ``group``, one member of each of ``support_size`` groups.
    """
    own = ["idx"] if group is None else ["idx", group]
    cell = Window.partitionBy(*BY)
    if group is None:
        each = rows.select("task", *own).crossJoin(grid(rows, sizes, reps))
        ranked = each.withColumn("__n", F.row_number().over(cell.orderBy(coded(family, F.col("idx")), "idx"))).where(F.col("__n") <= max(sizes))
        ids = ranked.where(F.col("__n") <= F.col("support_size")).drop("__n")
    else:
        names = rows.select("task", group).distinct().crossJoin(grid(rows, sizes, reps))
        ranked = names.withColumn("__n", F.row_number().over(cell.orderBy(coded(family, F.col(group)), group))).where(F.col("__n") <= max(sizes))
        few = ranked.where(F.col("__n") <= F.col("support_size")).drop("__n")  # grid x sizes rows
        code = coded("member", F.col("idx"))
        ids = rows.select("task", *own).join(few, ["task", group]).groupBy(*BY, group).agg(F.min_by("idx", F.struct(code, "idx")).alias("idx"))
    return rows.join(F.broadcast(ids.select(*BY, "idx")), ["task", "idx"])  # at most grid x sizes ids


def fit_cells(rows: DataFrame, sizes: list[int], reps: int, fit: Fit, family: str = "eval", group: str | None = None):
    """Fit every cell; a broadcast list of (keys, ids or groups that take no part, heads by name, the support's mean target)."""

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        named, y = dict(zip(BY, keys, strict=True)), frame.y.to_numpy(float)
        made = fit(named, np.stack(frame.x.to_list()).astype(float), y)
        out = frame[group or "idx"].unique().tolist()
        return pd.DataFrame({"task": [keys[0]], "blob": [pickle.dumps((named, out, made, float(y.mean())))]})

    made = stored(support_rows(rows, sizes, reps, family, group).groupBy(*BY).applyInPandas(run, "task string, blob binary"), "heads")
    if (size := made.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) > MOST:
        raise ValueError(f"the fitted heads take {size} bytes, more than {MOST}: use a smaller grid")
    found = made.collect()
    by_task: dict[str, list[bytes]] = {}
    for r in found:
        by_task.setdefault(r.task, []).append(bytes(r.blob))
    return rows.sparkSession.sparkContext.broadcast(by_task)


def _parts(rows: pd.DataFrame, cells: dict[str, list], group: str | None) -> Iterator[tuple]:
    """Each task's rows of a batch with each of its cells: keys, heads, centre, query rows and their ``x``."""
    for task, part in (own for i in range(0, len(rows), BLOCK) for own in rows.iloc[i : i + BLOCK].groupby("task", sort=False)):
        x = np.stack(part.x.to_list()).astype(float)
        for keys, out, made, centre in cells.get(task, []):
            query = ~part[group or "idx"].isin(out).to_numpy()
            if query.any():
                yield keys, made, centre, x[query], part[query]


def predicted(rows: DataFrame, models, each: Callable[[dict, dict, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, group: str | None = None) -> DataFrame:
    """``each(keys, heads, x, rows)`` on the rows of every batch that a cell has as queries; the keys stand before its columns."""
    wanted = rows.select("task", "idx", "x", "y", *([group] if group else []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = {t: [pickle.loads(b) for b in own] for t, own in models.value.items()}
        for b in batches:
            for keys, made, _, x, part in _parts(b, cells, group):
                found = each(keys, made, x, part)
                for i, k in enumerate(BY):
                    found.insert(i, k, keys[k])
                yield found

    return wanted.mapInPandas(run, f"{SCHEMA}, {schema}")


#: Sums of query rows that the measures of a cell follow from; targets are taken less the cell's fixed centre.
SUMS = ("n", "sse", "sy", "syy", "hits", "width")


def summed(pred: np.ndarray, y: np.ndarray, centre: float, hits: np.ndarray, width: np.ndarray | float = 0.0) -> np.ndarray:
    d = y - centre
    return np.array([len(y), ((pred - y) ** 2).sum(), d.sum(), (d * d).sum(), np.sum(hits), np.sum(width)])


def combined(rows: DataFrame, models, each: Callable[[dict, dict, float, np.ndarray, pd.DataFrame], dict[tuple, np.ndarray]], keys: str = "", group: str | None = None) -> DataFrame:
    """``SUMS`` of each cell and of each further key that ``each(cell, heads, centre, x, rows)`` names (a schema in ``keys``).

    A task adds up what its batches give and sends one row a cell and key, whatever its rows.
    """
    wanted = rows.select("task", "idx", "x", "y", *([group] if group else []))
    names = [*BY, *(f.split()[0] for f in keys.split(", ") if f)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = {t: [pickle.loads(b) for b in own] for t, own in models.value.items()}
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for own, made, centre, x, part in _parts(b, cells, group):
                for key, sums in each(own, made, centre, x, part).items():
                    key = (*(own[k] for k in BY), *key)
                    total[key] = total[key] + sums if key in total else sums
        if total:
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=[*names, *SUMS])

    schema = ", ".join([SCHEMA, *([keys] if keys else []), *(f"{c} double" for c in SUMS)])
    return wanted.mapInPandas(run, schema).groupBy(*names).agg(*[F.sum(c).alias(c) for c in SUMS])


def spread_of() -> Column:
    """The squared deviations of the targets."""
    return F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")


def r2_of_sums() -> Column:
    return F.when(spread_of() > M.TINY, 1 - F.col("sse") / spread_of())


def predictions(rows: DataFrame, sizes: list[int], reps: int, fit: Fit, family: str = "eval", group: str | None = None) -> DataFrame:
    """``task, support_size, repetition, idx, arm, n_features, note, y, pred`` of every query row, cell and head."""

    def each(_, made, x, part):
        own = [pd.DataFrame({"idx": part.idx.to_numpy(), "arm": arm, "n_features": m.n_features, "note": m.note, "y": part.y.to_numpy(float), "pred": m.predict(x)}) for arm, m in made.items()]
        return pd.concat(own, ignore_index=True)

    models = fit_cells(rows, sizes, reps, fit, family, group)
    return predicted(rows, models, each, "idx long, arm string, n_features int, note int, y double, pred double", group)


def scores(rows: DataFrame, sizes: list[int], reps: int, fit: Fit, family: str = "eval", group: str | None = None) -> DataFrame:
    """One result row a cell and head: ``arm, n_features, note, r2, rmse, rpd``."""

    def each(_, made, centre, x, part):
        y = part.y.to_numpy(float)
        out = {}
        for arm, m in made.items():
            pred = m.predict(x)
            out[arm, m.n_features, m.note] = summed(pred, y, centre, pred == y)
        return out

    made = combined(rows, fit_cells(rows, sizes, reps, fit, family, group), each, "arm string, n_features int, note int", group)
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    rpd = F.when(rmse <= M.TINY, F.lit(float("inf"))).when(F.col("n") > 1, F.sqrt(F.greatest(spread_of(), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0.0))) / F.nullif(rmse, F.lit(0.0)))
    out = made.select(*BY, "arm", "n_features", "note", r2_of_sums().alias("r2"), rmse.alias("rmse"), rpd.alias("rpd"), (F.col("hits") / F.col("n")).alias("accuracy"), F.col("n").cast("long").alias("n_query"))
    return out.where(F.col("n_query") > LEAST_QUERY)


def one_head(name: str, arm: str | None = None) -> Fit:
    return lambda _, x, y: {arm or name: heads.fitted(heads.head(name), x, y, None if name == "pls" else 5.0)}


def representation_comparison(rows: DataFrame, arms: dict[str, Callable[[DataFrame], DataFrame]], sizes: list[int], reps: int, head: str = "ridge") -> DataFrame:
    """One head over several representations of the same splits; an arm makes a table's ``x`` into its features."""
    out = None
    for arm, make in arms.items():
        one = scores(make(rows), sizes, reps, one_head(head, arm)).drop("note", "accuracy", "n_query")
        out = one if out is None else out.unionByName(one)
    return out


def label_budget(features: DataFrame, raw: DataFrame, sizes: list[int], reps: int, head: str = "ridge") -> DataFrame:
    """The head on features against PLS on raw channels, cell by cell, with the components PLS chose."""

    def pls(_, x, y):
        made = heads.fitted(heads.PLS(), x, y, None, scale_y=False)
        made.note = made.head.components
        return {"pls": made}

    a = scores(features, sizes, reps, one_head(head)).select(*BY, F.col("r2").alias("r2_head"))
    b = scores(raw, sizes, reps, pls).select(*BY, F.col("r2").alias("r2_pls"), F.col("note").alias("n_components_pls"))
    return a.join(b, BY)


def decoupling(rows: DataFrame, sizes: list[int], reps: int, components: int = 5) -> DataFrame:
    """Projection by head: PLS itself, ridge on PLS scores, ridge on principal scores of the support."""

    def fit(_, x, y):
        pls = heads.fitted(heads.PLS(min(components, len(y) - 1)), x, y, None, scale_y=False)
        s = pls.inputs(x)
        _, _, v = np.linalg.svd(s - s.mean(0), full_matrices=False)
        v = v[: min(components, len(v))].T
        out = {"r2_pls": pls}
        for arm, project in (("r2_pls_scores_ridge", pls.head.transform), ("r2_pca_scores_ridge", Projection(s.mean(0), v))):
            made = heads.Ridge(heads.RIDGE_GRID).fit(project(s), y)
            out[arm] = heads.Fitted(made, pls.centre, pls.spread, None, project=project)
        for m in out.values():
            m.n_features, m.note = x.shape[1], v.shape[1]
        return out

    made = scores(rows, sizes, reps, fit)
    picks = [F.max(F.when(F.col("arm") == a, F.col("r2"))).alias(a) for a in ("r2_pls", "r2_pls_scores_ridge", "r2_pca_scores_ridge")]
    return made.groupBy(*BY).agg(F.max("note").alias("n_components"), *picks)


class Projection:
    """Rows less a centre onto columns."""

    def __init__(self, centre: np.ndarray, columns: np.ndarray):
        self.centre, self.columns = centre, columns

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.columns


def corpus_flip(features: DataFrame, raw: DataFrame, sizes: list[int], reps: int, group: str, head: str = "ridge") -> DataFrame:
    """Three heads cell by cell, groups kept apart: a registered head and cross-validated ridge on components, PLS on raw channels.

    ``features`` hold scores on components of a corpus (with simulated rows or without); both tables have ``group``.
    """

    def two(_, x, y):
        return {"r2_head": heads.fitted(heads.head(head), x, y), "r2_ridge": heads.fitted(heads.head("ridge-cv"), x, y)}

    def pls(_, x, y):
        return {"r2_pls": heads.fitted(heads.PLS(), x, y, None)}

    made = scores(features, sizes, reps, two, "group", group).select(*BY, "arm", "r2").unionByName(scores(raw, sizes, reps, pls, "group", group).select(*BY, "arm", "r2"))
    return made.groupBy(*BY).agg(*[F.max(F.when(F.col("arm") == a, F.col("r2"))).alias(a) for a in ("r2_head", "r2_ridge", "r2_pls")])


def cars_scores(rows: DataFrame, sizes: list[int], reps: int, runs: int = 50) -> DataFrame:
    """Channels chosen on the support alone, then ridge on them."""

    def fit(keys, x, y):
        mask = heads.cars(x, y, runs=runs, seed=66_000 + keys["support_size"] * 100 + keys["repetition"])
        return {"cars": heads.fitted(heads.Ridge(), x, y, mask=mask)}

    return scores(rows, sizes, reps, fit).select(*BY, "n_features", "r2", "rmse", "rpd")


def fusion(modalities: dict[str, DataFrame], sizes: list[int], reps: int, classify: bool = False) -> DataFrame:
    """Each modality alone and all joined (scores one after another): R2, or accuracy of classes."""
    names = list(modalities)
    joined = None
    for name, df in modalities.items():
        own = df.select("task", "idx", "y", F.col("x").alias(name))
        joined = own if joined is None else joined.join(own.drop("y"), ["task", "idx"])
    out = None
    for arm, x in ({n: F.col(n) for n in names} | {"fused": F.concat(*names)}).items():
        fit = lambda _, a, b, arm=arm: {arm: heads.fitted(heads.NearestMean() if classify else heads.Ridge(), a, b, scale_y=not classify)}
        one = scores(joined.select("task", "idx", "y", x.alias("x")), sizes, reps, fit, "fusion")
        one = one.select(*BY, F.col("arm").alias("modality"), "n_features", F.col("accuracy" if classify else "r2").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def capped_ids(rows: DataFrame, sizes: list[int], reps: int, most: int, family: str = "eval") -> DataFrame:
    """``task, support_size, repetition, idx``: each cell's sample of at most ``most`` query rows."""
    support = support_rows(rows, sizes, reps, family)
    each = rows.select("task", "idx").crossJoin(grid(rows, sizes, reps)).join(F.broadcast(support.select(*BY, "idx")), [*BY, "idx"], "left_anti")
    # a limit that counts ranks in parts before the shuffle
    ranked = each.withColumn("__n", F.row_number().over(Window.partitionBy(*BY).orderBy(coded("cap", F.col("idx")), "idx")))
    return ranked.where(F.col("__n") <= most).select(*BY, "idx")


def pool_cells(rows: DataFrame, reps: int, pool: int = 200, test: int = 400) -> DataFrame:
    """Candidates and test rows of each repetition, capped, for sample selection: ids are split and capped, rows join at the end."""
    ids = rows.select("task", "idx", F.explode(F.array(*map(F.lit, range(reps)))).alias("repetition"))
    split = splits.share_split(ids, "idx", 0.6, F.col("repetition"), ["task", "repetition"])
    parts = [splits.capped(split.where(F.col("role") == role), "idx", most, ["task", "repetition"]) for role, most in (("candidate", pool), ("test", test))]
    few = parts[0].unionByName(parts[1])  # repetitions x caps rows
    return rows.select("task", "idx", "x", "y").join(few, ["task", "idx"]).select("task", "repetition", "idx", "role", "x", "y")
