"""Queries whose models SQL can't express: components, heads, trust analyses, simulation.

The target of ``embeddings`` is ``y = sum x_i cos(i)``, a third of it noise by hash; labels
stand for groups. Spectra of 64 channels repeat over a grid of support sizes and
repetitions; tests hold the parts against brute force.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.operators import experiments as X
from lumenfew.operators import pca, simulate, spectra, splits, trust
from lumenfew.operators.wavelet import scattering, with_scattering
from lumenfew.plans.embeddings import rows

SIZES, REPS = [5, 10, 20], 10
BUDGET = [5, 10, 20, 50, 100]


def task_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``task, idx, label, x, y``."""
    df = rows(spark, sf)
    signal = A.dot(F.col("x"), F.array(*[F.lit(math.cos(i)) for i in range(64)]))
    noise = (F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000 - 0.5) * 0.3
    return df.select(F.lit("synthetic").alias("task"), F.col("vec_id").alias("idx"), "label", A.snv(F.col("x")).alias("x"), (signal + noise).alias("y"))


def features(spark, sf, k: int = 10) -> DataFrame:
    df = task_rows(spark, sf)
    return df.withColumn("x", pca.fit(df, "x", k).scores(F.col("x")))


def plain(df: DataFrame) -> DataFrame:
    return df.select("task", "idx", "x", "y")


def pca_reconstruction_error(spark, sf):
    df = rows(spark, sf)
    return df.select("vec_id", pca.fit(df, "x", 20).error(F.col("x")).alias("error"))


def wide_component_error(spark, sf):
    """Error of rows of 2,080 channels (all products of two of the 64) rebuilt from ten components."""
    products = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.transform(F.slice("x", i, F.lit(64)), lambda v: v * F.element_at("x", i))))
    df = rows(spark, sf).select("vec_id", products.alias("x"))
    return pca.fit(df, "x", 10).transformed(df, "x", "scores", "error").select("vec_id", F.size("scores").alias("components"), "error")


def fixed_component_error(spark, sf):
    """The same with components that SQL can state: the first 20 axes around a centre of i / 1000."""
    df = rows(spark, sf)
    model = pca.Model([i / 1000 for i in range(64)], np.eye(64)[:20].tolist(), [])
    return df.select("vec_id", F.round(model.error(F.col("x")), 6).alias("error"))


def principal_angles(spark, sf):
    df = rows(spark, sf)
    cosines = pca.principal_angles(pca.fit(df.where("label < 5"), "x", 20), pca.fit(df.where("label >= 5"), "x", 20))
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(cosines)], "nth int, cosine double")


def wavelet_scattering(spark, sf):
    return rows(spark, sf).select("vec_id", scattering(F.col("x")).alias("features"))


def random_projection(spark, sf):
    """Every output of every row, one below another."""
    made = rows(spark, sf).select("vec_id", F.posexplode(spectra.representation("random-projection-100", 64)(F.col("x"))).alias("pos", "v"))
    return made.select("vec_id", "pos", F.round("v", 5).alias("v"))


def representation_comparison(spark, sf):
    df = task_rows(spark, sf)
    model = pca.fit(df, "x", 20)
    matrix = spectra.random_projection(64, 20)
    return X.representation_comparison(df.select("task", "idx", "x", "y"), {"raw-64": lambda d: d, "pca-20": lambda d: d.withColumn("x", model.scores(F.col("x"))), "random-projection-20": lambda d: d.withColumn("x", A.project(F.col("x"), matrix)), "wavelet-scattering": with_scattering}, SIZES, REPS)


def label_budget(spark, sf):
    return X.label_budget(plain(features(spark, sf)), plain(task_rows(spark, sf)), BUDGET, REPS)


def decoupling(spark, sf):
    return X.decoupling(task_rows(spark, sf).select("task", "idx", "x", "y"), SIZES, REPS)


def cars_selected(spark, sf):
    return X.cars_scores(plain(task_rows(spark, sf)), SIZES, REPS)


def grouped_cells(spark, sf):
    """Splits that keep groups apart, over the grid."""
    df = features(spark, sf).select("task", "idx", "label", "x", "y")
    return X.scores(df, [3, 5], REPS, X.one_head("ridge"), "group", "label").drop("note", "accuracy")


def posterior_audit(spark, sf):
    found = trust.posteriors(plain(features(spark, sf)), SIZES, REPS)
    return trust.audit(splits.halves(found, "idx", 0, 0, X.BY), X.BY)


def mean_coverage(spark, sf):
    """Mean coverage of each method at each nominal level."""
    return trust.mean_coverage(posterior_audit(spark, sf))


def ridge_jackknife(spark, sf):
    return trust.jackknife_audit(plain(features(spark, sf)), SIZES, REPS)


def physics_gate(spark, sf):
    return trust.gate_cells(trust.gate(plain(features(spark, sf)), SIZES, REPS, 100), X.BY)


def sample_selection(spark, sf):
    return trust.selection(X.pool_cells(features(spark, sf).select("task", "idx", "x", "y"), REPS), ["task", "repetition"])


def fusion_regression(spark, sf):
    df = task_rows(spark, sf).drop("label")
    parts = {n: df.withColumn("x", F.slice("x", a, b)) for n, a, b in (("nir", 1, 24), ("mir", 25, 24), ("raman", 49, 16))}
    return X.fusion(parts, SIZES, REPS)


def fusion_classification(spark, sf):
    df = task_rows(spark, sf).withColumn("y", F.col("label").cast("double")).drop("label")
    parts = {n: df.withColumn("x", F.slice("x", a, b)) for n, a, b in (("nir", 1, 24), ("mir", 25, 24), ("raman", 49, 16))}
    return X.fusion(parts, [20, 40], REPS, classify=True)


def class_library(spark, sf) -> np.ndarray:
    """The mean row of each label, one below another: a small library that follows the table."""
    means = spectra.class_means(rows(spark, sf).where("label is not null"), "x", ["label"]).orderBy("label").limit(100)
    return np.array([r.spectrum for r in means.collect()])


def simulated_mixtures(spark, sf):
    """As many mixtures of the labels' mean rows as the table has rows, unperturbed, and how far each is from its weighted parts."""
    library = class_library(spark, sf)
    low = library.min(axis=1, keepdims=True)
    scaled = F.array(*[F.array(*map(F.lit, v)) for v in ((library - low) / (library.max(axis=1, keepdims=True) - low + 1e-8)).tolist()])
    made = simulate.mixtures(spark, library, rows(spark, sf).count(), perturb=False)
    parts = F.transform(F.map_entries("weights"), lambda e: F.transform(F.get(scaled, e["key"].cast("int")), lambda v: v * e["value"]))
    whole = F.aggregate(parts, F.array_repeat(F.lit(0.0), 64), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    off = F.array_max(F.zip_with("spectrum", whole, lambda x, y: F.abs(x - y)))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, v: a + v)
    return made.select("idx", F.size("weights").alias("components"), total.alias("total"), F.size("spectrum").alias("channels"), off.alias("off"))


def simulated_mixtures_total(spark, sf):
    """What holds of every mixture, whatever it draws: its channels, the sum of its weights, and that it is what they make of the library."""
    return simulated_mixtures(spark, sf).select("idx", "channels", F.round("total", 9).alias("total"), (F.col("off") < 1e-5).alias("is_mixture"))


def fuel_compositions(spark, sf):
    """As many simulated fuels as the table has rows, from the labels' mean rows, and what non-negative least squares makes of them."""
    axis = np.linspace(700, 1500, 64)
    basis = class_library(spark, sf)[:4]
    basis = basis - basis.min(axis=1, keepdims=True)
    made = simulate.fuel(spark, axis, basis, np.array([[1.0, 0.5, 0.0, 0.1], [0.2, 0.0, 1.0, 0.3]])[:, : len(basis)], rows(spark, sf).count())
    return simulate.compositions(made, "spectrum", basis, axis).select("idx", "weights", "residual")


def corpus_blocks(spark, sf):
    """The corpus of two measured blocks and simulated rows, by block: sums of its first, a middle and its last channel (of the measured ones)."""
    df = rows(spark, sf).select(F.col("vec_id").alias("ordinal"), "label", F.col("x").alias("spectrum"))
    simulated = simulate.mixtures(spark, class_library(spark, sf), 200).select(F.col("idx").alias("ordinal"), "spectrum")
    every = simulate.corpus({"low": df.where("label < 5"), "high": df.where("label >= 5")}, simulated)
    total = lambda i: F.round(F.sum(F.when(F.col("source") != "simulated", F.get("spectrum", F.lit(i)).cast("double")).otherwise(0.0)), 3)
    return every.groupBy("source", "block").agg(F.count("*").alias("n"), F.min(F.size("spectrum")).alias("channels"), total(0).alias("first"), total(73).alias("middle"), total(511).alias("last"))


def corpus_flip(spark, sf):
    """Three heads on components of measured rows alone, and of measured and simulated rows; labels are groups."""
    df = task_rows(spark, sf).select("task", "idx", "label", "x", "y")
    mixed = simulate.mixtures(spark, class_library(spark, sf), 300).select(A.snv(A.doubles("spectrum")).alias("x"))
    corpora = {"real": df.select("x"), "real-and-simulated": df.select("x").unionByName(mixed)}
    out = None
    for name, corpus in corpora.items():
        scores = df.withColumn("x", pca.fit(corpus, "x", 10).scores(F.col("x")))
        one = X.corpus_flip(scores, df, [3, 5], REPS, "label").withColumn("corpus", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (pca_reconstruction_error, wide_component_error, fixed_component_error, principal_angles, wavelet_scattering, random_projection, representation_comparison, label_budget, decoupling, cars_selected, grouped_cells, posterior_audit, mean_coverage, ridge_jackknife, physics_gate, sample_selection, fusion_regression, fusion_classification, simulated_mixtures, simulated_mixtures_total, fuel_compositions, corpus_blocks, corpus_flip)}

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * {}[i]))"
SQL = {
    "fixed_component_error": "SELECT vec_id, round(list_sum(list_transform(range(21, 65), lambda i: pow(CAST(embedding[i] AS DOUBLE) - (i - 1) / 1000.0, 2))) / list_sum(list_transform(embedding, lambda v: pow(CAST(v AS DOUBLE), 2))), 6) AS error FROM embeddings",
    "random_projection": "WITH m AS (SELECT pos, c FROM (VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(spectra.random_projection(64))) + f") t(pos, c)) SELECT vec_id, CAST(pos AS INT) AS pos, round({_DOT.format('c')}, 5) AS v FROM embeddings, m",
    "corpus_blocks": """WITH m AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS source, embedding AS e FROM embeddings WHERE label IS NOT NULL)
SELECT source, CAST(CASE source WHEN 'low' THEN 0 ELSE 1 END AS INT) AS block, count(*) AS n, CAST(512 AS INT) AS channels, round(sum(CAST(e[1] AS DOUBLE)), 3) AS first, round(sum(CAST(e[10] AS DOUBLE)), 3) AS middle, round(sum(CAST(e[64] AS DOUBLE)), 3) AS last FROM m GROUP BY source
UNION ALL SELECT 'simulated', 2, 200, 512, 0.0, 0.0, 0.0""",
    "simulated_mixtures_total": "SELECT row_number() OVER () - 1 AS idx, CAST(64 AS INT) AS channels, 1.0::DOUBLE AS total, true AS is_mixture FROM embeddings",
}
