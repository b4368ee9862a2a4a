"""Readers of measurement files as DataFrames of ``sample_id, group_id, spectrum, targets``.

Line-oriented files are read with ``spark.read.text``; where lines relate to their place in
the file, the place comes from the byte offset order of one file, kept by ``ordinal``.
"""

from __future__ import annotations

import contextlib
import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.functions import text as T
from lumenfew.operators.ordered import running
from lumenfew.sources import formats


def ragged(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, fields``: lines cut at commas, without quoting rules, numbered as they stand in their file."""
    lines = formats.numbered_lines(spark, path)
    return lines.where(F.length(F.trim("value")) > 0).select("ordinal", F.split("value", ",").alias("fields"))


def diesel(spark: SparkSession, spectra: str, properties: str) -> DataFrame:
    """Spectra after the row ``Axisscale`` with the properties of their id; blank cells are null, the last of equal property rows wins."""
    rows = ragged(spark, spectra)
    start = F.broadcast(rows.where(T.clean_id(F.get("fields", 0)) == "Axisscale").agg(F.min_by("fields", "ordinal").alias("axis"), F.min("ordinal").alias("start")))
    body = rows.crossJoin(start).where("ordinal > start").withColumn("width", F.size("axis") - 2).where(F.size("fields") >= F.col("width") + 2)
    cells = F.transform(F.slice("fields", F.lit(3), F.col("width")), lambda c: F.struct(F.length(F.trim(c)).alias("n"), c.try_cast("double").alias("v")))
    body = body.withColumn("sample_id", T.clean_id(F.get("fields", 1))).withColumn("c", cells).where("sample_id <> ''").where(F.forall("c", lambda c: (c["n"] == 0) | c["v"].isNotNull()))
    found = body.select("ordinal", "sample_id", F.transform(F.slice("axis", F.lit(3), F.col("width")), lambda c: c.try_cast("double")).alias("wavelengths"), F.transform("c", lambda c: c["v"]).alias("spectrum"))
    props = ragged(spark, properties)
    head = F.broadcast(props.where((T.clean_id(F.get("fields", 0)) == "Label") & F.array_contains(F.transform("fields", T.clean_id), "CN")).agg(F.min_by(F.transform("fields", T.clean_id), "ordinal").alias("names"), F.min("ordinal").alias("start")))
    each = props.crossJoin(head).where("ordinal > start").select("ordinal", T.clean_id(F.get("fields", 1)).alias("id"), F.map_from_arrays(F.slice("names", 3, 100), F.transform(F.slice(F.concat("fields", F.array_repeat(F.lit(""), F.size("names"))), F.lit(3), F.greatest(F.size("names") - 2, F.lit(0))), lambda c: T.number(T.clean_id(c)))).alias("targets"))
    last = each.groupBy("id").agg(F.max_by("targets", "ordinal").alias("targets"))
    return found.join(last, F.col("sample_id") == F.col("id"), "left").drop("id")


def wide(df: DataFrame) -> tuple[DataFrame, list[float]]:
    """Columns that are named by numbers as one array ``spectrum``, and the axis."""
    names = T.numeric_columns(df)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*rest, F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("spectrum")), [float(c) for c in names]


def coerced(df: DataFrame, target: str) -> DataFrame:
    """A target column as a number, null where it is none."""
    return df.withColumn(target, T.number(F.col(f"`{target}`").cast("string")))


def edible_oil(spark: SparkSession, path: str, replicates: int = 3, oils: int | None = None) -> DataFrame:
    """Row 0 is the wavenumber axis; channels in ascending nanometres; gaps go; only oils with exactly ``replicates`` rows stay."""
    rows = ragged(spark, path)
    axis = F.broadcast(rows.where("ordinal = 0").select(F.transform(F.slice("fields", 3, 100_000), lambda c: c.try_cast("double")).alias("axis")))
    body = rows.where("ordinal > 0").crossJoin(axis).select("ordinal", T.number(F.get("fields", 0)).alias("kind"), T.number(F.get("fields", 1)).alias("value"), "axis", F.transform(F.slice("fields", 3, 100_000), lambda c: T.number(c)).alias("x"))
    good = body.where("kind is not null and value is not null").where(A.complete(F.col("x")) & (F.size("x") == F.size("axis")))
    nm, x = A.channel_sort(F.col("axis"), F.col("x"))
    named = good.select("ordinal", T.oil_id(F.col("kind"), F.col("value")).alias("group_id"), F.col("kind").cast("int").alias("label"), F.create_map(F.lit("peroxide"), "value").alias("targets"), nm.alias("wavelengths"), x.alias("spectrum"))
    kept = named.withColumn("n", F.count("*").over(Window.partitionBy("group_id"))).where(F.col("n") == replicates).drop("n")
    if oils is not None and (n := kept.select("group_id").distinct().count()) != oils:
        raise ValueError(f"{n} oils instead of {oils}")
    return kept


def modality(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, kind, value, spectrum`` of a CSV with a header, one row an oil."""
    rows = ragged(spark, path).where("ordinal > 0")
    return rows.select((F.col("ordinal") - 1).alias("ordinal"), T.number(F.get("fields", 0)).alias("kind"), T.number(F.get("fields", 1)).alias("value"), F.transform(F.slice("fields", 3, 100_000), lambda c: T.number(c)).alias("spectrum"))


def modalities(nir: DataFrame, mir: DataFrame, raman: DataFrame, replicates: int = 3) -> DataFrame:
    """Oils with all three modalities: NIR replicates averaged; an oil with a gap in any NIR replicate or Raman goes; rows must line up."""
    apart = mir.join(raman.select("ordinal", F.col("kind").alias("k"), F.col("value").alias("v")), "ordinal").where("not (kind <=> k) or abs(value - v) > 1e-6").count()
    if apart:
        raise ValueError(f"{apart} rows of the modalities don't line up")
    parts = nir.withColumn("oil", F.floor(F.col("ordinal") / replicates))
    dead = parts.where(~A.complete(F.col("spectrum"))).select("oil").union(raman.where(~A.complete(F.col("spectrum"))).select("ordinal")).distinct()
    each = parts.select("oil", F.posexplode("spectrum").alias("pos", "v")).groupBy("oil", "pos").agg(F.avg("v").alias("v"))
    mean = each.groupBy("oil").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda p: p["v"]).alias("nir"))
    both = mean.join(mir.select(F.col("ordinal").alias("oil"), F.col("kind").cast("int").alias("label"), F.col("value").alias("peroxide"), F.col("spectrum").alias("mir")), "oil").join(raman.select(F.col("ordinal").alias("oil"), F.col("spectrum").alias("raman")), "oil")
    return both.join(dead, "oil", "left_anti")


def fuel_raman(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[float]]:
    """Parquet parts together; channels with a gap go, then rows without values."""
    from lumenfew.operators.spectra import complete_channels, drop_incomplete

    df, axis = wide(spark.read.parquet(*paths))
    mask = complete_channels(df, "spectrum")
    return drop_incomplete(df, "spectrum"), [a for a, ok in zip(axis, mask, strict=True) if ok]


def with_ordinal(df: DataFrame, order: list[Column]) -> DataFrame:
    """``ordinal`` of rows in a stated order that tells them apart, for positional joins."""
    return running(df.withColumn("__one", F.lit(1)), [], order, ["__one"]).withColumn("ordinal", F.col("before___one").cast("long")).drop("__one", "before___one", "total___one")


def volume_fractions(df: DataFrame, parts: list[str], whole: str) -> DataFrame:
    return df.select("*", *[F.try_divide(F.col(f"`{p}`"), F.col(f"`{whole}`")).alias(f"{p.split(' ')[0].lower()}_fraction") for p in parts])


# -- JCAMP-DX ---------------------------------------------------------------------------


def parse_jcamp(content: str) -> dict | None:
    """Title, x and y of a JCAMP-DX text; None where fields or points are missing or too far from the stated number.

    Lines of a table have their abscissa first; a table marked ``(X++(Y..Y))`` has all
    ordinates of the line after it, others one. The abscissa runs evenly between the ends.
    """
    fields, rows, inside = {}, [], False
    for line in content.splitlines():
        if line.startswith("##"):
            key, _, value = line[2:].partition("=")
            key = key.strip().upper()
            fields[key] = value.strip()
            inside = key in ("XYDATA", "XYPOINTS") and not rows
        elif inside and line.startswith("$$"):
            inside = False
        elif inside:
            rows.append(line.split())
    if not {"XYDATA", "XYPOINTS"} & fields.keys():
        return None
    try:
        first, last, expected = float(fields["FIRSTX"]), float(fields["LASTX"]), int(float(fields["NPOINTS"]))
        fx, fy = float(fields.get("XFACTOR", 1)), float(fields.get("YFACTOR", 1))
    except (KeyError, ValueError):
        return None
    many, y = "X++" in fields.get("XYDATA", ""), []
    for row in rows:
        try:
            numbers = [float(v) for v in row]
        except ValueError:
            continue
        if len(numbers) > 1:
            y += numbers[1:] if many or len(numbers) > 2 else numbers[1:2]
    if abs(len(y) - expected) > max(2, 0.02 * expected):
        return None
    return {"title": fields.get("TITLE", ""), "x": np.linspace(first * fx, last * fx, len(y)).tolist(), "y": [v * fy for v in y]}


def jcamp(spark: SparkSession, path: str) -> DataFrame:
    """``path, title, x, y`` of files; what can't be read gives no row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(p, parse_jcamp(v)) for p, v in zip(b.path, b.value, strict=True)]
            yield pd.DataFrame([(p, m["title"], m["x"], m["y"]) for p, m in made if m], columns=["path", "title", "x", "y"])

    return files.mapInPandas(run, "path string, title string, x array<double>, y array<double>")


def pure_library(measured: DataFrame, classes: DataFrame, points: int = 100, rows: int = 3) -> DataFrame:
    """``name, y``: measured spectra with ``points`` finite values or more, and means of classes with ``rows`` rows or more."""
    from lumenfew.operators.spectra import class_means

    finite = measured.where((F.size("y") >= points) & F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    means = class_means(classes, "spectrum", ["label"], rows)
    return finite.select(F.col("title").alias("name"), A.doubles("y").alias("y")).unionByName(means.select(F.concat(F.lit("class-"), F.col("label").cast("string")).alias("name"), F.col("spectrum").alias("y")))


# -- result tables and peaks ------------------------------------------------------------


def results(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result files with their arm from the file name; the schema is stated, not guessed."""
    generation, representation, task = T.arm_of(F.input_file_name())
    return spark.read.csv(glob, header=True, schema=schema).select("*", generation.alias("file_family"), representation.alias("file_arm"), task.alias("file_task"))


def peaks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="compound string, wavenumber int, intensity int")


# -- numpy archives ---------------------------------------------------------------------


def archive(spark: SparkSession, path: str, array: str | None = None, columns: int | None = None, axis: str | None = None) -> DataFrame:
    """``path, ordinal, spectrum, wavelengths, fields``: the rows of a 2-D array of each archive.

    ``array`` names it (else the first of two dimensions); ``columns`` is the width of a flat,
    column-major one; ``axis`` names the array of its channels' places. Arrays with an entry a
    row come as JSON in ``fields``. Archives are read through Spark, one a task; arrays of
    Python objects are left out.
    """

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            own = {}
            for k in held.files:
                with contextlib.suppress(ValueError):
                    own[k] = held[k]
        matrix = own.pop(array or next(k for k, v in own.items() if v.ndim == 2))
        if columns is not None and (matrix.ndim == 1 or matrix.shape[1] != columns):
            matrix = matrix.reshape(-1, columns, order="F")
        places = own[axis].astype(float).tolist() if axis else None
        beside = {k: v for k, v in own.items() if v.ndim == 1 and len(v) == len(matrix)}
        for i, row in enumerate(matrix):
            yield name, i, row.astype(float).tolist(), places, json.dumps({k: v[i].item() for k, v in beside.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                yield pd.DataFrame(rows(name, content), columns=["path", "ordinal", "spectrum", "wavelengths", "fields"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, ordinal long, spectrum array<double>, wavelengths array<double>, fields string")


def step_axis(first: float, step: float, n: int) -> Column:
    """An axis of ``n`` points."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(first)) + i * F.lit(float(step)))


# -- curves from pictures ---------------------------------------------------------------


def merged_ticks(df: DataFrame, position: str, by: list[str], gap: int = 3) -> DataFrame:
    """Positions within ``gap`` of their neighbour are one tick, at their mean."""
    order = Window.partitionBy(*by).orderBy(position)
    far = F.col(position) - F.lag(position).over(order)
    island = F.sum(F.when(far <= gap, 0).otherwise(1)).over(order)
    return df.withColumn("tick", island).groupBy(*by, "tick").agg(F.avg(position).alias("at"), F.count("*").alias("n"))


def top_pixels(pixels: DataFrame, dark: int = 128, by: tuple[str, ...] = ()) -> DataFrame:
    """The topmost dark pixel of each column of (row, col, val)."""
    return pixels.where(F.col("val") < dark).groupBy(*by, "col").agg(F.min("row").alias("row"))


def calibrated(curve: DataFrame, x0: float, per_x: float, top: float, bottom: float) -> DataFrame:
    """Pixels to (x, percent): linear in both, clipped to 0 and 100."""
    y = F.lit(100.0) * (F.lit(bottom) - F.col("row")) / F.lit(bottom - top)
    return curve.select("*", (F.lit(x0) + F.col("col") * F.lit(per_x)).alias("x"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), y)).alias("percent"))


# -- tasks ------------------------------------------------------------------------------

POINTS = 512


def ordered_csv(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, fields``: each line of a small CSV with a header as a map of its columns."""
    rows = ragged(spark, path)
    head = F.broadcast(rows.where("ordinal = 0").select(F.transform("fields", T.clean_id).alias("names")))
    cells = F.slice(F.concat(F.col("fields"), F.array_repeat(F.lit(""), F.size("names"))), F.lit(1), F.size("names"))
    return rows.where("ordinal > 0").crossJoin(head).select((F.col("ordinal") - 1).alias("ordinal"), F.map_from_arrays("names", F.transform(cells, T.clean_id)).alias("fields"))


def _loaded(df: DataFrame, id_: Column, targets: dict[str, Column], wavelengths: Column | None = None, group: Column | None = None, label: Column | None = None) -> DataFrame:
    """The one form of all loaders."""
    none = F.lit(None)
    named = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), v.cast("double"))]) if targets else F.create_map().cast("map<string,double>")
    return df.select(
        F.col("ordinal").cast("long").alias("ordinal"), id_.cast("string").alias("sample_id"), (none if group is None else group).cast("string").alias("group_id"), (none if label is None else label).cast("string").alias("label"),
        (none if wavelengths is None else wavelengths).cast("array<double>").alias("wavelengths"), A.doubles("spectrum").alias("spectrum"), named.alias("targets"),
    )


def _field(name: str) -> Column:
    return F.get_json_object("fields", f"$.{name}")


# Files below the data root, names of their fields, and axes.


def load_diesel(spark: SparkSession, root: str) -> DataFrame:
    found = diesel(spark, f"{root}/diesel/spectra.csv", f"{root}/diesel/properties.csv")
    return found.select("ordinal", "sample_id", F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("label"), "wavelengths", "spectrum", "targets")


def load_gasoline(spark: SparkSession, root: str) -> DataFrame:
    """Octane of gasolines; the matrix is flat and column-major."""
    df = archive(spark, f"{root}/processed/gasoline_arrays.npz", "arr_1", 401)
    return _loaded(df, F.concat(F.lit("gas"), (F.col("ordinal") + 1).cast("string")), {"octane": _field("arr_0")}, step_axis(900, 2, 401))


def load_mayonnaise(spark: SparkSession, root: str) -> DataFrame:
    """Spectra with a class and no target."""
    df = archive(spark, f"{root}/processed/mayonnaise_arrays.npz", "arr_0")
    axis = F.transform(F.sequence(F.lit(0), F.size("spectrum") - 1), lambda i: (F.lit(1100) + 4 * i).cast("double"))
    return _loaded(df, F.concat(F.lit("mayo"), (F.col("ordinal") + 1).cast("string")), {}, axis, label=_field("arr_1"))


CORN_TARGETS = ("moisture", "oil", "protein", "starch")


def there(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds a file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def load_corn(spark: SparkSession, root: str, instrument: str = "m5") -> DataFrame:
    """Four targets on one of three instruments, from the MATLAB file (structs with ``data`` and ``axisscale``).

    Where only ``corn/corn.csv`` is there, from that table: ``instrument``, the targets, and columns named by wavelength (or by number).
    """
    if not there(spark, f"{root}/Corn_Cargill/corn.mat"):
        df, axis = wide(spark.read.option("header", True).csv(f"{root}/corn/corn.csv").where(F.col("instrument") == instrument))
        places = axis if axis[0] >= 100 else [1100 + 2 * i for i in range(len(axis))]
        return _loaded(df, F.col("ordinal"), {t: T.number(F.col(t)) for t in CORN_TARGETS}, F.array(*[F.lit(float(w)) for w in places]))
    rows = formats.matlab(spark, f"{root}/Corn_Cargill/corn.mat")
    made = rows.where(F.col("name") == "propvals").select("ordinal", F.col("spectrum").alias("values"))
    df = rows.where(F.col("name") == f"{instrument}spec").join(made, "ordinal", "left")
    numbered = F.transform(F.sequence(F.lit(0), F.size("spectrum") - 1), lambda i: (F.lit(1100) + 2 * i).cast("double"))
    axis = F.when(F.get("wavelengths", 0) < 100, numbered).otherwise(F.col("wavelengths"))
    return _loaded(df, F.concat(F.lit("corn"), (F.col("ordinal") + 1).cast("string")), {t: F.get("values", i) for i, t in enumerate(CORN_TARGETS)}, axis)


def load_evoo(spark: SparkSession, root: str) -> DataFrame:
    """Adulteration of olive oils, a row a spectrum, samples as groups, from the sheet; or from the CSV beside it where the sheet is not there."""
    base = f"{root}/EVOO_NIR_HSI/data/Raw_A"
    if not there(spark, f"{base}.xlsx"):
        df, axis = wide(spark.read.option("header", True).csv(f"{base}.csv"))
        return _loaded(df, F.col("sample_id"), {"adulteration_level": T.number(F.col("adulteration_level"))}, F.array(*[F.lit(w) for w in axis]), F.col("sample_id"), F.col("class_1"))
    rows = formats.sheet_table(spark, f"{base}.xlsx")
    cell = lambda name: F.element_at("fields", name)
    channels = F.filter("names", lambda n: F.regexp_replace(n, r"\.", "").rlike("^[0-9]+$"))
    # the row's map is made once, not once a channel
    spectrum = A.bound(F.col("fields"), lambda own: F.transform("channels", lambda n: F.element_at(own, n).try_cast("double")))
    df = rows.select("ordinal", "fields", channels.alias("channels")).withColumn("spectrum", spectrum)
    return _loaded(df, cell("sample_id"), {"adulteration_level": T.number(cell("adulteration_level"))}, F.transform("channels", lambda n: n.cast("double")), cell("sample_id"), cell("class_1"))


def load_pentane(spark: SparkSession, root: str) -> DataFrame:
    """Volume fractions; bottles are groups."""
    df = archive(spark, f"{root}/in-house-pentane-ccl4/pentane_ccl4_FTIR.npz", "X", axis="wavelength_nm")
    return _loaded(df, _field("name"), {"phi_pentane": _field("y")}, F.col("wavelengths"), _field("sample_id"))


def load_edible_oil(spark: SparkSession, root: str) -> DataFrame:
    df = edible_oil(spark, f"{root}/edible_oil/nir.csv")
    return _loaded(df, F.col("group_id"), {"peroxide_value": F.element_at("targets", "peroxide")}, F.col("wavelengths"), F.col("group_id"), F.col("label"))


def load_sugar_raman(spark: SparkSession, root: str, snr: str = "High SNR") -> DataFrame:
    """Four sugars' volume fractions; wells are groups. The pickled matrix is converted to an archive; it meets its metadata by position."""
    base = f"{root}/sugar_raman/{snr}"
    meta = ordered_csv(spark, f"{base}/metadata.csv").select(F.col("ordinal").alias("o"), F.col("fields").alias("meta"))
    df = archive(spark, f"{base}/data.npz").join(meta, F.col("ordinal") == F.col("o"))
    cell = lambda name: T.number(F.element_at("meta", name))
    return _loaded(df, F.element_at("meta", "samp"), {s: F.try_divide(cell(f"{s} [ul]"), cell("Total Volume [ul]")) for s in ("Sucrose", "Fructose", "Maltose", "Glucose")}, group=F.element_at("meta", "samp"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"diesel": load_diesel, "corn": load_corn, "gasoline": load_gasoline, "mayonnaise": load_mayonnaise, "evoo": load_evoo, "edible_oil": load_edible_oil, "pentane_ccl4": load_pentane, "sugar_raman": load_sugar_raman}

# The measured blocks of the corpus in their order, the library's size, the number of simulated rows.
CORPUS_BLOCKS: dict[str, tuple[str, dict]] = {
    "swri-diesel": ("diesel", {}),
    "kalivas-gasoline": ("gasoline", {}),
    "cargill-corn-m5": ("corn", {"instrument": "m5"}),
    "cargill-corn-mp5": ("corn", {"instrument": "mp5"}),
    "cargill-corn-mp6": ("corn", {"instrument": "mp6"}),
    "evoo-nir-hsi": ("evoo", {}),
    "mayonnaise": ("mayonnaise", {}),
    "nist-ir": ("infrared", {}),
}
LIBRARY_SIZE, SIMULATED = 111, 3000


def infrared(spark: SparkSession, root: str) -> DataFrame:
    """The infrared collection, JCAMP-DX files in order of their names."""
    found = jcamp(spark, f"{root}/NIST_IR/*.jdx")
    return with_ordinal(found, [F.col("path")]).select("ordinal", "title", F.col("y").alias("spectrum"))


def corpus_library(spark: SparkSession, root: str, expected: int = LIBRARY_SIZE) -> DataFrame:
    """``name, y``: the pure spectra that mixtures are made of, on ``POINTS`` channels; an error unless there are ``expected``."""
    measured = infrared(spark, root).select("title", F.col("spectrum").alias("y"))
    classes = [LOADERS[d](spark, root).where("label is not null").select(F.concat(F.lit(f"{short}_"), "label").alias("label"), A.resample(A.doubles("spectrum"), POINTS).alias("spectrum")) for d, short in (("evoo", "evoo"), ("mayonnaise", "mayo"))]
    library = pure_library(measured, classes[0].unionByName(classes[1])).select("name", A.resample(F.col("y"), POINTS).alias("y"))
    if (n := library.count()) != expected:
        raise ValueError(f"the library has {n} members instead of {expected}: is every dataset there?")
    return library


def assembled_corpus(spark: SparkSession, root: str, expected: int = LIBRARY_SIZE, simulated: int = SIMULATED, seed: int = 42) -> DataFrame:
    """``source, block, ordinal, spectrum``: the eight measured blocks in their order, then mixtures of the library."""
    from lumenfew.operators import simulate

    blocks = {name: (infrared(spark, root) if dataset == "infrared" else LOADERS[dataset](spark, root, **options)) for name, (dataset, options) in CORPUS_BLOCKS.items()}
    # of a checked size
    library = np.array([r.y for r in corpus_library(spark, root, expected).orderBy("name").collect()])
    mixed = simulate.mixtures(spark, library, simulated, seed=seed).select(F.col("idx").alias("ordinal"), "spectrum")
    return simulate.corpus(blocks, mixed)


# Tasks, their dataset and property.
TASKS = {
    "diesel-bp50": ("diesel", "BP50"),
    "diesel-cetane-number": ("diesel", "CN"),
    "diesel-density": ("diesel", "D4052"),
    "diesel-flash-point": ("diesel", "FLASH"),
    "diesel-freezing-point": ("diesel", "FREEZE"),
    "diesel-total-aromatics": ("diesel", "TOTAL"),
    "diesel-viscosity": ("diesel", "VISC"),
    "corn-moisture": ("corn", "moisture"),
    "corn-oil": ("corn", "oil"),
    "corn-protein": ("corn", "protein"),
    "corn-starch": ("corn", "starch"),
    "gasoline-octane": ("gasoline", "octane"),
    "olive-oil-adulteration": ("evoo", "adulteration_level"),
    "edible-oil-peroxide-value": ("edible_oil", "peroxide_value"),
    "pentane-ccl4-volume-fraction": ("pentane_ccl4", "phi_pentane"),
}
#: Tasks outside the main benchmark: the negative control, and the one whose spectra stay raw.
CONTROL, RAW = "edible-oil-peroxide-value", "pentane-ccl4-volume-fraction"


def task_table(spark: SparkSession) -> DataFrame:
    """``task, dataset, property, is_benchmark, uses_snv``: a small table to look tasks up in."""
    rows = [(t, d, p, t not in (CONTROL, RAW), t != RAW) for t, (d, p) in TASKS.items()]
    return spark.createDataFrame(rows, "task string, dataset string, property string, is_benchmark boolean, uses_snv boolean")


def task_pool(tasks: DataFrame, benchmark: bool = False, without: tuple[str, ...] = ()) -> DataFrame:
    """The benchmark's tasks, or all but the named ones."""
    kept = tasks.where("is_benchmark") if benchmark else tasks
    return kept.where(~F.col("task").isin(*without)) if without else kept


def named_task(spark: SparkSession, root: str, task: str) -> DataFrame:
    """A task's rows by its name: its dataset's loader, its property, its normalisation."""
    if task not in TASKS:
        raise KeyError(f"no task is called {task} (have {', '.join(TASKS)})")
    dataset, target = TASKS[task]
    return load_task(LOADERS[dataset](spark, root), task, target, task != RAW)


def load_task(data: DataFrame, task: str, target: str, uses_snv: bool = True, points: int = POINTS) -> DataFrame:
    """``task, idx, group_id, x, y``: rows with a target, on ``points`` channels, normalised unless the task is raw.

    ``data`` has ``ordinal``, ``spectrum``, ``targets`` and perhaps ``group_id``.
    """
    y = F.element_at("targets", target)
    x = A.resample(A.doubles("spectrum"), points)
    group = F.col("group_id") if "group_id" in data.columns else F.lit(None).cast("string")
    rows = data.where(y.isNotNull() & ~F.isnan(y))
    return rows.select(F.lit(task).alias("task"), F.col("ordinal").cast("long").alias("idx"), group.alias("group_id"), (A.snv(x) if uses_snv else x).cast("array<float>").alias("x"), y.alias("y"))


def usable_targets(df: DataFrame, least: int = 30) -> DataFrame:
    """Targets of a map column with ``least`` values or more."""
    each = df.select(F.explode("targets").alias("target", "v")).where("v is not null and not isnan(v)")
    return each.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") >= least)
