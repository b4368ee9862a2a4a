"""The instruments' own formats: MATLAB files, sheets, pictures; and row numbers in file order.

Files come through Spark's readers (any store Spark can read). What a format packs is taken apart in
the tasks that read the files, a task a file; all that follows is relational.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenfew.functions import arrays as A
from lumenfew.operators.ordered import quantiles

# -- row numbers ------------------------------------------------------------------------


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, ordinal, value``: the lines of each text file with their place in it, blank ones counted.

    Files are read in splits. A line's place in its split follows from Spark's increasing ids; the splits'
    line counts, one row a split, run on over each file. No window, task or row holds a file.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__id"))
    own = ["path", "__block"]
    splits = lines.groupBy(*own).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select(*own, "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return lines.join(splits, own).select("path", (F.col("__before") + F.col("__id") - F.col("__first")).alias("ordinal"), "value")


# -- MATLAB files, version 5 ------------------------------------------------------------

# The format's data types, and the classes of arrays.
_KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
_MATRIX, _COMPRESSED = 14, 15
_CELL, _STRUCT, _OBJECT, _CHAR = 1, 2, 3, 4


def elements(content: bytes, order: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the elements that stand one after another; compressed ones are unpacked."""
    while at + 8 <= len(content):
        kind, size = struct.unpack_from(f"{order}II", content, at)
        if kind >> 16:  # up to four bytes stand beside their tag
            kind, size = kind & 0xFFFF, kind >> 16
            yield kind, content[at + 4 : at + 4 + size]
            at += 8
            continue
        data = content[at + 8 : at + 8 + size]
        if kind == _COMPRESSED:
            yield from elements(zlib.decompress(data), order)
            at += 8 + size
        else:
            yield kind, data
            at += 8 + size + -size % 8


def numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, np.dtype(_KINDS[kind]).newbyteorder(order))


def array_of(data: bytes, order: str) -> tuple[str, object]:
    """Name and value of a matrix element: arrays, lists of cells, dicts of fields (a list of them if there are several), text."""
    parts = list(elements(data, order))
    if not parts:
        return "", np.zeros((0, 0))
    kind = int(numbers(*parts[0], order)[0]) & 0xFF
    shape = numbers(*parts[1], order).astype(int).tolist()
    name = bytes(parts[2][1]).decode("latin-1")
    n = int(np.prod(shape))
    if kind == _CELL:
        return name, [array_of(d, order)[1] for _, d in parts[3 : 3 + n]]
    if kind in (_STRUCT, _OBJECT):
        rest = parts[4:] if kind == _OBJECT else parts[3:]  # an object names its class first
        width = int(numbers(*rest[0], order)[0])
        labels = [rest[1][1][i : i + width].split(b"\0")[0].decode("latin-1") for i in range(0, len(rest[1][1]), width)]
        values = [array_of(d, order)[1] for _, d in rest[2:]]
        made = [dict(zip(labels, values[i : i + len(labels)], strict=False)) for i in range(0, len(values), max(len(labels), 1))]
        return name, made[0] if n == 1 and made else made
    if len(parts) < 4:
        return name, np.zeros(shape)
    flat = numbers(*parts[3], order)
    return name, "".join(map(chr, flat)) if kind == _CHAR else flat.reshape(shape, order="F")


def matlab_arrays(content: bytes) -> dict[str, object]:
    """The variables of a version-5 file by name."""
    if len(content) < 128:
        raise ValueError("not a MATLAB file of version 5")
    order = {b"IM": "<", b"MI": ">"}.get(content[126:128])
    if order is None:
        raise ValueError("not a MATLAB file of version 5")
    return dict(array_of(data, order) for kind, data in elements(content, order, 128) if kind == _MATRIX)


def axis_of(value: object, wide: int) -> list[float]:
    """The first of a struct's axes that has an entry a channel; else the channels' numbers."""
    todo = value if isinstance(value, list) else [value]
    for part in todo:
        if isinstance(part, list):
            found = axis_of(part, -1)
            if len(found) == wide:
                return found
        elif isinstance(part, np.ndarray) and part.size == (wide if wide >= 0 else part.size) and part.dtype.kind in "iuf":
            return part.ravel(order="F").astype(float).tolist()
    return [float(i) for i in range(max(wide, 0))]


def matlab_rows(path: str, content: bytes) -> Iterator[tuple]:
    """``path, name, ordinal, spectrum, wavelengths`` of each row of each matrix, and of the ``data`` of each struct with its ``axisscale``."""
    for name, value in matlab_arrays(content).items():
        axis = None
        if isinstance(value, dict) and isinstance(value.get("data"), np.ndarray):
            matrix = value["data"]
            axis = axis_of(value.get("axisscale", []), matrix.shape[1])
        else:
            matrix = value
        if isinstance(matrix, np.ndarray) and matrix.ndim == 2 and matrix.dtype.kind in "iuf":
            for i, row in enumerate(matrix.astype(float)):
                yield path, name, i, row.tolist(), axis


MATLAB = "path string, name string, ordinal long, spectrum array<double>, wavelengths array<double>"


def matlab(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the matrices of MATLAB files, through Spark's binary reader: any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(matlab_rows(name, content))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in MATLAB.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MATLAB)


class MatlabSource(DataSource):
    """``spark.read.format("matlab").load(path)`` for folders that all executors share; a partition a file.

    Register it with ``spark.dataSource.register(MatlabSource)``.
    """

    @classmethod
    def name(cls) -> str:
        return "matlab"

    def schema(self) -> str:
        return MATLAB

    def reader(self, schema) -> DataSourceReader:
        return MatlabReader(self.options["path"])


class MatlabFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MatlabReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[MatlabFile]:
        found = sorted(glob.glob(f"{self.path}/*.mat")) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(f"no MATLAB file at {self.path}")
        return [MatlabFile(p) for p in found]

    def read(self, partition: MatlabFile) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from matlab_rows(partition.path, f.read())


# -- sheets -----------------------------------------------------------------------------


def members(spark: SparkSession, path: str) -> DataFrame:
    """``path, member, value``: the text members of zip files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    own = [(name, m, held.read(m).decode("utf-8-sig")) for m in held.namelist() if m.endswith(".xml")]
                yield pd.DataFrame(own, columns=["path", "member", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, value string")


def column_number(reference: Column) -> Column:
    """The column of a cell's reference, from 0: letters count in base 26."""
    letters = F.regexp_extract(reference, "^([A-Z]+)", 1)
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1


_ROW = "struct<_r:bigint,c:array<struct<_r:string,_t:string,v:string,is:struct<t:string>>>>"
_TEXT = "struct<t:string,r:array<struct<t:string>>>"


def _pieces(value: str, tag: str) -> Column:
    """A member cut before each ``tag``; the pieces that begin with it, with their places."""
    return F.posexplode(F.filter(F.split(F.col(value), f"(?=<{tag}[ >/])"), lambda p: p.rlike(f"^<{tag}[ >/]")))


def _closed(tag: str) -> Column:
    """A piece up to the end of its element."""
    whole = F.regexp_extract("piece", f"(?s)^(<{tag}[ >].*</{tag}>)", 1)
    return F.when(whole != "", whole)


def sheet(spark: SparkSession, path: str, number: int = 1) -> DataFrame:
    """``path, ordinal, cells``: the rows of a workbook's sheet; ``cells`` are (column, text) in order of columns, empty ones left out.

    Rows are cut out of the sheet's member and read by Spark's XML functions; shared strings meet their cells by a join.
    """
    parts = members(spark, path)
    pieces = parts.where(F.col("member") == f"xl/worksheets/sheet{number}.xml").select("path", _pieces("value", "row").alias("place", "piece"))
    rows = pieces.select("path", "place", F.from_xml(_closed("row"), _ROW).alias("row")).where("row is not null")
    cells = rows.select("path", (F.coalesce("row._r", F.col("place") + 1) - 1).alias("ordinal"), F.posexplode("row.c").alias("nth", "c"))
    cells = cells.select("path", "ordinal", F.coalesce(column_number(F.col("c._r")), "nth").alias("column"), F.col("c._t").alias("kind"), F.coalesce("c.is.t", "c.v").alias("text"))
    texts = parts.where("member = 'xl/sharedStrings.xml'").select("path", _pieces("value", "si").alias("place", "piece"))
    text = F.from_xml(_closed("si"), _TEXT)
    shared = texts.select("path", F.col("place").alias("__place"), text.alias("t")).select("path", "__place", F.coalesce("t.t", F.array_join(F.transform("t.r", lambda r: r["t"]), "")).alias("__shared"))
    wanted = F.when(F.col("kind") == "s", F.col("text").try_cast("int"))
    named = cells.withColumn("__place", wanted).join(shared, ["path", "__place"], "left").withColumn("text", F.when(F.col("kind") == "s", F.coalesce("__shared", F.lit(""))).otherwise(F.col("text")))
    full = named.where("text is not null")
    # a sheet's width at most
    return full.groupBy("path", "ordinal").agg(F.array_sort(F.collect_list(F.struct("column", "text"))).alias("cells"))


def sheet_table(spark: SparkSession, path: str, number: int = 1) -> DataFrame:
    """``path, ordinal, fields``: a sheet whose first row names its columns, each row below as a map."""
    rows = sheet(spark, path, number)
    head = rows.groupBy("path").agg(F.min_by("cells", "ordinal").alias("head"), F.min("ordinal").alias("top"))
    # the map is made once a row, not once a cell
    entries = A.bound(F.map_from_entries("head"), lambda names: F.transform("cells", lambda c: F.struct(F.element_at(names, c["column"]).alias("k"), c["text"].alias("v"))))
    body = rows.join(head, "path").where("ordinal > top")
    return body.select("path", (F.col("ordinal") - F.col("top") - 1).alias("ordinal"), F.map_from_entries(F.filter(entries, lambda e: e["k"].isNotNull())).alias("fields"), F.transform("head", lambda c: c["text"]).alias("names"))


# -- curves from pictures ---------------------------------------------------------------

# What counts as dark, and where the left edge of the frame stands.
DARK, LEFT = 128, 4000.0


def dark_pixels(spark: SparkSession, path: str, dark: int = DARK) -> DataFrame:
    """``path, height, width, row, col`` of the pixels of pictures that are darker than ``dark``, from Spark's image source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, h, w, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.uint32)
                # luminance of blue, green, red in 16-bit fractions
                grey = pixels[..., 0] if n == 1 else (pixels[..., 0] * 7471 + pixels[..., 1] * 38470 + pixels[..., 2] * 19595 + 0x8000) >> 16
                row, col = np.nonzero(grey < dark)
                same = [pa.array([v] * len(row), t) for v, t in ((name, pa.string()), (h, pa.int32()), (w, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32))], names=["path", "height", "width", "row", "col"])

    image = spark.read.format("image").load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return image.mapInArrow(run, "path string, height int, width int, row int, col int")


def frames(pixels: DataFrame) -> DataFrame:
    """``path, left, right, top, bottom``: the outermost rows that are dark over half the width and columns over 0.4 of the height."""
    across = pixels.groupBy("path", "row").agg(F.count("*").alias("n"), F.first("width").alias("size")).where("n > 0.5 * size").groupBy("path").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.count("*").alias("__h"))
    down = pixels.groupBy("path", "col").agg(F.count("*").alias("n"), F.first("height").alias("size")).where("n > 0.4 * size").groupBy("path").agg(F.min("col").alias("left"), F.max("col").alias("right"), F.count("*").alias("__v"))
    return across.join(down, "path").where("__h >= 2 and __v >= 2").select("path", "left", "right", "top", "bottom")


def tick_spacing(pixels: DataFrame, framed: DataFrame) -> DataFrame:
    """``path, spacing``: the median distance, in pixels, of the ticks below the frame; pictures with fewer than three ticks give none."""
    below = pixels.join(framed, "path").where("row > bottom and row <= bottom + 7")
    columns = below.groupBy("path", "col").agg(F.count("*").alias("n"), F.first("left").alias("left")).where("n >= 3")
    order = Window.partitionBy("path").orderBy("col")  # a picture's columns at most
    far = F.col("col") - F.lag("col").over(order)
    smeared = columns.withColumn("tick", F.sum(F.when(far <= 3, 0).otherwise(1)).over(order)).groupBy("path", "tick").agg(F.max("col").alias("at"), F.first("left").alias("left"))
    ticks = smeared.where("at >= left - 2")
    apart = ticks.select("path", (F.col("at") - F.lag("at").over(Window.partitionBy("path").orderBy("at"))).alias("d")).where("d is not null")
    n = apart.groupBy("path").agg(F.count("*").alias("n")).where("n >= 2")
    return quantiles(apart.join(n, "path"), ["path"], "d", [0.5]).select("path", F.get("q", 0).alias("spacing"))


def digitised(spark: SparkSession, path: str, per_tick: float = 1000.0) -> DataFrame:
    """``path, x, percent``: the curve within the frame of each picture, its topmost dark pixel in each column.

    ``x`` falls from ``LEFT`` at the frame's left edge by ``per_tick`` a tick; the frame's height is 100 percent.
    Pictures without a frame or ticks give no row.
    """
    pixels = dark_pixels(spark, path)
    framed = frames(pixels)
    scale = framed.join(tick_spacing(pixels, framed), "path")
    inside = pixels.join(scale, "path").where("row >= top + 2 and row < bottom - 1 and col >= left + 2 and col < right - 1")
    top = inside.groupBy("path", "col", "left", "top", "bottom", "spacing").agg(F.min("row").alias("row"))
    percent = (F.col("bottom") - F.col("row")) / (F.col("bottom") - F.col("top")) * 100.0
    x = F.lit(LEFT) - (F.col("col") - F.col("left")) / (F.col("spacing") / F.lit(float(per_tick)))
    return top.select("path", x.alias("x"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)).alias("percent"))
