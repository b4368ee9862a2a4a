"""Files in the instruments' own formats: written here byte by byte, read back by Spark."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfew.operators import simulate
from lumenfew.sources import formats, readers

RNG = np.random.default_rng(31)

# -- a small writer of MATLAB files -----------------------------------------------------


def element(kind, data, small=True):
    if small and len(data) <= 4:
        return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0")
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, value, kind=None):
    """An array (6: doubles), a list (cells), a dict (struct) or text as a matrix element."""
    if isinstance(value, dict):
        width = 32
        fields = element(5, struct.pack("<i", width)) + element(1, b"".join(k.encode().ljust(width, b"\0") for k in value))
        body, code, shape = fields + b"".join(matrix("", v) for v in value.values()), 2, (1, 1)
    elif isinstance(value, list):
        body, code, shape = b"".join(matrix("", v) for v in value), 1, (1, len(value))
    elif isinstance(value, str):
        body, code, shape = element(4, value.encode("utf-16-le")), 4, (1, len(value))
    else:
        value = np.asarray(value)
        stored = {"i1": 1, "u2": 4, "f4": 7, "f8": 9}[kind or "f8"]
        body, code, shape = element(stored, value.astype(kind or "f8").tobytes(order="F")), 6, value.shape
    head = element(6, struct.pack("<II", code, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
    return element(14, head + body, small=False)


def matlab_file(variables, compressed=False):
    out = b"made by a test".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    for name, value in variables.items():
        own = matrix(name, *value) if isinstance(value, tuple) else matrix(name, value)
        packed = zlib.compress(own)
        out += struct.pack("<II", 15, len(packed)) + packed if compressed else own
    return out


@pytest.mark.parametrize("compressed", [False, True])
def test_matlab_arrays(compressed):
    a, b = RNG.normal(size=(5, 7)), np.arange(12).reshape(3, 4)
    got = formats.matlab_arrays(matlab_file({"a": a, "small": (b, "i1"), "one": (np.array([[7]]), "u2"), "text": "abc", "nested": {"data": a[:2], "cells": [a[:1], "x", {"y": b[:1]}]}}, compressed))
    assert np.array_equal(got["a"], a) and np.array_equal(got["small"], b) and got["one"] == 7 and got["text"] == "abc"
    assert np.array_equal(got["nested"]["data"], a[:2]) and got["nested"]["cells"][1] == "x" and np.array_equal(got["nested"]["cells"][2]["y"], b[:1])
    with pytest.raises(ValueError):
        formats.matlab_arrays(b"no such file" * 20)


def corn_file(folder, n=6, wide=9):
    (folder / "Corn_Cargill").mkdir(parents=True)
    spectra = {i: RNG.normal(size=(n, wide)) for i in ("m5", "mp5", "mp6")}
    targets = RNG.normal(size=(n, 4))
    axis = 1100 + 2.0 * np.arange(wide)
    variables = {
        "m5spec": {"name": "m5", "data": spectra["m5"], "axisscale": [[np.zeros((0, 0)), axis[None]], "label"]},
        "mp5spec": {"data": spectra["mp5"], "axisscale": [np.arange(4.0)[None], np.arange(float(wide))[None]]},  # an axis of numbers
        "mp6spec": {"data": spectra["mp6"], "axisscale": [np.zeros((0, 0))]},  # no axis that fits
        "propvals": {"data": targets},
    }
    (folder / "Corn_Cargill/corn.mat").write_bytes(matlab_file(variables, True))
    return spectra, targets, axis


def test_corn_from_its_matlab_file(spark, tmp_path):
    spectra, targets, axis = corn_file(tmp_path)
    for name, x in spectra.items():
        got = readers.load_corn(spark, str(tmp_path), name).orderBy("ordinal").collect()
        assert [r.sample_id for r in got] == [f"corn{i + 1}" for i in range(6)]
        assert np.allclose([r.spectrum for r in got], x) and all(np.allclose(r.wavelengths, axis) for r in got)
        assert np.allclose([[r.targets[t] for t in readers.CORN_TARGETS] for r in got], targets)
    assert readers.named_task(spark, str(tmp_path), "corn-oil").count() == 6


def test_matlab_data_source(spark, tmp_path):
    spectra, _, _ = corn_file(tmp_path)
    (tmp_path / "Corn_Cargill/two.mat").write_bytes(matlab_file({"a": np.eye(3)}))
    spark.dataSource.register(formats.MatlabSource)
    df = spark.read.format("matlab").load(f"{tmp_path}/Corn_Cargill")
    assert df.rdd.getNumPartitions() == 2
    rows = df.collect()
    assert sorted((r.name, r.ordinal) for r in rows if r.path.endswith("two.mat")) == [("a", i) for i in range(3)]
    own = sorted((r for r in rows if r.name == "m5spec"), key=lambda r: r.ordinal)
    assert np.allclose([r.spectrum for r in own], spectra["m5"])
    plain = {(r.name, r.ordinal): r.spectrum for r in formats.matlab(spark, f"{tmp_path}/Corn_Cargill/corn.mat").collect()}
    assert plain == {(r.name, r.ordinal): r.spectrum for r in rows if r.path.endswith("corn.mat")}


# -- sheets -----------------------------------------------------------------------------


def letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, rows):
    """Numbers as values, text as shared or inline strings, None as no cell."""
    strings, lines = [], []
    for r, row in enumerate(rows):
        cells = []
        for c, v in enumerate(row):
            ref = f"{letters(c)}{r + 1}"
            if isinstance(v, str) and c % 2:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                if v not in strings:
                    strings.append(v)
                cells.append(f'<c r="{ref}" s="1" t="s"><v>{strings.index(v)}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{ref}"><v>{v!r}</v></c>')
        lines.append(f'<row r="{r + 1}" spans="1:3">{"".join(cells)}</row>')
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rich = [f"<si><r><t>{s[:2]}</t></r><r><rPr><b/></rPr><t>{s[2:]}</t></r></si>" if i % 3 == 2 else f'<si><t xml:space="preserve">{s}</t></si>' for i, s in enumerate(strings)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"{head}<workbook {space}/>")
        z.writestr("xl/worksheets/sheet1.xml", f"{head}<worksheet {space}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"{head}<sst {space}>{''.join(rich)}</sst>")


def oils(n=7, wide=30):
    names = ["sample_id", "class_1", "adulteration_level", *[f"{900 + 3.5 * i:g}" for i in range(wide)], "note"]
    body = [[f"sample {i // 2}", ["pure", "mixed oil", "other &amp; more"][i % 3], i * 5 if i != 3 else None, *np.round(RNG.normal(size=wide), 6).tolist(), "last" if i % 2 else None] for i in range(n)]
    return names, body


def test_sheet_equals_its_csv(spark, tmp_path):
    names, body = oils()
    for kind in ("sheet", "csv"):
        (tmp_path / f"{kind}/EVOO_NIR_HSI/data").mkdir(parents=True)
    workbook(tmp_path / "sheet/EVOO_NIR_HSI/data/Raw_A.xlsx", [names, *body])
    lines = [",".join("" if v is None else str(v).replace("&amp;", "&") for v in row) for row in [["ordinal", *names], *[[i, *row] for i, row in enumerate(body)]]]
    (tmp_path / "csv/EVOO_NIR_HSI/data/Raw_A.csv").write_text("\n".join(lines))
    one, two = (sorted(readers.load_evoo(spark, f"{tmp_path}/{k}").collect(), key=lambda r: r.ordinal) for k in ("sheet", "csv"))
    assert len(one) == len(body) and one == two and len(one[0].spectrum) == 30
    assert [r.label for r in one[:3]] == ["pure", "mixed oil", "other & more"] and one[3].targets["adulteration_level"] is None


def test_cells_keep_their_columns(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["x", None, "z"] + [None] * 30 + [5.5], [], [None, "b", 2.0]])
    got = {r.ordinal: [(c.column, c.text) for c in r.cells] for r in formats.sheet(spark, f"{tmp_path}/a.xlsx").collect()}
    assert got == {0: [(0, "x"), (2, "z"), (33, "5.5")], 2: [(1, "b"), (2, "2.0")]}


# -- lines in their order ---------------------------------------------------------------


def test_lines_are_numbered_over_many_splits(spark, tmp_path):
    text = {"a.csv": [f"{i},{'x' * (i % 17)}" if i % 11 else "" for i in range(3000)], "b.csv": ["only", "two"], "c.csv": []}
    for name, lines in text.items():
        (tmp_path / name).write_text("\n".join(lines))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        df = formats.numbered_lines(spark, str(tmp_path))
        assert df.select("value").rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in text.items():
        own = sorted((r.ordinal, r.value) for r in rows if r.path.endswith(name))
        assert own == list(enumerate(lines))


# -- pictures ---------------------------------------------------------------------------


def picture(path, pixels):
    """An RGB image as PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def plot(curve, spacing=60, left=40, right=640, top=30, bottom=330):
    pixels = np.full((380, 700, 3), 255, np.uint8)
    pixels[[top, bottom], left : right + 1] = 0
    pixels[top : bottom + 1, [left, right]] = 0
    for x in range(left, right + 1, spacing):
        pixels[bottom + 1 : bottom + 8, x : x + 2] = (20, 40, 10)  # smeared over two columns
    for x in range(left + 3, right - 2):
        y = int(round(bottom - (bottom - top) * curve(x) / 100))
        pixels[y : y + 3, x] = (0, 0, 120)
    pixels[10:20, 300:330] = 0  # a label
    return pixels


def test_a_drawn_curve_comes_back_within_a_pixel(spark, tmp_path):
    curves = {"one.png": lambda x: 50 + 40 * np.sin(x / 70), "two.png": lambda x: 10 + (x - 40) / 8}
    for name, curve in curves.items():
        picture(tmp_path / name, plot(curve))
    picture(tmp_path / "none.png", np.full((50, 60, 3), 255, np.uint8))
    pixels = formats.dark_pixels(spark, str(tmp_path))
    framed = formats.frames(pixels)
    assert {tuple(r)[1:] for r in framed.collect()} == {(40, 640, 30, 330)}
    assert {r.spacing for r in formats.tick_spacing(pixels, framed).collect()} == {60.0}
    rows = formats.digitised(spark, str(tmp_path)).collect()
    for name, curve in curves.items():
        own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: -r.x)
        assert len(own) == 595
        for r in own:
            col = 40 + (4000 - r.x) * 60 / 1000
            assert abs(col - round(col)) < 1e-6 and abs(r.percent - curve(round(col))) <= 100 / 300
    assert not [r for r in rows if r.path.endswith("none.png")]


# -- the corpus -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def data_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "diesel").mkdir()
    axis = ",".join(str(750 + 2 * i) for i in range(8))
    body = "\n".join(f',d{i},{",".join(f"{v:.6f}" for v in RNG.normal(size=8))}' for i in range(4))
    (root / "diesel/spectra.csv").write_text(f"Axisscale,,{axis}\n{body}\n")
    (root / "diesel/properties.csv").write_text("Label,,BP50,CN\n" + "\n".join(f",d{i},{i},{2 * i}" for i in range(4)))
    (root / "processed").mkdir()
    np.savez(root / "processed/gasoline_arrays.npz", arr_0=np.arange(5.0), arr_1=RNG.normal(size=(5, 401)))
    np.savez(root / "processed/mayonnaise_arrays.npz", arr_0=RNG.normal(size=(8, 20)), arr_1=np.array(["1", "2"] * 4))
    corn_file(root)
    (root / "EVOO_NIR_HSI/data").mkdir(parents=True)
    names, body = oils(9)
    workbook(root / "EVOO_NIR_HSI/data/Raw_A.xlsx", [names, *body])
    (root / "NIST_IR").mkdir()
    for i in range(106):
        y = RNG.uniform(1, 2, 120)
        (root / f"NIST_IR/s{i:03d}.jdx").write_text(f"##TITLE=substance {i:03d}\n##FIRSTX=0\n##LASTX=119\n##NPOINTS=120\n##XYDATA=(X++(Y..Y))\n" + "\n".join(f"{j} " + " ".join(f"{v:.5f}" for v in y[j : j + 10]) for j in range(0, 120, 10)) + "\n##END=\n")
    return str(root)


def test_corpus_is_assembled_from_the_loaders(spark, data_root):
    got = readers.assembled_corpus(spark, data_root, simulated=30)
    counts = {r.block: (r.source, r.n, r.low, r.high, r.channels) for r in got.groupBy("block", "source").agg(F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.min(F.size("spectrum")).alias("channels")).collect()}
    names = [*readers.CORPUS_BLOCKS, "simulated"]
    assert [counts[i][0] for i in range(9)] == names and {c[-1] for c in counts.values()} == {512}
    assert [counts[i][1] for i in range(9)] == [4, 5, 6, 6, 6, 9, 8, 106, 30]
    rows = {r.ordinal: r.spectrum for r in got.where("source = 'cargill-corn-mp6'").collect()}
    want = {r.ordinal: r.spectrum for r in readers.load_corn(spark, data_root, "mp6").collect()}
    for i, x in want.items():
        assert np.allclose(rows[i], np.interp(np.linspace(0, 1, 512), np.linspace(0, 1, len(x)), x), atol=1e-5)
    assert list(readers.infrared(spark, data_root).orderBy("ordinal").toPandas().title) == [f"substance {i:03d}" for i in range(106)]


def test_library_must_be_whole(spark, data_root):
    library = readers.corpus_library(spark, data_root)
    assert library.count() == readers.LIBRARY_SIZE and {r.n for r in library.select(F.size("y").alias("n")).distinct().collect()} == {512}
    with pytest.raises(ValueError, match="instead of 112"):
        readers.corpus_library(spark, data_root, 112)
    assert simulate.checked_size(library, 111, "library") is library
