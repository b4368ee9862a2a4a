"""Array queries over the ``embeddings`` table, which stands for spectra of 64 channels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.functions import arrays as A
from lumenfew.operators import simulate, spectra, splits, trust
from lumenfew.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", A.doubles("embedding").alias("x"))


E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
SNV_SQL = "list_transform(x, lambda v: (v - list_avg(x)) / (list_stddev_pop(x) + 1e-8))"
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"


def code(family: str, k: int, rep: int, id_: str) -> str:
    return f"md5(concat_ws('-', '{family}', '{k}', '{rep}', CAST({id_} AS VARCHAR)))"


@query(
    E
    + f""", s AS (SELECT vec_id, label, {SNV_SQL} AS x FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY {code("eval", 40, 0, "vec_id")}, vec_id) AS rn FROM s),
long AS (SELECT vec_id, label, rn, i, x[i] AS v FROM r, range(1, 65) t(i)),
stats AS (SELECT k, i, avg(v) AS m, stddev_pop(v) AS sd FROM long, (VALUES (10), (20), (40)) ks(k) WHERE rn <= k GROUP BY k, i),
z AS (SELECT k, vec_id, label, rn, i, greatest(-5, least(5, (v - m) / (sd + 1e-8))) AS z FROM long JOIN stats USING (i)),
d AS (SELECT q.k, q.vec_id, q.label, s.label AS near, sum((q.z - s.z) * (q.z - s.z)) AS dist, s.vec_id AS sid
  FROM z q JOIN z s ON q.k = s.k AND q.i = s.i AND s.rn <= s.k WHERE q.rn > 40 GROUP BY ALL),
best AS (SELECT k, vec_id, label, arg_min(near, (dist, sid)) AS pred FROM d GROUP BY ALL)
SELECT CAST(k AS INT) AS support_size, count(*) AS n_query, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM best GROUP BY k"""
)
def nearest_support_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest of K standardised support spectra, K = 10, 20, 40; queries are the rows beyond the largest support."""
    df = rows(spark, sf).withColumn("x", A.snv(F.col("x")))
    top = splits.support(df, "vec_id", 40, 0).withColumn("__code", splits.code("eval", 40, 0, F.col("vec_id")))
    # 40 rows: one window over them numbers the support
    from pyspark.sql import Window

    ranked = top.withColumn("rn", F.row_number().over(Window.orderBy("__code", "vec_id"))).drop("__code")
    sizes = F.explode(F.array(F.lit(10), F.lit(20), F.lit(40)))
    each = ranked.withColumn("k", sizes).where("rn <= k")
    stats = spectra.channel_stats(each, "x", ["k"])
    z = A.standardised(F.col("x"), F.col("centre"), F.col("spread"))
    own = each.join(stats, "k").select("k", F.struct(F.col("vec_id").alias("id"), "label", z.alias("z")).alias("s"))
    support = own.groupBy("k").agg(F.collect_list("s").alias("support")).join(stats, "k")  # at most 40 spectra a size
    rest = df.join(F.broadcast(ranked.select("vec_id")), "vec_id", "left_anti")
    asked = rest.crossJoin(F.broadcast(support))
    # z is made once a row and size
    near = A.bound(z, lambda q: F.array_min(F.transform("support", lambda s: F.struct(A.squared_distance(s["z"], q).alias("d"), s["id"].alias("id"), s["label"].alias("label")))))
    return asked.select("k", "label", near["label"].alias("pred")).groupBy(F.col("k").alias("support_size")).agg(F.count("*").alias("n_query"), F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6).alias("accuracy"))


@query(E + f", s AS (SELECT vec_id, label, {SNV_SQL} AS z FROM e) SELECT vec_id, label, round(z[1], 6) AS c1, round(z[2], 6) AS c2, round(z[64], 6) AS c64, round(list_sum(list_transform(z, lambda v: abs(v))), 5) AS size FROM s")
def snv_first_channels(spark, sf):
    z = A.snv(F.col("x"))
    return rows(spark, sf).select("vec_id", "label", z.alias("z")).select("vec_id", "label", *[F.round(F.get("z", i), 6).alias(f"c{i + 1}") for i in (0, 1, 63)], F.round(A.total(F.transform("z", F.abs)), 5).alias("size"))


def _resample_sql(n: int) -> str:
    return f"list_transform(range(0, {n}), lambda j: x[CAST(floor(j * 63.0::DOUBLE / {n - 1}) AS INT) + 1] + (j * 63.0::DOUBLE / {n - 1} - floor(j * 63.0::DOUBLE / {n - 1})) * (x[least(CAST(floor(j * 63.0::DOUBLE / {n - 1}) AS INT) + 2, 64)] - x[CAST(floor(j * 63.0::DOUBLE / {n - 1}) AS INT) + 1]))"


@query(E + f", r AS (SELECT vec_id, {_resample_sql(16)} AS a, {_resample_sql(512)} AS b FROM e) SELECT vec_id, round(a[1], 6) AS a0, round(a[6], 6) AS a5, round(a[16], 6) AS a15, round(b[300], 6) AS b299, round(list_sum(b), 5) AS total FROM r")
def resample_linear(spark, sf):
    df = rows(spark, sf).select("vec_id", A.resample(F.col("x"), 16).alias("a"), A.resample(F.col("x"), 512).alias("b"))
    return df.select("vec_id", *[F.round(F.get("a", i), 6).alias(f"a{i}") for i in (0, 5, 15)], F.round(F.get("b", 299), 6).alias("b299"), F.round(A.total(F.col("b")), 5).alias("total"))


@query(E + " SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(range(1, 65), lambda i: x[i] * cos((i - 1) * {j}))), 6) AS p{j}" for j in range(4)) + " FROM e")
def fixed_projection(spark, sf):
    p = A.project(F.col("x"), [[math.cos(i * j) for i in range(64)] for j in range(4)])
    return rows(spark, sf).select("vec_id", p.alias("p")).select("vec_id", *[F.round(F.get("p", j), 6).alias(f"p{j}") for j in range(4)])


@query(
    E
    + f""", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {code("cap", 5, 0, "vec_id")}, vec_id) <= 5 AS s FROM e),
long AS (SELECT vec_id, label, s, i, x[i] AS v FROM r, range(1, 65) t(i)),
stats AS (SELECT label, i, avg(v) AS m, stddev_pop(v) AS sd FROM long WHERE s GROUP BY ALL)
SELECT vec_id, label, CASE WHEN s THEN 'support' ELSE 'query' END AS role, round(sum(greatest(-5, least(5, (v - m) / (sd + 1e-8)))), 4) AS total,
  round(max(abs(greatest(-5, least(5, (v - m) / (sd + 1e-8))))), 5) AS largest, round(sum(greatest(-5, least(5, v / (sd + 1e-8)))), 4) AS scaled_only
FROM long JOIN stats USING (label, i) GROUP BY ALL"""
)
def standardize_by_support(spark, sf):
    df = rows(spark, sf)
    roles = splits.with_roles(df, splits.capped(df.select("vec_id", "label"), "vec_id", 5, ["label"]), "vec_id")
    z = spectra.standardise_by_support(roles, "x", ["label"])
    both = spectra.standardise_by_support(z.withColumnRenamed("z", "z1"), "x", ["label"], shift=False)
    return both.select("vec_id", "label", "role", F.round(A.total(F.col("z1")), 4).alias("total"), F.round(F.array_max(F.transform("z1", F.abs)), 5).alias("largest"), F.round(A.total(F.col("z")), 4).alias("scaled_only"))


@query(f"SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY {code('eval', 20, 3, 'vec_id')}, vec_id) <= 20 THEN 'support' ELSE 'query' END AS role FROM embeddings")
def paired_split(spark, sf):
    return splits.eval_split(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id"), "vec_id", 20, 3)


@query(
    f"""WITH g AS (SELECT label, row_number() OVER (ORDER BY {code("group", 5, 0, "label")}, label) AS g FROM (SELECT DISTINCT label FROM embeddings)),
r AS (SELECT vec_id, label, g, row_number() OVER (PARTITION BY label ORDER BY {code("member", 5, 0, "vec_id")}, vec_id) AS rn FROM embeddings JOIN g USING (label))
SELECT vec_id, label, CASE WHEN g <= 5 THEN 'support' ELSE 'query' END AS role FROM r WHERE g > 5 OR rn = 1"""
)
def group_aware_split(spark, sf):
    return splits.grouped_eval_split(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "vec_id", "label", 5, 0)


@query(f"SELECT vec_id, label, CASE WHEN g <= 4 THEN 'support' ELSE 'query' END AS role FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY {code('whole', 4, 1, 'label')}, label) AS g FROM (SELECT DISTINCT label FROM embeddings)) USING (label)")
def whole_group_split(spark, sf):
    return splits.whole_group_split(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "label", 4, 1)


@query(f"SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {code('candidate', 0, 0, 'vec_id')}, vec_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.6, 0) THEN 'candidate' ELSE 'test' END AS role FROM embeddings")
def candidate_test_split(spark, sf):
    return splits.share_split(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "vec_id", 0.6, 0, ["label"])


@query(f"SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {code('half', 5, 2, 'vec_id')}, vec_id) <= count(*) OVER (PARTITION BY label) // 2 AS is_calibration FROM embeddings")
def calibration_halves(spark, sf):
    return splits.halves(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label"), "vec_id", 5, 2, ["label"])


@query(E + " SELECT label, CAST(i - 1 AS INT) AS pos, count(*) AS n, round(avg(x[i]), 6) AS mean FROM e, range(1, 65) t(i) GROUP BY ALL HAVING count(*) >= 3")
def class_mean_spectrum(spark, sf):
    means = spectra.class_means(rows(spark, sf), "x", ["label"], 3)
    return means.select("label", "n", F.posexplode("spectrum").alias("pos", "v")).select("label", "pos", "n", F.round("v", 6).alias("mean"))


@query(E + " SELECT CAST(vec_id // 3 AS BIGINT) AS sample, count(DISTINCT vec_id) AS n, round(avg(x[1]), 6) AS c1, round(avg(x[64]), 6) AS c64 FROM e GROUP BY ALL")
def replicate_average(spark, sf):
    means = spectra.class_means(rows(spark, sf).withColumn("sample", F.floor(F.col("vec_id") / 3)), "x", ["sample"])
    return means.select("sample", "n", F.round(F.get("spectrum", 0), 6).alias("c1"), F.round(F.get("spectrum", 63), 6).alias("c64"))


@query(
    E
    + """, m AS (SELECT vec_id, list_min(x) AS lo, list_max(x) AS hi, x FROM e),
c AS (SELECT i FROM (SELECT i, max(abs(x[i])) AS top FROM e, range(1, 65) t(i) GROUP BY i) WHERE top <= 0.45)
SELECT vec_id, round(list_sum(list_transform(x, lambda v: (v - lo) / (hi - lo + 1e-8))), 5) AS scaled_total,
  (SELECT count(*) FROM c) AS n_channels, round((SELECT sum(m.x[i]) FROM c), 6) AS kept_total FROM m"""
)
def min_max_and_channel_mask(spark, sf):
    """Rows scaled to [0, 1]; channels with an outlying value anywhere are gaps, and go from all rows."""
    df = rows(spark, sf)
    gaps = df.withColumn("g", F.transform("x", lambda v: F.when(F.abs(v) <= 0.45, v)))
    mask = F.array(*map(F.lit, spectra.complete_channels(gaps, "g")))
    kept = A.masked(F.col("x"), mask)
    return df.select("vec_id", F.round(A.total(A.min_max(F.col("x"))), 5).alias("scaled_total"), F.size(kept).cast("long").alias("n_channels"), F.round(F.when(F.size(kept) > 0, A.total(kept)), 6).alias("kept_total"))


@query(E + " SELECT vec_id, round(1e7 / 4063, 6) AS first_nm, round(x[64], 6) AS first_value, round(x[1], 6) AS last_value, round(list_sum(list_transform(range(1, 65), lambda i: i * x[65 - i])), 5) AS weighted FROM e")
def channel_sort(spark, sf):
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (4000 + i).cast("double"))
    nm, x = A.channel_sort(axis, F.col("x"))
    df = rows(spark, sf).select("vec_id", nm.alias("nm"), x.alias("s"))
    weighted = A.total(F.transform("s", lambda v, i: v * (i + 1)))
    return df.select("vec_id", F.round(F.get("nm", 0), 6).alias("first_nm"), F.round(F.get("s", 0), 6).alias("first_value"), F.round(F.get("s", 63), 6).alias("last_value"), F.round(weighted, 5).alias("weighted"))


@query(E + ", s AS (SELECT vec_id, list_sort(x) AS x FROM e) SELECT vec_id, round(x[2], 6) AS low, round(x[63], 6) AS high, round(x[32], 6) AS middle FROM s")
def jackknife_endpoints(spark, sf):
    """Ends of a 95 % interval over 64 values a row, by the inverted distribution function."""
    return rows(spark, sf).select("vec_id", *[F.round(A.inverted_cdf(F.col("x"), a), 6).alias(n) for a, n in ((0.025, "low"), (0.975, "high"), (0.5, "middle"))])


@query(
    E
    + f""", refs AS (SELECT vec_id AS ref, x AS r FROM e ORDER BY {code("refs", 4, 0, "vec_id")}, vec_id LIMIT 4),
m AS (SELECT vec_id, c, list_sum(list_transform(range(1, 65), lambda i: abs(c * r[i] + (1 - c) * x[i]))) AS size FROM e, refs, (VALUES (0.3::DOUBLE), (0.5), (0.7)) f(c))
SELECT vec_id, round(avg(size), 6) AS mean_size, round(max(size), 6) AS max_size, count(*) AS n FROM m GROUP BY ALL"""
)
def mixture_additivity(spark, sf):
    """Every spectrum with 4 references at 3 fractions."""
    df = rows(spark, sf)
    refs = splits.support(df, "vec_id", 4, 0, "refs").select(F.col("x").alias("r"))
    fractions = F.array(*[F.lit(c) for c in trust.FRACTIONS])
    each = df.crossJoin(F.broadcast(refs)).withColumn("c", F.explode(fractions))
    sized = each.select("vec_id", A.total(F.transform(A.blended(F.col("r"), F.col("x"), F.col("c")), F.abs)).alias("size"))
    return sized.groupBy("vec_id").agg(F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.max("size"), 6).alias("max_size"), F.count("*").alias("n"))


@query(
    E
    + f""", s AS (SELECT x AS r FROM e ORDER BY {code("seed", 2, 0, "vec_id")}, vec_id LIMIT 2),
d AS (SELECT vec_id, min(list_sum(list_transform(range(1, 65), lambda i: (x[i] - r[i]) * (x[i] - r[i])))) AS distance FROM e, s GROUP BY ALL)
SELECT vec_id, round(distance, 6) AS distance FROM d ORDER BY d.distance DESC, vec_id LIMIT 1"""
)
def k_center_first_pick(spark, sf):
    df = rows(spark, sf)
    return trust.farthest(df, splits.support(df, "vec_id", 2, 0, "seed"), "vec_id", "x").withColumn("distance", F.round("distance", 6))


@query(
    """WITH k AS (SELECT 'nation-' || s_nationkey AS compound, 700 + (s_suppkey * 37) % 800 AS p, 10 + s_suppkey % 90 AS intensity FROM supplier)
SELECT compound, CAST(w AS BIGINT) AS wavenumber, round(sum(intensity * exp(-0.5 * ((w - p) / 7.0) ** 2)), 6) AS value FROM k, range(700, 1500, 4) t(w) GROUP BY ALL"""
)
def gaussian_component_basis(spark, sf):
    """Suppliers stand for peaks, their nations for compounds."""
    number = F.col("s_suppkey")
    peaks = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("nation-"), "s_nationkey").alias("compound"), (700 + (number * 37) % 800).cast("int").alias("wavenumber"), (10 + number % 90).cast("int").alias("intensity"))
    return simulate.component_basis(peaks, spark.range(700, 1500, 4).withColumnRenamed("id", "wavenumber")).withColumn("value", F.round("value", 6))


@query("SELECT vec_id, round(((0.5 * u - 1.5) * u + 0.25) * u + 2, 6) AS y, round(power(10.0, -4 + (vec_id % 26) * 5 / 25.0), 8) AS penalty FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS u FROM embeddings)")
def polynomial_baseline(spark, sf):
    """A cubic by Horner's scheme at each row's first channel, and a place in the penalty grid."""
    grid = F.get(A.log_grid(-4, 1, 26), (F.col("vec_id") % 26).cast("int"))
    return rows(spark, sf).select("vec_id", F.round(A.polynomial(F.array(*map(F.lit, (0.5, -1.5, 0.25, 2.0))), F.get("x", 0).cast("double")), 6).alias("y"), F.round(grid, 8).alias("penalty"))


@query(
    E
    + """, p AS (SELECT vec_id, CAST(i - 1 AS INT) AS col, CAST(j AS INT) AS row_, CASE WHEN abs(x[i]) * 100 > j THEN 0 ELSE 255 END AS val FROM e, range(1, 65) t(i), range(0, 40) u(j))
SELECT vec_id, col, min(row_) AS row FROM p WHERE val < 128 GROUP BY ALL"""
)
def top_pixel_curve(spark, sf):
    """The topmost dark pixel of each column of a picture 40 rows high."""
    cells = rows(spark, sf).select("vec_id", F.posexplode("x").alias("col", "v")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(39))))
    return readers.top_pixels(cells.withColumn("val", F.when(F.abs("v") * 100 > F.col("row"), 0).otherwise(255)), by=("vec_id",))
