"""Relational and report queries over the star-schema, event and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.functions import metrics as M
from lumenfew.functions import text as T
from lumenfew.operators import reports, spectra, trust
from lumenfew.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- joins, filters, unions --------------------------------------------------------------


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_orderkey HAVING count(*) = 3")
def exact_replicate_groups(spark, sf):
    kept = spectra.exact_groups(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", 3)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)")
def left_lookup_targets(spark, sf):
    """One row a document, whatever the labels hold."""
    once = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf, "documents").select("doc_id", "lang").join(once, "doc_id", "left")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(done, "o_orderkey", "left_anti")


@query(
    """SELECT source, CAST(block AS INT) AS block, count(*) AS n, round(sum(v), 2) AS total FROM (
SELECT 'returned' AS source, 0 AS block, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'accepted', 1, l_quantity FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT 'orders', 2, o_totalprice FROM orders) GROUP BY ALL"""
)
def union_blocks(spark, sf):
    """Blocks in a stated order, one under another."""
    items = table(spark, sf, "lineitem")
    blocks = {"returned": items.where("l_returnflag = 'R'").select(F.col("l_quantity").alias("v")), "accepted": items.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("v")), "orders": table(spark, sf, "orders").select(F.col("o_totalprice").alias("v"))}
    out = None
    for i, (name, df) in enumerate(blocks.items()):
        own = df.select(F.lit(name).alias("source"), F.lit(i).alias("block"), "v")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("source", "block").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def dead_ids(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return a.union(table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey")).distinct()


@query("SELECT o_orderpriority AS target, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) GROUP BY ALL HAVING count(*) >= 30")
def usable_targets(spark, sf):
    maps = table(spark, sf, "orders").select(F.create_map("o_orderpriority", F.col("o_totalprice").cast("double")).alias("targets"))
    return readers.usable_targets(maps)


@query(
    r"""SELECT event_id, trim(regexp_replace(trim('" ' || event_type || '"'), '^"+|"+$', '', 'g')) AS id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS bad, 'c' || CAST(user_id % 7 AS VARCHAR) || '_pv' || CAST(round(value, 1) AS VARCHAR) AS name, 'C' || replace('64-17-5', '-', '') AS registry FROM events"""
)
def text_coercion(spark, sf):
    """Ids, numbers that may not be, names from values."""
    e = table(spark, sf, "events")
    return e.select("event_id", T.clean_id(F.concat(F.lit('" '), "event_type", F.lit('"'))).alias("id"), T.number(F.get_json_object("props", "$.k")).alias("k"), T.number(F.col("event_type")).alias("bad"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"), F.lit("_pv"), F.round("value", 1).cast("string")).alias("name"), T.registry_id(F.lit("64-17-5")).alias("registry"))


@query(
    """WITH r AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
i AS (SELECT *, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS tick FROM r)
SELECT user_id, CAST(tick AS BIGINT) AS tick, round(avg(event_id), 4) AS at, count(*) AS n FROM i GROUP BY user_id, tick"""
)
def merged_ticks(spark, sf):
    """Gaps and islands: positions near their neighbour are one tick."""
    return readers.merged_ticks(table(spark, sf, "events").select("user_id", "event_id"), "event_id", ["user_id"], 50).withColumn("at", F.round("at", 4))


# -- metrics -----------------------------------------------------------------------------

PRED = "l_extendedprice / 1000"


@query(
    f"""WITH p AS (SELECT l_returnflag, l_linestatus, {PRED} AS pred, l_quantity::DOUBLE AS y FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS n, round(1 - sum((pred - y) ** 2) / regr_syy(y, y), 6) AS r2, round(sqrt(avg((pred - y) ** 2)), 6) AS rmse,
  round(stddev_samp(y) / sqrt(avg((pred - y) ** 2)), 6) AS rpd, CAST(1 - sum((pred - y) ** 2) / regr_syy(y, y) < -1 AS INT) AS catastrophic,
  round(avg(CASE WHEN y BETWEEN pred * 0.5 AND pred * 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS coverage, round(avg(pred * 1.5 - pred * 0.5), 6) AS width
FROM p GROUP BY ALL"""
)
def r2_rmse_rpd_by_group(spark, sf):
    p = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.expr(PRED).alias("pred"), F.col("l_quantity").cast("double").alias("y"))
    pred, y = F.col("pred"), F.col("y")
    out = p.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), M.r2(pred, y).alias("r2"), F.round(M.rmse(pred, y), 6).alias("rmse"), F.round(M.rpd(pred, y), 6).alias("rpd"), F.round(M.coverage(pred * 0.5, pred * 1.5, y), 6).alias("coverage"), F.round(M.width(pred * 0.5, pred * 1.5), 6).alias("width"))
    return out.withColumn("catastrophic", M.catastrophic(F.col("r2"))).withColumn("r2", F.round("r2", 6))


@query(
    """WITH lim AS (SELECT l_returnflag, avg(p) AS m, stddev_pop(p) AS s FROM (SELECT l_returnflag, l_discount AS p FROM lineitem WHERE l_tax = 0) GROUP BY ALL HAVING count(*) >= 5)
SELECT l_returnflag, l_tax AS level, count(*) AS n_test_spectra, round(avg(CASE WHEN l_discount > m + 3.3 * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS detection_rate_at_lod,
  round(avg(CASE WHEN l_discount > m + 10 * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS detection_rate_at_loq, round(quantile_cont(l_discount, 0.5), 6) AS median_prediction, round(any_value(m), 6) AS blank_mean, round(any_value(s), 6) AS blank_sd
FROM lineitem JOIN lim USING (l_returnflag) GROUP BY ALL"""
)
def detection_limit_by_level(spark, sf):
    out = trust.detection_limits(table(spark, sf, "lineitem").select("l_returnflag", "l_discount", F.col("l_tax").alias("level")), ["l_returnflag"], "l_discount", "level")
    return out.select("l_returnflag", "level", "n_test_spectra", *[F.round(c, 6).alias(c) for c in ("detection_rate_at_lod", "detection_rate_at_loq", "median_prediction", "blank_mean", "blank_sd")])


@query(
    """WITH s AS (SELECT event_type, nominal, abs(value) AS score FROM events, (VALUES (50), (68), (80), (90), (95)) l(nominal)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type, nominal ORDER BY score) AS rn, count(*) OVER (PARTITION BY event_type, nominal) AS n FROM s)
SELECT event_type, CAST(nominal AS INT) AS nominal, round(score, 6) AS radius FROM r WHERE rn = least(n, CAST(ceil((n + 1) * nominal / 100.0 - 1e-9) AS BIGINT))"""
)
def conformal_quantile(spark, sf):
    levels = F.explode(F.array(*[F.lit(n) for n, _, _ in trust.LEVELS])).alias("nominal")
    scored = table(spark, sf, "events").select("event_type", F.abs("value").alias("score"), levels)
    return trust.conformal_quantile(scored, ["event_type"], "score", "nominal").withColumn("radius", F.round("radius", 6))


@query(
    """WITH b AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS idx, l_discount * 1000 + (l_orderkey * 7919 + l_linenumber * 31) % 997 AS score, l_quantity::DOUBLE AS y, l_extendedprice / 2000 AS pred FROM lineitem),
d AS (SELECT l_suppkey, idx, min(score) AS score, max(pred) AS pred, max(y) AS y FROM b GROUP BY ALL),
r AS (SELECT l_suppkey, row_number() OVER w AS m, count(*) OVER (PARTITION BY l_suppkey) AS n, sum((pred - y) ** 2) OVER w AS sse, sum(y - ym) OVER w AS s1, sum((y - ym) ** 2) OVER w AS s2
  FROM (SELECT *, avg(y) OVER (PARTITION BY l_suppkey) AS ym FROM d) WINDOW w AS (PARTITION BY l_suppkey ORDER BY score, idx)),
f AS (SELECT l_suppkey, 0.5 + g * 0.05::DOUBLE AS f, sse / (s2 - s1 * s1 / m) AS risk FROM r, range(0, 11) t(g)
  WHERE m = greatest(2, CAST(round_even(round(n * (0.5 + g * 0.05::DOUBLE), 9), 0) AS BIGINT))),
p AS (SELECT l_suppkey, (f - lag(f) OVER w) * (risk + lag(risk) OVER w) / 2 AS piece FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY f))
SELECT l_suppkey, round(sum(piece), 5) AS auc FROM p GROUP BY ALL"""
)
def risk_coverage_auc(spark, sf):
    """Each supplier is a cell."""
    own = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (F.col("l_discount") * 1000 + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31) % 997).alias("score"), F.col("l_quantity").cast("double").alias("y"), (F.col("l_extendedprice") / 2000).alias("pred"))
    once = own.groupBy("l_suppkey", "idx").agg(F.min("score").alias("score"), F.max("pred").alias("pred"), F.max("y").alias("y"))
    return trust.risk_coverage(once, ["l_suppkey"], "score").withColumn("auc", F.round("auc", 5))


# -- reports over a result table -----------------------------------------------------------
# Suppliers stand for tasks, line numbers for support sizes, parts for repetitions, flags for arms.

RESULT = """res AS (SELECT CAST(l_suppkey % 13 AS INT) AS task, l_linenumber AS k, CAST(l_partkey % 10 AS INT) AS rep, l_returnflag AS arm, round(avg(l_discount * 30 - 2 + l_tax * 3), 9) AS r2, round(avg(l_quantity), 9) AS seconds
FROM lineitem GROUP BY ALL)"""


def results(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 13).cast("int").alias("task"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 10).cast("int").alias("rep"), F.col("l_returnflag").alias("arm"), (F.col("l_discount") * 30 - 2 + F.col("l_tax") * 3).alias("v"), "l_quantity")
    return df.groupBy("task", "k", "rep", "arm").agg(F.round(F.avg("v"), 9).alias("r2"), F.round(F.avg("l_quantity"), 9).alias("seconds"))


@query(f"WITH {RESULT} SELECT k, arm, round(quantile_cont(greatest(r2, -1), 0.5), 6) AS median_r2, count(*) AS n FROM res GROUP BY ALL")
def median_winsorized(spark, sf):
    return reports.medians(results(spark, sf), ["k", "arm"]).withColumn("median_r2", F.round("median_r2", 6))


@query(f"WITH {RESULT}, i AS (SELECT task, k, arm, quantile_cont(greatest(r2, -1), 0.75) - quantile_cont(greatest(r2, -1), 0.25) AS iqr FROM res GROUP BY ALL) SELECT k, arm, round(quantile_cont(iqr, 0.5), 6) AS median_iqr, count(*) AS n_groups FROM i GROUP BY ALL")
def iqr_then_median(spark, sf):
    return reports.iqr_then_median(results(spark, sf), ["task", "k", "arm"], ["k", "arm"]).withColumn("median_iqr", F.round("median_iqr", 6))


PAIRS = "pairs AS (SELECT task, k, rep, max(CASE WHEN arm = 'A' THEN r2 END) AS a, max(CASE WHEN arm = 'N' THEN r2 END) AS b FROM res WHERE arm IN ('A', 'N') GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"


@query(f"WITH {RESULT}, {PAIRS} SELECT k, round(avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS win_rate, round(quantile_cont(a - b, 0.5), 6) AS median_difference, count(*) AS n FROM pairs GROUP BY ALL")
def paired_win_rate(spark, sf):
    out = reports.win_rates(reports.paired(results(spark, sf), "A", "N", ["task", "k", "rep"]), ["k"])
    return out.select("k", F.round("win_rate", 6).alias("win_rate"), F.round("median_difference", 6).alias("median_difference"), "n")


@query(f"WITH {RESULT.replace('AS r2', 'AS r2_').replace('AS seconds', 'AS r2')}, {PAIRS} SELECT k, round(quantile_cont(a / b, 0.5), 6) AS median_ratio, count(*) AS n FROM pairs WHERE b <> 0 GROUP BY ALL")
def width_ratio(spark, sf):
    out = reports.ratio_medians(reports.paired(results(spark, sf), "A", "N", ["task", "k", "rep"], "seconds"), ["k"])
    return out.withColumn("median_ratio", F.round("median_ratio", 6))


@query(
    """WITH s AS (SELECT o_orderpriority, round(o_totalprice / 1000) AS score, CAST(o_orderkey % 3 = 0 AS INT) AS pos FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY score) + (count(*) OVER (PARTITION BY o_orderpriority, score) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT o_orderpriority, round((sum(r * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_positive, CAST(count(*) - sum(pos) AS BIGINT) AS n_negative FROM r GROUP BY ALL"""
)
def pooled_roc_auc(spark, sf):
    s = table(spark, sf, "orders").select("o_orderpriority", F.round(F.col("o_totalprice") / 1000).alias("score"), "o_orderkey")
    return reports.roc_auc(s, ["o_orderpriority"], "score", F.col("o_orderkey") % 3 == 0).withColumn("auc", F.round("auc", 6))


@query(
    f"""WITH {RESULT}, {PAIRS}, d AS (SELECT k, round(a - b, 3) AS d FROM pairs WHERE round(a - b, 3) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY k, abs(d)) AS c FROM d)
SELECT k, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n, round(sum((c * c - 1.0::DOUBLE) / 48), 6) AS tie_term FROM r GROUP BY ALL"""
)
def wilcoxon_signed_rank(spark, sf):
    pairs = reports.paired(results(spark, sf), "A", "N", ["task", "k", "rep"])
    return reports.signed_ranks(pairs, ["k"], F.round(F.col("a") - F.col("b"), 3)).withColumn("tie_term", F.round("tie_term", 6))


@query(
    f"""WITH {RESULT}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seconds DESC, task, rep, arm) > floor(count(*) OVER (PARTITION BY k) * 0.2 + 1e-9) AS kept FROM res)
SELECT k, count(*) AS n, count(CASE WHEN kept THEN 1 END) AS n_released, round(avg(CASE WHEN r2 < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS bad_before,
  round(avg(CASE WHEN kept THEN (CASE WHEN r2 < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END), 6) AS bad_after, round(quantile_cont(CASE WHEN kept THEN r2 END, 0.5), 6) AS median_released FROM r GROUP BY ALL"""
)
def gate_release_stats(spark, sf):
    out = reports.released(results(spark, sf), ["k"], "seconds", "r2", ["task", "rep", "arm"])
    return out.select("k", "n", "n_released", *[F.round(c, 6).alias(c) for c in ("bad_before", "bad_after", "median_released")])


@query(
    f"""WITH {RESULT}, c AS (SELECT task, k, avg(CASE WHEN arm = 'A' THEN r2 END) - avg(CASE WHEN arm = 'N' THEN r2 END) AS d FROM res GROUP BY ALL),
n AS (SELECT *, lead(k) OVER w AS nk, lead(d) OVER w AS nd FROM c WINDOW w AS (PARTITION BY task ORDER BY k))
SELECT task, round(k + (nk - k) * d / (d - nd), 4) AS crossing FROM n WHERE d * nd < 0 OR (d = 0 AND nd IS NOT NULL)"""
)
def curve_crossover(spark, sf):
    curves = results(spark, sf).groupBy("task", "k").agg(F.avg(F.when(F.col("arm") == "A", F.col("r2"))).alias("a"), F.avg(F.when(F.col("arm") == "N", F.col("r2"))).alias("b"))
    return reports.crossover(curves, "k", "a", "b", ["task"]).withColumn("crossing", F.round("crossing", 4))


@query(f"WITH {RESULT}, m AS (SELECT k, arm, quantile_cont(r2, 0.5) AS median, avg(r2) AS mean FROM res GROUP BY ALL) SELECT k, arm, round(median, 6) AS median, round(mean, 6) AS mean FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY m.median DESC, m.mean DESC, arm DESC) = 1")
def best_arm(spark, sf):
    out = reports.best_arms(results(spark, sf), "k", "arm", "r2")
    return out.select("k", "arm", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


@query(f"WITH {RESULT} SELECT arm, round(sum(seconds), 4) AS seconds, count(*) AS n FROM res GROUP BY ALL")
def seconds_by_family(spark, sf):
    return reports.seconds(results(spark, sf), ["arm"]).withColumn("seconds", F.round("seconds", 4))


@query(f"WITH {RESULT} SELECT arm, round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std, count(*) AS n_repetitions, count(DISTINCT task) AS n_tasks FROM res GROUP BY ALL")
def baseline_summary(spark, sf):
    own = results(spark, sf).withColumns({"rmse": F.col("seconds"), "rpd": F.col("seconds"), "n_test": F.lit(1)})
    tasks = own.groupBy("arm").agg(F.countDistinct("task").alias("n_tasks"))
    return reports.baseline_summary(own, ["arm"]).select("arm", F.round("r2_mean", 6).alias("r2_mean"), F.round("r2_std", 6).alias("r2_std"), "n_repetitions").join(tasks, "arm")


@query(f"WITH {RESULT}, p AS (SELECT task, k, rep, max(CASE WHEN arm = 'A' THEN r2 END) AS a, max(CASE WHEN arm = 'N' THEN r2 END) AS n, max(CASE WHEN arm = 'R' THEN r2 END) AS r FROM res GROUP BY ALL HAVING count(DISTINCT arm) = 3) SELECT * FROM p")
def three_families_aligned(spark, sf):
    own = results(spark, sf).withColumnsRenamed({"k": "support_size", "rep": "repetition"})
    out = reports.aligned({name.lower(): own.where(F.col("arm") == name) for name in ("A", "N", "R")})
    return out.withColumnsRenamed({"support_size": "k", "repetition": "rep"})


@query(
    f"""WITH {RESULT} SELECT g.task, g.k, g.rep, g.seconds AS gate, a.r2 AS coverage FROM (SELECT * FROM res WHERE arm = 'A') g JOIN (SELECT * FROM res WHERE arm = 'N') a ON g.task = a.task AND g.k = a.k AND g.rep = a.rep"""
)
def gate_against_audit(spark, sf):
    """Gate rows with the audit rows of one method and level."""
    own = results(spark, sf).withColumnsRenamed({"k": "support_size", "rep": "repetition"})
    audit = own.select("task", "support_size", "repetition", F.when(F.col("arm") == "N", "native-posterior").otherwise("split-conformal").alias("method"), F.lit(90).alias("nominal"), F.col("r2").alias("empirical_coverage"), F.col("seconds").alias("mean_interval_width"))
    gate = own.where("arm = 'A'").select("task", "support_size", "repetition", F.col("seconds").alias("gate"))
    return reports.gate_against_audit(gate, audit).select("task", F.col("support_size").alias("k"), F.col("repetition").alias("rep"), "gate", F.col("empirical_coverage").alias("coverage"))


# -- tasks and further reports -----------------------------------------------------------


@query(
    """WITH t AS (SELECT * FROM (VALUES (0, 'diesel-bp50', 'diesel', 'BP50'), (1, 'diesel-cetane-number', 'diesel', 'CN'), (2, 'diesel-density', 'diesel', 'D4052'), (3, 'diesel-flash-point', 'diesel', 'FLASH'),
  (4, 'diesel-freezing-point', 'diesel', 'FREEZE'), (5, 'diesel-total-aromatics', 'diesel', 'TOTAL'), (6, 'diesel-viscosity', 'diesel', 'VISC'), (7, 'corn-moisture', 'corn', 'moisture'), (8, 'corn-oil', 'corn', 'oil'),
  (9, 'corn-protein', 'corn', 'protein'), (10, 'corn-starch', 'corn', 'starch'), (11, 'gasoline-octane', 'gasoline', 'octane'), (12, 'olive-oil-adulteration', 'evoo', 'adulteration_level'),
  (14, 'pentane-ccl4-volume-fraction', 'pentane_ccl4', 'phi_pentane')) v(nth, task, dataset, property))
SELECT task, dataset, property, nth <> 14 AS is_benchmark, nth <> 14 AS uses_snv, count(*) AS n, round(sum(l_discount), 2) AS total FROM lineitem JOIN t ON l_suppkey % 15 = nth GROUP BY ALL"""
)
def task_lookup(spark, sf):
    """Rows of each task but the negative control: suppliers stand for tasks in the table's order."""
    names = spark.createDataFrame([(i, t) for i, t in enumerate(readers.TASKS)], "nth int, task string")
    tasks = readers.task_pool(readers.task_table(spark), without=(readers.CONTROL,)).join(names, "task")
    own = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 15).cast("int").alias("nth"), "l_discount")
    return own.join(tasks, "nth").groupBy("task", "dataset", "property", "is_benchmark", "uses_snv").agg(F.count("*").alias("n"), F.round(F.sum("l_discount"), 2).alias("total"))


@query("SELECT l_returnflag, round(quantile_cont(abs(l_discount - l_tax), 0.5), 6) AS median_error, round(quantile_cont(abs(l_discount - l_tax), 0.9), 6) AS p90_error, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def error_quantiles(spark, sf):
    found = reports.error_quantiles(table(spark, sf, "lineitem").withColumn("e", F.abs(F.col("l_discount") - F.col("l_tax"))), ["l_returnflag"], "e")
    return found.select("l_returnflag", F.round("median_error", 6).alias("median_error"), F.round("p90_error", 6).alias("p90_error"), "n")


@query("SELECT l_returnflag AS method, l_linenumber AS nominal, round(avg(l_discount), 6) AS mean_coverage, round(avg(l_tax), 6) AS mean_width, count(*) AS n FROM lineitem GROUP BY ALL")
def coverage_by_method(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("nominal"), F.col("l_discount").alias("empirical_coverage"), F.col("l_tax").alias("mean_interval_width"))
    found = trust.mean_coverage(df)
    return found.select("method", "nominal", F.round("mean_coverage", 6).alias("mean_coverage"), F.round("mean_width", 6).alias("mean_width"), "n")
