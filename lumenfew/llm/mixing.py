"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are put in a shuffled order (md5 of the id) and cut into blocks of
``BLOCK`` words. Slot t of the schedule takes the golden-ratio point frac(t * phi), maps it
through the sources' cumulative targets and so names a source; the k-th slot of a source
(its rank) takes the source's block k, beginning anew after the last. Slots past a
source's target are dropped, the last one is cut to the word, and the few slots that a
source is short of by the points' discrepancy follow at the end. So every prefix of the
mix has the sources near their weights.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share ``SHARE``
of all words; a source's target stops at ``EPOCHS`` times its words and the excess is
shared anew by weight.

Defined cases: null and empty texts have no words and are never taken; a null source is a
source; repeated rows are documents of their own; rows that share an id (ties) are ordered by
size, then by text; a very long text spans as many blocks as it fills; a table without words
has targets 0, an empty one gives an empty result; further columns are carried by ``mixed`` and
not read elsewhere, whatever their names (but for those that begin with two underscores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import WORD, staged, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Words in a block.
BLOCK = 256
PHI = 0.6180339887498949
#: Rows that one window group of the two-level running sums holds, about.
GROUP = 20_000


def sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` with ``size``: its words, and ``tie``, which orders rows that share an id."""
    return docs.select(*keep, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` (double).

    The level at which the shares settle is found in one pass: with the sources in the
    order of cap over weight, a source whose cap lies below its share of what the earlier
    ones leave is full; the first that is not full fixes the level for all that follow.
    The windows run over one row a source.
    """
    every = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    named = every.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((number - 1) % len(weights)) + 1).cast("double"))
    whole = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") * epochs / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    words_left = F.lit(float(share)) * F.sum("source_size").over(whole).cast("double") - (earlier("source_size") * epochs).cast("double")
    level = named.withColumn("level", words_left / (F.sum("w").over(whole) - earlier("w"))).withColumn("nth", F.row_number().over(by_cap))
    first = F.min(F.when(F.col("source_size") * epochs > F.col("level") * F.col("w"), F.struct("nth", "level"))).over(whole)
    target = F.when(first.isNull() | (F.col("nth") < first["nth"]), (F.col("source_size") * epochs).cast("double")).otherwise(first["level"] * F.col("w"))
    return level.withColumn("target", target).select("source", "source_size", "target")


def running(df: DataFrame, key: str, bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the earlier rows of ``key``, without a key's rows meeting in one task.

    ``bucket`` must not fall along ``order``; sums run within (key, bucket), and over the
    buckets' totals.
    """
    parts = df.withColumn("__b", bucket)
    totals = parts.groupBy(key, "__b").agg(F.sum(value).alias("__t"))
    so_far = totals.withColumn("__base", F.coalesce(F.sum("__t").over(Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col(key).alias("__k"), F.col("__b").alias("__c"), "__base")
    within = F.coalesce(F.sum(value).over(Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = parts.withColumn("__in", within)
    return summed.join(so_far, summed[key].eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__c"))).withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__k", "__c", "__base", "__in")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots ``t, source, epoch, block, words`` from ``targets``: one row for each block that the mix takes.

    A source's slots read its words from the beginning, again and again, up to its target.
    """
    spark = goals.sparkSession
    wanted = F.floor("target").cast("long")
    need = goals.withColumn("wanted", wanted).where("wanted > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    need = need.withColumn("slots", F.floor(F.col("wanted") / F.col("source_size")) * F.col("n_blocks") + F.ceil(F.col("wanted") % F.col("source_size") / block))
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    upto, of = F.sum("target").over(by_source), F.sum("target").over(Window.partitionBy())
    bounds = need.select("source", "source_size", "wanted", "n_blocks", "slots", ((upto - F.col("target")) / of).alias("low"), (upto / of).alias("high"), F.row_number().over(by_source).alias("s"))
    bounds = staged(bounds, "bounds")  # one row a source
    total = bounds.agg(F.sum("slots").alias("n"), F.count("*").alias("k")).first()
    n, k = total.n or 0, total.k
    # frac(t * phi) in two steps, so that large t keep their digits
    point = F.floor(F.col("t") / (1 << 20)) * ((PHI * (1 << 20)) % 1.0) + (F.col("t") % (1 << 20)) * PHI
    slots = spark.range(n).select(F.col("id").alias("t")).withColumn("u", point - F.floor(point))
    # a slot finds its source in a grid over [0, 1), where a cell lists the sources that it meets
    cells = max(16, 4 * k)
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    grid = bounds.select(F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"), "s", "low", F.when(F.col("s") == k, 2.0).otherwise(F.col("high")).alias("high"))
    named = slots.withColumn("cell", F.floor(F.col("u") * cells)).join(grid, "cell").where("u >= low and u < high").select("t", "s", F.lit(1).alias("one"))
    ranked = running(named, "s", F.floor(F.col("t") / GROUP), ["t"], "one", "rank").select("t", "s", "rank")
    drawn = staged(ranked.join(bounds.select("s", "slots"), "s").where("rank < slots").select("t", "s", "rank"), "drawn")
    got = drawn.groupBy("s").agg(F.count("*").alias("got"))
    short = bounds.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    late = short.select("s", "got", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank")).select((F.lit(n) + F.col("rank") - F.col("got")).alias("t"), "s", "rank")
    every = drawn.unionByName(late).join(bounds, "s").withColumn("epoch", F.floor(F.col("rank") / F.col("n_blocks"))).withColumn("block", F.col("rank") % F.col("n_blocks"))
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("wanted") - F.col("epoch") * F.col("source_size") - F.col("block") * block)
    return every.select("t", "source", "epoch", "block", words.cast("long").alias("words"))


def shuffled(sized: DataFrame) -> DataFrame:
    """``begin``: how many words of the source precede the document in its shuffled order."""
    rows = sized.agg(F.count("*")).first()[0]
    digits = max(1, len(f"{max(1, rows // GROUP):x}"))
    coded = sized.withColumn("__code", F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string"))))
    return running(coded, "source", F.substring("__code", 1, digits), ["__code", F.col("size").desc(), "tie"], "size", "begin").drop("__code")


def mix(ordered: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the mix takes of ``shuffled`` documents: ``source, begin, t, epoch, from_word, taken``.

    Documents are cut along the blocks of their source and join the slots that take them.
    """
    slots = schedule(goals, block).select("t", F.col("source").alias("of_source"), "epoch", F.col("block").alias("of_block"), F.col("words").alias("upto"))
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    pieces = ordered.where("size > 0").select("source", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), last)).alias("block"))
    start = F.greatest(F.col("begin"), F.col("block") * block)
    pieces = pieces.select("source", "begin", "block", (start - F.col("begin")).alias("from_word"), (start - F.col("block") * block).alias("at"), (F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block).alias("end"))
    both = pieces.join(slots, pieces.source.eqNullSafe(F.col("of_source")) & (pieces.block == F.col("of_block")))
    return both.withColumn("taken", F.least("end", "upto") - F.col("at")).where("taken > 0").select("source", "begin", "t", "epoch", "from_word", "taken")


def taken(ordered: DataFrame, goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``ordered`` with ``source_size``, ``target`` and ``taken``, the words that the mix takes of each row.

    ``first_slot`` is the first slot of the schedule that takes words of it (null: none), ``epochs`` how many epochs do.
    """
    # the epochs that take words of a row run from the first on
    once = [F.sum("taken").cast("long").alias("got"), F.min("t").alias("first_slot"), (F.max("epoch") + 1).cast("long").alias("seen")]
    sums = mix(ordered, goals, block).groupBy(F.col("source").alias("s"), F.col("begin").alias("b")).agg(*once)
    own = (F.col("size") > 0) & F.col("source").eqNullSafe(F.col("s")) & (F.col("begin") == F.col("b"))
    per = goals.select(F.col("source").alias("src"), "source_size", "target")
    counted = {to: F.coalesce(c, F.lit(0)).cast("long") for to, c in (("taken", "got"), ("epochs", "seen"))}
    found = ordered.join(sums, own, "left").withColumns(counted).drop("s", "b", "got", "seen")
    return found.join(per, found.source.eqNullSafe(per.src)).drop("src")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The documents as the mix takes them, in the order of the schedule, with the columns of ``docs``.

    A document comes once for each epoch that takes words of it; the one at a source's
    target keeps its first words only. ``n_chars``, where there is one, is counted anew.
    """
    sized = staged(sizes(docs, ["doc_id", "source"]), "sizes")
    ordered = staged(shuffled(sized), "shuffled")
    each = mix(ordered, staged(targets(sized, weights, share, epochs), "targets")).groupBy(F.col("source").alias("s"), F.col("begin").alias("b"), "epoch").agg(F.min("t").alias("__t"), F.sum("taken").alias("__taken"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # rows that share id and text are told apart by their number, in the order of their source
    nth = lambda id_, tie: Window.partitionBy(id_, tie).orderBy(F.col("source").asc_nulls_last())
    numbered = ordered.where("size > 0").select("source", "begin", name.alias("__id"), F.col("tie").alias("__tie")).withColumn("__n", F.row_number().over(nth("__id", "__tie")))
    takes = each.join(numbered, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("begin"))).select(F.col("__id").alias("__i"), F.col("__tie").alias("__h"), F.col("__n").alias("__m"), "__t", "__taken")
    mine = docs.withColumn("__id", name).withColumn("__tie", F.xxhash64("text")).withColumn("__n", F.row_number().over(nth("__id", "__tie")))
    # the numbers are compared outside the join's keys, so that the window's partitioning serves the join
    rows = mine.join(takes, (F.col("__id") == F.col("__i")) & (F.col("__tie") == F.col("__h")) & (F.abs(F.col("__n") - F.col("__m")) == 0))
    parts = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    cut = F.regexp_count(F.col("text"), F.lit(WORD)) > F.col("__taken")
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(parts, F.lit(1), F.col("__taken").cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    return rows.repartitionByRange("__t").sortWithinPartitions("__t").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, in how many epochs, and from which slot of the schedule on."""
    sized = staged(sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"]), "sizes")
    goals = staged(targets(sized), "targets")
    return taken(staged(shuffled(sized), "shuffled"), goals).select("doc_id", F.col("size"), F.col("source_size").cast("long").alias("source_size"), "target", "taken", "first_slot", "epochs")


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w FROM per),
levels AS (
  SELECT *, row_number() OVER by_cap AS nth,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(source_size) OVER before_, 0) * 2 AS DOUBLE))
    / (sum(w) OVER () - coalesce(sum(w) OVER before_, 0)) AS level
  FROM named
  WINDOW by_cap AS (ORDER BY CAST(source_size * 2 AS DOUBLE) / w, source ASC NULLS LAST),
    before_ AS (ORDER BY CAST(source_size * 2 AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_open AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM levels WHERE source_size * 2 > level * w),
goals AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.nth IS NULL OR l.nth < f.nth THEN CAST(l.source_size * 2 AS DOUBLE) ELSE f.level * l.w END AS target
  FROM levels l, first_open f),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR))), size DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM sized),
joined AS (SELECT p.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS wanted FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source),
need AS (SELECT *, CAST(floor(target) AS BIGINT) AS wanted, (source_size + 255) // 256 AS n_blocks FROM goals WHERE floor(target) > 0),
bounds AS (
  SELECT *, wanted // source_size * n_blocks + (wanted % source_size + 255) // 256 AS slots, row_number() OVER by_source AS s,
    (sum(target) OVER by_source - target) / sum(target) OVER () AS low, sum(target) OVER by_source / sum(target) OVER () AS high
  FROM need WINDOW by_source AS (ORDER BY source ASC NULLS LAST)),
every AS (SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) AS n, max(s) AS k FROM bounds),
points AS (SELECT t, t // 1048576 * ((0.6180339887498949::DOUBLE * 1048576) % 1.0::DOUBLE) + (t % 1048576) * 0.6180339887498949::DOUBLE AS p FROM (SELECT unnest(range(n)) AS t FROM every)),
named_slots AS (
  SELECT t, s, row_number() OVER (PARTITION BY s ORDER BY t) - 1 AS rank
  FROM points JOIN bounds ON p - floor(p) >= low AND (p - floor(p) < high OR s = (SELECT k FROM every))),
drawn AS (SELECT t, s, rank FROM named_slots JOIN bounds USING (s) WHERE rank < slots),
got AS (SELECT s, slots, coalesce(g, 0) AS g FROM bounds LEFT JOIN (SELECT s, count(*) AS g FROM drawn GROUP BY s) USING (s)),
late AS (SELECT n + rank - g AS t, s, rank FROM (SELECT s, g, unnest(range(g, CAST(slots AS BIGINT))) AS rank FROM got), every),
slotted AS (
  SELECT t, source, source_size, rank // n_blocks AS epoch, rank % n_blocks AS block,
    least(256, source_size - rank % n_blocks * 256, wanted - rank // n_blocks * source_size - rank % n_blocks * 256) AS upto
  FROM (SELECT * FROM drawn UNION ALL SELECT * FROM late) JOIN bounds USING (s)),
firsts AS (
  SELECT p.source, p.begins, min(t) AS first_slot, max(epoch) + 1 AS epochs
  FROM placed p JOIN slotted g ON p.source IS NOT DISTINCT FROM g.source AND g.block BETWEEN p.begins // 256 AND (p.begins + p.size - 1) // 256
  WHERE p.size > 0 AND least(p.begins + p.size, g.block * 256 + g.upto) > greatest(p.begins, g.block * 256) GROUP BY ALL)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN CAST(0 AS BIGINT) ELSE CAST(wanted // source_size * size + greatest(0, least(joined.begins + size, wanted % source_size) - joined.begins) AS BIGINT) END AS taken,
  CASE WHEN size > 0 THEN CAST(first_slot AS BIGINT) END AS first_slot,
  CASE WHEN size > 0 THEN CAST(coalesce(epochs, 0) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS epochs
FROM joined LEFT JOIN firsts ON joined.source IS NOT DISTINCT FROM firsts.source AND joined.begins = firsts.begins AND joined.size > 0
"""
