"""Document fingerprints from closed syncmers, in DataFrame functions only.

The sequence is the text's words. A run of ``K`` words is an anchor when the least hash
of its inner words lies at an edge (its first or last word): the choice depends on the run
alone, not on what surrounds it, so equal passages give equal anchors wherever they stand,
and of any ``K - 1`` runs in a row one at least is an anchor. The fingerprint holds every
anchor of the whole text in order: a hex digit for the words since the anchor before, and
eight for the anchor's 32-bit hash.

Anchors are matched by relative position: beside its anchors a fingerprint is taken to have
a link for each two neighbouring anchors and their distance. The likeness of two
fingerprints is the Jaccard likeness of their sets of anchors and links, so a passage that
has moved as a whole still matches, and one whose anchors stand elsewhere matches by half.

Defined cases: a null text counts as empty; words without an anchor among them (fewer than
``K``, or ``K`` whose least is within) make one anchor of all words; no word gives the
empty fingerprint, which is like another empty one (1) and unlike the rest (0); very long
texts keep all their anchors; an empty table gives an empty result; the next document is
by descending id, nulls last, ties by text, and the last one's is the first; a single
document is its own next; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import partitions, table, text_or_empty

K = 3
MASK = 0xFFFFFFFF
SPACES = r"[\x20\x09-\x0D]+"
#: Documents that a range of ids holds, about; how many ranges there are at most (fuller ranges
#: spill); and the ids a range that its cuts are estimated from. Cuts never change a result.
ROWS, RANGES, IDS = 5_000, 65_536, 100


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def pieces(text: Column, k: int = K) -> Column:
    """The closed syncmers of ``k`` words in order, one long each: words since the one before (below 16, so ``k`` may be 16 at most), then a 32-bit hash."""
    h = F.transform(F.array_remove(F.split(text, SPACES, -1), ""), lambda w: F.xxhash64(w))
    piece = lambda distance, run: distance.cast("long") * (1 << 32) + F.xxhash64(run).bitwiseAND(F.lit(MASK))
    least = lambda found: found[0] if len(found) == 1 else F.least(*found)

    def chosen(h: Column) -> Column:
        n = F.size(h)
        m = n - (k - 1)
        runs = F.arrays_zip(F.sequence(F.lit(1), m), F.arrays_zip(*[F.slice(h, j, m) for j in range(1, k + 1)]))
        at = lambda z: z.getField("0")
        word = lambda z, j: z.getField("1").getField(str(j))
        edge = lambda z: least([word(z, j) for j in sorted({0, k - 1})])
        kept = F.filter(runs, lambda z: edge(z) <= least([word(z, j) for j in range(1, k - 1)])) if k > 2 else runs
        written = lambda kept: F.transform(kept, lambda z, i: piece(at(z) - F.coalesce(at(F.get(kept, i - 1)), F.lit(0)), z.getField("1")))
        found = F.when(n >= k, _bound(kept, written)).otherwise(F.array().cast("array<bigint>"))
        whole = F.when(n > 0, F.array(piece(F.lit(1), h))).otherwise(F.array().cast("array<bigint>"))
        return _bound(found, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))

    return _bound(h, chosen)


def written(pieces: Column) -> Column:
    """A fingerprint: nine hex digits a piece."""
    return F.lower(F.array_join(F.transform(pieces, lambda p: F.hex(p)), ""))


def fingerprint(text: Column, k: int = K) -> Column:
    """Every anchor of the text in order, as nine hex digits: its distance from the one before and its hash."""
    return written(pieces(text, k))


def parts(pieces: Column) -> Column:
    """The distinct anchors and links of a text's pieces; a link is the hash of an anchor, a distance and the next anchor, below zero to stand apart."""

    def both(pieces: Column) -> Column:
        code = lambda p: p.bitwiseAND(F.lit(MASK))
        rest = F.greatest(F.size(pieces) - 1, F.lit(0))
        links = F.zip_with(F.slice(pieces, 1, rest), F.slice(pieces, 2, rest), lambda a, b: F.xxhash64(code(a), b).bitwiseOR(F.lit(-(1 << 63))))
        return F.array_union(F.transform(pieces, code), links)

    return _bound(pieces, both)


def overlap(a: Column, b: Column) -> Column:
    """0 to 1: the Jaccard likeness of two sets of ``parts``; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(every, F.lit(1)).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how like two fingerprints are."""
    read = lambda f: F.transform(F.array_remove(F.split(F.regexp_replace(f, "(.{9})", "$1 "), " "), ""), lambda p: F.conv(p, 16, 10).cast("long"))
    return overlap(parts(read(a)), parts(read(b)))


def _constants(values: list, kind: str) -> Column:
    """An array of numbers as one folded constant, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(kind)


def _range_of(column: str, cuts: list) -> Column:
    """The number of ``cuts`` below the value, by binary search; -1 for null."""
    n = len(cuts)
    if not n:
        return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(F.lit(0))
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    table_ = _constants(cuts, f"array<{'bigint' if isinstance(cuts[0], int) else 'double'}>")
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(table_, low + step - 1) < F.col(column)), low + step).otherwise(low))
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, columns: list[str], made: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``next_<c>`` of the row that follows by descending ``doc_id`` (after the last: the first).

    Ids are cut into ranges at estimated quantiles; each range looks ahead within
    itself, and a copy of the leading row of the range that follows stands at its end. The
    number of ranges follows that of the rows. ``made`` adds columns, and their ``next_``,
    that are worked out once a row behind the shuffle and its sort.
    """
    made = made or {}
    n_rows = docs.count()
    n = max(2, partitions(docs.sparkSession), min(n_rows // ROWS, RANGES))
    ids = docs.select("doc_id")
    ids = ids.sample(IDS * n / n_rows, 1) if n_rows > IDS * n else ids
    cuts = ids.agg(F.percentile_approx("doc_id", _constants([i / n for i in range(1, n)], "array<double>"), F.lit(10 * n))).first()[0] or []
    ranged = docs.withColumn("__range", _range_of("doc_id", sorted(set(cuts))))
    order = [F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in columns]]
    lead = ranged.groupBy("__range").agg(F.max("doc_id").alias("__top"))
    heads = lead.select("__range", F.lead("__range").over(Window.orderBy(F.col("__range"))).alias("__after"), F.max("__range").over(Window.partitionBy()).alias("__last"))
    heads = F.broadcast(heads.join(lead, "__range"))  # one row a range: as many as partitions
    at_top = ranged.join(heads, "__range").where(F.col("doc_id").eqNullSafe(F.col("__top")))
    first = Window.partitionBy("__range").orderBy(*order)
    ghosts = at_top.withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
    # a range is followed, in descending order, by the one below; the lowest by the highest
    low = F.coalesce(F.col("__after"), F.expr("-2"))
    wrap = heads.agg(F.min("__range").alias("__lowest"))
    ghosts = ghosts.crossJoin(F.broadcast(wrap)).withColumn("__range", F.when(low == -2, F.col("__lowest")).otherwise(F.col("__after")))
    rows = ranged.withColumn("__ghost", F.lit(0)).select(*docs.columns, "__range", "__ghost").unionAll(ghosts.withColumn("__ghost", F.lit(1)).select(*docs.columns, "__range", "__ghost"))
    ahead = Window.partitionBy("__range").orderBy(F.col("__ghost"), *order)
    rows = rows.repartition(n, "__range").sortWithinPartitions("__range", "__ghost", *order).withColumns(made)
    return rows.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in [*columns, *made]]).where("__ghost = 0").drop("__range", "__ghost")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = with_next(docs, ["text"], {"pieces": pieces(F.col("text"))})
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "pieces", "next_pieces", pieces(F.col("edited")).alias("edited_pieces"))
    rows = rows.select("*", *[parts(F.col(c)).alias(of) for c, of in (("pieces", "own"), ("edited_pieces", "of_edited"), ("next_pieces", "of_next"))])
    prints = [written(F.col(c)).alias(name) for c, name in (("pieces", "fingerprint"), ("edited_pieces", "edited_fingerprint"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", *prints, overlap(F.col("own"), F.col("of_edited")).alias("near_edited"), overlap(F.col("own"), F.col("of_next")).alias("near_next"))
