"""Ranked lexical search by inverted treaps.

1. Postings. Every whole text is cut into terms; each document keeps its number of terms and
   the counts of those that a search item has. Nothing is shuffled: a row stays a document.
2. Statistics. Document frequencies, the number of documents and of terms, over all rows.
3. Search. A task takes its rows in chunks of bounded size. For each term of a chunk an
   inverted treap is built: in order of document id as a search tree, with the greatest
   impact on top as a heap. A search walks the treaps of an item's terms together over
   intervals of documents: the roots are the maxima of an interval, their sum bounds each of
   its scores, and intervals whose sum can't enter the best ``k`` are left. Intervals of at
   most ``LEAF`` documents are scored. The best ``k`` go on from chunk to chunk, so later
   chunks are pruned by earlier ones.
4. The best ``k`` of all tasks are ranked, first among groups of tasks, then over all.

Items are taken in blocks of about ``PAIRS`` (item, term) pairs, each broadcast and searched
in a pass of its own; documents are never broadcast or collected.

Defined cases: a null text has no term; such a document counts for nothing. Rows are documents
of their own, whatever their ids: repeated rows are ranked each, a null id after all others of
an equal score. Item rows that share an id are one item with the terms of all. An item without
a term, or without a document that has one of its terms, gives no row. Empty tables give no
row. Very long texts are read whole. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, release, staged, table
from lumenfew.llm.textvec import buffer_of, lowered

#: Results an item.
BEST = 10
#: Pairs of item and term in a block of items: what is broadcast at once.
PAIRS = 200_000
#: Postings and documents of a chunk at most (one document at least).
POSTINGS = 1 << 21
DOCUMENTS = 1 << 17
#: Documents of an interval that is scored at once, and intervals that are looked at in a round.
LEAF = 512
ROUND = 64
#: Steps down a treap until an interval's greatest impact is looked up in its list instead: ids in order of impact make a treap a chain.
STEPS = 48
#: Groups of tasks whose results are ranked first.
GROUPS = 256
_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of a string column, A-Z lower-cased, and the row of each."""
    data, offsets = buffer_of(column)
    data = lowered(data)
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)  # rows touch in the buffer
    edge[offsets] = True
    before, here = solid[:-1], solid[1:]
    start, end = np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[solid[1:-1]].tobytes())])
    return terms, np.searchsorted(offsets, start, "right") - 1


def item_terms(items: DataFrame) -> DataFrame:
    """Each item's terms: ``item_id, terms`` (binary, distinct)."""

    def run(column):
        terms, row = terms_of(column)
        bounds = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
        return (pa.ListArray.from_arrays(pa.array(bounds), terms.cast(pa.binary())),)

    each = append_arrow(items.select("item_id", "text"), "text", [("terms", "array<binary>")], run, ["item_id"])
    return each.select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(F.collect_list("term").alias("terms"))


def postings(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """``doc_id, n`` (terms with repeats), ``ids`` and ``counts``: which of ``terms`` (bounded) the document has, and how often."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(terms)

    def run(column):
        found, row = terms_of(column)
        at = pc.index_in(found, value_set=wanted.value.cast(pa.large_binary())).fill_null(-1).to_numpy(zero_copy_only=False)
        hit = at >= 0
        width = max(len(wanted.value), 1)
        code, count = np.unique(row[hit].astype(np.int64) * width + at[hit], return_counts=True)
        bounds = pa.array(np.searchsorted(code, np.arange(len(column) + 1, dtype=np.int64) * width).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (code % width, count)]
        return [pa.array(np.bincount(row, minlength=len(column)).astype(np.int64)), *lists]

    return append_arrow(docs.select("doc_id", "text"), "text", [("n", "long"), ("ids", "array<int>"), ("counts", "array<int>")], run, ["doc_id"])


def treaps(term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right children of each posting, and each term's root. Postings come by term and, within it, by document; a term's treap never leaves it.

    Of equal impacts the one whose place mixes higher is on top, so that copies make no chain.
    """
    place = np.arange(len(impact), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = ((impact << 16) | (place >> np.uint64(48)).astype(np.int64)).tolist()
    left, right = [-1] * len(key), [-1] * len(key)
    stack: list[int] = []
    roots: list[int] = []
    own = None
    for i, (t, k) in enumerate(zip(term.tolist(), key, strict=True)):
        if t != own:
            roots += stack[:1]
            stack, own = [], t
        last = -1
        while stack and key[stack[-1]] < k:
            last = stack.pop()
        left[i] = last
        if stack:
            right[stack[-1]] = i
        stack.append(i)
    return np.array(left, np.int32), np.array(right, np.int32), np.array(roots + stack[:1], np.int64)


class Chunk:
    """The inverted treaps of some documents."""

    def __init__(self, ids, unnamed, n, bounds, term, count, weight, documents, total):
        order = np.lexsort((ids, unnamed))
        self.ids, self.unnamed = ids[order], unnamed[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
        by = np.lexsort((place[doc], term))
        doc, self.term, count = doc[by], term[by].astype(np.int64), count[by].astype(np.int64)
        self.place, self.width = place[doc], max(len(ids), 1)
        length = 10 + (90 * n * documents) // max(total, 1)
        self.impact = weight[self.term] * ((1_000_000_000 * count) // (1000 * count + 8 * length[doc]))
        self.key = self.term * self.width + self.place
        self.left, self.right, roots = treaps(self.term, self.impact)
        self.first = np.searchsorted(self.term, np.arange(len(weight) + 1))
        self.top = np.full(len(weight), -1, np.int64)
        self.top[self.term[roots]] = roots

    def root(self, node, low, high):
        """The greatest posting of [low, high), from a ``node`` above it or in it; -1 in empty ranges."""
        node = np.where(low < high, node, -1)
        for _ in range(STEPS):
            out = np.nonzero((node >= 0) & ((node < low) | (node >= high)))
            if not len(out[0]):
                return node
            at = node[out]
            node[out] = np.where(at < low[out], self.right[at], self.left[at])
        for at in zip(*np.nonzero((node >= 0) & ((node < low) | (node >= high))), strict=True):
            node[at] = low[at] + np.argmax(self.impact[low[at] : high[at]])
        return node

    def search(self, terms: np.ndarray, best: tuple, k: int) -> tuple:
        """``best`` (scores, unnamed, ids; in order, ``k`` at most) and this chunk's documents together."""
        low, high = self.first[terms], self.first[terms + 1]
        low, high, terms = low[low < high], high[low < high], terms[low < high]
        if not len(terms):
            return best
        front = (np.zeros(1, np.int64), np.full(1, len(self.ids)), low[None], high[None], self.top[terms][None])
        bound = self.impact[front[4]].sum(axis=1)
        while len(bound):
            if len(best[0]) >= k:  # what can't enter goes
                last = (best[0][-1], best[1][-1], best[2][-1])
                begin = front[0]
                later = (self.unnamed[begin] > last[1]) | ((self.unnamed[begin] == last[1]) & (self.ids[begin] >= last[2]))
                keep = (bound > last[0]) | ((bound == last[0]) & ~later)
            else:
                keep = bound > 0
            front, bound = tuple(x[keep] for x in front), bound[keep]
            if not len(bound):
                break
            order = np.argsort(-bound, kind="stable")
            now, rest = order[:ROUND], order[ROUND:]
            begin, end, low, high, node = (x[now] for x in front)
            small = end - begin <= LEAF
            if small.any():
                best = self.scored(begin[small], low[small], high[small], best, k)
            front, bound = tuple(x[rest] for x in front), bound[rest]
            if not small.all():
                begin, end, low, high, node = (x[~small] for x in (begin, end, low, high, node))
                middle = (begin + end) // 2
                cut = np.searchsorted(self.key, terms[None] * self.width + middle[:, None])
                one = self.root(node, low, cut)
                two = self.root(node, cut, high)
                made = tuple(np.concatenate(x) for x in ((begin, middle), (middle, end), (low, cut), (cut, high), (one, two)))
                more = np.where(made[4] >= 0, self.impact[made[4]], 0).sum(axis=1)
                front, bound = tuple(np.concatenate(x) for x in zip(front, made, strict=True)), np.concatenate([bound, more])
        return best

    def scored(self, begin, low, high, best, k):
        size = (high - low).ravel()
        at = np.repeat(low.ravel() - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        leaf = np.repeat(np.repeat(np.arange(len(begin)), low.shape[1]), size)
        # sums stay far below 2**53, so doubles hold them exactly
        total = np.bincount(leaf * LEAF + self.place[at] - begin[leaf], self.impact[at], len(begin) * LEAF).astype(np.int64)
        found = np.flatnonzero(total >= max(1, best[0][-1] if len(best[0]) >= k else 1))
        doc = begin[found // LEAF] + found % LEAF
        score, unnamed, ids = (np.concatenate(x) for x in zip(best, (total[found], self.unnamed[doc], self.ids[doc]), strict=True))
        order = np.lexsort((ids, unnamed, -score))[:k]
        return score[order], unnamed[order], ids[order]


def best_of(chunks, items: list[np.ndarray], weight: np.ndarray, documents: int, total: int, k: int):
    """The best ``k`` of each item over chunks of (ids, unnamed, n, bounds, term, count)."""
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    best = [none] * len(items)
    for chunk in chunks:
        index = Chunk(*chunk, weight, documents, total)
        best = [index.search(terms, b, k) for terms, b in zip(items, best, strict=True)]
    return best


def chunked(batches):
    """Arrow batches of ``doc_id, n, ids, counts`` as chunks of bounded size."""

    def joined(rows):
        ids = np.concatenate([r.column(0).fill_null(0).to_numpy() for r in rows])
        unnamed = np.concatenate([r.column(0).is_null().to_numpy(zero_copy_only=False) for r in rows])
        sizes = np.concatenate([pc.list_value_length(r.column(2)).to_numpy() for r in rows])
        values = [np.concatenate([r.column(i).flatten().to_numpy() for r in rows]) for i in (2, 3)]
        return ids.astype(np.int64), unnamed, np.concatenate([r.column(1).to_numpy() for r in rows]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), *values

    held, docs, size = [], 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            end = min(int(np.searchsorted(sizes, done + POSTINGS - size, "right")), at + DOCUMENTS - docs, batch.num_rows)
            if end <= at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                docs, size = docs + end - at, size + int(sizes[end - 1]) - done
            if end < batch.num_rows:
                yield joined(held)
                held, docs, size = [], 0, 0
            at = max(end, at)
    if held:
        yield joined(held)


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` documents (``doc_id, text``) of highest score above 0 for each item (``item_id, text``): ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = staged(item_terms(items), "items")
    pairs = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // PAIRS)
    found = [_block(docs, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), kind, k) for b in range(blocks)]
    empty = spark.createDataFrame([], f"item_id {kind}, score long, doc_id long, part int")
    rows = empty
    for more in found:
        rows = rows.unionAll(more)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: DataFrame, kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    held = items.toArrow()
    names, lists = held.column("item_id").combine_chunks(), held.column("terms").combine_chunks()
    terms = pc.unique(lists.flatten()).cast(pa.binary())
    at = pc.index_in(lists.flatten().cast(pa.binary()), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    each = [at[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    rows = staged(postings(docs, terms), "postings")
    documents, total = rows.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    documents, total = documents or 0, total or 0
    # at most one row a term of the block
    df = rows.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = df.withColumn("w", F.floor(1000 * F.log((F.lit(2 * documents + 2) / (2 * F.col("df") + 1)).cast("double")))).select("term", "w").toArrow()
    weight = np.zeros(len(terms), np.int64)
    weight[weights.column("term").to_numpy()] = weights.column("w").to_numpy()
    sent = spark.sparkContext.broadcast((names, each, weight))

    def run(batches):
        names, each, weight = sent.value
        best = best_of(chunked(batches), each, weight, documents, total, k)
        item = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        if len(item):
            score, unnamed, ids = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(score), pa.array(ids, mask=unnamed)], names=["item_id", "score", "doc_id"])
        release()

    made = rows.where(F.size("ids") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "n", "ids", "counts").mapInArrow(run, f"item_id {kind}, score long, doc_id long")
    return made.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten documents of highest score."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"unnest(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = rf"""
WITH tokens AS (SELECT doc_id, {_TERMS} AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM lengths),
wanted AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM wanted JOIN counts c USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, c.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 10
"""
