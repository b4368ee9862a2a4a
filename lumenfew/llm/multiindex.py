"""Approximate nearest neighbours by inner product, with an inverted multi-index.

1. Codebooks. The halves of the vectors are quantised separately, by k-means on at most
   ``SAMPLE`` vectors (a bounded sample by hash, the only thing that is fitted on less than all
   rows). Every row is indexed: its cell is the pair of its halves' centroids. A cell's rows
   are packed in lists of about ``PART`` rows, so a crowded cell is many lists.
2. Traversal. A query meets pairs of centroids in order of their summed inner products, taken from
   a heap over the two sorted lists of centroids, until their cells hold ``NEAR`` rows. These are
   reranked: the query has a ``k``-th best score.
3. It goes on down the pairs as far as a row can be expected to reach that score. How far follows
   from the query's own regression of summed centroid products on true products over
   ``CALIBRATE`` sampled rows: down to ``MARGIN`` standard deviations below what a row of that score has
   on average. So few cells are met where the data have structure, and most of them where
   they have none (directions drawn at random).
4. Reranking. Every row of a met cell is compared by its original vector. A pair of centroids is
   met exactly if its sum is at least the query's stop, so a list knows its queries without a
   join: queries go out in blocks of bounded bytes, and a task keeps the best ``k`` of each over
   all its lists. No row, cell or partner is capped.

Of rows with one and the same vector a list keeps the ``k`` + 1 least ids: no query can show more
of them. Scores are summed from the first component to the last in doubles.

Defined cases: rows with a null id, and vectors that are null, zero, or hold a null or non-finite
component, take no part. Shorter vectors count as if they ended in zeros. A row is no partner of
rows with its id; repeated rows are queries of their own, as partners they count once. Equal
scores are ordered by id. A table of one row, or an empty one, gives no row. Further columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import release, staged, table
from lumenfew.llm.vectors import finite, groups, matrix, row_limit, width

#: Neighbours a query.
NEIGHBOURS = 20
#: Rows, and bytes, that the codebooks are fitted on at most; rounds of k-means.
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
ROUNDS = 10
#: Rows a cell on average, and centroids a half at most: a million cells.
PER_CELL = 50
CENTROIDS = 1024
#: Rows that a query meets at least, sampled rows that its margin follows, and the margin.
NEAR = 1000
CALIBRATE = 2048
MARGIN = 1.75
#: Rows of a list, about.
PART = 512
#: Bytes of queries that are broadcast at once, and of centroid products that a task keeps.
BLOCK_BYTES = 16 << 20
KEPT_BYTES = 64 << 20
#: Queries whose margins are worked out at once.
QUERIES = 1024
#: Groups of tasks whose results are ranked first.
GROUPS = 256


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids, or one for each distinct row if those are fewer."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centre = distinct[np.random.default_rng(0).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centre)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, column, k) for column in x.T], axis=1) if x.shape[1] else np.zeros((k, 0))
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in parts of bounded size."""
    size = (centre**2).sum(axis=1)
    part = max(1, (8 << 20) // (8 * max(len(centre), 1)))
    return np.concatenate([np.zeros(0, np.int64), *((size - 2 * x[i : i + part] @ centre.T).argmin(axis=1) for i in range(0, len(x), part))])


@dataclass
class Codebooks:
    wide: int
    first: np.ndarray  #: centroids of the first half
    second: np.ndarray
    ids: np.ndarray  #: sampled rows, for the margins
    rows: np.ndarray
    cells: np.ndarray

    @property
    def cut(self) -> int:
        return self.wide // 2

    def cell(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.cut], self.first) * len(self.second) + nearest(x[:, self.cut :], self.second)

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, : self.cut] @ self.first.T, q[:, self.cut :] @ self.second.T

    def margins(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (slope, offset): slope * score + offset is the least summed product that its rows of this score are looked for at."""
        one, two = self.products(q)
        s, m = q @ self.rows.T, one[:, self.cells // len(self.second)] + two[:, self.cells % len(self.second)]
        w = (self.ids[None] != ids[:, None]).astype(float)
        n = np.maximum(w.sum(axis=1), 1)
        mean = lambda v: (v * w).sum(axis=1) / n
        ms, mm = mean(s), mean(m)
        ds, dm = s - ms[:, None], m - mm[:, None]
        var, both = mean(ds * ds), mean(ds * dm)
        slope = np.where(var > 0, both / np.where(var > 0, var, 1), 0)
        rest = np.sqrt(np.maximum(mean(dm * dm) - slope * both, 0))
        return slope, mm - slope * ms - MARGIN * rest


def traversed(one: np.ndarray, two: np.ndarray, counts: np.ndarray, near: int) -> float:
    """The summed product of the last pair that a query takes from the heap until its cells hold ``near`` rows; minus infinity if all together don't."""
    a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
    x, y = one[a].tolist(), two[b].tolist()
    heap, begun, held = [(-(x[0] + y[0]), 0, 0)], 0, 0
    while heap:
        total, i, j = heapq.heappop(heap)
        held += int(counts[a[i], b[j]])
        if held >= near:
            return -total
        if j == 0 and i == begun and i + 1 < len(x):  # a row of pairs begins when the one above has
            begun = i + 1
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
    return -np.inf


def fit(rows: DataFrame, wide: int) -> tuple[Codebooks, int]:
    """Codebooks of ``vec_id, embedding``, and the number of rows."""
    n = rows.count()
    most = row_limit(wide, SAMPLE, SAMPLE_BYTES)
    share = min(1.0, most / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct().limit(2 * most)
    held = drawn.toArrow().combine_chunks()
    ids = held.column(0).to_numpy().astype(np.int64)
    x = np.concatenate([np.zeros((0, wide)), *(matrix(c, wide) for c in held.column(1).chunks)])
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    k = int(min(max(round((n / PER_CELL) ** 0.5), 2), CENTROIDS))
    books = Codebooks(wide, k_means(x[:, : wide // 2], k), k_means(x[:, wide // 2 :], k), ids, x, np.zeros(0, np.int64))
    some = np.random.default_rng(1).permutation(len(x))[:CALIBRATE]
    books.ids, books.rows = ids[some], x[some]
    books.cells = books.cell(books.rows)
    return books, n


def indexed(rows: DataFrame, books: Codebooks, k: int) -> tuple[DataFrame, np.ndarray]:
    """Every row's vector in the lists of its cell (staged: ``cell, ids, vectors``), and the rows of each cell."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    kind = rows.schema["embedding"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            cell = sent.value.cell(matrix(b.column(1), sent.value.wide))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", "vec_id", "embedding"])
        release()

    own = staged(rows.mapInArrow(assign, f"cell long, vec_id long, embedding {kind}"), "cells")
    # one row a cell at most: a million
    held = own.groupBy("cell").count().toArrow()
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    counts[held.column(0).to_numpy()] = held.column(1).to_numpy()
    full = np.flatnonzero(counts > PART)
    parts = spark.createDataFrame(pa.table({"cell": full, "parts": -(-counts[full] // PART)}))
    dealt = own.join(F.broadcast(parts), "cell", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))).drop("parts")

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column("vec_id").to_numpy()
        x = np.concatenate([matrix(c, sent.value.wide) for c in group.column("embedding").chunks])
        same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        ids, same, x = ids[order], same[order], x[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])
        ids, same, x = ids[fresh], same[fresh], x[fresh]
        keep = np.arange(len(ids)) - np.searchsorted(same, same) <= k
        return pa.table({"cell": pa.array([group.column("cell")[0].as_py()], pa.int64()), "ids": pa.array([ids[keep].astype(np.int64).tobytes()]), "vectors": pa.array([x[keep].tobytes()])})

    return staged(dealt.groupBy("cell", "part").applyInArrow(pack, "cell long, ids binary, vectors binary"), "lists"), counts.reshape(len(books.first), len(books.second))


def planned(queries: DataFrame, books: Codebooks, counts: np.ndarray) -> DataFrame:
    """Each query with the stop of its first traversal and its margin: ``vec_id, embedding, stop, slope, offset`` (staged)."""
    sent = queries.sparkSession.sparkContext.broadcast((books, counts))
    kind = queries.schema["embedding"].dataType.simpleString()

    def run(batches):
        books, counts = sent.value
        for b in (part for held in groups(batches, QUERIES) for part in held):
            q = matrix(b.column(1), books.wide)
            one, two = books.products(q)
            stop = np.array([traversed(x, y, counts, NEAR) for x, y in zip(one, two, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(stop), *map(pa.array, books.margins(b.column(0).to_numpy(), q))], names=["vec_id", "embedding", "stop", "slope", "offset"])
        release()

    return staged(queries.mapInArrow(run, f"vec_id long, embedding {kind}, stop double, slope double, offset double"), "queries")


class Best:
    """The best ``k`` partners of each query so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.own, self.q, self.k = ids, q, k
        self.norms = np.sqrt((q**2).sum(axis=1))
        self.score, self.partner = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, who: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        about = self.q[who] @ x.T
        last = self.score[who, -1]
        slack = 1e-9 * self.norms[who] * np.sqrt((x**2).sum(axis=1).max(initial=0))
        row, at = np.nonzero((about >= (last - slack)[:, None]) & (ids[None] != self.own[who][:, None]))
        if not len(row):
            return
        score = np.zeros(len(row))
        for c in range(x.shape[1]):  # from the first component to the last, whatever the batch
            score += self.q[who[row], c] * x[at, c]
        met = np.unique(row)
        old = self.score[who[met]] > -np.inf
        query = np.concatenate([np.repeat(met, old.sum(axis=1)), row])
        score, partner = np.concatenate([self.score[who[met]][old], score]), np.concatenate([self.partner[who[met]][old], ids[at]])
        order = np.lexsort((partner, -score, query))
        query, score, partner = query[order], score[order], partner[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (partner[1:] != partner[:-1])
        query, score, partner = query[fresh], score[fresh], partner[fresh]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.score[who[query[keep]], rank[keep]], self.partner[who[query[keep]], rank[keep]] = score[keep], partner[keep]


def met(lists: DataFrame, books, block, k: int) -> DataFrame:
    """The best ``k`` over all lists of a block of queries (broadcast: ids, vectors, stops): ``asked, rank, partner, score``."""

    def run(batches):
        ids, q, stop = block.value
        own, half, seconds = Best(ids, q, k), books.value.cut, len(books.value.second)
        kept: dict[tuple[int, int], np.ndarray] = {}

        def product(side: int, i: int) -> np.ndarray:
            if (side, i) not in kept:
                if len(kept) * max(len(q), 1) * 8 > KEPT_BYTES:
                    kept.clear()
                kept[side, i] = q[:, half:] @ books.value.second[i] if side else q[:, :half] @ books.value.first[i]
            return kept[side, i]

        for b in batches:
            for cell, names, vectors in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                who = np.flatnonzero(product(0, cell // seconds) + product(1, cell % seconds) >= stop)
                if len(who):
                    names = np.frombuffer(names, np.int64)
                    own.meet(who, names, np.frombuffer(vectors).reshape(len(names), books.value.wide))
        asked, place = np.nonzero(own.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(own.partner[asked, place]), pa.array(own.score[asked, place])], names=["asked", "partner", "score"])
        release()

    rows = lists.mapInArrow(run, "asked long, partner long, score double").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for by in (["asked", "part"], ["asked"]):  # a repeated row may stand in several lists
        rows = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "partner"))).where(F.col("rank") <= k)
    return rows.select("asked", "rank", "partner", "score").distinct()


def neighbours(rows: DataFrame, asked: Column, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest found rows (``vec_id, embedding``) of each row that ``asked`` holds for: ``query_id, rank, vec_id, score``."""
    spark = rows.sparkSession
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    wide = width(kept, "embedding")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books, n = fit(kept, wide)
    if n == 0:
        return out
    lists, counts = indexed(kept, books, k)
    queries = planned(kept.where(asked), books, counts)
    sent = spark.sparkContext.broadcast(books)
    blocks = -(-queries.count() * wide * 8 // BLOCK_BYTES)
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = own.column(0).to_numpy()
        q = np.concatenate([np.zeros((0, wide)), *(matrix(c, wide) for c in own.column(1).chunks)])
        stop, slope, offset = (own.column(i).to_numpy() for i in (2, 3, 4))
        first = met(lists, sent, spark.sparkContext.broadcast((ids, q, stop)), k)
        last = first.where(F.col("rank") == k).select("asked", "score").toArrow()  # one row a query of the block
        further = np.full(len(ids), -np.inf)
        at = last.column(0).to_numpy()
        further[at] = np.minimum(stop[at], slope[at] * last.column(1).to_numpy() + offset[at])
        found = met(lists, sent, spark.sparkContext.broadcast((ids, q, further)), k)
        names = spark.createDataFrame(pa.table({"asked": np.arange(len(ids)), "query_id": ids}))
        out = out.unionAll(found.join(F.broadcast(names), "asked").select("query_id", "rank", F.col("partner").alias("vec_id"), "score"))
    return out


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth row's 20 nearest others."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The exact search. Queries meet ``NEAR`` rows at least, so on tables of up to so many rows the index finds the same.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id)::INTEGER AS rank,
       b.vec_id AS vec_id, list_inner_product(a.e, b.e) AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
QUALIFY rank <= 20
"""
