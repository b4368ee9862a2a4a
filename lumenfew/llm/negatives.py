"""Hard-negative mining by ball-tree branch and bound on integer inner products.

1. Trees. Rows are taken where they lie, in shards of bounded bytes; each shard becomes a tree
   whose nodes hold a centre, a radius and the range of their labels. Nodes of several labels
   are cut between labels, others at the median of their widest component. The trees are
   written once to the shared folder.
2. Positives. Anchors are taken in blocks of bounded bytes; a block is broadcast and meets all
   trees. A node's centre and radius bound its inner products with an anchor above and below;
   a node is left if its labels don't suit or its upper bound is strictly beneath the score
   that is the last of the anchor's best so far.
3. Negatives. Each (anchor, positive) asks again with the window of scores that the positive
   sets: nodes whose bounds lie outside the window, or strictly beneath the last of the best
   so far, are left.
4. The best of all tasks are ranked, first among groups of tasks, then over all.

Products of whole numbers below 2**53 are exact in doubles; tables with larger ones are
multiplied as 64-bit integers, which every product has to fit.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part. Shorter vectors count as if they ended in zeros; an empty vector scores 0 with all. Rows
that share an id are rows of their own (each an anchor, if its id is one), but no row is a
partner of one with its id. Equal scores are ordered by id. An anchor without a positive, and a
positive without a negative, give no row; nor does an empty table. Further columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import release, staged, table
from lumenfew.llm.vectors import finite, groups, matrix, row_limit, width

#: Rows and bytes of a shard at most, and rows of a leaf.
SHARD = 1 << 14
SHARD_BYTES = 16 << 20
LEAF = 64
#: Bytes of anchors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Groups of tasks whose results are ranked first.
GROUPS = 256
#: Doubles hold whole numbers up to here.
EXACT = 1 << 53
_TREE = "rows long, wide long, ids binary, labels binary, vectors binary, centres binary, radii binary, nodes binary"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x); rows beyond 64 bits are an error."""
    out = np.floor(scale * x)
    if len(out) and np.abs(out).max(initial=0) >= 2.0**63:
        raise ValueError("a scaled component does not fit 64 bits")
    return out.astype(np.int64)


def grown(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree: rows in the order of its leaves, and nodes (start, end, left, right, least label, greatest label)."""
    order = np.lexsort((ids, labels))
    ids, labels, rows = ids[order], labels[order], rows[order]
    points = rows.astype(np.float64)
    place = np.arange(len(ids))
    nodes, centres, radii = [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        own = place[start:end]
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        x = points[own]
        centre = x.mean(axis=0)
        nodes.append([start, end, -1, -1, labels[own].min(), labels[own].max()])
        centres.append(centre)
        radii.append(np.sqrt(((x - centre) ** 2).sum(axis=1).max()) * (1 + 1e-9))
        if end - start <= LEAF:
            continue
        if nodes[-1][4] < nodes[-1][5]:
            # own is still in order of labels: the boundary between labels nearest to the middle
            edges = np.flatnonzero(np.diff(labels[own])) + 1
            cut = int(edges[np.argmin(np.abs(edges - len(own) // 2))])
        else:
            axis = int(np.argmax(x.var(axis=0))) if x.shape[1] else 0
            cut = len(own) // 2
            if x.shape[1]:
                place[start:end] = own[np.argpartition(x[:, axis], cut)]
        todo += [(start, start + cut, len(nodes) - 1, 0), (start + cut, end, len(nodes) - 1, 1)]
    return {"ids": ids[place], "labels": labels[place], "vectors": rows[place], "centres": np.array(centres), "radii": np.array(radii), "nodes": np.array(nodes, np.int64)}


def trees(rows: DataFrame, scale: float = 1.0, wide: int | None = None) -> DataFrame:
    """``vec_id, label, embedding`` as staged ball trees, one row a shard."""
    wide = width(rows, "embedding") if wide is None else wide
    limit = row_limit(wide, SHARD, SHARD_BYTES)

    def run(batches):
        for held in groups(batches, limit):
            part = pa.Table.from_batches(held).combine_chunks()
            ids, labels = (part.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            made = grown(ids, labels, whole(np.concatenate([matrix(c, wide) for c in part.column(2).chunks]), scale))
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)]), pa.array([wide]), *(pa.array([made[k].tobytes()], pa.binary()) for k in ("ids", "labels", "vectors", "centres", "radii", "nodes"))], names=[f.split()[0] for f in _TREE.split(", ")])
        release()

    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    return staged(kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, _TREE), "trees")


class Tree:
    def __init__(self, row: dict):
        n, wide = row["rows"], row["wide"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(n, wide)
        self.nodes, self.radii = np.frombuffer(row["nodes"], np.int64).reshape(-1, 6), np.frombuffer(row["radii"])
        self.centres = np.frombuffer(row["centres"]).reshape(len(self.nodes), wide)
        self.most = int(np.abs(self.vectors).max(initial=0))
        self.points = self.vectors.astype(np.float64)


class Asked:
    """Questions to the trees: vectors, own ids and labels, whether partners share the label, and windows of scores; their best so far."""

    def __init__(self, vectors, ids, labels, same: bool, k: int, low=None, high=None):
        self.vectors, self.ids, self.labels, self.same = vectors, ids, labels, same
        self.low = np.full(len(ids), _LEAST) if low is None else low
        self.high = np.full(len(ids), _MOST) if high is None else high
        self.points = vectors.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(axis=1))
        self.most = int(np.abs(vectors).max(initial=0))
        self.score, self.partner = np.full((len(ids), k), _LEAST), np.full((len(ids), k), _MOST)
        self.full = np.zeros(len(ids), np.int64)

    def ask(self, tree: Tree) -> None:
        exact = self.most * tree.most * max(tree.vectors.shape[1], 1) < EXACT
        todo = [(0, np.arange(len(self.ids)))]
        while todo:
            node, who = todo.pop()
            start, end, left, right, least, greatest = tree.nodes[node]
            own = self.labels[who]
            who = who[(own >= least) & (own <= greatest) if self.same else (own != least) | (own != greatest)]
            centre = self.points[who] @ tree.centres[node]
            reach = self.norms[who] * tree.radii[node]
            slack = 0.5 + 1e-9 * (np.abs(centre) + reach)
            floor = np.maximum(self.low[who], self.score[who, -1]).astype(np.float64)
            near = (centre + reach + slack >= floor) & (centre - reach - slack <= self.high[who].astype(np.float64))
            who = who[near]
            if not len(who):
                continue
            if left < 0:
                self.leaf(tree, start, end, who, exact)
                continue
            # the side that promises more, on the whole, first
            first, second = (self.points[who] @ tree.centres[[left, right]].T).mean(axis=0)
            todo += [(int(right), who), (int(left), who)] if first >= second else [(int(left), who), (int(right), who)]

    def leaf(self, tree: Tree, start: int, end: int, who: np.ndarray, exact: bool) -> None:
        if exact:
            score = np.rint(self.points[who] @ tree.points[start:end].T).astype(np.int64)
        else:
            score = self.vectors[who] @ tree.vectors[start:end].T
        ids, labels = tree.ids[start:end], tree.labels[start:end]
        fits = (labels[None] == self.labels[who][:, None]) == self.same
        fits &= (ids[None] != self.ids[who][:, None]) & (score >= self.low[who][:, None]) & (score <= self.high[who][:, None])
        last, partner = self.score[who, -1][:, None], self.partner[who, -1][:, None]
        fits &= (score > last) | ((score == last) & (ids[None] < partner)) | (self.full[who] < self.score.shape[1])[:, None]
        some = fits.any(axis=1)
        who, fits, score = who[some], fits[some], score[some]
        if not len(who):
            return
        k = self.score.shape[1]
        # absent entries: the least score with the greatest id, after all others
        score = np.concatenate([self.score[who], np.where(fits, score, _LEAST)], axis=1)
        ids = np.concatenate([self.partner[who], np.where(fits, ids[None], _MOST)], axis=1)
        there = np.concatenate([np.arange(k)[None] < self.full[who][:, None], fits], axis=1)
        order = np.lexsort((ids, -score, ~there), axis=1)[:, :k]
        self.full[who] = np.minimum(self.full[who] + fits.sum(axis=1), k)
        self.score[who], self.partner[who] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def found(self) -> pa.RecordBatch:
        """``asked, score, partner`` rows."""
        here = np.arange(self.score.shape[1])[None] < self.full[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.nonzero(here)[0]), pa.array(self.score[here]), pa.array(self.partner[here])], names=["asked", "score", "partner"])


def best(index: DataFrame, make, k: int) -> DataFrame:
    """The best ``k`` partners over all trees of what ``make()`` asks: ``asked, rank, score, partner``."""

    def run(batches):
        asked = make()
        for batch in batches:
            for i in range(batch.num_rows):
                asked.ask(Tree({n: batch.column(n)[i].as_py() for n in batch.schema.names}))
        yield asked.found()
        release()

    rows = index.mapInArrow(run, "asked long, score long, partner long").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    order = (F.col("score").desc(), F.col("partner"))
    for by in (["asked", "part"], ["asked"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("asked", "rank", "score", "partner")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: float = 1.0) -> DataFrame:
    """For each row of ``vec_id, label, embedding`` that ``anchor`` holds for, and each of its first ``positives`` partners of the
    same label: its first ``negatives`` partners of other labels with window[0] * positive <= 100 * negative <= window[1] * positive.

    Gives ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    spark = rows.sparkSession
    wide = width(rows, "embedding")
    index = trees(rows, scale, wide)
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding") & anchor)
    kept = staged(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"), "anchors")
    blocks = -(-kept.count() * max(wide, 1) * 8 // BLOCK_BYTES)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for b in range(blocks):
        # a block has its share of rows by place, not by id: rows that share an id are spread too
        own = kept.where(F.pmod(F.xxhash64("vec_id", "label", "embedding", F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(blocks)) == b)
        out = out.unionAll(_block(spark, own, index, wide, positives, negatives, window, scale))
    return out


def _block(spark: SparkSession, anchors: DataFrame, index: DataFrame, wide: int, positives: int, negatives: int, window: tuple[int, int], scale: float) -> DataFrame:
    held = anchors.toArrow().combine_chunks()
    ids, labels = (held.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    vectors = whole(np.concatenate([np.zeros((0, wide)), *(matrix(c, wide) for c in held.column(2).chunks)]), scale)
    sent = spark.sparkContext.broadcast((vectors, ids, labels))

    def nearest() -> Asked:
        return Asked(*sent.value, True, positives)

    # at most ``positives`` rows an anchor of the block
    found = best(index, nearest, positives).toArrow()
    at, score, partner = (found.column(n).to_numpy() for n in ("asked", "score", "partner"))
    low = np.array([-(-window[0] * int(s) // 100) for s in score], np.int64)
    high = np.array([window[1] * int(s) // 100 for s in score], np.int64)
    open_ = low <= high
    at, score, partner, low, high = at[open_], score[open_], partner[open_], low[open_], high[open_]
    windows = spark.sparkContext.broadcast((at, low, high))

    def between() -> Asked:
        at, low, high = windows.value
        vectors, ids, labels = (x[at] for x in sent.value)
        return Asked(vectors, ids, labels, False, negatives, low, high)

    pairs = spark.sparkContext.broadcast((ids[at], partner, score))

    def named(batches):
        for b in batches:
            i = b.column(0).to_numpy()
            own, positive, top = (x[i] for x in pairs.value)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(positive), b.column(1), b.column(3), pa.array(top), b.column(2)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return best(index, between, negatives).mapInArrow(named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row's hard negatives, beside each of its first five rows of the same label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, scale=256.0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
