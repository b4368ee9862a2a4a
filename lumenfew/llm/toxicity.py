"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents (P) and unlabelled ones (U) only; U is every
training document, its label hidden if it has one. Its
linear score over hashed words and word beginnings is fitted by minimising the risk
``pi * E_P[l(+)] + max(0, E_U[l(-)] - pi * E_P[l(-)])`` with class prior ``pi`` (the
share of toxic rows among the labels of the training folds). When the second part falls
below zero its gradient is reversed, as in the non-negative estimator, which stops the
unlabelled toxic documents from being learned as clean.

The risk is minimised on at most ``POSITIVES`` and ``UNLABELLED`` rows, by the hash of their
ids, one row an id, as far as the features of each side take ``BYTES``. How many documents of U have a feature, which scales it, and the scores that settle
the bias are counted over all training text.

Defined cases: null and empty texts get the score of the bias alone; with no toxic
training row every score is 0; repeated rows are scored alike; of rows that share an id
(ties) the one whose features come first can be fitted on; very long texts are read whole; an
empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, crc_of_id, session, staged, table
from lumenfew.llm.textvec import lowered, mix, per_doc_sum, slices, words_of

#: Rows on which the risk is minimised at most.
POSITIVES = 3000
UNLABELLED = 8000
#: Bytes of features that a side's rows bring to the driver at most.
BYTES = 128 << 20
BUCKETS = 1 << 20
FOLDS = 5
#: Documents of P that a feature needs.
LEAST = 3
#: Bins of a unit of the score, and the score (before the bias) from which all are in one bin.
BINS, TOP = 256, 120
#: Bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def buckets_of(words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs, sorted: which features a document has."""
    span = words.hasher(lowered(words.data))
    doc, found = [], []
    for k in (0, *BEGINNINGS):
        end = np.minimum(words.start + k, words.end) if k else words.end
        longer = words.end - words.start > k if k else np.ones(len(end), bool)
        h = mix(span(words.start[longer], end[longer]) + np.uint64(k * 1_000_003))
        found.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        doc.append(words.doc[longer])
    pairs = np.unique(np.concatenate(doc) * BUCKETS + np.concatenate(found)) if doc else np.zeros(0, np.int64)
    return pairs // BUCKETS, pairs % BUCKETS


def _features(column: pa.Array):
    doc, bucket = buckets_of(words_of(column))
    bounds = np.searchsorted(doc, np.arange(len(column) + 1))
    return (pa.array([bucket[i:j].astype(np.int32).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 200, rate: float = 0.05, decay: float = 3e-4, seen: tuple[np.ndarray, int] | None = None) -> Model:
    """Minimise the non-negative risk with logistic loss; each feature is scaled by its log-odds in P against U.

    The decay is the one of least log loss among 3e-5 to 1e-2 on a fifth of the training rows held out of training.

    ``seen``: how many of all documents of U have each bucket, and their number (those of ``unlabelled`` by default).
    """
    if not positive or not unlabelled or prior <= 0:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    prior = min(prior, 0.95)
    seen_p = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    seen_u, n_u = seen or (np.bincount(np.concatenate(unlabelled), minlength=BUCKETS), len(unlabelled))
    odds = np.log((seen_p + 0.5) / (len(positive) + 1)) - np.log((seen_u + 0.5) / (n_u + 1))
    spread = np.sqrt(1 / (seen_p + 0.5) + 1 / (seen_u + 0.5))
    scale = np.where((seen_p >= LEAST) & (odds > 2.5 * spread) & (odds > 0.4), odds, 0.0)
    used = np.flatnonzero(scale)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))

    def packed(docs):
        own = [place[d][place[d] >= 0] for d in docs]
        return np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate(own) if own else np.zeros(0, int), len(own)

    sides = [packed(positive), packed(unlabelled)]
    w, b = np.full(len(used), 0.5), -2.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = (np.bincount(row, (w * scale[used])[at], n) + b for row, at, n in sides)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gain_p, gain_u = prior * (sigmoid(zp) - 1) / len(zp), sigmoid(zu) / len(zu)
        lost_p = -prior * sigmoid(zp) / len(zp)
        gp, gu = (gain_p + lost_p, gain_u) if rest >= 0 else (-lost_p, -gain_u)
        grad = np.zeros(len(used) + 1)
        for g, (row, at, _) in ((gp, sides[0]), (gu, sides[1])):
            grad[:-1] += np.bincount(at, g[row], len(used)) * scale[used]
            grad[-1] += g.sum()
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    z = np.bincount(sides[1][0], (w * scale[used])[sides[1][1]], sides[1][2])
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * scale[used]
    return Model(weights, settled_bias(z, np.ones(len(z)), prior))


def settled_bias(z: np.ndarray, n: np.ndarray, prior: float) -> float:
    """The bias at which U has as many toxic documents as the prior says; ``n`` documents have the score ``z`` without a bias."""
    low, high = -float(TOP), 30.0
    for _ in range(60):
        b = (low + high) / 2
        low, high = (b, high) if np.average(1 / (1 + np.exp(-np.clip(z + b, -30, 30))), weights=n) < prior else (low, b)
    return float(b)


def raw_scores(weights: np.ndarray, column) -> np.ndarray:
    """The scores without the bias."""
    doc, bucket = buckets_of(words_of(column))
    return per_doc_sum(weights[bucket], np.searchsorted(doc, np.arange(len(column) + 1)))


def _counted(rows: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``of(texts)`` (integers, few of them) over all rows, and how often each occurs."""

    def run(batches):
        total = {}
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                for v, n in zip(*(x.tolist() for x in np.unique(of(part.column("text")), return_counts=True)), strict=True):
                    total[v] = total.get(v, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["v", "n"])

    found = rows.select("text").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()
    return np.array([r.v for r in found], np.int64), np.array([r.n for r in found], np.int64)


def sampled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``doc_id, y, buckets`` of the chosen ids, one row an id, by the hash of the id up to ``BYTES`` a side."""
    made = append_arrow(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", [("buckets", "binary")], _features, keep=["doc_id", "y"])
    rows = staged(made.groupBy("doc_id", "y").agg(F.min("buckets").alias("buckets")), "features")
    in_turn = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    upto = rows.select("doc_id", "y", F.sum(F.octet_length("buckets").cast("long")).over(in_turn).alias("upto"))  # POSITIVES + UNLABELLED rows at most
    return rows.join(F.broadcast(upto.where(F.col("upto") <= BYTES).select("doc_id", "y")), ["doc_id", "y"])


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """Fit from rows whose crc32(doc_id) modulo ``folds`` is not 0."""
    ids = lambda df: df.where("doc_id is not null").where(crc_of_id() % folds != 0)
    known = ids(labels).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    some = lambda df, n, y: df.select("doc_id", F.lit(y).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    free = ids(docs.select("doc_id")).distinct()
    chosen = some(known.where("y = 1"), POSITIVES, 1).unionAll(some(free, UNLABELLED, 0))
    rows = sampled(docs, chosen).collect()
    side = {y: [np.frombuffer(r.buckets, np.int32) for r in sorted(rows, key=lambda r: (r.doc_id, r.buckets)) if r.y == y] for y in (0, 1)}
    if not side[1] or share <= 0:
        return fit(side[1], side[0], share)
    every = ids(docs.select("doc_id", "text"))
    spread = session(docs.sparkSession).sparkContext.broadcast
    asked = spread(np.bincount(np.concatenate(side[1]), minlength=BUCKETS) >= LEAST)  # no other bucket can be a feature

    def features(column):
        """The asked buckets of each document, and BUCKETS for each document."""
        _, bucket = buckets_of(words_of(column))
        return np.concatenate([bucket[asked.value[bucket]], np.full(len(column), BUCKETS)])

    bucket, n = _counted(every, features)
    seen = np.zeros(BUCKETS + 1, np.int64)
    seen[bucket] = n
    model = fit(side[1], side[0], share, seen=(seen[:-1], int(seen[-1])))
    weights = spread(model.weights)
    z, n = _counted(every, lambda column: np.rint(np.minimum(raw_scores(weights.value, column), TOP) * BINS).astype(np.int64))
    return Model(model.weights, settled_bias(z / BINS, n, min(share, 0.95)))


def apply(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(column):
        z = raw_scores(shared.value.weights, column) + shared.value.bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p, (p >= 0.5).astype(np.int32)

    return append_arrow(docs, "text", [("score", "double"), ("predicted", "int")], score, keep)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each document; rows with crc32(doc_id) modulo 5 equal to 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return apply(docs, model, keep=["doc_id"]).withColumn("held_out", crc_of_id() % FOLDS == 0)
