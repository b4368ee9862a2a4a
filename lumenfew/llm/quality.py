"""Quality rules: heuristics and a calibrated logistic regression over hashed n-grams.

``train`` fits hashed word 1-2-grams and byte 4-grams (mean-pooled, so length does not
matter) on at most ``SAMPLE`` labelled rows, chosen by the hash of their ids, and
calibrates the logit on a fifth of them (Platt). ``apply`` scores whole texts in Arrow
batches and compares the probability with a fixed threshold.

A text's n-grams are its own: a score doesn't depend on the texts that share its batch.
Training gathers one row a labelled id, of at most 8 bytes a bucket: 2 MB a row whatever
the text's length, ``SAMPLE`` rows.

Defined cases: a null or empty text has no words, so the base rules reject it; without
labelled rows of both classes the model is neutral and only the base rules decide; an
empty table gives no rows; very long texts count and score whole; of rows that share a
labelled id the one with the least features trains; equal texts get equal results; other
columns pass through, but those named like a result are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, release, table
from lumenfew.llm.textvec import mix, per_doc_sum, words_of

#: Labelled rows used for training at most.
SAMPLE = 2500
#: Hash buckets of the model.
BUCKETS = 1 << 18
#: Least calibrated probability of quality 1 that keeps a document.
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("quality", "double"), ("kept", "boolean")]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logit + self.bias) + self.shift, -30, 30)))


def _inner(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``n`` neighbours (by their first) lie within one document, and where each document's kept ones begin."""
    size = np.diff(bounds)
    keep = np.ones(bounds[-1], bool)
    for k in range(1, n):
        keep[bounds[1:][size >= k] - k] = False
    return keep[: max(len(keep) - n + 1, 0)], np.concatenate([[0], np.cumsum(np.maximum(size - n + 1, 0))])


def _grams(words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram its buckets and where each document's begin; none reaches into another document."""
    h = words.hashes()
    kinds = [((h & np.uint64(BUCKETS - 1)).astype(np.int64), words.first)]
    keep, bounds = _inner(words.first, 2)
    two = mix(h[:-1] * np.uint64(3) + h[1:])[keep]
    kinds.append(((two & np.uint64(BUCKETS - 1)).astype(np.int64), bounds))
    keep, bounds = _inner(words.offsets, 4)
    d = words.data.astype(np.uint32)
    four = (d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24))[keep]
    four = (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)
    kinds.append((four.astype(np.int64), bounds))
    return kinds


def logits(words, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each kind of n-gram, summed over the kinds."""
    out = np.zeros(len(words.offsets) - 1)
    for buckets, bounds in _grams(words):
        out += per_doc_sum(weights[buckets], bounds) / np.maximum(np.diff(bounds), 1)
    return out


def _features(column: pa.Array):
    """Each document's buckets and pooled values, packed."""
    words = words_of(column)
    kinds = _grams(words)
    index, value = [], []
    for i in range(len(column)):
        own = [(b[x[i] : x[i + 1]]) for b, x in kinds]
        at = np.concatenate(own)
        each = np.concatenate([np.full(len(o), 1 / max(len(o), 1), np.float32) for o in own])
        at, inverse = np.unique(at, return_inverse=True)
        index.append(at.astype(np.int32).tobytes())
        value.append(np.bincount(inverse, each, len(at)).astype(np.float32).tobytes())
    return pa.array(index, pa.binary()), pa.array(value, pa.binary())


def _fit(rows: list, steps: int = 80, rate: float = 1.5, decay: float = 1e-6, chunk: int = 200) -> tuple[np.ndarray, float]:
    """Full-batch logistic regression with Adam steps over packed sparse rows, ``chunk`` rows at a time."""
    y = np.array([r.y for r in rows], np.float64)
    share = y.mean()
    per_row = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    parts = []
    for i in range(0, len(rows), chunk):
        own = rows[i : i + chunk]
        sizes = [len(r.buckets) // 4 for r in own]
        parts.append((slice(i, i + len(own)), np.repeat(np.arange(len(own), dtype=np.int32), sizes), np.frombuffer(b"".join(r.buckets for r in own), np.int32), np.frombuffer(b"".join(r.value for r in own), np.float32)))
    seen = np.zeros(BUCKETS, bool)
    for _, _, at, _ in parts:
        seen[at] = True
    w, b = np.zeros(BUCKETS), 0.0
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        grad = np.append(decay * w, 0.0)
        for which, row, at, x in parts:
            z = np.bincount(row, x * w[at], which.stop - which.start) + b
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[which]) * per_row[which]
            grad[:-1] += np.bincount(at, x * g[row], BUCKETS)
            grad[-1] += g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w, b = w - np.where(seen, step[:-1], 0), b - step[-1]
    return w.astype(np.float32), float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows; a fifth of them, by id, calibrates."""
    some = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    each = append_arrow(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "text", [("buckets", "binary"), ("value", "binary")], _features, keep=["doc_id", "y"])
    # one row an id, so that repeated ids don't raise the bound
    rows = each.groupBy("doc_id").agg(F.min(F.struct("y", "buckets", "value")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r.y for r in rows}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 30.0)
    code = lambda r: zlib.crc32(str(r.doc_id).encode()) % 5
    fold = [r for r in rows if code(r)]
    rest = [r for r in rows if not code(r)]
    if len({r.y for r in fold}) < 2 or len({r.y for r in rest}) < 2:
        fold = rest = rows
    weights, bias = _fit(fold)
    release()
    z = np.array([np.frombuffer(r.value, np.float32) @ weights[np.frombuffer(r.buckets, np.int32)] for r in rest]) + bias
    y = np.array([r.y for r in rest], np.float64)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a, c = 1.0, 0.0
    for _ in range(50):  # Newton steps of Platt's two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        da, dc = np.clip(np.linalg.solve(h, g), -1, 1)
        a, c = max(a - da, 1e-3), c - dc
    return Model(weights, bias, float(a), float(c))


def measures(column: pa.Array) -> tuple:
    """The five counts of each text, and its words."""
    words = words_of(column)
    n = words.counts
    inside = ~words.space & ((words.data & 0xC0) != 0x80)
    chars = per_doc_sum(inside, words.offsets)
    symbols = per_doc_sum(_SYMBOLS[words.data], words.offsets)
    lines = []
    for i, j in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        own = [x for x in words.data[i:j].tobytes().split(b"\n") if x.strip()]
        lines.append(len(own) - len(set(own)))
    h = words.hashes()
    covered = np.zeros(len(h), bool)
    if len(h) > 2:
        within = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        three = mix(mix(h[within] * np.uint64(3) + h[within + 1]) * np.uint64(5) + h[within + 2]) ^ mix(words.doc[within].astype(np.uint64) + np.uint64(77))
        order = np.argsort(three, kind="stable")
        same = three[order[1:]] == three[order[:-1]]
        twice = np.zeros(len(three), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for k in range(3):
            covered[within[twice] + k] = True
    return words, n, chars, symbols, np.array(lines, np.int64), per_doc_sum(covered, words.first)


def apply(docs: DataFrame, model: Model, threshold: float = KEEP_AT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the counts, the base verdict, the probability of quality 1 and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(column):
        words, n, chars, symbols, lines, repeats = measures(column)
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        p = shared.value.probability(logits(words, shared.value.weights))
        return n, chars, symbols, lines, repeats, failed, p, ~failed & (p >= threshold)

    return append_arrow(docs, "text", FIELDS, score, keep)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each document."""
    docs = table(spark, sf_dir, "documents")
    return apply(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
