"""SimHash near duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
three bits share at least five of them. A posting list holds the fingerprints that have the
same bytes at four positions (70 choices; single bytes would list a 256th of all documents
each). A pair that meets is tallied: how many of the eight positional bytes it shares. Pairs
under the guaranteed minimum of five go (those that share just the list's four), the pair is
taken up in the first of the lists in which it meets, and the rest are verified by counting
differing bits.

Exact copies are one fingerprint: the index holds distinct fingerprints only. A posting
list of up to ``PAIRWISE`` members is compared by lags, and a longer one enumerates the
neighbours of each member in the 32 open bits, which takes linear time and adds a spanning
set of links: either way no link between components is lost.

Defined cases: a null text counts as empty; texts with no word have fingerprint zero and
link like others; fewer words than a shingle has make one shingle; null ids never become a
component id (a component of null ids only has a null id); repeated rows and ties get equal
results; an empty table gives no rows; very long texts count whole (shingle hashes are
summed in parts); other columns are passed on, but ``simhash`` is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, partitions, staged, table
from lumenfew.llm.components import components

SHINGLE = 3
MAX_BITS = 3
BYTES = 8
SEED = 42
#: Members of a posting list that are compared with each other by lags.
PAIRWISE = 1024


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.concatenate([[0], np.cumsum(lengths[:-1])])
    end = (start + lengths - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], SEED) for i, j in zip(start.tolist(), end, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; no hashes give 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def with_fingerprints(docs: DataFrame, size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``simhash`` (long)."""

    def run(column):
        texts = column.fill_null("").cast(pa.binary()).to_pylist()
        return (np.array([fingerprint(shingle_hashes(t, size)) for t in texts], np.int64),)

    return append_arrow(docs, "text", [("simhash", "long")], run, keep)


def _masks(least: int) -> list[int]:
    full = [0xFF << (8 * i) for i in range(BYTES)]
    return [sum(full[i] for i in c) for c in combinations(range(BYTES), least)]


def postings(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Each fingerprint once for each choice of one position less than the guaranteed minimum: (list, bytes, simhash)."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(BYTES - max_bits - 1)]
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), F.col("simhash").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])).alias("p")
    return prints.select("simhash", entry).select("p.list", "p.bytes", "simhash")


def _shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which positional bytes are equal, as a mask of eight bits."""
    equal = (a ^ b).view(np.uint8).reshape(-1, BYTES) == 0
    return np.packbits(equal, axis=1, bitorder="little")[:, 0]


def _dense(prints: np.ndarray, open_bits: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a long posting list, found by flipping up to ``max_bits`` of its open bits."""
    prints = np.sort(prints)
    left, right = [], []
    for n in range(1, max_bits + 1):
        for c in combinations(open_bits.tolist(), n):
            other = prints ^ np.bitwise_or.reduce(np.array(c, np.uint64))
            at = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
            hit = np.flatnonzero((prints[at] == other) & (prints < other))
            left.append(hit)
            right.append(at[hit])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(prints))  # links that join nothing new are left out
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(root)))
    return prints[root[other]], prints[other]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` fingerprints at most ``max_bits`` (6 or less) apart; all of them but for long lists, where they span the list's components."""
    from pyspark.sql import Window

    least = BYTES - max_bits
    choices = list(combinations(range(BYTES), least - 1))
    masks = np.array(_masks(least - 1), np.uint64)
    first = np.array([next((i for i, c in enumerate(choices) if all(s >> k & 1 for k in c)), -1) for s in range(256)])
    # spread first: the few bytes of a fingerprint become many postings
    entries = postings(prints.repartition(partitions(prints.sparkSession), "simhash"), max_bits)
    shared = entries.withColumn("n", F.count("*").over(Window.partitionBy("list", "bytes"))).where("n > 1").drop("n").sortWithinPartitions("list", "bytes")

    def settle(which, group, value):
        """Pairs of complete posting lists, which lie one after another."""
        begin = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (group[1:] != group[:-1])]))
        size = np.diff(np.concatenate([begin, [len(which)]]))
        long = size > PAIRWISE
        for at, n in zip(begin[long], size[long], strict=True):
            mask = masks[which[at]]
            free = np.array([1 << i for i in range(64) if not int(mask) >> i & 1], np.uint64)
            yield _dense(np.unique(value[at : at + n]), free, max_bits)
        end = np.repeat(np.where(long, 0, begin + size), size)
        live, lag = np.arange(len(value)), 1
        while len(live := live[live + lag < end[live]]):  # those that have a partner so far behind
            for i in np.array_split(live, -(-len(live) // (1 << 20))):
                a, b = value[i], value[i + lag]
                tally = _shared_bytes(a, b)
                near = np.flatnonzero((np.bitwise_count(tally) >= least) & (first[tally] == which[i]))
                near = near[np.bitwise_count(a[near] ^ b[near]) <= max_bits]
                yield a[near], b[near]
            lag += 1

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield from out(settle(*[x[:cut] for x in now]))
        if rest is not None and len(rest[0]):
            yield from out(settle(*rest))

    def out(pairs):
        for a, b in pairs:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return shared.mapInArrow(run, "a long, b long")


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(simhash, doc_id)`` to ``(simhash, component_id)``: the least id of all fingerprints reachable."""
    each = prints.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    found = components(links(each.select("simhash"), max_bits))
    rooted = each.join(found, each.simhash == found.node, "left").select("simhash", "least", F.coalesce("root", "simhash").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("simhash", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, simhash, component_id`` for each row of ``docs``."""
    prints = staged(with_fingerprints(docs.select("doc_id", "text"), size, keep=["doc_id"]), "simhash")
    return prints.join(groups(prints, max_bits), "simhash")


def _similar(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """``(a, b)`` fingerprints of texts whose shingle sets are alike; ``prints`` has ``doc_id, tie, simhash, sig, n_set, bands``."""
    from lumenfew.llm import minhash

    sets = staged(prints.where("n_set > 0").groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie", "simhash")).alias("one"), F.first("n_set").alias("n_set"), F.first("bands").alias("bands")), "sets")
    pairs, crowd = minhash.candidates(sets.select("sig", "n_set", "bands"))
    ends = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig"))).unionAll(crowd).distinct()
    asked = staged(sets.join(ends, "sig").select("sig", F.col("one.doc_id").alias("__id"), F.col("one.tie").alias("__tie")), "asked")
    texts = docs.select("doc_id", "text").withColumn("__hash", F.xxhash64("text")).join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tie")))
    shingles = minhash.shingles_of(texts.select("sig", "text").dropDuplicates(["sig"]))
    near = minhash.verified(pairs, shingles).unionAll(minhash.crowd_links(staged(shingles.join(crowd, "sig"), "crowd")))
    names = sets.select("sig", F.col("one.simhash").alias("print"))
    # equal sets may have several fingerprints
    equal = prints.select("sig", "simhash").join(names, "sig").where("simhash <> print").select(F.col("print").alias("a"), F.col("simhash").alias("b")).distinct()
    left, right = names.select(F.col("sig").alias("a"), F.col("print").alias("of_a")), names.select(F.col("sig").alias("b"), F.col("print").alias("of_b"))
    return near.join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).unionAll(equal).where("a <> b")


def representatives(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, similar: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the least id (nulls last, ties by a hash of the text).

    ``similar`` also links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Only ids, fingerprints and text hashes are gathered; whole rows are joined by their own
    id, so a large group's rows stay spread.
    """
    prints = with_fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), size, keep=["doc_id", "tie", "text"] if similar else ["doc_id", "tie"])
    if similar:
        from lumenfew.llm import minhash

        prints = minhash.with_bands(prints, ["doc_id", "tie", "simhash"])
    prints = staged(prints, "simhash")
    best = prints.groupBy("simhash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("best"))
    best = staged(best, "best")
    near = links(best.select("simhash"), max_bits)
    found = components(near.unionAll(_similar(docs, prints)) if similar else near)
    rooted = best.join(found, best.simhash == found.node, "left").select("best", F.coalesce("root", "simhash").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("__id"), F.col("best.tie").alias("__tie"))
    rows = docs.withColumn("__hash", F.xxhash64("text")).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tie")), "left_semi")
    if not prints.groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "__hash"])
    return rows.drop("__hash")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
