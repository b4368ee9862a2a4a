"""Pairs of texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

1. Signatures. A text's distinct shingles of ``SIZE`` lower-cased words are hashed; equal
   sets have one signature and are one set here. ``BANDS`` times ``ROWS`` minima of
   multiplied hashes make the bands.
2. Short lists. Sets with a band in common meet in its posting list. A pair of similarity s
   has no band in common with probability (1 - s**ROWS)**BANDS: 2.6e-5 at 0.8, less above. In
   lists of up to ``PAIRWISE`` sets all meet.
3. Crowds. Sets of a longer list (copies of one text, or texts that share a template) are joined
   by prefixes of their shingles instead. In any one order of all shingles, two sets of sizes
   m <= n and similarity 0.8 share one among the first m - 8m/9 + 1 of the smaller and the first
   n - 4n/5 + 1 of the larger. That is exact. Shingles that are frequent in a sample of the
   crowd stand last, so a prefix holds what a text doesn't share with many: lists are short again.
   (The order decides how long lists are, never which pairs meet.)
4. Blocks. A prefix reaches into frequent shingles only if eight ninths of the set are frequent: it is
   one of many copies. Sets that long lists join, directly or by others, are a blob; it is dealt by hash over blocks of
   bounded bytes. All sets of a block are compared, but for those that its links join already: parities of hashed shingles
   bound the difference of two sets from below, what is left is counted. If a blob has several blocks, some sets of each large component
   meet first, so that one component of many blocks becomes one; then each two blocks meet, unless both hold
   only sets of the same component. That is exact: its links join what all pairs would join. Its work grows with the square of
   the sets of a blob that are not joined, its memory with a block.
5. Verification. Each candidate pair's shingles are compared: what is linked has the
   similarity, exactly.

Lists are counted by partial sums before their rows meet; only lists of up to ``PAIRWISE`` sets are gathered.

Defined cases: a null text counts as empty; texts without a word have the empty set and
no band; fewer words than a shingle has make one shingle; repeated rows are one set; very long
texts are read whole (minima are taken in parts); an empty table has no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfew.llm.common import append_arrow, release, staged
from lumenfew.llm.simhash import shingle_hashes

SIZE = 5
LEAST = 0.8
BANDS = 20
ROWS = 4
#: Sets of a posting list that are all compared with each other.
PAIRWISE = 64
#: Bytes of a block's shingles and its sets, both about; sets of a large component that stand for it when blocks first meet.
BLOCK_BYTES = 16 << 20
BLOCK_SETS = 8192
STAND = 32
#: Sets of a crowd that the order of shingles is drawn from, how often one has to occur there, and how many are told apart.
SAMPLE = 8192
OFTEN = 3
FREQUENT = 1 << 20
#: Shingles that are multiplied at once.
PART = 1 << 12
_FACTORS = np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SIZE))


def signature(shingles: np.ndarray) -> int:
    """64 bits that stand for the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def bands(shingles: np.ndarray, factors: np.ndarray = _FACTORS, rows: int = ROWS) -> np.ndarray:
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), PART):
        least = np.minimum(least, (factors[:, None] * shingles[None, i : i + PART]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(-1, rows)], np.uint64).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def with_bands(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` with ``sig`` (long), ``n_set`` (shingles) and ``bands``."""

    def run(column):
        sets = [shingle_set(t) for t in column.fill_null("").cast(pa.binary()).to_pylist()]
        return [signature(s) for s in sets], [len(s) for s in sets], pa.array([bands(s) for s in sets], pa.list_(pa.int64()))

    return append_arrow(docs, "text", [("sig", "long"), ("n_set", "long"), ("bands", "array<long>")], run, keep)


def by_length(entries: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The entries of lists of up to ``PAIRWISE``, and those of longer ones. Keys are counted by partial sums."""
    long = staged(entries.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > PAIRWISE).select(*key), "long")
    return entries.join(long, key, "left_anti"), entries.join(long, key, "left_semi")


def fits(m, n):
    """Whether sets of sizes ``m <= n`` can have the similarity."""
    return 5 * m >= 4 * n


def within(lists: DataFrame, key: list[str]) -> DataFrame:
    """``(a, b)`` of each list (of up to ``PAIRWISE`` entries ``sig, n_set, probe``): a smaller set's probe with a larger one's entry."""
    own = Window.partitionBy(*key)
    rows = lists.withColumn("n", F.count("*").over(own)).where("n > 1").withColumn("at", F.row_number().over(own.orderBy("sig"))).select("n", "at", "sig", "n_set", "probe")

    def run(batches):
        rest = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = np.flatnonzero(rest[1] == 1)[-1] if (rest[1] == 1).any() else 0
            # the last list is complete if it has all its members
            cut = len(rest[1]) if rest[1][-1] == rest[0][-1] else int(last)
            if cut:
                yield from pairs(*[x[:cut] for x in rest])
                rest = [x[cut:] for x in rest] if cut < len(rest[1]) else None

    def pairs(n, at, sig, size, probe):
        found = []
        for lag in range(1, int(n.max(initial=1))):
            i = np.flatnonzero(at[lag:] > lag)
            j = i + lag
            fine = fits(np.minimum(size[i], size[j]), np.maximum(size[i], size[j])) & ((probe[i] & (size[i] <= size[j])) | (probe[j] & (size[j] <= size[i])))
            if fine.any():
                found.append(np.stack([sig[i[fine]], sig[j[fine]]]))
        if found:  # near copies meet in many lists
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct ``sig, n_set, bands``: the pairs ``(a, b)`` of short lists, and the ``sig`` of crowds. Both are staged."""
    each = sets.select("sig", "n_set", F.lit(True).alias("probe"), F.posexplode("bands").alias("band", "value"))
    short, long = by_length(each, ["band", "value"])
    return staged(within(short, ["band", "value"]), "pairs"), staged(long.select("sig").distinct(), "crowd")


def shingles_of(texts: DataFrame) -> DataFrame:
    """``sig, text`` to ``sig, shingles`` (sorted hashes, binary), staged."""

    def make(column):
        return ([shingle_set(t).tobytes() for t in column.fill_null("").cast(pa.binary()).to_pylist()],)

    return staged(append_arrow(texts, "text", [("shingles", "binary")], make, ["sig"]), "shingles")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets (``sig, shingles``) reach ``LEAST``."""
    left, right = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"))

    def check(batches):
        for batch in batches:
            near = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= LEAST for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))
        release()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def frequent(crowd: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are frequent in a bounded sample of the crowd's sets, sorted, and how often each occurs there."""
    share = min(1.0, SAMPLE / max(crowd.count(), 1))

    def each(batches):
        # counted within the task: its sets are a bounded sample
        token, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            more = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist())])
            token, at = np.unique(np.concatenate([token, more]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(more), np.int64)]), len(token)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

    drawn = crowd.where(F.pmod(F.xxhash64("sig"), F.lit(1 << 30)) < int(share * (1 << 30))).select("shingles")
    counts = drawn.mapInArrow(each, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    held = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).toArrow()
    token, n = held.column(0).to_numpy().view(np.uint64), held.column(1).to_numpy()
    order = np.argsort(token)
    token, n = token[order], n[order]
    del held
    release()
    return token, n


def prefixes(crowd: DataFrame) -> DataFrame:
    """``token, sig, n_set, probe``: the shingles by which each set meets larger ones (``probe``) and smaller ones."""
    sent = crowd.sparkSession.sparkContext.broadcast(frequent(crowd))

    def run(batches):
        known, often = sent.value
        for batch in batches:
            token, size, place = [], [], []
            for content in batch.column(1).to_pylist():
                s = np.frombuffer(content, np.uint64)
                n = len(s)
                at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                weight = np.where(known[at] == s, often[at], 0) if len(known) else np.zeros(n, np.int64)
                keep = n - (4 * n + 4) // 5 + 1
                token.append(s[np.lexsort((s, weight))[:keep]])
                size.append(n)
                place.append(np.arange(len(token[-1])))
            lengths = [len(t) for t in token]
            n = np.repeat(np.array(size, np.int64), lengths)
            probe = np.concatenate([np.zeros(0, np.int64), *place]) < n - (8 * n + 8) // 9 + 1
            sig = batch.column(0).to_numpy().repeat(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *token]).view(np.int64)), pa.array(sig), pa.array(n), pa.array(probe)], names=["token", "sig", "n_set", "probe"])
        release()

    return staged(crowd.select("sig", "shingles").mapInArrow(run, "token long, sig long, n_set long, probe boolean"), "prefixes")


def parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set, whether an odd number of its shingles falls on each of ``bits``, as words: two sets differ by as many shingles as bits, at least."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)
    return out


def spanning(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that, with the labels, join what all links between the sides (or within the only one) would join."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, side = [sets[i] for i in order], side[order]
    root = np.unique(label[order], return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    last = np.searchsorted(4 * size, 5 * size, "right")  # the first set too large for each
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(np.median(size), 1))), 10, 16))
    fine = parities(sets, bits)
    coarse = np.bitwise_xor.reduce(fine.reshape(len(sets), -1, 16), axis=1)  # folded to 1,024 bits
    both, found = side.min() != side.max(), []
    for i in range(len(sets)):
        own = slice(i + 1, last[i])
        j = i + 1 + np.flatnonzero((root[own] != root[i]) & ((side[own] != side[i]) if both else True))
        # 5 * common >= 4 * union, by the difference
        for words in (coarse, fine):
            j = np.concatenate([part[9 * np.bitwise_count(words[part] ^ words[i]).sum(axis=1, dtype=np.int64) <= size[part] + size[i]] for part in np.array_split(j, len(j) // 2048 + 1)])
        for k in j.tolist():
            if root[k] != root[i] and jaccard(sets[i], sets[k]) >= LEAST:
                root[root == root[k]] = root[i]
                found.append((int(order[i]), int(order[k])))
    return found


def met(groups: DataFrame, key: list[str]) -> DataFrame:
    """``(a, b)`` of each group of ``sig, label, side, shingles``."""

    def run(group: pa.Table) -> pa.Table:
        sig, sets = group.column("sig").to_numpy(), [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        found = np.array(spanning(sets, group.column("label").to_numpy(), group.column("side").to_numpy()), np.int64).reshape(-1, 2)
        release()
        a, b = sig[found[:, 0]], sig[found[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return groups.select(*key, "sig", "label", "side", "shingles").groupBy(*key).applyInArrow(run, "a long, b long")


def parts(n: str = "n", size: str = "size") -> Column:
    """Blocks for so many sets and bytes."""
    return F.ceil(F.greatest(F.col(n) / BLOCK_SETS, F.col(size) / BLOCK_BYTES)).cast("long")


def dealt(salt: int, over: Column, by: str = "sig") -> Column:
    return F.pmod(F.xxhash64(by, F.lit(salt)), F.greatest(over, F.lit(1)))


def labelled(sets: DataFrame, found: list[DataFrame], name: str) -> DataFrame:
    """``sets`` with the ``label`` of the component that the links make of each."""
    from lumenfew.llm.components import components

    roots = components(_together(found)).withColumnsRenamed({"node": "sig", "root": "label"})
    return staged(sets.drop("label").join(roots, "sig", "left").withColumn("label", F.coalesce("label", "sig")), name)


def block_pairs(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``blob, sig, label, size``: each set's ``block`` with the component that all of the block is (``pure``), and the blocks ``(i, j)`` to compare."""
    each = sets.groupBy("blob", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).withColumn("whole", 2 * F.greatest(F.col("n") / BLOCK_SETS, F.col("size") / BLOCK_BYTES) >= 1)
    mixed = each.where("not whole").groupBy("blob").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).select("blob", parts().alias("of_mixed"))
    large = each.select("blob", "label", "whole", parts().alias("of_whole"))
    own = sets.join(large, ["blob", "label"]).join(mixed, "blob", "left")
    at = F.when(F.col("whole"), dealt(1, F.col("of_whole"))).otherwise(dealt(2, F.col("of_mixed"), "label"))
    own = own.select("blob", "sig", "label", F.when(F.col("whole"), F.col("label")).alias("pure"), at.alias("nth"))
    own = staged(own.withColumn("block", F.xxhash64("blob", F.col("pure").isNull(), "pure", "nth")), "blocks")
    blocks = own.select("blob", "block", "pure").distinct()
    left, right = blocks.select("blob", F.col("block").alias("i"), F.col("pure").alias("of_i")), blocks.select("blob", F.col("block").alias("j"), F.col("pure").alias("of_j"))
    return own, staged(left.join(right, "blob").where("i <= j and not coalesce(of_i = of_j, false)").select("i", "j"), "meetings")


def crowd_links(crowd: DataFrame) -> DataFrame:
    """Links ``(a, b)`` within a crowd (``sig, shingles``) of texts that many have much in common with: they join what all links would join."""
    from lumenfew.llm.components import components

    short, long = by_length(prefixes(crowd), ["token"])
    found = [verified(within(short, ["token"]), crowd)]
    # a list without a set that asks has no pair
    heads = long.groupBy("token").agg(F.min("sig").alias("head"), F.max("probe").alias("asked")).where("asked").select("token", "head")
    blobs = components(long.join(heads, "token").select(F.col("sig").alias("a"), F.col("head").alias("b")))
    blobs = blobs.unionAll(blobs.select(F.col("root").alias("node"), "root")).distinct()
    sets = staged(crowd.join(blobs.select(F.col("node").alias("sig"), F.col("root").alias("blob")), "sig").withColumn("size", F.octet_length("shingles")), "blobs")
    own = staged(sets.groupBy("blob").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("blob", parts().alias("of")), "parts")
    alone = F.lit(0).cast("int").alias("side")
    first = sets.join(own, "blob").select("blob", dealt(0, F.col("of")).alias("nth"), "sig", F.col("sig").alias("label"), alone, "shingles")
    found.append(met(first, ["blob", "nth"]))
    if (own.agg(F.max("of")).first()[0] or 0) < 2:
        return _together(found)
    found = [staged(x, "near") for x in found]
    wide = staged(sets.join(own.where("of > 1"), "blob").select("blob", "sig", "size", "of"), "wide")
    now = labelled(wide, found, "labelled")
    # a few of each component that may lie in many blocks
    ranked = now.withColumn("n", F.row_number().over(Window.partitionBy("blob", "label").orderBy(F.xxhash64("sig", F.lit(3)), "sig"))).where(F.col("n") <= STAND)
    large = now.groupBy("blob", "label").count().where(F.col("count") >= STAND).select("blob", "label")
    stand = ranked.join(large, ["blob", "label"], "left_semi").select("blob", "sig", "label", "size")
    shares = stand.groupBy("blob").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select("blob", parts().alias("of"))
    few = stand.join(shares, "blob").select("blob", dealt(4, F.col("of")).alias("nth"), "sig", "label", alone).join(crowd, "sig")
    found.append(staged(met(few, ["blob", "nth"]), "near"))
    own, pairs = block_pairs(labelled(wide, found, "labelled"))
    rows = own.select("block", "sig", "label").join(crowd, "sig")
    left = rows.join(pairs, rows.block == pairs.i).select("i", "j", "sig", "label", alone, "shingles")
    right = rows.join(pairs.where("i < j"), rows.block == pairs.j).select("i", "j", "sig", "label", F.lit(1).cast("int").alias("side"), "shingles")
    return _together([*found, met(left.unionAll(right), ["i", "j"])])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out
