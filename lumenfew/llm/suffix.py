"""Suffix-array deduplication: remove every byte of a string of ``length`` bytes (``LENGTH`` by default) that starts more than once.

1. Anchors. Every ``length``-byte string has a least hash among its pieces of ``gram_of(length)`` bytes;
   equal strings have equal ones. The positions of a text fall into runs with their
   least hash at one place, and only runs whose hash is another run's too can hold a repeated string. This
   loses nothing and leaves the other text out of the sorting.
2. Shards. The text that such runs cover (nothing else travels) is gathered into shards of about
   ``SHARD`` bytes, in
   the order of the texts' least shared anchors, so that texts with a passage in common
   mostly meet in one shard and list it once (a range partitioning cuts a frequent anchor
   too). An anchor that one shard alone has needs no merging. Each shard gets a suffix array by Larsson-Sadakane refinement: suffixes are grouped by eight
   bytes, then only groups that are still tied are sorted, by the group of the suffix h
   further on, with h doubling. Common prefixes follow in Kasai's text order: where the
   bytes before a suffix and before its predecessor agree, the common prefix is one less
   than that of the suffix before; the rest are compared. Neighbours that share ``length``
   bytes or more form a class, which is repeated within the shard.
3. Merging. Each shard lists its classes whose anchor another shard has too, once each, as sorted 96-bit digests of their
   strings, cut into ranges of the digest. A range meets the lists of all shards in one
   task and finds by binary search which classes other shards have too. However often a
   string occurs, a shard lists it once, and digests fall evenly into ranges.
4. Spans. Each shard marks the bytes that repeated strings cover, and texts lose them where
   they stand. With ``words``, a span of fewer words than that and fewer than ``LENGTH`` bytes stays.

Equal texts are one text here, with a number of copies: all of a copied text of ``length``
bytes or more goes (with ``words``, as for spans).

Defined cases: a null text counts as empty; texts shorter than ``length`` bytes keep all;
null ids, repeated rows and ties are rows like others; an empty table gives no rows; very
long texts are matched whole; other columns, whatever their names, are passed on by ``removed``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import dropped, partitions, release, session, staged, table, text_or_empty
from lumenfew.llm.textvec import buffer_of, mix, slices

LENGTH = 400
#: Bytes of a shard, about.
SHARD = 1 << 20
#: Text bytes that are hashed at once, about.
PART = 1 << 20
#: Digests in a range, about.
RANGE = 1_000_000
_C = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
NONE = np.uint32(0xFFFFFFFF)


def gram_of(length: int) -> int:
    """Bytes of an anchor's piece: the greatest power of two that is a third of ``length`` at most."""
    if length < 3:
        raise ValueError("repeated strings have 3 bytes or more")
    return 1 << (length // 3).bit_length() - 1


def gram_hashes(data: np.ndarray, size: int, a: np.uint64 = _C[0], b: np.uint64 = _C[1]) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (a power of two) from each position on, by doubling."""
    h = mix(np.arange(1, 257, dtype=np.uint64) * a)[data]
    step = 1
    while step < size:
        if len(h) <= step:
            return h[:0]
        right = h[step:]
        h = h[:-step] * a + (right ^ (right >> np.uint64(29))) * b
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Runs of positions whose strings have their least hash at one place: document, first position in it, positions, hash."""
    gram = gram_of(length)
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    h = gram_hashes(data, gram)
    # the upper half of the hash, then the position: the leftmost of equal ones counts
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, step, least = length - gram + 1, 1, keyed
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    room = np.maximum(np.diff(offsets) - length + 1, 0)
    has = np.flatnonzero(room)
    first = offsets[:-1][has]
    cut = np.zeros(n + 1, bool)
    cut[1:-1] = least[1:] != least[:-1]
    cut[first] = True
    cut[first + room[has]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    doc = np.searchsorted(offsets, start, "right") - 1
    # the last document that begins at this byte; empty ones before it have no run
    valid = (start < n) & (start - offsets[doc] < np.maximum(offsets[doc + 1] - offsets[doc] - length + 1, 0))
    start, end, doc = start[valid], end[valid], doc[valid]
    return doc, start - offsets[doc], end - start, h[(least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)].view(np.int64)


def shifted(data: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 text (which never holds 0xFF) raised by one, so that separators are less than any."""
    return np.where(segment >= 0, data + np.uint8(1), np.uint8(0))


def packed_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros beyond the end."""
    v = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    step = 1
    while step < 8:
        v = (v[: len(v) - step] << np.uint64(8 * step)) | v[step:]
        step *= 2
    return v[: len(data)]


def suffix_array(words: np.ndarray, segment: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sorted suffixes of all segments (``segment`` -1: a separator), each ending with its segment.

    Larsson-Sadakane refinement; an end sorts before every byte, later segments' ends first.
    """
    where = np.flatnonzero(segment >= 0)
    sa = where[np.argsort(words[where], kind="stable")]
    n = len(segment)
    rank = np.zeros(n, np.int64)

    def regroup(at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number the groups of equal ``key`` among the places ``at`` of ``sa``; the places that are still tied."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(key)))
        rank[sa[at]] = np.repeat(at[begin], size)
        return at[np.repeat(size > 1, size)]

    tied = regroup(np.arange(len(sa)), words[sa]) if len(sa) else np.arange(0)
    h = 8
    while len(tied):
        s = sa[tied]
        inside = s + h < ends[segment[s]]
        second = np.where(inside, rank[np.minimum(s + h, n - 1)], -1 - s)
        key = rank[s] * np.int64(2 * n + 2) + (second + n + 1)
        order = np.argsort(key, kind="stable")
        sa[tied] = s[order]
        tied = regroup(tied, key[order])
        h *= 2
    return sa


def common_prefixes(words: np.ndarray, data: np.ndarray, segment: np.ndarray, ends: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``sa`` the bytes that its suffix shares with the one before (0 for the first)."""
    if not len(sa):
        return np.zeros(0, np.int64)
    before = np.full(len(segment), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.flatnonzero(before >= 0)
    b = before[i]
    inner = (i > 0) & (b > 0)
    inner &= (segment[np.maximum(i - 1, 0)] >= 0) & (segment[np.maximum(b - 1, 0)] >= 0) & (data[np.maximum(i - 1, 0)] == data[np.maximum(b - 1, 0)])
    shared = np.zeros(len(segment), np.int64)
    own = i[~inner]
    other = before[own]
    room = np.minimum(ends[segment[own]] - own, ends[segment[other]] - other)
    length = np.zeros(len(own), np.int64)
    live = np.arange(len(own))
    while len(live):
        x = words[own[live] + length[live]] ^ words[other[live] + length[live]]
        same = x == 0
        top = np.where(same, 8, 0)
        odd = np.flatnonzero(~same)
        bits = 64 - np.frexp((x[odd] >> np.uint64(11)).astype(np.float64))[1] - 11
        bits = np.where(x[odd] < 256, 56, bits)
        top[odd] = bits // 8
        length[live] += top
        live = live[same & (length[live] < room[live])]
    shared[own] = np.minimum(length, room)
    anchor = np.zeros(len(segment), np.int64)
    anchor[own] = own
    anchor = np.maximum.accumulate(anchor)
    rest = i[inner]
    shared[rest] = shared[anchor[rest]] - (rest - anchor[rest])
    return shared[sa]


def shard_classes(data: np.ndarray, segment: np.ndarray, ends: np.ndarray, length: int = LENGTH):
    """Positions whose string repeats within the shard, and for each class of strings its first position and size."""
    words = packed_words(shifted(data, segment))
    sa = suffix_array(words, segment, ends)
    shared = common_prefixes(words, data, segment, ends, sa)
    full = ends[segment[sa]] - sa >= length
    new = (shared < length) | ~full
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(sa)))
    keep = full[begin]
    repeated = sa[np.repeat(size > 1, size)]
    return repeated, sa[begin[keep]], size[keep]


def digests(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits that stand for the ``length`` bytes from each position on."""
    half = 1 << (length - 1).bit_length() - 1
    out = []
    for a, b in ((_C[0], _C[1]), (_C[2], _C[3])):
        h = gram_hashes(data, half, a, b)
        out.append(mix(h[at] * b + h[at + length - half]))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def merged_intervals(begin: np.ndarray, count: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """The bytes that the runs' strings cover, as disjoint intervals."""
    out: list[tuple[int, int]] = []
    for i, n in sorted(zip(begin.tolist(), count.tolist(), strict=True)):
        if out and i <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], i + n + length - 1)
        else:
            out.append((i, i + n + length - 1))
    return out


def covered(at: np.ndarray, end: int, length: int = LENGTH) -> np.ndarray:
    """The bytes that strings from the positions ``at`` on cover, as (begin, end) rows."""
    edge = np.zeros(end + length + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    return np.flatnonzero(np.diff(inside)).reshape(-1, 2)


_SHARDS = "shard binary, `range` int, digests binary, checks binary, positions binary, key binary, pieces binary"


_RUNS = "array<struct<begin:bigint,n:bigint,anchor:bigint>>"


def _cut(length: int):
    """Rows (lead, key, text, runs) to what the runs' strings cover of the text: pieces by their begin and size."""

    def run(batches):
        for batch in batches:
            begins, sizes, parts = [], [], []
            for text, own in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                spans = merged_intervals(np.array([r["begin"] for r in own]), np.array([r["n"] for r in own]), length)
                begins.append(np.array([i for i, _ in spans], np.int64).tobytes())
                sizes.append(np.array([j - i for i, j in spans], np.int64).tobytes())
                parts.append(b"".join(text[i:j] for i, j in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in (begins, sizes, parts)), batch.column(3)], names=["lead", "key", "begins", "sizes", "parts", "runs"])

    return run


def _assign(batches):
    """Rows (key, begins, sizes, parts, runs) in order, each key once in a row, to rows with the shard that they fall into (its first key)."""
    shard, weight, last = None, 0, None
    for batch in batches:
        keep, shards = [], []
        for key, parts in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            keep.append(key != last)
            if key != last:
                if shard is None or weight >= SHARD:
                    shard, weight = key, 0
                weight += len(parts.as_py())
                last = key
            shards.append(shard)
        out = pa.RecordBatch.from_arrays([pa.array(shards, pa.binary()), *batch.columns], names=["shard", "key", "begins", "sizes", "parts", "runs"])
        yield out.filter(pa.array(keep))


def _build(n_ranges: int, length: int):
    """One shard's texts, and the runs whose anchor other shards have too, to the rows of the shard."""

    kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 5]

    def run(texts: pa.Table, shared: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({f.split()[0].strip("`"): pa.array([], k) for f, k in zip(_SHARDS.split(", "), kinds, strict=True)})
        across = set(zip(shared["of_key"].to_pylist(), shared["of_begin"].to_pylist(), strict=True))
        parts, pieces, at = [], [], 0
        segment, ends, wanted = [], [], []
        keys = texts["key"].to_pylist()
        for key, begins, sizes, held, own_runs in zip(keys, *(texts[c] for c in ("begins", "sizes", "parts", "runs")), strict=True):
            held = held.as_py()
            own, done = [], 0
            for i, n in zip(np.frombuffer(begins.as_py(), np.int64).tolist(), np.frombuffer(sizes.as_py(), np.int64).tolist(), strict=True):
                own.append((i, at, n))
                parts += [np.frombuffer(held, np.uint8, n, done), np.zeros(8, np.uint8)]
                segment += [np.full(n, len(ends), np.int32), np.full(8, -1, np.int32)]
                ends.append(at + n)
                at += n + 8
                done += n
            first = np.array([p[0] for p in own])
            for r in own_runs.as_py():
                if (key, r["begin"]) in across:
                    i, to, _ = own[int(np.searchsorted(first, r["begin"], "right")) - 1]
                    wanted.append((to + r["begin"] - i, r["n"]))
            pieces.append(np.array(own, np.int64).tobytes())
        data, segment, ends = np.concatenate(parts), np.concatenate(segment), np.array(ends, np.int64)
        shard = texts["shard"][0].as_py()
        repeated, first, size = shard_classes(data, segment, ends, length)
        rows = [(shard, -2, None, None, None, key, piece) for key, piece in zip(keys, pieces, strict=True)]
        rows.append((shard, -1, None, None, covered(repeated, at, length).tobytes(), None, None))
        listed = np.zeros(len(data), bool)
        for i, n in wanted:
            listed[i : i + n] = True
        first, size = first[listed[first]], size[listed[first]]
        wide, narrow = digests(data, first, length)
        order = np.argsort(wide, kind="stable")
        wide, narrow = wide[order], narrow[order]
        place = np.where(size == 1, first, NONE).astype(np.uint32)[order]
        which = ((wide >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
        bounds = np.searchsorted(which, np.arange(n_ranges + 1))
        for r in np.flatnonzero(np.diff(bounds)).tolist():
            i, j = bounds[r], bounds[r + 1]
            rows.append((shard, r, wide[i:j].tobytes(), narrow[i:j].tobytes(), place[i:j].tobytes(), None, None))
        del data, segment, repeated, first, size, wide, narrow, order, place, listed, parts
        release()
        names = ["shard", "range", "digests", "checks", "positions", "key", "pieces"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """One range of digests: the positions whose class another shard has too."""
    lists = [np.frombuffer(x.as_py(), np.uint64) for x in group["digests"]]
    checks = [np.frombuffer(x.as_py(), np.uint32) for x in group["checks"]]
    places = [np.frombuffer(x.as_py(), np.uint32) for x in group["positions"]]
    every = np.sort(np.concatenate(lists), kind="stable")
    hits = [np.flatnonzero(np.searchsorted(every, d, "right") - np.searchsorted(every, d, "left") > 1) for d in lists]
    wide = np.concatenate([d[h] for d, h in zip(lists, hits, strict=True)])
    narrow = np.concatenate([c[h] for c, h in zip(checks, hits, strict=True)])
    order = np.lexsort((narrow, wide))
    same = (wide[order[1:]] == wide[order[:-1]]) & (narrow[order[1:]] == narrow[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    shards, found, at = [], [], 0
    for shard, p, h in zip(group["shard"], places, hits, strict=True):
        own = p[h][twice[at : at + len(h)]]
        at += len(h)
        own = own[own != NONE]
        if len(own):
            shards.append(shard.as_py())
            found.append(own.tobytes())
    return pa.table({"shard": pa.array(shards, pa.binary()), "positions": pa.array(found, pa.binary())})


def _enough(span: bytes, words: int) -> bool:
    """Whether a repeated span counts: ``words`` words or ``LENGTH`` bytes (any does with ``words`` 0)."""
    return len(span) >= LENGTH or len(span.split()) >= words


def _spans(group: pa.Table, length: int) -> pa.Table:
    """One shard: the bytes of each of its texts that repeated strings cover."""
    docs = [r for r in group.to_pylist() if r["key"] is not None]
    pieces = [np.frombuffer(r["pieces"], np.int64).reshape(-1, 3) for r in docs]
    end = max(int(p[-1, 1] + p[-1, 2]) for p in pieces) + 1
    edge = np.zeros(end + 1, np.int32)
    for x, own in zip(group["positions"], group["own"], strict=True):
        if x.as_py() and own.as_py():  # within the shard: covered bytes
            begin, stop = np.frombuffer(x.as_py(), np.int64).reshape(-1, 2).T
            np.add.at(edge, begin, 1)
            np.add.at(edge, np.minimum(stop, end), -1)
        elif x.as_py():  # across shards: positions
            at = np.frombuffer(x.as_py(), np.uint32).astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    change = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])))
    start, stop = change[::2], change[1::2]
    out = {"key": [], "spans": []}
    for r, own in zip(docs, pieces, strict=True):
        spans = []
        for i, at, n in own.tolist():
            k = slice(np.searchsorted(start, at), np.searchsorted(start, at + n))
            spans += [{"begin": i + a - at, "end": i + b - at} for a, b in zip(start[k].tolist(), stop[k].tolist(), strict=True)]
        if spans:
            out["key"].append(r["key"])
            out["spans"].append(spans)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table({"key": pa.array(out["key"], pa.binary()), "spans": pa.array(out["spans"], span)})


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", F.unhex(F.md5(text_or_empty())))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For each text that loses bytes: ``key`` (its MD5), ``copies`` and ``spans`` (begin and end bytes).

    ``spans`` are null for texts that only ``copies`` > 1 makes repeat: they go whole.
    Strings of ``length`` bytes are looked for.
    """
    spark = session(docs.sparkSession)
    texts = _keyed(docs.select("doc_id", "text"))
    long = texts.where(F.octet_length("text") >= length)

    def find(batches):
        seen = set()  # a copied text once a task
        for batch in batches:
            for part in slices(batch, "text", PART):
                keys = part.column("key").to_pylist()
                fresh = [k not in seen and not seen.add(k) for k in keys]
                part = part.filter(pa.array(fresh))
                doc, begin, n, anchor = runs(*buffer_of(part.column("text")), length)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column("key").take(pa.array(doc)), pa.array(begin), pa.array(n)], names=["anchor", "key", "begin", "n"])
        release()

    found = staged(long.select("key", "text").mapInArrow(find, "anchor long, key binary, begin long, n long"), "anchors")
    place = F.xxhash64("key", "begin")
    shared = found.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("anchor")
    # written first: a join of two plain exchanges is one whose frequent anchors Spark can split
    shared = staged(shared, "shared")
    cuts = found.join(shared, "anchor", "left_semi").groupBy("key").agg(F.collect_set(F.struct("begin", "n", "anchor")).alias("runs"), F.min("anchor").alias("lead"))
    keys = long.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    marked = staged(keys.join(cuts, "key", "left").where("copies > 1 or runs is not null"), "marked")
    dropped(found, shared)
    total = marked.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]))).first()[0] or 0
    n_ranges = max(partitions(spark), -(-total // RANGE))
    cut = marked.where("runs is not null").select(F.col("key").alias("k"), "rep", "runs", "lead")
    chosen = long.join(cut, (long.key == cut.k) & long.doc_id.eqNullSafe(cut.rep)).select("lead", "key", F.col("text").cast("binary").alias("text"), "runs")
    pieces = chosen.mapInArrow(_cut(length), f"lead long, key binary, begins binary, sizes binary, parts binary, runs {_RUNS}")
    in_order = pieces.repartitionByRange("lead", "key").sortWithinPartitions("lead", "key").drop("lead")
    texts = staged(in_order.mapInArrow(_assign, f"shard binary, key binary, begins binary, sizes binary, parts binary, runs {_RUNS}"), "texts")
    each = texts.select("shard", "key", F.explode("runs").alias("r")).select("shard", "key", "r.begin", "r.anchor")
    wide = each.groupBy("anchor").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b").select("anchor")
    wide = staged(wide, "wide")
    wanted = each.join(wide, "anchor", "left_semi").select(F.col("shard").alias("of"), F.col("key").alias("of_key"), F.col("begin").alias("of_begin"))
    shards = staged(texts.groupBy("shard").cogroup(wanted.groupBy("of")).applyInArrow(_build(n_ranges, length), _SHARDS), "shards")
    dropped(texts, wide)
    across = shards.where("`range` >= 0").groupBy("range").applyInArrow(_merge, "shard binary, positions binary")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("key", "pieces")]
    marks = shards.where("`range` < 0").select("shard", "positions", "key", "pieces", F.lit(True).alias("own")).unionAll(across.select("shard", "positions", *nothing, F.lit(False)))
    spans = staged(marks.groupBy("shard").applyInArrow(lambda t: _spans(t, length), "key binary, spans array<struct<begin:bigint,end:bigint>>"), "spans")
    dropped(shards)
    copies = marked.select("key", "copies")
    return copies.join(spans, "key", "left").where("copies > 1 or spans is not null")


_KEPT = [("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")]


def with_kept(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` (its columns as ``_0``, ``_1`` and so on) with ``n_bytes, n_removed, n_spans`` and ``kept``, the bytes that stay.

    ``words`` keeps the spans of fewer words (and fewer than ``LENGTH`` bytes).
    """
    lost = repeats(docs, length).select(F.col("key").alias("__key"), F.col("copies") > 1, "spans").toDF("__key", "__copied", "__spans")
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("text").alias("__text"))
    rows = plain.withColumn("__own", F.unhex(F.md5(text_or_empty("__text")))).join(lost, F.col("__own") == F.col("__key"), "left").drop("__own", "__key")
    n = len(docs.columns)

    def run(batches):
        for batch in batches:
            made = []
            for text, copied, spans in zip(*(batch.column(n + k).to_pylist() for k in range(3)), strict=True):
                text = (text or "").encode()
                spans = [(0, len(text))] if copied and len(text) >= length else [(s["begin"], s["end"]) for s in spans or ()]
                spans = [(i, j) for i, j in spans if _enough(text[i:j], words)]
                edges = [0, *[e for s in spans for e in s], len(text)]
                made.append((len(text), sum(j - i for i, j in spans), len(spans), b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([m[k] for m in made], kinds[k]) for k in range(4))], names=[f"_{i}" for i in range(n)] + [c for c, _ in _KEPT])
        release()

    schema = ", ".join([f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)] + [f"{c} {t}" for c, t in _KEPT])
    return rows.mapInArrow(run, schema)


def removed(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text`` and ``n_chars`` set anew; a character that is cut in part goes whole."""
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    rest = F.col(at["text"])
    kept = F.col("kept")
    # a cut character leaves bytes that aren't valid; a text that stays as it was is not touched
    text = F.when(F.col("n_removed") > 0, F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))).otherwise(rest)
    own = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in at else {})
    return with_kept(docs, length, words).select(*[own.get(c, F.col(k)).alias(c) for c, k in at.items()])


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses, and a digest of what it keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_kept(docs).select(F.col("_0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
