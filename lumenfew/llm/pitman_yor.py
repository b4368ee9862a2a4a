"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end a text. Each context (the word before, or the
beginning) has a restaurant whose dishes are words; all context restaurants share the word
restaurant as parent, and the word restaurant's base measure is uniform over the training
vocabulary and one outcome for whatever else a word may be. A context's customers are its
training tokens; every table sends one customer to the parent. So a word after a context is

    (customers - discount * tables + (strength + discount * the context's tables) * parent)
    / (strength + the context's customers)

and the parent is alike, with the tables of all contexts as customers. Seatings are sampled
by Gibbs: a sweep draws every dish's number of tables from its full conditional, given the
other dishes' tables, which is the law that moving its customers one by one tends to. For c
customers, t tables weigh S(c, t) times, for each table, the weight of opening it: S is the
generalised Stirling number, which counts the seatings. Scores average the predictive
probabilities over the samples that follow burn-in.

How it runs: tasks tokenise blocks of about ``BLOCK`` bytes. Each block lists its distinct
words and (word, context) cells with their training counts, cut by ranges of the word hash.
A range meets all blocks' lists in one task, adds up the counts and says how many customers
and dishes each of its contexts has; buckets of contexts add these up over all ranges and
answer each range in its own order. Then the range seats its customers and answers each
block with the probabilities of exactly the cells that the block asked for. Nothing is
dropped, nothing reaches the driver, and what is gathered grows with the corpus. A block has a
row for each range that one of its words is in, a range a row for each bucket that one of its
contexts is in: never more rows than cells, at any size. A frequent word is one entry a block,
but all its cells, one for each word before it, meet in the task of its range: that task grows
with the number of distinct words, and is the largest.

What is approximate: within a sweep the dishes move together, so other dishes' tables are
those of the sweep before; tables that another range holds of a context are its dishes
there (exact) times the tables a dish of that context has here; words are told apart by
64-bit hashes and contexts by 32 bits of them; the strength is fixed and the discounts come
from the counts of counts. Stirling numbers follow their recurrence up to ``EXACT``
customers (beyond 256 at steps of 1 %) and above that their ratio's law in t / c.

Defined cases: null and empty texts are one end token; an empty table gives no rows;
without training rows every count is 0 and the base measure (of one outcome) alone scores,
0; null ids have the crc32 of the empty string; repeated rows and ties score alike; very
long texts are scored whole, within one block; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfew.llm.common import crc_of_id, partitions, release, session, staged, table, text_or_empty
from lumenfew.llm.textvec import lowered, slices, words_of

FOLDS, HELD = 7, 2
#: Text bytes of a block, and of what a range holds, about.
BLOCK, RANGE = 12 << 20, 32 << 20
#: Text bytes that are tokenised at once, about.
PART = 1 << 20
BURN_IN = 4
SAMPLES = 4
STRENGTH = 1.0
#: Customers up to which Stirling numbers follow their recurrence.
EXACT = 8192
#: A context is the upper half of its word's hash; the beginning has this one.
BEGIN = np.uint32(0xB391_0001)
END = np.uint64(0x5EED0E0D5EED0E0D)
#: Probabilities travel as -log10 in units of 1 / UNIT.
UNIT = 2048


# -- blocks --------------------------------------------------------------------


def tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token, and the tokens of each text."""
    docs = len(words.offsets) - 1
    word = np.empty(len(words.start) + docs, np.uint64)
    ends = words.first[1:] + np.arange(docs)
    word[np.arange(len(words.start)) + words.doc] = words.hashes(lowered(words.data))
    word[ends] = END
    return word, words.counts + 1


def packed(values: np.ndarray) -> bytes:
    """Numbers in their smallest width, byte by byte of equal weight, compressed."""
    if values.dtype.kind in "iu":
        top = int(values.max(initial=0))
        values = values.astype(next(d for d in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(d).max))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    head = np.array([len(values), values.dtype.itemsize], np.int64).tobytes()
    return head + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def unpacked(content: bytes, kind: str = "u") -> np.ndarray:
    n, size = np.frombuffer(content, np.int64, 2)
    if not n:
        return np.zeros(0, f"{kind}{size}")
    planes = np.frombuffer(pa.decompress(content[16:], decompressed_size=int(n * size), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"{kind}{size}").ravel()


def range_of(words: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)


_BLOCKS = "block long, names binary, tokens binary, sizes binary, ids binary"


def _read_blocks(batches):
    """Batches (held, id, text) to blocks: distinct words, each token's place among them, tokens of each text, ids."""

    def flush(block: int, held: list):
        names, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.string()), ("held", pa.bool_())])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array([i for x in held for i in x[3]], pa.string()), pa.array(np.concatenate([x[2] for x in held]))], names=["id", "held"]))
        ids = sink.getvalue()
        row = [packed(names), packed(at), packed(np.concatenate([x[1] for x in held])), np.array([ids.size], np.int64).tobytes() + pa.compress(ids, codec="zstd", asbytes=True)]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c], pa.binary()) for c in row)], names=["block", "names", "tokens", "sizes", "ids"])

    block, held, weight = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for part in slices(batch, "text", PART):
            words = words_of(part.column("text"))
            held.append((*tokens(words), np.asarray(part.column("held")), part.column("id").to_pylist()))
            weight += len(words.data)
            if weight >= BLOCK:
                yield from flush(block, held)
                block, held, weight = block + 1, [], 0
    if held:
        yield from flush(block, held)


def _ids(content: bytes) -> pa.Table:
    size = int(np.frombuffer(content, np.int64, 1)[0])
    return pa.ipc.open_stream(pa.decompress(content[8:], decompressed_size=size, codec="zstd")).read_all()


def cells_of(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The (word, context) cell of each token; the context's place is one more than its word's, 0 for the beginning."""
    context = np.empty(len(at), np.int64)
    context[1:] = at[:-1].astype(np.int64) + 1
    context[np.cumsum(sizes) - sizes] = 0
    return at.astype(np.int64) * (int(at.max(initial=0)) + 2) + context


_LISTS = "block long, `range` int, words binary, n_words binary, cell_word binary, cell_context binary, cell_n binary"
_LIST_NAMES = ["block", "range", "words", "n_words", "cell_word", "cell_context", "cell_n"]


def _list_cells(n_ranges: int):
    """Blocks to their lists, one row a range."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                names, at, sizes = unpacked(r["names"]).astype(np.uint64), unpacked(r["tokens"]), unpacked(r["sizes"]).astype(np.int64)
                trained = np.repeat(~np.asarray(_ids(r["ids"])["held"]), sizes)
                n_words = np.bincount(at, trained, len(names)).astype(np.uint32)
                key = np.sort(cells_of(at, sizes) * 2 + trained)
                begin = np.flatnonzero(np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1]))
                cells, n_cells = key[begin] >> 1, np.add.reduceat(key & 1, begin)
                word, context = np.divmod(cells, int(at.max(initial=0)) + 2)
                context = np.where(context > 0, (names >> np.uint64(32)).astype(np.uint32)[np.maximum(context, 1) - 1], BEGIN)
                edges = np.searchsorted(range_of(names, n_ranges), np.arange(n_ranges + 1))
                cuts = np.searchsorted(word, edges)
                rows = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    w, c = slice(edges[k], edges[k + 1]), slice(cuts[k], cuts[k + 1])
                    rows.append((r["block"], k, packed(names[w]), packed(n_words[w]), packed(np.diff(word[c], prepend=edges[k])), packed(context[c]), packed(n_cells[c])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * 5], strict=True)], names=_LIST_NAMES)

    return run


def _merge_lists(group: pa.Table):
    """All blocks' lists of one range, by block: distinct words and cells with their training counts, and where each list's are."""
    rows = sorted(group.to_pylist(), key=lambda r: r["block"])
    lists = [unpacked(r["words"]).astype(np.uint64) for r in rows]
    names, at = np.unique(np.concatenate(lists), return_inverse=True)
    n_words = np.bincount(at, np.concatenate([unpacked(r["n_words"]) for r in rows]), len(names)).astype(np.int64)
    keys, offset = [], 0
    for r, own in zip(rows, lists, strict=True):
        word = at[offset : offset + len(own)][np.cumsum(unpacked(r["cell_word"]), dtype=np.int64)]
        keys.append(word.astype(np.uint64) << np.uint64(32) | unpacked(r["cell_context"]).astype(np.uint64))
        offset += len(own)
    cells, place = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(place, np.concatenate([unpacked(r["cell_n"]) for r in rows]), len(cells)).astype(np.int64)
    ends = np.cumsum([[len(o), len(k)] for o, k in zip(lists, keys, strict=True)], axis=0)
    names, u = np.unique((cells & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_inverse=True)
    return [r["block"] for r in rows], n_words, at, (cells >> np.uint64(32)).astype(np.int64), c, place, ends, names, u


# -- totals of contexts over all ranges ----------------------------------------


def bucket_edges(contexts: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` buckets begins among sorted contexts."""
    return np.searchsorted((contexts.astype(np.uint64) * np.uint64(n)) >> np.uint64(32), np.arange(n + 1))


_FACTS = ["words", "distinct", "once", "twice", "alone", "paired", "cells"]
_ASKS = "bucket int, `range` int, contexts binary, dishes binary, customers binary, " + ", ".join(f"{f} long" for f in _FACTS)
_TOTALS = "`range` int, bucket int, dishes binary, customers binary"


def _ask(n_buckets: int):
    """A range's lists to its contexts' customers and dishes, a row for each bucket that one of its contexts is in.

    Facts, on the range's first row: training words in all and distinct; cells with one customer and with two; words with one context and with two; cells in all.
    """

    def run(group: pa.Table) -> pa.Table:
        _, n_words, _, w, c, _, _, contexts, u = _merge_lists(group)
        on = c > 0
        dishes = np.bincount(w[on], minlength=len(n_words))
        per_dish, per_customer = np.bincount(u, on, len(contexts)).astype(np.int64), np.bincount(u, c, len(contexts)).astype(np.int64)
        edges = bucket_edges(contexts, n_buckets)
        here = np.flatnonzero(np.diff(edges))
        own = [slice(edges[k], edges[k + 1]) for k in here]
        facts = np.zeros((len(_FACTS), len(here)), np.int64)
        facts[:, 0] = [n_words.sum(), (n_words > 0).sum(), (c == 1).sum(), (c == 2).sum(), (dishes == 1).sum(), (dishes == 2).sum(), on.sum()]
        columns = [
            pa.array(here, pa.int32()), pa.array([group["range"][0].as_py()] * len(here), pa.int32()),
            *(pa.array([packed(f(x)) for x in own], pa.binary()) for f in (lambda x: np.diff(contexts[x].astype(np.int64), prepend=0), lambda x: per_dish[x], lambda x: per_customer[x])),
            *map(pa.array, facts),
        ]
        return pa.table(columns, names=["bucket", "range", "contexts", "dishes", "customers", *_FACTS])

    return run


def _settle(group: pa.Table) -> pa.Table:
    """One bucket of contexts: each range's contexts with the totals over all ranges."""
    rows = group.select(["contexts", "dishes", "customers"]).to_pylist()
    lists = [np.cumsum(unpacked(r["contexts"]), dtype=np.int64) for r in rows]
    _, at = np.unique(np.concatenate(lists), return_inverse=True)
    totals = [np.bincount(at, np.concatenate([unpacked(r[c]) for r in rows])).astype(np.int64) for c in ("dishes", "customers")]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    own = [at[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table([group["range"], group["bucket"], *(pa.array([packed(t[x]) for x in own], pa.binary()) for t in totals)], names=["range", "bucket", "dishes", "customers"])


# -- seating -------------------------------------------------------------------


class Stirling:
    """Logs of S(c, t) / S(c, t - 1) for t from 2 on, of generalised Stirling numbers with a discount.

    S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t) gives the ratios' own recurrence.
    For large c the ratio times discount * (t - 1) depends on t / c alone.
    """

    SMALL, STEP = 256, 0.01

    def __init__(self, discount: float, exact: int = EXACT):
        self.discount, self.exact = discount, exact
        steps = np.arange(1, int(np.log(exact / self.SMALL) / self.STEP) + 1)
        self.grid = np.unique(np.concatenate([np.arange(1, self.SMALL + 1), np.round(self.SMALL * np.exp(steps * self.STEP)).astype(np.int64), [exact]]))
        self.rows: list[np.ndarray] = []
        wanted = set(self.grid.tolist())
        ratio = np.zeros(1)  # ratio[t - 2]; S(1, 2) = 0
        self.rows.append(np.zeros(0))
        for c in range(1, exact):
            below = np.concatenate([[0.0], 1 / ratio[: c - 1]])  # S(c, t - 2) / S(c, t - 1)
            t = np.arange(2, c + 2)
            ratio = (1 + (c - t * discount) * ratio[:c]) / (below + c - (t - 1) * discount)
            if c + 1 in wanted:
                self.rows.append(np.log(ratio))
            ratio = np.append(ratio, 0.0)
        last = np.exp(self.rows[-1]) * discount * np.arange(1, exact)
        self.share = np.minimum(last, 1.0)

    def place(self, c: np.ndarray) -> np.ndarray:
        """The row of the nearest number of customers; beyond the last, whole steps of 1 %."""
        near = np.minimum(np.searchsorted(self.grid, c), len(self.grid) - 1)
        lower = np.maximum(near - 1, 0)
        near = np.where(np.abs(self.grid[lower] - c) < np.abs(self.grid[near] - c), lower, near)
        beyond = np.round(np.log(np.maximum(c, 1) / self.exact) / self.STEP).astype(np.int64)
        return np.where(c > self.exact, len(self.grid) - 1 + np.maximum(beyond, 0), near)

    def customers(self, place: int) -> float:
        over = place - len(self.grid) + 1
        return float(self.grid[place]) if over <= 0 else self.exact * float(np.exp(over * self.STEP))

    def ratios(self, place: int, most: int) -> np.ndarray:
        """The logs for t = 2 .. ``most``."""
        if place < len(self.grid):
            return self.rows[place][: most - 1]
        t = np.arange(2, most + 1)
        at = t * self.exact / self.customers(place)
        share = np.interp(at, np.arange(2, self.exact + 1), self.share)
        share = np.where(at < 2, 1 - (1 - self.share[0]) * (at / 2) ** (self.discount / (1 - self.discount)), share)
        return np.log(np.maximum(share, 1e-300) / (self.discount * (t - 1)))


_STIRLING: dict[float, Stirling] = {}


def stirling(discount: float) -> Stirling:
    """This process's numbers for a discount."""
    if discount not in _STIRLING:
        _STIRLING.clear() if len(_STIRLING) > 3 else None
        _STIRLING[discount] = Stirling(discount)
    return _STIRLING[discount]


def draw_tables(rng, c: np.ndarray, others: np.ndarray, whole: float | np.ndarray, opening: np.ndarray, numbers: Stirling, grows: float = 1.0) -> np.ndarray:
    """Tables of dishes with ``c`` >= 1 customers, each from its full conditional.

    The t-th table weighs ``opening + discount * (t - 1)`` times the parent's probability,
    ``(others + grows * (t - 1)) / whole``.
    """
    d = numbers.discount
    out = np.ones(len(c), np.int64)
    whole = np.broadcast_to(np.asarray(whole, np.float64), c.shape)
    places = numbers.place(c)
    order = np.argsort(places, kind="stable")
    order = order[c[order] > 1]
    cuts = np.flatnonzero(np.diff(places[order])) + 1
    for own in np.split(order, cuts) if len(order) else []:
        place = int(places[own[0]])
        limit = max(int(numbers.customers(place)), 2)
        window = min(limit, 32)
        while len(own):
            ratios = numbers.ratios(place, window)
            j = np.arange(1, len(ratios) + 1)
            rest = []
            for k in range(0, len(own), max(1, (1 << 21) // window)):
                i = own[k : k + max(1, (1 << 21) // window)]
                each = np.log(others[i, None] + grows * j) - np.log(whole[i, None]) + np.log(opening[i, None] + d * j) + ratios
                weight = np.concatenate([np.zeros((len(i), 1)), np.cumsum(each, axis=1)], axis=1)
                weight -= weight.max(axis=1, keepdims=True)
                open_ = (weight[:, -1] > -21) & (window < limit)  # the tail still counts
                mass = np.cumsum(np.exp(weight), axis=1)
                drawn = 1 + (mass < (rng.random(len(i)) * mass[:, -1])[:, None]).sum(axis=1)
                out[i] = np.minimum(drawn, c[i])
                rest.append(i[open_])
            own, window = np.concatenate(rest), min(limit, window * 4)
    return out


def seat(rng, w: np.ndarray, u: np.ndarray, c: np.ndarray, n_words: int, dishes: np.ndarray, customers: np.ndarray, facts: np.ndarray, burn_in: int = BURN_IN, samples: int = SAMPLES) -> np.ndarray:
    """The averaged probability of each cell of one range (word ``w``, context ``u``, ``c`` customers).

    ``dishes`` and ``customers``: each context's over all ranges; ``facts``: as in ``_ask``.
    """
    _, v, once, twice, alone, paired, every = facts.tolist()
    share = lambda a, b: round(float(np.clip(a / max(a + 2 * b, 1), 0.1, 0.95)), 6)
    one, two = stirling(share(once, twice)), stirling(share(alone, paired))
    d1, d0, h = one.discount, two.discount, 1 / (v + 1)
    on = c > 0
    t = on.astype(np.int64)
    local = np.bincount(u, t, len(dishes))
    c0 = np.bincount(w, t, n_words)
    t0 = (c0 > 0).astype(np.int64)
    many = np.flatnonzero(c > 1)
    scale0, scale1 = v / max(t0.sum(), 1), every / max(local.sum(), 1)
    out = np.zeros(len(c))

    def totals():
        here = np.bincount(u, t, len(dishes))
        usual = here.sum() / max(local.sum(), 1)
        tables = here + np.maximum(dishes - local, 0) * (here + 8 * usual) / (local + 8)
        return tables, float(here.sum()) * scale1, float(t0.sum()) * scale0

    for i in range(burn_in + samples):
        tables, customers0, tables0 = totals()
        low = np.maximum(c0 - d0 * t0, 0) + (STRENGTH + d0 * tables0) * h
        if len(many):
            others = np.maximum(low[w[many]] - t[many], (STRENGTH + d0 * tables0) * h - d0)
            t[many] = draw_tables(rng, c[many], others, STRENGTH + customers0, STRENGTH + d1 * np.maximum(tables[u[many]] - t[many], 0), one)
        c0 = np.bincount(w, t, n_words).astype(np.int64)
        dish = np.flatnonzero(c0 > 0)
        t0 = np.where(c0 > 0, np.minimum(np.maximum(t0, 1), np.maximum(c0, 1)), 0)
        t0[dish] = draw_tables(rng, c0[dish], np.full(len(dish), h), 1.0, STRENGTH + d0 * np.maximum(tables0 - t0[dish], 0), two, grows=0.0)
        if i >= burn_in:
            tables, customers0, tables0 = totals()
            parent = (np.maximum(c0 - d0 * t0, 0) + (STRENGTH + d0 * tables0) * h) / (STRENGTH + customers0)
            out += (np.maximum(c - d1 * t, 0) + (STRENGTH + d1 * tables[u]) * parent[w]) / (STRENGTH + customers[u])
    return out / samples


_ANSWERS = "block long, `range` int, n binary, log_p binary, facts binary"


def _answer(group: pa.Table, totals: pa.Table) -> pa.Table:
    """For each block: the training counts of its words and the probabilities of its cells, in its own order."""
    blocks, n_words, at, w, c, place, ends, _, u = _merge_lists(group)
    rows = sorted(totals.to_pylist(), key=lambda r: r["bucket"])
    dishes, customers = (np.concatenate([unpacked(r[k]) for r in rows]).astype(np.float64) for k in ("dishes", "customers"))
    rng = np.random.default_rng([7919, group["range"][0].as_py()])
    facts = np.array([rows[0][f] for f in _FACTS], np.int64)
    p = seat(rng, w, u, c, len(n_words), dishes, customers, facts)
    del w, c, u
    release()
    coded = np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * UNIT), 0, 65_535).astype(np.uint16)
    starts = np.concatenate([[[0, 0]], ends[:-1]]).astype(np.int64)
    columns = [
        pa.array(blocks, pa.int64()), pa.array([group["range"][0].as_py()] * len(blocks), pa.int32()),
        pa.array([packed(n_words[at[i:j]]) for i, j in zip(starts[:, 0].tolist(), ends[:, 0].tolist(), strict=True)], pa.binary()),
        pa.array([packed(coded[place[i:j]]) for i, j in zip(starts[:, 1].tolist(), ends[:, 1].tolist(), strict=True)], pa.binary()),
        pa.array([facts.tobytes()] * len(blocks), pa.binary()),
    ]
    return pa.table(columns, names=["block", "range", "n", "log_p", "facts"])


_SCORES = "id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The scores of a block's texts."""
    r = block.to_pylist()[0]
    order = sorted(answers.to_pylist(), key=lambda a: a["range"])
    at, sizes = unpacked(r["tokens"]), unpacked(r["sizes"]).astype(np.int64)
    n = np.concatenate([unpacked(a["n"]) for a in order]).astype(np.float64)[at]
    log_p = np.concatenate([unpacked(a["log_p"]) for a in order]) / -UNIT
    key = cells_of(at, sizes)
    every = np.sort(key)
    own = np.searchsorted(every[np.concatenate([[True], every[1:] != every[:-1]])], key)
    facts = np.frombuffer(order[0]["facts"], np.int64)
    begin = np.cumsum(sizes) - sizes
    add = lambda x: np.add.reduceat(x, begin)  # noqa: E731  every text has a token
    ids = _ids(r["ids"])
    base = np.log10((n + 1) / (facts[0] + (facts[1] + 1)))
    return pa.table({"id": ids["id"], "held_out": ids["held"], "n_tokens": sizes, "n_known": add((n > 0).astype(np.int64)), "train_tokens": np.full(len(sizes), int(facts[0])), "base_score": add(base), "score": add(log_p[own])})


def scores(docs: DataFrame, held: str = f"__crc % {FOLDS} = {HELD}") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text; trained on rows not held out."""
    spark = session(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"), crc_of_id().alias("__crc")).withColumn("held", F.expr(held)).drop("__crc")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(partitions(spark), -(-size // RANGE))

    blocks = staged(rows.mapInArrow(_read_blocks, _BLOCKS), "blocks")
    # one exchange of the lists serves both readings of a range
    by_range = blocks.mapInArrow(_list_cells(n_ranges), _LISTS).groupBy("range")
    asks = by_range.applyInArrow(_ask(n_ranges), _ASKS).repartition("bucket")
    facts = asks.agg(*[F.sum(f).alias(f) for f in _FACTS])  # one row
    totals = asks.groupBy("bucket").applyInArrow(_settle, _TOTALS).crossJoin(F.broadcast(facts))
    answers = by_range.cogroup(totals.groupBy("range")).applyInArrow(_answer, _ANSWERS)
    texts = blocks.select("block", "tokens", "sizes", "ids")
    found = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, _SCORES)
    kind = docs.schema["doc_id"].dataType
    return found.select(F.col("id").cast(kind).alias("doc_id"), *[c.split()[0] for c in _SCORES.split(", ")[1:]])


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those whose crc32(doc_id) modulo 7 is not 2."""
    return scores(table(spark, sf_dir, "documents"))
