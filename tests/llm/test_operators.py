"""Each operator against a plain brute-force version on whole small tables."""

import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest
import xxhash

from lumenfew.llm import mixing, packing, pitman_yor, quality, simhash, suffix, syncmers, tokencount, toxicity, warc

SPLIT = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return SPLIT.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory, docs):
    """Nulls in every column, empty and very long texts, repeated rows, ties, marks, and columns that clash."""
    passage = " ".join(f"shared{i} words{i * 7 % 13}" for i in range(60))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 6), (None, "no id here " * 30, "en", None, 1), (None, "no id here " * 30, "en", None, 1),
        (4, "one", "en", "b", 3), (5, "two words", "en", "b", 9), (6, "ONE", "de", "b", 3), (7, passage + " tail one", "en", "c", 1), (8, "head " + passage, "en", "c", 1),
        (9, passage + " tail one", "en", "a", 1), (9, passage + " tail one", "en", "a", 1), (10, "é ü 漢字  x y 'tis it's we'll <|endoftext|> 123 4! İ ﬁ é", "fr", "z", 1),
        (11, " ".join(f"w{i * i % 9973}" for i in range(60_000)), "en", "c", 1), (12, "ab " * 400, "en", "c", 1), (13, "x" * 3000, "en", "c", 1), (14, "\x00 nul \x1f\x85", "en", "c", 1),
    ]
    rows += [(100 + i, docs[i]["text"], "en", docs[i]["source"], 1) for i in range(0, 40)]
    folder = tmp_path_factory.mktemp("odd")
    frame = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(("key", "size", "tie", "target", "kept", "score", "simhash", "begin", "epoch", "n_words", "start", "copies", "__text2", "a.b")):
        frame = frame.selectExpr("*", f"{i} as `{c}`")
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(100, 140)] + [(None, 1, None), (101, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def table(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


OPS = [mixing.op1_mixing, packing.op2_packing, suffix.op3_suffix_dedup, tokencount.op4_token_counts, toxicity.op5_toxicity, warc.op6_warc, pitman_yor.op7_language_model, simhash.op8_simhash, syncmers.op9_syncmers, quality.op10_quality_rules]


@pytest.mark.parametrize("op", OPS, ids=lambda f: f.__name__)
def test_empty_tables(spark, empty, op):
    assert op(spark, empty).collect() == []


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_mixing_equals_sql(spark, sf, odd, which):
    folder = {"sf": sf, "odd": odd}[which]
    got = mixing.op1_mixing(spark, folder).toPandas()
    con = duckdb.connect()
    src = f"{folder}/documents.parquet" + ("/*.parquet" if which == "odd" else "")
    con.sql(f"create view documents as select * from '{src}'")
    want = con.sql(mixing.OP1_SQL).df()
    order = ["doc_id", "size", "taken"]
    if which == "odd":  # rows that share an id may change places
        got, want = (d[d.doc_id.notna() & (d.doc_id != 9)] for d in (got, want))
    got, want = (d.sort_values(order).reset_index(drop=True)[["doc_id", "size", "source_size", "target", "taken", "first_slot", "epochs"]] for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
    assert (got.taken <= 2 * got["size"]).all()
    assert (got.first_slot.notna() == (got.taken > 0)).all() and ((got.epochs > 0) == (got.taken > 0)).all()


def test_mix_is_low_discrepancy_and_whole(spark, sf):
    from lumenfew.llm.common import staged

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sized = staged(mixing.sizes(docs, ["doc_id", "source"]), "t")
    goals = staged(mixing.targets(sized), "t")
    slots = mixing.schedule(goals).toPandas().sort_values("t")
    total = slots.words.sum()
    share = {r.source: r.target for r in goals.collect()}
    assert {k: int(v) for k, v in share.items()} == slots.groupby("source", dropna=False).words.sum().to_dict()
    half = slots[slots.t <= slots.t.median()]
    for s, t in share.items():
        assert abs(half[half.source == s].words.sum() / half.words.sum() - t / total) < 0.03
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    taken = mixing.op1_mixing(spark, sf).toPandas().set_index("doc_id").taken
    found = Counter()
    for r in mixed.collect():
        found[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(found)


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_packing_round_trip(spark, sf, odd, which):
    from tokenizers import Tokenizer

    folder = {"sf": sf, "odd": odd}[which]
    library = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pieces(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"]).collect()
    digest = packing.op2_packing(spark, folder).collect()
    assert sorted((str(r.doc_id), r.start, r.length, zlib.crc32(r.ids), r.doc_tokens) for r in rows) == sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in digest)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.length == 1 << r.bucket for r in rows)
    assert len({r.sequence_id for r in rows}) == len(rows)
    want, got = Counter(), Counter()
    for d in table(folder):
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[d["doc_id"], ids] += 1
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for (doc, n), parts in own.items():
        copies = sum(s == 0 for s, _ in parts)
        parts = sorted(parts)[:: copies or 1]
        ids = b"".join(p for _, p in parts)
        assert len(ids) == 4 * n and [s for s, _ in parts] == [len(b"".join(p for _, p in parts[:i])) // 4 for i in range(len(parts))]
        got[doc, ids] += copies
    assert got == want


def removed_by_brute_force(texts, length=400):
    codes = [np.fromiter((hash(t[i : i + length]) for i in range(len(t) - length + 1)), np.int64, max(len(t) - length + 1, 0)) for t in texts]
    names, counts = np.unique(np.concatenate(codes), return_counts=True)
    for t, own in zip(texts, codes, strict=True):
        mask = bytearray(len(t))
        for i in np.flatnonzero(counts[np.searchsorted(names, own)] > 1).tolist():
            mask[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(mask)))
        yield sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask, strict=True) if not m)).hexdigest()


def test_suffix_dedup(spark, sf, odd):
    for folder in (sf, odd):
        rows = [r for r in table(folder) if len(r["text"] or "") < 50_000]
        source = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
        import tempfile

        own = tempfile.mkdtemp(prefix="lumenfew-")
        source.repartition(3).write.parquet(f"{own}/documents.parquet")
        got = Counter(tuple(r) for r in suffix.op3_suffix_dedup(spark, own).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        texts = [(r["text"] or "").encode() for r in rows]
        want = Counter((r["doc_id"], len(t), *x) for r, t, x in zip(rows, texts, removed_by_brute_force(texts), strict=True))
        assert got == want
        assert any(k[2] for k in want)


def test_suffix_dedup_many_shards(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    shared = ["".join(chr(97 + c) for c in rng.integers(0, 4, 450)) for _ in range(6)]
    rows = []
    for i in range(120):
        fill = lambda: "".join(chr(97 + c) for c in rng.integers(0, 4, int(rng.integers(0, 900))))
        rows.append((i, fill() + (shared[i % 6] if i % 3 else "") + fill() + ("ab" * 300 if i % 40 == 0 else "")))
    monkeypatch.setattr(suffix, "SHARD", 4000)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in suffix.op3_suffix_dedup(spark, str(tmp_path)).collect())
    texts = [t.encode() for _, t in rows]
    assert got == sorted((i, len(t), *x) for (i, _), t, x in zip(rows, texts, removed_by_brute_force(texts), strict=True))


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"abracadabra-abracadabra", np.uint8)
    segment, ends = np.zeros(len(data), np.int32), np.array([len(data)])
    packed = suffix.packed_words(suffix.shifted(data, segment))
    sa = suffix.suffix_array(packed, segment, ends)
    text = data.tobytes()
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = suffix.common_prefixes(packed, data, segment, ends, sa)
    for k in range(1, len(sa)):
        a, b = text[sa[k - 1] :], text[sa[k] :]
        assert lcp[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_token_counts(spark, sf, odd, which):
    from tokenizers import Tokenizer

    folder = {"sf": sf, "odd": odd}[which]
    library = Tokenizer.from_file(packing.vocabulary_path())
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.op4_token_counts(spark, folder).collect())
    want = Counter()
    for d in table(folder):
        n = len(library.encode(d["text"] or "", add_special_tokens=False).ids)
        want[d["doc_id"], len((d["text"] or "").encode()), n, n > 2048] += 1
    assert got == want


def test_token_counts_on_strange_text():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.vocabulary_path())
    rng = np.random.default_rng(3)
    alphabet = list("abcdeistlrvm'' 0129.,!?-\n\t éßÀ漢字ひ́😀ΑΣς‍İ") + ["<|endoftext|>", "n't", "'ll", "supercalifragilistic"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(400)] + ["a" * 2000, "'" * 700, "é" * 900]
    machine = tokencount.Transducer(packing.vocabulary_path())
    assert machine.counts(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("states, rounds", [(120_000, 12), (120_000, 1), (2_000, 12), (300, 2)])
def test_token_counts_without_white_space(monkeypatch, states, rounds):
    """Chunks composed by maps, by fewer rounds than they need, and with states dropped on the way, count as the library does."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokencount, "STATES", states)
    monkeypatch.setattr(tokencount, "ROUNDS", rounds)
    library = Tokenizer.from_file(packing.vocabulary_path())
    rng = np.random.default_rng(7)
    draw = lambda among, n: "".join(rng.choice(list(among), n))
    texts = ["a" * 3000, "ab" * 1500, draw("abcdefghij", 3000), draw(["the", "naïve", "日本", "don't", "42"], 1500), "日本語" * 700, "é" * 1501, "", "!?" * 900, "'" * 800 + "s", "<|endoftext|>" * 120, "x " * 200]
    machine = tokencount.Transducer(packing.vocabulary_path())
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert machine.counts(texts).tolist() == want
    assert machine.counts(texts[::-1]).tolist() == want[::-1]
    assert len(machine.names) <= machine.most + 64


def test_long_text_without_white_space_takes_few_steps(monkeypatch):
    machine, steps = tokencount.Transducer(packing.vocabulary_path()), []
    march = machine.march
    monkeypatch.setattr(machine, "march", lambda entry, rows, held=(): steps.append(rows.shape) or march(entry, rows, held))
    text = "".join(np.random.default_rng(2).choice(["spark", "model", "data", "learning"], 20_000))
    machine.counts([text])
    lanes = len(text) / tokencount.CHUNK
    assert sum(s[0] for s in steps) <= 8 * tokencount.CHUNK and sum(s[1] for s in steps) <= 6 * lanes


def auc(y, score):
    rank = pd.Series(score).rank()
    y = np.asarray(y)
    return (rank[y == 1].sum() - (n := y.sum()) * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_on_held_out_rows(spark, sf, odd):
    folder = sf.replace("0.001", "0.1")
    got = toxicity.op5_toxicity(spark, folder).toPandas()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pandas().merge(got, on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = labels[labels.held_out & labels.toxic.notna()]
    assert auc(held.toxic.astype(int), held.score) > 0.92  # some labels are wrong on purpose
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.95
    strange = toxicity.op5_toxicity(spark, odd).toPandas()
    assert len(strange) == len(table(odd)) and strange.score.between(0, 1).all()


def test_language_model(spark, sf, odd):
    for folder in (sf, odd):
        got = pitman_yor.op7_language_model(spark, folder).toPandas()
        rows = table(folder)
        held = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2 for r in rows]
        tokens = [[*words(lower(r["text"])), None] for r in rows]
        counts = Counter(t for own, h in zip(tokens, held, strict=True) if not h for t in own)
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(r["doc_id"]), len(own), sum(counts[t] > 0 for t in own), n, round(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4), h) for r, own, h in zip(rows, tokens, held, strict=True))
        own_id = lambda x: "None" if pd.isna(x) else str(int(x))
        assert [x[:4] + x[5:] for x in want] == [x[:4] + x[5:] for x in sorted((own_id(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), r.held_out) for r in got.itertuples())]
        assert np.allclose(sorted(x[4] for x in want), sorted(got.base_score), atol=1e-3)
        assert np.isfinite(got.score).all() and (got.score < 0).all()
        if folder == sf:
            unseen = got[got.held_out]
            assert unseen.score.sum() > unseen.base_score.sum()


def test_pitman_yor_tables_follow_their_conditional():
    numbers = pitman_yor.Stirling(0.6, exact=300)
    s = {(1, 1): 1.0}
    for c in range(1, 12):
        for t in range(1, c + 2):
            s[c + 1, t] = s.get((c, t - 1), 0.0) + (c - 0.6 * t) * s.get((c, t), 0.0)
    rng = np.random.default_rng(0)
    weight = [s[12, t] * np.prod([(0.3 + j) / 50 * (4 + 0.6 * j) for j in range(1, t)]) for t in range(1, 13)]
    drawn = pitman_yor.draw_tables(rng, np.full(40_000, 12), np.full(40_000, 0.3), 50.0, np.full(40_000, 4.0), numbers)
    assert np.allclose(np.bincount(drawn, minlength=13)[1:] / 40_000, np.array(weight) / sum(weight), atol=0.01)
    # beyond the recurrence, ratios follow their law
    far = pitman_yor.Stirling(0.6, exact=3000)
    place = int(numbers.place(np.array([3000]))[0])
    for t in (2, 5, 50, 500, 1500):
        assert abs(numbers.ratios(place, t)[-1] - far.rows[-1][t - 2]) < 0.03
    # a window of tables is widened until its tail no longer counts
    big = pitman_yor.draw_tables(rng, np.full(400, 3000), np.full(400, 9.0), 1000.0, np.full(400, 9000.0), numbers, grows=0.0)
    log_weight = np.concatenate([[0], np.cumsum(np.log(0.009 * (9000 + 0.6 * np.arange(1, 3000))) + far.rows[-1])])
    weight = np.exp(log_weight - log_weight.max())
    mean = (weight * np.arange(1, 3001)).sum() / weight.sum()
    assert mean > 60 and abs(big.mean() / mean - 1) < 0.03


def sampled_by_customers(texts, held, sweeps=160, burn_in=60, strength=1.0):
    """A plain sampler: every customer of every restaurant moves by itself, with each table's size at hand."""
    rng = np.random.default_rng(1)
    tokens = [[*words(lower(t)), None] for t in texts]
    pairs = [(a, b) for own, h in zip(tokens, held, strict=True) if not h for a, b in zip(["<", *own[:-1]], own, strict=True)]
    cells = Counter(pairs)
    v = len({b for _, b in cells})
    share = lambda n: min(max((a := n.count(1)) / max(a + 2 * n.count(2), 1), 0.1), 0.95)
    d1, d0 = share(list(cells.values())), share(list(Counter(b for _, b in cells).values()))
    rooms, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    size, tables, total = Counter(), Counter(), [0, 0]

    def parent(w):
        own = root.get(w, ())
        return (sum(own) - d0 * len(own) + (strength + d0 * total[1]) / (v + 1)) / (strength + total[0])

    def sit(own, d, new):
        weights = [n - d for n in own] + [new]
        k = int(np.searchsorted(np.cumsum(weights), rng.random() * sum(weights)))
        own.append(1) if k >= len(own) else own.__setitem__(k, own[k] + 1)
        return k >= len(own) - 1 and own[-1] == 1 and k == len(own) - 1

    def leave(own):
        k = int(np.searchsorted(np.cumsum(own), rng.random() * sum(own), "right"))
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            return True
        return False

    def enter(a, b):
        before = len(rooms[a][b])
        sit(rooms[a][b], d1, (strength + d1 * tables[a]) * parent(b))
        size[a] += 1
        if len(rooms[a][b]) > before:
            tables[a] += 1
            old = len(root[b])
            sit(root[b], d0, (strength + d0 * total[1]) / (v + 1))
            total[0] += 1
            total[1] += len(root[b]) > old

    for a, b in pairs:
        enter(a, b)
    out, n = np.zeros(len(texts)), 0
    sums = defaultdict(float)
    for i in range(sweeps):
        for a, b in pairs:
            size[a] -= 1
            if leave(rooms[a][b]):
                tables[a] -= 1
                total[0] -= 1
                total[1] -= leave(root[b])
            enter(a, b)
        if i >= burn_in and i % 5 == 0:
            n += 1
            for a, b in {(a, b) for own in tokens for a, b in zip(["<", *own[:-1]], own, strict=True)}:
                own = rooms[a].get(b, [])
                sums[a, b] += (sum(own) - d1 * len(own) + (strength + d1 * tables[a]) * parent(b)) / (strength + size[a])
    for k, own in enumerate(tokens):
        out[k] = sum(np.log10(sums[p] / n) for p in zip(["<", *own[:-1]], own, strict=True))
    return out, np.array([len(own) for own in tokens])


def test_language_model_equals_a_plain_sampler(spark):
    rng = np.random.default_rng(6)
    names = [f"w{i}" for i in range(30)]
    follows = {a: rng.dirichlet(np.full(30, 0.15)) for a in names}
    texts = []
    for _ in range(70):
        own = ["w0"]
        while len(own) < 25:
            own.append(names[int(rng.choice(30, p=follows[own[-1]]))])
        texts.append(" ".join(own))
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(70)]
    want, n = sampled_by_customers(texts, held)
    got = pitman_yor.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).toPandas().sort_values("doc_id")
    assert np.abs(got.score.to_numpy() - want).max() < 0.02 * n.max() and abs((got.score.to_numpy() - want).sum() / n.sum()) < 0.005
    assert np.corrcoef(got.score / n, want / n)[0, 1] > 0.99
    unseen = got[got.held_out]
    assert unseen.score.sum() > unseen.base_score.sum()


def prints_by_brute_force(text):
    own = lower(text)
    w = words(own)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_simhash(spark, sf, odd, which):
    folder = {"sf": sf, "odd": odd}[which]
    rows = [(r["doc_id"], prints_by_brute_force(r["text"])) for r in table(folder)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    want = Counter((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, folder).collect()) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = {find(i) for i in range(len(rows))}
    ids = kept.select("doc_id").toPandas().doc_id
    assert len(ids) == len(groups) and {int(x) for x in ids.dropna()} == set(least.values())


def test_simhash_links_in_dense_and_chained_lists(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(20, int(rng.integers(0, 6)), replace=False)) for _ in range(900)}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 200)}
    prints = sorted(prints)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(prints)):
        least[find(i)] = min(least.get(find(i), i), i)
    for pairwise in (4, 64):
        monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
        frame = spark.createDataFrame(list(enumerate(prints)), "doc_id long, simhash long")
        got = {r.simhash: r.component_id for r in simhash.groups(frame).collect()}
        assert got == {p: least[find(i)] for i, p in enumerate(prints)}


def spark_hash(values):
    """Spark's xxhash64 of an array of longs: each element's hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def sketch(text):
    h = [x - (1 << 64) if (x := xxhash.xxh64_intdigest(w.encode(), 42)) >> 63 else x for w in words(text)]
    if not h:
        return ""
    kept = [(i + 1, h[i : i + 3]) for i in range(len(h) - 2) if min(h[i], h[i + 2]) == min(h[i : i + 3])] or [(1, h)]
    before = [0] + [at for at, _ in kept]
    return "".join(f"{at - b:x}{spark_hash(r) & 0xFFFFFFFF:08x}" for (at, r), b in zip(kept, before, strict=False))


def like(a, b):
    def whole(s):
        p = [(s[i], s[i + 1 : i + 9]) for i in range(0, len(s), 9)]
        return {c for _, c in p} | {(x[1], *y) for x, y in zip(p, p[1:], strict=False)}

    x, y = whole(a), whole(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_syncmers_keep_positions(spark):
    texts = ["a b c d e f g h i j", "", "x", "x y", *[f"p{i} q{i} r{i}" for i in range(20)], " ".join(f"w{i * i % 9973}" for i in range(9000))]
    moved = f"one two three {texts[-1]}"
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, moved])], "i int, t string").withColumn("f", syncmers.fingerprint(syncmers.F.col("t")))
    got = [r.f for r in frame.orderBy("i").collect()]
    assert got == [sketch(t) for t in [*texts, moved]]
    assert all(got[i] for i in range(2, len(got)))  # a text with words is never like one without
    assert all(g[i] in "12" for g in got for i in range(0, len(g), 9))  # no stretch of a text is without anchors
    pair = frame.where(f"i >= {len(texts) - 1}").groupBy().pivot("i").agg(syncmers.F.first("f"))
    a, b = pair.columns
    near = pair.select(syncmers.likeness(syncmers.F.col(a), syncmers.F.col(b)).alias("n")).first().n
    assert near == like(got[-2], got[-1]) and near > 0.999  # a passage that has moved still matches, positions being relative


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_syncmers(spark, sf, odd, which):
    folder = {"sf": sf, "odd": odd}[which]
    rows = sorted(((r["doc_id"], r["text"] or "") for r in table(folder)), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    want = Counter()
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch(text), sketch(edited), round(like(sketch(text), sketch(edited)), 9), round(like(sketch(text), sketch(after)), 9)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in syncmers.op9_syncmers(spark, folder).collect())
    assert got == want


def test_next_rows_over_many_sampled_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS", 20)
    monkeypatch.setattr(syncmers, "IDS", 2)
    ids = [7 * i - 900 for i in range(600)] + [5] * 40 + [None] * 3  # ties and null ids, and cuts that are far from even
    frame = spark.createDataFrame([(d, f"t{d}-{i % 3}") for i, d in enumerate(ids)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = Counter((r.doc_id, r.text, r.next_text, r.n, r.next_n) for r in syncmers.with_next(frame, ["text"], {"n": syncmers.F.length("text")}).collect())
    assert got == Counter((d, t, after, len(t), len(after)) for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True))


def measured(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_quality_of_a_text_is_its_own(spark, docs):
    import pyarrow as pa

    from lumenfew.llm.textvec import words_of

    texts = ["", "a", "abc de", *[d["text"] for d in docs[:30]], "é 漢字 x", ""]
    rng = np.random.default_rng(2)
    weights = rng.normal(size=quality.BUCKETS)
    together = quality.logits(words_of(pa.array(texts)), weights)
    alone = [quality.logits(words_of(pa.array([t])), weights)[0] for t in texts]
    assert np.allclose(together, alone)
    for i, (a, b) in enumerate(zip(*quality._features(pa.array(texts)), strict=True)):
        x, y = (c[0] for c in quality._features(pa.array([texts[i]])))
        assert a == x and b == y
    # one and the same count by hand
    w = words("abc de fgh de")
    kinds = quality._grams(words_of(pa.array(["zz yy", "abc de fgh de", "q"])))
    assert [int(x[2] - x[1]) for _, x in kinds] == [len(w), len(w) - 1, len("abc de fgh de") - 3]


def test_quality_takes_text_ids_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"fine{i}" for i in range(50)], [f"junk{i}" for i in range(50)]
    rows = [(f"d{i // 2}", " ".join(rng.choice(good if (i // 2) % 2 else bad, 80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(100)], "doc_id string, quality int")
    got = quality.apply(docs, quality.train(docs, labels), keep=["doc_id"]).collect()
    assert all((r.quality > 0.5) == (int(r.doc_id[1:]) % 2 == 1) for r in got)


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_quality_counts(spark, sf, odd, which):
    folder = {"sf": sf, "odd": odd}[which]
    got = Counter(tuple(r) for r in quality.op10_quality_rules(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    assert got == Counter((r["doc_id"], *measured(r["text"])) for r in table(folder))


def test_quality_on_rows_that_training_did_not_see(spark, sf):
    folder = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.apply(docs, model, keep=["doc_id"]).toPandas().merge(pq.read_table(f"{folder}/labels.parquet").to_pandas(), on="doc_id")
    held = got[(got.doc_id % 3 == 0) & got.quality_y.notna() & ~got.base_failed]
    assert auc(held.quality_y.astype(int), held.quality_x) > 0.9
    assert (held[held.quality_y == 1].kept).mean() > 0.95


def test_warc_round_trip(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(9001, None, None), (9002, "http://é.example/ü", ""), (9003, "http://x", "<p>caf&eacute;</p><script>no</script><!-- no --> \r\n\r\n WARC/1.1 <a href='/y'>y</a>")], "page_id long, url string, html string")
    rows = warc.responses(pages.select("page_id", "url", "html").unionAll(extra))
    made = warc.derivatives(rows).cache()
    n = pages.count() + 3
    assert made.count() == n
    for compressed in (False, True):
        for column in ("conversion", "metadata"):
            path = f"{tmp_path}/{column}-{compressed}"
            warc.write(made, column, path, compressed)
            back = {r.headers["WARC-Record-ID"]: r for r in warc.read(spark, f"{path}/part-*").collect()}
            assert len(back) == n
            for r in made.collect():
                own = back[r[f"{column}_id"]]
                assert own.headers["WARC-Refers-To"] == r.response_id and own.headers["WARC-Block-Digest"] == warc.digest(own.block)
                if column == "conversion":
                    assert own.block.decode() == r.text and warc.digest(own.block) == r.text_digest
                else:
                    facts = json.loads(own.block)
                    assert facts["refers_to"] == r.response_id and facts["conversion"] == r.conversion_id and facts["payload_digest"] == r.source_payload_digest == r.payload_digest
                    assert facts["warc_headers"]["WARC-Record-ID"] == r.response_id and facts["http_headers"]["Content-Type"].startswith("text/html")
    one = made.where("page_id = '9003'").first()
    assert "café" in one.text and "no" not in one.text.split() and one.n_links == 1


def test_warc_query_returns_every_page(spark, sf):
    got = warc.op6_warc(spark, sf)
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(json.loads(r.metadata_json)["refers_to"] == r.response_id for r in rows)


def test_toxicity_with_every_document_labelled(spark):
    rng = np.random.default_rng(8)
    fine, bad = [[f"{a}{i}" for i in range(40)] for a in ("calm", "vile")]
    rows = [(i, " ".join([*rng.choice(fine, 30), *rng.choice(bad if i % 10 == 0 else fine, 6)])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.apply(docs, toxicity.train(docs, labels), keep=["doc_id"]).collect()}
    assert sum(got[i] for i in got if i % 10 == 0) > 108
    assert sum(got[i] for i in got if i % 10) < 11


def test_toxicity_fits_one_row_an_id_within_bytes(spark, monkeypatch):
    rows = [(i % 6, f"word{i} some more words of text {'long ' * (i // 6)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(i, y) for i in range(6) for y in (0, 1)], "doc_id long, y int")
    every = toxicity.sampled(docs, chosen).collect()
    assert sorted((r.doc_id, r.y) for r in every) == sorted((i, y) for i in range(6) for y in (0, 1))
    own = {bytes(f) for f in toxicity._features(pa.array([t for _, t in rows]))[0].to_pylist()}
    assert all(bytes(r.buckets) in own for r in every)
    monkeypatch.setattr(toxicity, "BYTES", max(len(r.buckets) for r in every) * 3)
    few = toxicity.sampled(docs, chosen).collect()
    for y in (0, 1):
        assert 3 <= sum(r.y == y for r in few) < 6 and sum(len(r.buckets) for r in few if r.y == y) <= toxicity.BYTES


def test_toxicity_fit_equals_a_dense_version():
    rng = np.random.default_rng(5)
    n, width, prior, decay, rate = 200, 30, 0.2, 3e-4, 0.05
    toxic = rng.random(n) < 0.15
    x = rng.random((n, width)) < np.where(toxic[:, None] & (np.arange(width) < 8), 0.8, 0.05)
    sides = x[toxic], x
    lists = [[np.flatnonzero(r) for r in side] for side in sides]
    got = toxicity.fit(*lists, prior)
    count_p, count_u = (s.sum(axis=0) for s in sides)
    odds = np.log((count_p + 0.5) / (len(sides[0]) + 1) / ((count_u + 0.5) / (n + 1)))
    use = (count_p >= toxicity.LEAST) & (odds > 2.5 * np.sqrt(1 / (count_p + 0.5) + 1 / (count_u + 0.5))) & (odds > 0.4)
    scaled = [s * np.where(use, odds, 0.0) for s in sides]
    theta = np.append(np.where(use, 0.5, 0.0), -2.0)
    first, second = np.zeros(width + 1), np.zeros(width + 1)

    def parts(theta):
        """Values and gradients of the confirmed part and of the part that may not fall below zero."""
        zp, zu = (s @ theta[:-1] + theta[-1] for s in scaled)
        up, uu = (np.hstack([s, np.ones((len(s), 1))]) for s in scaled)
        p, u = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        rest = np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
        return rest, prior * up.T @ (p - 1) / len(p), uu.T @ u / len(u) - prior * up.T @ p / len(p)

    for t in range(1, 201):
        rest, confirmed, other = parts(theta)
        grad = (confirmed + other if rest >= 0 else -other) + decay * np.append(theta[:-1], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta - rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta[:-1] = np.where(use, np.maximum(theta[:-1], 0), 0)
    assert use.sum() >= 3
    np.testing.assert_allclose(got.weights[:width], theta[:-1] * np.where(use, odds, 0), rtol=1e-4, atol=1e-5)
    z = x @ got.weights[:width].astype(float) + got.bias
    assert abs((1 / (1 + np.exp(-z))).mean() - prior) < 1e-6


def test_toxicity_counts_all_training_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "UNLABELLED", 20)
    seen = {}
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: seen.update(k) or fit(*a, **k))
    rows = [(i, "vile words" if i % 4 == 0 else "calm words") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    toxicity.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "doc_id long, toxic int"))
    trained = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    counts, n = seen["seen"]
    assert n == len(trained) and counts.max() == n
    assert sum(t.startswith("vile") for t in trained) in counts


def derived_by_brute_force(url, page, key):
    """A page's facts by Python's own HTML parser and plain formulas."""
    import base64
    import html as entities
    import uuid
    from html.parser import HTMLParser

    blocks = set("address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    hidden = set("script style noscript template head".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.out, self.links, self.deep = [], [], []

        def handle_starttag(self, tag, attrs):
            if self.deep:
                return
            if tag in hidden:
                self.deep.append(tag)
                return
            self.out.append("\n" if tag in blocks else "")
            self.links += [v or "" for k, v in attrs if tag == "a" and k == "href"][:1]

        def handle_endtag(self, tag):
            if self.deep:
                if tag == self.deep[-1]:
                    self.deep.pop()
                    self.out.append(" ")
                return
            self.out.append("\n" if tag in blocks else "")

        def handle_data(self, data):
            self.out.append("" if self.deep else data)

        def handle_entityref(self, name):
            self.out.append("" if self.deep else entities.unescape(f"&{name};"))

        def handle_charref(self, name):
            self.out.append("" if self.deep else entities.unescape(f"&#{name};"))

        def handle_comment(self, data):
            self.out.append("" if self.deep else " ")

    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = [" ".join(x.split()) for x in "".join(reader.out).split("\n")]
    text = "\n".join(x for x in lines if x)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda *parts: f"<urn:uuid:{uuid.uuid5(uuid.UUID('7b0f3c0a-0000-5000-8000-000000000000'), '|'.join(map(str, parts)))}>"
    source = name("response", key, url, "1970-01-01T00:00:00Z", sha(page.encode()))
    return source, name("conversion", source), name("metadata", source), sha(page.encode()), text, sha(text.encode()), len(reader.links)


def test_warc_equals_brute_force(spark, sf):
    got = {r.page_id: r for r in warc.op6_warc(spark, sf).collect()}
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        want = derived_by_brute_force(p["url"], p["html"] or "", p["page_id"])
        assert (r.response_id, r.conversion_id, r.metadata_id, r.payload_digest, r.text, r.text_digest, r.n_links) == want
        facts = json.loads(r.metadata_json)
        assert facts["payload_digest"] == want[3] and facts["text_digest"] == want[5] and facts["refers_to"] == want[0] and facts["warc_headers"]["WARC-Target-URI"] == p["url"]


def test_warc_reads_broken_files_and_odd_pages(spark, tmp_path):
    import gzip
    import time

    whole = warc.response("http://a", "<p>one</p>", warc.DATE, 1)[1]
    two = warc.response("http://b", "<p>two</p>", warc.DATE, 2)[1]
    assert [h["WARC-Target-URI"] for h, _ in warc.parse(whole + b"\r\n\r\n" + two)] == ["http://a", "http://b"]
    assert [h["WARC-Target-URI"] for h, _ in warc.parse(whole + b"\r\n\r\n" + two[:-3])] == ["http://a"]  # cut short
    assert warc.parse(whole[:40]) == [] and warc.parse(b"") == [] and warc.parse(b"\x1f\x8bnothing") == []
    odd = b"WARC/1.0\r\nno colon here\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert warc.parse(odd + whole)[0] == ({"WARC-Type": "response", "Content-Length": "2"}, b"hi") and len(warc.parse(odd + whole)) == 2
    assert [h["WARC-Target-URI"] for h, _ in warc.parse(b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + whole)] == ["http://a"]
    assert len(warc.parse(gzip.compress(whole) + gzip.compress(two))) == 2 and len(warc.parse(gzip.compress(whole) + gzip.compress(two)[:20])) == 1
    began = time.time()
    for page in ("<script>" * 60_000, "<" * 300_000, "<!--" * 100_000, "<a href=" * 50_000, "x" * 2_000_000, "<title>" * 100_000, "<title " * 100_000 + ">", "<a " * 200_000 + ">", "<a href='" * 50_000 + ">", "<a href" + " " * 300_000 + ">", "<a href=\"x" * 50_000 + ">"):
        warc.plain_text(page), warc.links(page), warc.title_of(page)
    assert time.time() - began < 20
    rows = [(1, None, None, "k"), (1, None, None, "k"), (2, "http://x", "<p>a</p>", "m"), (None, "http://y", "<b>", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = warc.derivatives(warc.responses(frame)).collect()
    assert len(got) == 4 and got[0].response_id == got[1].response_id and sorted(r.text for r in got) == ["", "", "", "a"]
    bare = spark.createDataFrame([(bytearray(odd),), (None,), (bytearray(b"junk"),)], "record binary")
    assert [r.text for r in warc.derivatives(bare).collect()] == [""]


def test_warc_headers_stay_whole_and_records_begin_lines(spark):
    urls = ["http://a\r\n\r\nb", "http://a\nWARC-Type: request", "\r", "http://plain", None]
    frame = spark.createDataFrame([(i, u, f"<p>page {i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.derivatives(warc.responses(frame)).collect()}
    assert sorted(got) == [str(i) for i in range(len(urls))]
    for i, url in enumerate(urls):
        (headers, block), = warc.parse(bytes(got[str(i)].metadata))
        assert got[str(i)].text == f"page {i}" and json.loads(block)["warc_headers"].get("WARC-Target-URI") == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
    whole = warc.response("http://a", "<p>one</p>", warc.DATE, 1)[1]
    body = b"see WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi"
    broken = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n" + body + b"\r\n\r\n"
    assert [h["WARC-Target-URI"] for h, _ in warc.parse(broken + whole)] == ["http://a"]
    assert [h["WARC-Target-URI"] for h, _ in warc.parse(b"WARC/1.1\r\nWARC-Type: resp" + b"\r\n" + whole)] == ["http://a"]
    assert warc.parse(b"WARC/1.0\r\n\r\n" + whole + b"WARC/1.0\r\n" * 100_000 + b"\r\n")[0][0]["WARC-Target-URI"] == "http://a"
    assert warc.parse(b"WARC/x\r\nContent-Length: 0\r\n\r\n") == [] and warc.parse(b" WARC/1.0\r\nContent-Length: 0\r\n\r\n") == []


def test_warc_links_and_titles():
    page = """<a class=x HREF = "/one?a=1&amp;b=2">1</a><a>no</a><a name='b' href='/t>wo'>2</a><A href=/three>3</A><abbr href=no><a <a href="/four">4</a><a data-x="y" href="">5</a>"""
    assert warc.links(page) == ["/one?a=1&b=2", "/t>wo", "/three", "/four", ""]
    assert warc.title_of("<head><TITLE lang=en> a &lt; b </title>") == "a < b" and warc.title_of("<title>open") is None and warc.title_of("</title>") is None


def test_language_model_rows_follow_the_cells(monkeypatch):
    """However many buckets there are, a range writes no more rows than it has contexts."""
    rng = np.random.default_rng(6)
    for n in (300, 3000):
        text = pa.array([" ".join(f"w{i}" for i in rng.zipf(1.5, 12) % 500) for _ in range(n // 12)])
        batch = pa.RecordBatch.from_arrays([pa.array([False] * len(text)), pa.array([str(i) for i in range(len(text))]), text], names=["held", "id", "text"])
        monkeypatch.setattr(pitman_yor, "TaskContext", type("One", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
        blocks = list(pitman_yor._read_blocks([batch]))
        lists = pa.Table.from_batches([b for x in blocks for b in pitman_yor._list_cells(64)([x])])
        made = [pitman_yor._ask(1 << 20)(lists.filter(pa.compute.equal(lists["range"], k))) for k in sorted(set(lists["range"].to_pylist()))]
        cells = sum(len(pitman_yor.unpacked(c)) for c in lists["cell_context"].to_pylist())
        asked = sum(len(pitman_yor.unpacked(c)) for m in made for c in m["contexts"].to_pylist())
        assert len(made) <= 64 and sum(m.num_rows for m in made) <= asked <= cells
        assert all(len(pitman_yor.unpacked(c)) for m in made for c in m["contexts"].to_pylist())
        assert sum(sum(m["words"].to_pylist()) for m in made) == 13 * len(text)
