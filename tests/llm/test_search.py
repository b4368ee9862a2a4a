"""Hard negatives, nearest neighbours and lexical search against plain brute-force versions."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfew.llm import lexical, multiindex, negatives

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, embedding array<float>, label int, `part` int, `asked` int, `a.b` int"
NAN, INF = float("nan"), float("inf")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_brute_force(docs, items, k=10):
    counts = [Counter(terms(d["text"])) for d in docs]
    n = [sum(c.values()) for c in counts]
    total, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    wanted = defaultdict(set)
    for item in items:
        wanted[item["item_id"]].update(terms(item["text"]))
    out = []
    for item, own in wanted.items():
        scores = []
        for d, c, size in zip(docs, counts, n, strict=True):
            m = 10 + (90 * size * total) // words if words else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d["doc_id"] is None, d["doc_id"] or 0))
        out += [(item, i + 1, None if gone else d, -s) for i, (s, gone, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(folder, name, table):
    (folder / f"{name}.parquet").mkdir()
    pq.write_table(table, folder / f"{name}.parquet/part-0.parquet")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Nulls, non-finite and zero vectors, other lengths, repeated rows and ids, ties, great values, and columns that clash."""
    rng = np.random.default_rng(5)
    base = [(int(i), [float(v) for v in x], int(i) % 3, 1, 1, 1) for i, x in enumerate(np.round(rng.normal(size=(180, 8)), 2))]
    same = [0.5] * 8
    odd = [(None, same, 1, 1, 1, 1), (200, None, 1, 1, 1, 1), (300, [0.1, None, 0.3], 1, 1, 1, 1), (400, [NAN] * 8, 1, 1, 1, 1), (500, [INF] * 8, 1, 1, 1, 1), (600, [0.0] * 8, 1, None, 1, 1), (700, [], 2, 1, None, 1)]
    odd += [(800, same, None, 1, 1, 1), (900, [1.0, 2.0], 1, 1, 1, 1), (1000, [3.0] * 11, 0, 1, 1, 1), (1100, [5e4] * 8, 2, 1, 1, 1)]
    odd += [(1200, same, 1, 1, 1, 1)] * 3 + [(1300 + i, same, i % 2, 1, 1, 1) for i in range(60)] + [(1300, [-v for v in same], 0, 1, 1, 1)]
    folder = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(base + odd, VECTORS).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def padded(folder, with_label):
    kept = []
    for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (r["label"] is not None or not with_label):
            kept.append((r["vec_id"], r["label"], v + [0.0] * (11 - len(v))))
    return kept


def negatives_by_brute_force(kept):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in kept]
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in kept if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            found = [(t, n) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(found)]
    return sorted(out, key=str)


def test_negatives_equal_brute_force_on_odd_vectors(spark, vectors):
    got = negatives.op11_hard_negatives(spark, vectors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives_by_brute_force(padded(vectors, True))
    assert want and rows(got) == want


def test_negatives_in_small_shards_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 3)
    monkeypatch.setattr(negatives, "SHARD", 50)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 300)
    assert rows(negatives.op11_hard_negatives(spark, vectors)) == negatives_by_brute_force(padded(vectors, True))


def test_trees_prune_clustered_rows():
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.normal(size=(40, 16)) * 300, 50, axis=0) + rng.normal(size=(2000, 16)) * 3).astype(np.int64)
    labels = rng.integers(0, 4, 2000)
    made = negatives.grown(np.arange(2000), labels, x)
    row = {"rows": 2000, "wide": 16, **{k: v.tobytes() for k, v in made.items()}}
    asked = negatives.Asked(x[:20], np.arange(20), labels[:20], True, 5)
    seen = []
    leaf = negatives.Asked.leaf
    asked.leaf = lambda tree, start, end, who, exact: (seen.append((end - start) * len(who)), leaf(asked, tree, start, end, who, exact))
    asked.ask(negatives.Tree(row))
    assert sum(seen) < 0.3 * 20 * 2000 / 4  # of the rows with the label
    for i in range(20):
        score = x @ x[i]
        best = sorted((-score[j], j) for j in range(2000) if j != i and labels[j] == labels[i])[:5]
        assert [(-s, p) for s, p in zip(asked.score[i].tolist(), asked.partner[i].tolist(), strict=True)] == best


def product(v, w):
    """From the first component to the last, without compensation."""
    total = 0.0
    for a, b in zip(v, w, strict=True):
        total += a * b
    return total


def near_by_brute_force(kept, k=20):
    kept = [(i, v) for i, _, v in kept if any(v)]
    out = []
    for i, v in kept:
        if i % 20 == 0:
            best = sorted({(-product(v, w), j) for j, w in kept if j != i})[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(set(out), key=str)


def test_neighbours_equal_brute_force_where_all_cells_are_met(spark, vectors):
    got = multiindex.op12_nearest_neighbours(spark, vectors)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = near_by_brute_force(padded(vectors, False))
    assert sorted(set(rows(got)), key=str) == want
    assert [r for r in want if r[0] == 1200 and r[2] != 1200]


def test_neighbours_in_crowded_cells_and_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(multiindex, "PART", 7)
    monkeypatch.setattr(multiindex, "BLOCK_BYTES", 500)
    monkeypatch.setattr(multiindex, "KEPT_BYTES", 100)
    assert sorted(set(rows(multiindex.op12_nearest_neighbours(spark, vectors))), key=str) == near_by_brute_force(padded(vectors, False))


def test_pairs_come_by_summed_products():
    rng = np.random.default_rng(2)
    for near in (1, 5, 40, 300):
        one, two, counts = rng.normal(size=6), rng.normal(size=7), rng.integers(0, 9, (6, 7))
        sums = (one[:, None] + two[None]).ravel()
        order = np.argsort(-sums)
        held = np.cumsum(counts.ravel()[order])
        at = np.flatnonzero(held >= near)
        assert multiindex.traversed(one, two, counts, near) == (sums[order[at[0]]] if len(at) else -np.inf)


def clustered(spark, n=6000, wide=32):
    """Halves drawn from 40 centres each: structure that the pairs of centroids can follow."""
    rng = np.random.default_rng(8)
    parts = [rng.normal(size=(40, wide // 2))[rng.integers(0, 40, n)] for _ in range(2)]
    x = np.concatenate(parts, axis=1) + 0.15 * rng.normal(size=(n, wide))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    kind = pa.list_(pa.float32())
    return spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), kind)})).repartition(4), x.astype(float)


def test_recall_and_share_on_clustered_rows(spark, monkeypatch):
    frame, x = clustered(spark)
    monkeypatch.setattr(multiindex, "NEAR", 200)
    found = multiindex.neighbours(frame, F.col("vec_id") % 60 == 0).toPandas()
    own = found.groupby("query_id")["vec_id"].apply(set)
    score = x @ x.T
    np.fill_diagonal(score, -9)
    recall = np.mean([len(own[i] & set(np.argsort(-score[i])[:20])) / 20 for i in range(0, 6000, 60)])
    assert recall >= 0.9 and all(found.groupby("query_id")["vec_id"].nunique() == 20)
    # the rows that a query meets, worked out from its stops
    books, n = multiindex.fit(frame.select("vec_id", "embedding"), 32)
    q = x[::60]
    slope, offset = books.margins(np.arange(0, 6000, 60), q)
    one, two = books.products(q)
    cell = books.cell(x)
    top = np.sort(score[::60], axis=1)[:, -20]
    sums = one[:, cell // len(books.second)] + two[:, cell % len(books.second)]
    assert n == 6000 and (sums >= (slope * top + offset)[:, None]).mean() < 0.2


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    found = multiindex.op12_nearest_neighbours(spark, sf).toPandas()
    read = pq.read_table(f"{sf}/embeddings.parquet")
    x = read.column("embedding").combine_chunks().flatten().to_numpy().reshape(read.num_rows, -1).astype(float)
    ids = read.column("vec_id").to_numpy()
    own = found.groupby("query_id")["vec_id"].apply(set)
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -9
    assert np.mean([len(own[ids[i]] & set(ids[np.argsort(-s)[:20]])) / 20 for i, s in zip(asked, score, strict=True)]) >= 0.9


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("texts")
    texts = [None, "", " .,- \t", "Alpha beta", "alpha BETA beta", "é漢字 ÀB àb ﬁ", "x" * 4000, "alpha " * 3000, "\x00nul\x7fdel", "don't stop"] + [f"alpha beta gamma{i % 4} delta{i % 3}" for i in range(40)] + ["alpha beta gamma1"] * 30
    found = [(i if i % 9 else None, t, i, i, i) for i, t in enumerate(texts)] + [(77, "alpha beta twice", 1, 1, 1)] * 3 + [(1000, " ".join(f"w{i * i % 997}" for i in range(30_000)), 1, 1, 1)]
    spark.createDataFrame(found, "doc_id long, text string, n int, ids int, `a.b` int").repartition(4).write.parquet(f"{folder}/documents.parquet")
    items = [(1, "alpha ALPHA beta!"), (2, None), (3, ""), (4, "nowhere"), (None, "àb nul gamma1"), (5, "ÀB don t"), (6, "w0 w1 w4 delta2"), (7, "gamma2"), (7, "gamma3"), (8, "x" * 4000), (1, "alpha ALPHA beta!")]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def read(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def test_lexical_equals_brute_force_on_odd_texts(spark, odd_texts):
    got = lexical.op13_lexical_search(spark, odd_texts)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked_by_brute_force(read(odd_texts, "documents"), read(odd_texts, "benchmark"))
    assert want and rows(got) == want


def test_lexical_in_small_chunks_and_blocks(spark, odd_texts, sf, monkeypatch):
    for name, value in {"PAIRS": 6, "POSTINGS": 40, "DOCUMENTS": 16, "LEAF": 2, "ROUND": 3, "STEPS": 1}.items():
        monkeypatch.setattr(lexical, name, value)
    assert rows(lexical.op13_lexical_search(spark, odd_texts)) == ranked_by_brute_force(read(odd_texts, "documents"), read(odd_texts, "benchmark"))


def test_treaps_are_heaps_by_impact_and_trees_by_document():
    rng = np.random.default_rng(1)
    term, impact = np.sort(rng.integers(0, 4, 300)), rng.integers(1, 20, 300)
    left, right, roots = lexical.treaps(term, impact)
    for root in roots:
        order, todo = [], [(root, False)]
        while todo:
            node, seen = todo.pop()
            if seen:
                order.append(node)
                continue
            for child in (left[node], right[node]):
                assert child < 0 or (impact[child] <= impact[node] and term[child] == term[node])
            todo += [(x, s) for x, s in ((right[node], False), (node, True), (left[node], False)) if x >= 0]
        assert order == np.flatnonzero(term == term[root]).tolist()


def test_walks_leave_intervals_that_cannot_enter(monkeypatch):
    rng = np.random.default_rng(4)
    docs, width = 40_000, 5
    term = np.concatenate([np.sort(rng.choice(50, width, replace=False)) for _ in range(docs)])
    count, n = rng.integers(1, 4, docs * width), rng.integers(20, 40, docs)
    count[: width * 20] = 60  # twenty documents that matter
    chunk = lexical.Chunk(np.arange(docs), np.zeros(docs, bool), n, np.arange(0, docs * width + 1, width), term, count, np.full(50, 1000), docs, int(n.sum()))
    seen = []
    plain = chunk.scored
    chunk.scored = lambda begin, *rest: (seen.append(len(begin)), plain(begin, *rest))[1]
    monkeypatch.setattr(lexical, "LEAF", 64)
    none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
    own = term[:2]
    score, _, ids = chunk.search(own, none, 5)
    dense = np.zeros(docs, np.int64)
    np.add.at(dense, chunk.place[np.isin(chunk.term, own)], chunk.impact[np.isin(chunk.term, own)])
    best = np.lexsort((np.arange(docs), -dense))[:5]
    assert (ids.tolist(), score.tolist()) == (best.tolist(), dense[best].tolist())
    assert sum(seen) < docs / 64 / 2


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_nearest_neighbours", "op13_lexical_search"])
def test_search_equals_sql(spark, sf, name):
    from lumenfew import llm

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(llm.oracle_sql()[name])
    got = llm.queries()[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    found = want.fetchall()
    assert found and sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(found)


def test_search_of_empty_tables(spark, tmp_path):
    write(tmp_path, "documents", pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    write(tmp_path, "benchmark", pa.table({"item_id": pa.array([1]), "text": pa.array(["some words"])}))
    write(tmp_path, "embeddings", pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}))
    for op in (negatives.op11_hard_negatives, multiindex.op12_nearest_neighbours, lexical.op13_lexical_search):
        assert op(spark, str(tmp_path)).collect() == []
