"""The pipeline's stages, each on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from lumenfew.llm.packing import binary_cuts

from .test_operators import docs, empty, measured, odd, words  # noqa: F401


@pytest.fixture(scope="module")
def after(spark, sf):
    folder = sf.replace("0.001", "0.01")
    rows, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["documents"] = rows.collect()
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.staged(stage(spark, rows, folder), name)
        if name != "packing":
            assert rows.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        out[name] = rows.collect()
    return out


def test_quality_keeps_clean_documents(spark, sf, after):
    kept = {r.doc_id for r in after["quality"]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = {r.doc_id: r.text for r in after["documents"]}
    fine = [d for d, q in labels.items() if q == 1 and d in rows and not measured(rows[d])[-1]]
    assert sum(d in kept for d in fine) / len(fine) > 0.95
    assert not any(measured(rows[d])[-1] for d in kept)


def least_of_groups(rows):
    """Links are three bits or five-word Jaccard of 0.8, by brute force over all pairs: the least id of each component, and the shingles' own links."""
    from .test_operators import lower, prints_by_brute_force

    prints = np.array([prints_by_brute_force(text) for _, text in rows], np.uint64)
    tokens = [words(lower(text)) for _, text in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in tokens]
    size = np.array([len(s) for s in sets])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = []
    for i in range(len(rows)):
        near = np.bitwise_count(prints[:i] ^ prints[i]) <= 3
        close = np.minimum(size[:i], size[i]) >= 0.8 * np.maximum(size[:i], size[i])
        for j in np.flatnonzero(near | close).tolist():
            common = 0 if near[j] else len(sets[i] & sets[j])
            if near[j] or common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                links += [] if near[j] else [(rows[j][0], rows[i][0])]
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values()), links


def test_one_document_of_each_group_stays(after):
    least, links = least_of_groups([(r.doc_id, r.text) for r in after["quality"]])
    assert links  # some links are the shingles' alone
    assert {r.doc_id for r in after["near_dedup"]} == least


def test_repeats_go(after):
    """Every byte of a repeated 101-byte string goes where its span has 51 words or 400 bytes, and nothing else does."""
    rows = after["near_dedup"]
    texts = [r.text.encode() for r in rows]
    length, least = corpus_pipeline.PASSAGE, corpus_pipeline.PASSAGE_WORDS
    codes = [np.fromiter((hash(t[i : i + length]) for i in range(len(t) - length + 1)), np.int64, max(len(t) - length + 1, 0)) for t in texts]
    names, counts = np.unique(np.concatenate(codes), return_counts=True)
    left = {r.doc_id: r for r in after["suffix_dedup"]}
    assert set(left) == {r.doc_id for r in rows}
    some = 0
    for r, t, own in zip(rows, texts, codes, strict=True):
        mask = np.zeros(len(t) + 1, np.int32)
        twice = np.flatnonzero(counts[np.searchsorted(names, own)] > 1)
        np.add.at(mask, twice, 1)
        np.add.at(mask, twice + length, -1)
        gone = np.concatenate([[0], np.cumsum(mask)[:-1] > 0, [0]]).astype(np.int8)
        kept, at = [], 0
        for i, j in np.flatnonzero(np.diff(gone)).reshape(-1, 2).tolist():
            if j - i >= 400 or len(t[i:j].split()) >= least:
                kept.append(t[at:i])
                at = j
                some += 1
        kept.append(t[at:])
        assert left[r.doc_id].text == b"".join(kept).decode("utf-8", "replace").replace("\ufffd", "") or "\ufffd" in r.text
        assert left[r.doc_id].n_chars == len(left[r.doc_id].text)
    assert some


def test_mix_and_packing(after):
    texts = {r.doc_id: r.text for r in after["suffix_dedup"]}
    for r in after["mixing"]:
        assert texts[r.doc_id].startswith(r.text) and words(r.text)
    per = {}
    for r in after["packing"]:
        per.setdefault(r.doc_id, []).append(r)
    assert set(per) == {r.doc_id for r in after["mixing"]}
    assert sum(r.start == 0 for r in after["packing"]) == len(after["mixing"])
    for own in per.values():
        if len({r.doc_tokens for r in own}) == 1 and sum(r.start == 0 for r in own) == 1:
            assert [r.length for r in sorted(own, key=lambda r: r.start)] == binary_cuts(own[0].doc_tokens)


def test_odd_and_empty_tables(spark, odd, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).collect() == []
    assert corpus_pipeline.run(spark, odd).columns[0] == "doc_id"
    rows = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, odd).columns == rows.columns, name
        stage(spark, rows, odd).collect()


def test_copies_of_0_8_to_0_9_go(spark, tmp_path):
    rng = np.random.default_rng(3)
    fresh = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    rows, close, apart = [], [], []
    for i in range(40):
        text = fresh(400)
        for j, n in ((1, 6), (2, 8), (3, 14)):
            copy = list(text)
            for at in range(20, 20 + 25 * n, 25):
                copy[at] = fresh(1)[0]
            (close if alike(text, copy) >= 0.8 else apart).append(100 * i + j)
            assert alike(text, copy) < 0.9
            rows.append((100 * i + j, " ".join(copy)))
        rows.append((100 * i, " ".join(text)))
    # one large group
    text = fresh(400)
    for i in range(150):
        rows.append((9000 + i, " ".join([*text[:200], *fresh(5), *text[205:]])))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert len(close) >= 40 and len(apart) >= 40
    assert not kept & set(close)
    assert set(range(0, 4000, 100)) <= kept
    assert {d for d in kept if d >= 9000} == {9000}


def test_repeated_passages_under_400_bytes_go(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n, size: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, size)) for _ in range(n))
    passages = [fresh(52, 5), fresh(60, 4), fresh(51, 1), fresh(40, 5)]
    rows = [(i, f"{fresh(80, 6)} {passages[i % 4]} {fresh(80, 6)}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, "").collect()}
    for i, text in rows:
        gone = passages[i % 4]
        assert len(gone) < 400
        if i % 4 == 3:  # 40 words stay
            assert left[i] == text
        else:
            assert gone not in left[i] and len(gone) <= len(text) - len(left[i]) <= len(gone) + 8


def test_large_group_of_copies_that_are_unlike_each_other_goes(spark, tmp_path):
    """Copies of one text at about 0.85, more than a list compares in pairs; two copies are under 0.8."""
    rng = np.random.default_rng(11)
    fresh = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    text, rows = fresh(300), []
    for i in range(400):
        copy = list(text)
        for at in (int(rng.integers(5, 60)), int(rng.integers(80, 140)), int(rng.integers(160, 220)), int(rng.integers(240, 290))):
            copy[at] = fresh(1)[0]
        rows.append((i + 1, copy))
    assert min(alike(text, w) for _, w in rows) >= 0.85 and np.median([alike(rows[i][1], rows[i + 1][1]) for i in range(50)]) < 0.8
    docs = spark.createDataFrame([(0, " ".join(text)), *((i, " ".join(w)) for i, w in rows)], "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()] == [0]


def templated(n, seed, size=300):
    """Texts that share a template (0.72 to 0.78 alike), ``n`` planted pairs among them at 0.81 to 0.84; all ids and the pairs."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(k)]
    template, rows, pairs = fresh(size), [], []
    for i in range(n):
        own = fresh(int(size * 0.145))
        first = template[: size - len(own)] + own
        other = list(first)
        gone = int(len(own) * rng.uniform(0.6, 0.72))
        other[-gone:] = fresh(gone)
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, first), (2 * i + 1, other)]
    return rows, pairs


@pytest.mark.parametrize("n", [150, 600])
def test_pairs_among_texts_of_one_template_are_found(spark, n):
    rows, pairs = templated(n, n)
    rows = [(i, " ".join(w)) for i, w in rows]
    least, links = least_of_groups(rows)
    assert len(links) >= 0.9 * n
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == least  # every link, and no other


def test_copies_of_a_text_that_is_not_there(spark):
    """Copies at about 0.73 of each other, pairs among them at 0.82: no shingle is rare, and no hub links them all."""
    rng = np.random.default_rng(21)
    fresh = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    text, rows = fresh(400), []
    for i in range(150):
        copy = list(text)
        for at in rng.choice(np.arange(8, 390, 12), 6, replace=False):
            copy[at] = fresh(1)[0]
        twin = list(copy)
        for at in rng.choice(np.arange(8, 390, 12), 5, replace=False):
            twin[at] = fresh(1)[0]
        rows += [(2 * i, " ".join(copy)), (2 * i + 1, " ".join(twin))]
    least, links = least_of_groups(rows)
    assert len(links) >= 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert least <= kept and len(kept) - len(least) <= 0.02 * len(links)


def choices(n, m, seed):
    """Texts that choose between two words at 33 places, so that no shingle is rare: ``n`` near each other, and ``m`` that are near one of those alone."""
    rng = np.random.default_rng(seed)
    fresh = lambda k: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(k)]
    text, other, out = fresh(400), fresh(400), {False: [], True: []}
    places = np.arange(6, 402 - 12, 12)
    for i in range(n + m):
        chosen = rng.permutation(len(places))[:4] if i < n else np.concatenate([own := rng.permutation(len(places))[:4], np.setdiff1d(rng.permutation(len(places)), own)[rng.permutation(len(places) - 4)[:8]]])
        for some in [chosen] if i < n else [chosen[:4], chosen]:
            words_ = list(text)
            for at in places[some]:
                words_[at] = other[at]
            out[len(some) == 4].append(" ".join(words_))
    return list(enumerate(out[False] + out[True]))


@pytest.mark.parametrize("block", [None, 800])
def test_no_link_of_a_crowd_is_lost(spark, monkeypatch, block):
    """The crowd's groups are those of all pairs, in one block of sets and in many."""
    from lumenfew.llm import minhash
    from lumenfew.llm.components import components

    if block:
        monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    sets = [minhash.shingle_set(t.encode()) for _, t in choices(100, 1500, 33)]
    names = np.unique(np.concatenate(sets))
    has = np.stack([np.isin(names, x) for x in sets]).astype(np.float32)
    size, both = has.sum(axis=1), has @ has.T
    near, root = both >= 0.8 * (size[:, None] + size - both) - 1e-3, np.arange(len(sets))
    while (least := np.where(near, root, len(sets)).min(axis=1)).tolist() != root.tolist():
        root = least
    crowd = minhash.staged(spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "sig long, shingles binary").repartition(4), "crowd")
    found = {r.node: r.root for r in components(minhash.crowd_links(crowd)).collect()}
    assert [found.get(i, i) for i in range(len(sets))] == root.tolist()


def test_links_of_a_crowd_join_what_all_pairs_join():
    """Chains of sets: the spanning links, within one side and between two, against all pairs."""
    from lumenfew.llm.minhash import jaccard, spanning

    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        own = rng.integers(0, 1 << 63, 300, np.uint64)
        for _ in range(15):  # every set replaces some of the one before
            own = own.copy()
            own[rng.choice(len(own), int(rng.integers(10, 50)), replace=False)] = rng.integers(0, 1 << 63, 1, np.uint64)
            sets.append(np.unique(own))
    rng.shuffle(sets)
    label, side = np.arange(len(sets)), rng.integers(0, 2, len(sets))

    def joined(links):
        root = list(range(len(sets)))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return [root.index(r) for r in root]

    every = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert len(every) > 50
    assert joined(spanning(sets, label, np.zeros(len(sets), int))) == joined(every)
    assert joined(spanning(sets, label, side)) == joined([(i, j) for i, j in every if side[i] != side[j]])
    assert spanning(sets, np.zeros(len(sets), int), side) == []
