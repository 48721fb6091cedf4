import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from seaweft.llm import simhash


def brute_fingerprint(text, shingle=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [b" ".join(words)] if words else []
    count = Counter(bit for p in parts for bit in range(64) if xxhash.xxh64_intdigest(p, 42) >> bit & 1)
    return sum(1 << bit for bit, n in count.items() if 2 * n > len(parts))


def brute_components(ids, fps, most=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, d in enumerate(ids)}


@pytest.mark.parametrize("text", ["", None, "One", "a b c", "A b C d", "a b c d e f g", "É x\x1cy z \n w é", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    fps = set()
    while len(fps) < n:
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 40])):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            if rng.random() < 0.3:
                centre = x
    return sorted(fps)


@pytest.mark.parametrize("most,limits", [(1, {}), (3, {}), (4, {}), (7, {}), (4, {"listed_to": 2, "block": 5, "lot": 40, "weight": 200}), (7, {"listed_to": 1, "block": 3, "lot": 2, "weight": 65})])
def test_components_equal_brute_force(spark, limits, most):
    fps = clustered(260, most)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    roots = {r.fp: r.root for r in simhash.fingerprint_roots(spark.createDataFrame([(x,) for x in signed], "fp bigint"), max_bits=most, **limits).collect()}
    assert {x: roots.get(x, x) for x in signed} == brute_components(signed, [x & (1 << 64) - 1 for x in signed], most)


def test_links_of_a_dense_group_are_few(spark, monkeypatch):
    centre = random.Random(1).getrandbits(64)
    fps = {centre ^ 1 << i for i in range(20)} | {centre}  # all within 2 bits: they share most entries
    kinds = spark.createDataFrame([(i, x.to_bytes(8, "little")) for i, x in enumerate(sorted(fps))], "node bigint, sig binary")
    for limits in ({}, {"listed_to": 1}, {"listed_to": 1, "block": 4}, {"lot": 3}):
        pairs = [(r.a, r.b) for r in simhash.links(kinds, **limits).collect()]
        assert 20 <= len(pairs) <= 6 * 21, limits
    index = simhash.Index(4, 1, 4)
    nodes, sigs = np.arange(21), np.array(sorted(fps), np.uint64).reshape(-1, 1)
    lots = index.lots(sigs)
    found = [simhash.Index.links(index, np.sort(x), nodes[o], sigs[o]) for x in lots for o in [np.argsort(x, kind="stable")]]
    pairs = [frozenset(p) for part in found for a, b, _ in part for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs)) == 21 * 20 // 2  # each link at one entry only
    few = simhash.Trees().new([x for part in found for x in part])
    assert len(few[0]) == 20


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a bigint, b bigint")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_query_on_all_documents(spark, sf_dir):
    from seaweft.llm.queries import op10_simhash
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_simhash(spark, sf_dir).collect()
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{x:016x}" for d, x in fps.items()} and len(rows) == len(texts)
    assert {r.doc_id: r.component_id for r in rows} == brute_components(list(fps), list(fps.values()))


def test_edge_rows(spark):
    schema = "doc_id bigint, text string, fp string, component_id int"
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(3, text, "x", 1), (2, text, "x", 1), (2, text, "x", 1), (None, text, "y", 1), (5, "", "x", 1), (4, None, "x", 1), (None, "only here and once", "x", 1)], schema)
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, 2), (2, 2), (2, 2), (None, 2), (5, 4), (4, 4), (None, None)], key=repr)
    for found in (simhash.near_duplicates(df), simhash.near_duplicates_wide(df)):
        assert sorted((r.doc_id for r in simhash.keep_one(df, found).collect()), key=repr) == [2, 4, None]
        assert simhash.keep_one(df, found).columns == df.columns
    assert simhash.near_duplicates_wide(df.limit(0)).collect() == []
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def sets_of(texts, size=5):
    out = {}
    for d, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def similar_pairs(sets):
    """Similarity of every pair that shares a shingle, by an inverted index."""
    holders, shared = {}, Counter()
    for d, s in sets.items():
        for x in s:
            for other in holders.setdefault(x, []):
                shared[other, d] += 1
            holders[x].append(d)
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}


def brute_classes(sets, pairs, least=0.8):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    empty = [d for d, s in sets.items() if not s]
    for a, b in [p for p, j in pairs.items() if j >= least - 1e-12] + list(zip(empty, empty[1:])):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {d: find(d) for d in sets}


LIMITS = [{}, {"listed_to": 2, "block": 4, "lot": 30, "weight": 3000}]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_wide_against_brute_force(spark, sf, limits):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    sets = sets_of({r.doc_id: r.text for r in docs.collect()})
    want = brute_classes(sets, similar_pairs(sets))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(docs, **limits).collect()} == want


def test_wide_on_ten_thousand_documents(spark):
    """Recall by band of similarity, and no link that exact similarity doesn't make."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(docs).collect()}
    sets = sets_of({r.doc_id: r.text for r in docs.collect()})
    pairs = similar_pairs(sets)
    want = brute_classes(sets, pairs)
    assert all(want[d] == want[c] for d, c in got.items())
    for low, high in ((0.8, 0.85), (0.85, 1), (1, 2)):
        band = [p for p, j in pairs.items() if low - 1e-12 <= j < high - 1e-12]
        assert len(band) > 30 and sum(got[a] == got[b] for a, b in band) >= 0.95 * len(band)


def test_wide_at_the_threshold(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for i in range(400):
        base = [word() for _ in range(rng.choice([24, 60, 300]))]
        copy = list(base)
        # a replaced word changes five shingles: of 20 to 296, so that similarities lie on both sides of 0.8
        for at in rng.sample(range(2, len(base) - 2), {24: 1, 60: rng.choice([1, 2]), 300: rng.choice([5, 6, 7])}[len(base)]):
            copy[at] = word()
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(copy)}
    sets = sets_of(texts)
    pairs = similar_pairs(sets)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    linked = {(a, b) for a, b in pairs if got[a] == got[b]}
    close = {p for p, j in pairs.items() if j >= 0.8}
    assert len(close) > 100 and len(pairs) - len(close) > 100
    assert linked <= close and len(linked) >= 0.95 * len(close)


def test_wide_on_large_mixed_groups(spark):
    """A template's texts of pairwise similarity about 0.7 to 0.9, a group of near copies of one text, and exact copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template, texts = [word() for _ in range(120)], {}
    for _ in range(700):
        copy = list(template)
        for at in rng.sample(range(120), rng.choice([1, 1, 2, 3, 4])):
            copy[at] = word()
        texts[len(texts)] = " ".join(copy)
    drift = [word() for _ in range(150)]
    for _ in range(300):  # each is near the one before it only
        drift[rng.randrange(150)] = word()
        texts[len(texts)] = " ".join(drift)
    for _ in range(500):
        texts[len(texts)] = " ".join(template)
    sets = sets_of(texts)
    want = brute_classes(sets, similar_pairs(sets))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_wide(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == want and 1 < len(set(want.values())) < 700


def test_wide_keeps_a_link_whose_ends_share_a_third_neighbour():
    """x is near y and z by fingerprints but not by shingles; y and z are similar."""
    x, y, z = np.arange(0, 100), np.arange(30, 130), np.arange(31, 131)
    grams = np.concatenate([x, y, z]).astype(np.uint64)
    found = simhash.settle(np.arange(3), np.zeros((3, 1), np.uint64), grams, np.array([0, 100, 200, 300]), lambda d: np.ones(len(d), bool), 0.8)
    assert [tuple(sorted(p)) for p in found] == [(1, 2)]


def test_wide_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    near = " ".join(f"w{i}" for i in range(3_000, 120_000))
    rows = [(1, "", 1, 1), (2, None, 1, 1), (3, " \n ", 1, 1), (4, "two words", 1, 1), (5, "Two  words", 1, 1), (6, "two words more", 1, 1), (7, long, 1, 1), (8, near, 1, 1), (8, near, 1, 1), (None, long, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int, root int")
    got = sorted({(r.doc_id, r.component_id) for r in simhash.near_duplicates_wide(df).collect()}, key=repr)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 7), (None, 7)], key=repr)
    assert sorted(r.doc_id for r in simhash.keep_one(df, simhash.near_duplicates_wide(df)).collect()) == [1, 4, 6, 7]


def test_keep_one_keeps_each_component_of_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(1, a), (7, a), (7, b), (7, c), (7, c), (None, d), (None, d), (None, e), (None, a), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = simhash.keep_one(df, simhash.near_duplicates_wide(df)).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(1, a), (7, b), (7, c), (None, d), (None, e), (9, "")], key=repr)
