import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from seaweft.llm import imatch

M = 2**64 - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_fingerprint(text, band, subsets=128, rates=14):
    """The definition, in whole numbers: band terms sorted; those of each subset hashed by place; all words last."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    terms = sorted({xxhash.xxh3_64_intdigest(w) >> 16 for w in low.split()})
    out = []
    for k in range(subsets):
        salt = (k + 1) * 0x9E3779B97F4A7C15 & M
        picks = [t for t in terms if t in band and plain_mix((t + salt) & M) >> (63 - k % rates) == 0]
        total = sum(plain_mix(t ^ (i * 0x9E3779B97F4A7C15 & M)) for i, t in enumerate(picks)) & M
        out.append(plain_mix(total) >> 32 | 1 if picks else 0)
    out.append(xxhash.xxh3_64_intdigest(b"".join(t.to_bytes(8, "little") for t in terms)) >> 32 | 1 if terms else 0)
    return out


def plain_likeness(a, b, rates=14):
    some = both = 0.0
    for k, (x, y) in enumerate(zip(a, b)):
        w = math.sqrt(2 ** (1 + k % rates)) if k < len(a) - 1 else 1.0
        some += w * bool(x or y)
        both += w * (x == y and x != 0)
    return both / some if some else 1.0


def plain_text(signature):
    return "".join(f"{x:08x}" for x in signature)


def plain_band(texts, least=math.log(5), most=math.log(1000)):
    n = Counter(w for t in texts for w in {xxhash.xxh3_64_intdigest(w) >> 16 for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()})
    return {t for t, k in n.items() if len(texts) * math.exp(-most) <= k <= len(texts) * math.exp(-least)}


def test_signature_ignores_order_case_and_repeats():
    lex = imatch.Lexicon(sorted(imatch.term_hash(f"w{i}".encode()) for i in range(500)))
    a = lex.signature(" ".join(f"w{i}" for i in range(100)))
    b = lex.signature(" ".join(f"W{i} w{i}" for i in reversed(range(100))) + " outside words")
    assert (a == b)[:-1].all() and 1.0 > imatch.likeness(a, b) > 0.99 and (a != 0).sum() > 20
    near = lex.signature(" ".join(f"w{i}" for i in range(3, 100)))
    far = lex.signature(" ".join(f"w{i}" for i in range(200, 300)))
    assert imatch.likeness(a, near) > 0.5 > 0.1 > imatch.likeness(a, far)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 40, 700])
def test_signature_against_plain_loops(n):
    lex = imatch.Lexicon(sorted(imatch.term_hash(f"w{i}".encode()) for i in range(900)))
    text = " ".join(f"w{i}" for i in range(n)) + " outside the band"
    got = lex.signature(text)
    assert got.tolist() == plain_fingerprint(text, set(lex.terms.tolist()))
    assert (got[:-1] != 0).any() == (n > 0) or n < 4


def test_all_picks_of_a_subset_are_hashed():
    lex = imatch.Lexicon(sorted(imatch.term_hash(f"w{i}".encode()) for i in range(500)))
    words = [f"w{i}" for i in range(400)]
    whole = lex.signature(" ".join(words))
    assert (whole != 0).sum() > 70
    dense = [k for k in range(imatch.SUBSETS) if k % imatch.RATES == 0]  # rate 1/2: about 200 picks
    changed = Counter()
    for i in range(0, 400, 20):
        less = lex.signature(" ".join(words[:i] + words[i + 1 :]))
        changed.update(k for k in dense if less[k] != whole[k])
    assert all(3 <= changed[k] <= 17 for k in dense)  # a missing term changes each signature that picks it


def test_lexicon_is_the_band(spark, monkeypatch):
    monkeypatch.setattr(imatch, "HELD", 3)
    docs = spark.createDataFrame([(i, " ".join(["all", "All", f"own{i}", *(["half"] if i % 2 else []), *(["few"] if i < 3 else [])])) for i in range(20)] + [(20, None)], "doc_id bigint, text string")
    assert imatch.fit(docs, least_idf=math.log(2), most_idf=math.log(10)).terms.tolist() == sorted(map(imatch.term_hash, (b"few", b"half")))


def check(spark, rows, parts, kind="bigint"):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id {kind}, text string, part string")
    texts = [t or "" for _, t in rows]
    band = plain_band(texts)
    hashes = {r.text: r.h for r in df.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (hashes[r[1]], r[1]))
    order = sorted((r for r in order if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in order if r[0] is None]
    # a reversed stable sort keeps equal ids in order
    want, known = [], {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        a, b, c = (known.setdefault(x, plain_fingerprint(x, band)) for x in (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_text(a), plain_text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, imatch.compare_edited(df, imatch.fit(df)).collect())]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_next_document_over_many_ranges(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()], 17)


def test_edge_rows(spark):
    rows = [(5, "a b c"), (5, "a b"), (5, "a b"), (None, "n"), (None, None), (-3, ""), (2**62 + 1, "日本 🙂 x" * 3000), (2**62, "next to it"), (2, None)]
    for parts in (1, 3, 20):
        check(spark, rows, parts)
    check(spark, [("b", "one two"), ("a", "two"), (None, "three"), ("b", "x")], 3, "string")
    check(spark, [(1, "one")], 10)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert imatch.compare_edited(empty, imatch.fit(empty)).collect() == []
    assert {r.fingerprint for r in imatch.fingerprint(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), imatch.Lexicon([])).collect()} == {"0" * 8 * (imatch.SUBSETS + 1)}


def test_texts_without_band_terms_are_equal_only_if_their_words_are():
    lex = imatch.Lexicon([])
    a, b, c = map(lex.signature, ("one two", "Two one one", "three"))
    assert imatch.likeness(a, b) == 1.0 and imatch.likeness(a, c) == 0.0 == imatch.likeness(a, lex.signature(""))


def test_an_edited_text_is_nearer_than_another_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in imatch.compare_edited(docs, imatch.fit(docs)).collect() if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9
    assert np.mean([r.near_edited for r in rows]) > 4 * np.mean([r.near_next for r in rows])


def test_long_texts_have_signatures_that_tell_them_apart():
    for n in (3_000, 20_000, 50_000):
        words = [f"w{i}" for i in range(2 * n)]
        lex = imatch.Lexicon(sorted(imatch.term_hash(w.encode()) for w in words))
        a, near, far = (lex.signature(" ".join(x)) for x in (words[:n], words[n // 100 : n], words[n:]))
        assert (a != 0).sum() >= 100 and (far != 0).sum() >= 100, n
        assert imatch.likeness(a, near) > 0.3 and imatch.likeness(a, far) < 0.1 and imatch.likeness(a, lex.signature("")) == 0.0
