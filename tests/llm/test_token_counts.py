import math
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from seaweft.llm import token_counts as tc


@pytest.fixture(scope="module")
def pieces():
    return tc.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def brute(pre, scores):
    """Best (score, -pieces) by trying every split."""
    byte = min(scores.values()) - tc.BYTE_GAP
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(pre)
    for e in range(1, len(pre) + 1):
        for s in range(e):
            if pre[s:e] in scores:
                best[e] = max(best[e], (best[s][0] + scores[pre[s:e]], best[s][1] - 1))
        if pre[e - 1] not in scores:
            n = len(pre[e - 1].encode())
            best[e] = max(best[e], (best[e - 1][0] + n * byte, best[e - 1][1] - n))
    return -best[-1][1]


def test_trie_equals_every_split(pieces):
    scores = tc.zipf_scores(pieces)
    rng = random.Random(3)
    words = ["▁" + "".join(rng.choice("thenrsatio ñ日🙂") for _ in range(rng.randint(1, 14))) for _ in range(600)] + ["▁", "▁" + "a" * 200, "▁" + "日" * 70]
    for most in (10**6, 5):
        trie = tc.Trie(scores, most)
        assert [trie.count(w) for w in words + words] == [brute(w, scores) for w in words] * 2


def test_equals_library(pieces):
    scores = tc.zipf_scores(pieces)
    lib = Tokenizer(models.Unigram([("<unk>", -100.0), *scores.items()], 0, False))
    trie = tc.Trie(scores)
    rng = random.Random(4)
    for _ in range(500):
        w = "▁" + "".join(rng.choice("thenrsatioéü") for _ in range(rng.randint(1, 14)))
        if all(c in scores for c in w):
            assert trie.count(w) == len(lib.encode(w).ids), w


def test_query_on_all_documents(spark, sf_dir, pieces):
    from seaweft.llm.queries import op2_token_counts
    scores, known = tc.zipf_scores(pieces), {}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        for w in words:
            known[w] = known.get(w) or (brute("▁" + w, scores) if len(w) < 400 else tc.Trie(scores).count("▁" + w))
        assert (r.n_words, r.n_distinct, r.n_tokens) == (len(words), len(set(words)), sum(known[w] for w in words))


def test_edge_rows(spark, pieces):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a a", 5), (2, " \n ", 5)], "doc_id bigint, text string, n_words int")
    assert sorted((r.n_words, r.n_distinct) for r in tc.count_tokens(df, pieces).collect()) == [(0, 0), (0, 0), (0, 0), (2, 1)]
    assert tc.count_tokens(df.limit(0), pieces).collect() == []
    long = spark.createDataFrame([(1, "token " * 800_000), (2, "x" * 300_000)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in tc.count_tokens(long, pieces).collect()}
    one = tc.Trie(tc.zipf_scores(pieces)).count("▁token")
    assert (got[1].n_words, got[1].n_tokens, got[2].n_words) == (800_000, 800_000 * one, 1)
