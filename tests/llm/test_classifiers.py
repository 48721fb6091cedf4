import math
import random
import time
import zlib

import numpy as np
import pytest

from seaweft.llm import quality_classifier as qc
from seaweft.llm import toxicity as tx

ROOT = "/root/testdata/sf0.01"


def test_folding():
    assert tx.fold("") == "  " or tx.fold("").strip() == ""
    assert tx.fold("Аn 1D1​ОT, é!") == " an idiot e "


def test_lexicon_and_exceptions():
    lex = tx.Lexicon({"trash": 3.0, "idiot": 3.0}, ("trash can",))
    assert lex.raw("the trash can is full")[0] == 0 and lex.raw("you are trash")[0] == 3
    assert lex.raw("1d10ts and TRASH!")[0] == 6 and lex.raw("retrashed")[0] == 0
    assert lex.raw("trash can trash")[0] == 3
    assert lex.score(0.0, 100) < 0.3 < lex.score(9.0, 100) and lex.score(3.0, 10) > lex.score(3.0, 10_000)


def test_exceptions_against_plain_search_and_in_linear_time():
    rng = random.Random(4)
    terms, phrases = {"trash": 2.0, "tras": 1.0, "loser": 3.0, "can": 0.5}, ("trash can", "sore loser", "can trash", "the trash can is")
    lex = tx.Lexicon(terms, phrases)
    for _ in range(300):
        folded = tx.fold(" ".join(rng.choice(["trash", "can", "loser", "sore", "the", "is", "trashy", "x"]) for _ in range(rng.randint(0, 14))))
        assert lex.hits(folded) == brute_hits(lex, folded)
    start = time.perf_counter()
    assert lex.raw("trash can loser the " * 250_000)[0] == 750_000  # 5 MB
    assert time.perf_counter() - start < 60


def brute_hits(lex, folded):
    """Heaviest entry at each place where one begins, outside the exception phrases, by plain comparison."""
    places = lambda s: [i for i in range(len(folded)) if folded.startswith(s, i)]
    spared = {j for p in lex.exceptions for i in places(tx.fold(p)[:-1]) for j in range(i, i + len(tx.fold(p)) - 1)}
    out = {}
    for term, w in lex.weights.items():
        for i in places(" " + tx.fold(term).strip()):
            if i not in spared:
                out[i] = max(w, out.get(i, 0.0))
    return out


def test_toxicity_against_plain_search(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    lex = tx.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tx.score(docs, lex).collect():
        folded = tx.fold(texts[r.doc_id]) if len(texts[r.doc_id]) < 20_000 else None
        if folded is not None:
            hits, words = brute_hits(lex, folded), len(folded.split())
            x = lex.slope * sum(hits.values()) / (1 + words / 100) ** lex.power + lex.offset
            assert (r.n_hits, r.n_words) == (len(hits), words) and abs(r.score - 1 / (1 + math.exp(-x))) < 1e-9


def test_word_buckets_equal_for_equal_words():
    ids, last = qc.word_buckets(np.frombuffer(b" ab cd ab  ab\n" + b"z" * 3000, np.uint8))
    assert len(ids) == 5 and ids[0] == ids[2] and ids[3] == qc.AGAIN and ids[0] != ids[1]
    assert qc.word_buckets(np.frombuffer(b"z" * 3000 + b" z", np.uint8), last)[0].tolist()[0] == qc.AGAIN


LONG = [" ".join(f"word{i % 97}" for i in range(3000)), "x" * 5000, "a b\n" * 900, "日本語 のテキスト\tété " * 400, "same " * 2000, "\n".join("é" * (i % 9) for i in range(2000)), " " * 3000 + "end"]


@pytest.mark.parametrize("text", LONG)
def test_score_does_not_depend_on_where_a_text_is_cut(text, monkeypatch):
    model = qc.Model(np.random.default_rng(1).normal(size=2 << qc.BITS).astype(np.float32), 0.1)
    whole, shares = model.logit(text), qc.features(text)
    for span in (1, 7, 501):
        monkeypatch.setattr(qc, "SPAN", span)
        assert abs(model.logit(text) - whole) < 1e-9
        assert all((a == b).all() for a, b in zip(qc.features(text), shares))


def brute_logit(model, text):
    """The definition in whole numbers: a bucket for each word and each n-gram of characters."""
    m = 2**64 - 1
    words = []
    for w in text.encode().split():
        h = sum((c + 1) * pow(0x100000001B3, i % 1024 + 1, m + 1) for i, c in enumerate(w)) & m
        words.append((h, h * 0x9E3779B97F4A7C15 % (m + 1) >> (64 - qc.BITS)))
    ids = [qc.AGAIN if i and words[i - 1][0] == h else b for i, (h, b) in enumerate(words)]
    grams = []
    for n in qc.GRAMS:
        for i in range(len(text) - n + 1):
            code = sum(ord(c) * 0x01000193**k for k, c in enumerate(text[i : i + n])) % 2**32
            grams.append((1 << qc.BITS) + ((code ^ n * 0x85EBCA6B % 2**32) * 2654435761 % 2**32 >> (32 - qc.BITS)))
    return sum(float(model.gain[i]) for i in ids) / max(1, len(ids)) + sum(float(model.gain[i]) for i in grams) / max(1, len(grams)) + model.offset


def test_quality_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in qc.score(docs, model).collect():
        if len(texts[r.doc_id]) < 20_000:
            assert abs(r.score - 1 / (1 + math.exp(-brute_logit(model, texts[r.doc_id])))) < 1e-9
    for text in ["", " ", "é", "日本", *LONG]:
        assert abs(model.logit(text) - brute_logit(model, text)) < 1e-9


def held_out(spark, name, label, mod, rem):
    from seaweft.llm import queries
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, ROOT).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(d).encode()) % mod == rem) for d, r in rows.items())
    pairs = [(rows[d].predicted, y) for d, y in labels.items() if d in rows and rows[d].held_out]
    return sum(p == y for p, y in pairs) / len(pairs)


def test_held_out_accuracy(spark):
    assert held_out(spark, "op1_quality_classifier", "quality", 5, 0) > 0.9
    assert held_out(spark, "op9_toxicity", "toxic", 4, 2) > 0.9


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)]])
def test_edge_rows(spark, labels):
    df = spark.createDataFrame([(1, "a b c", 1), (2, None, 2), (2, "", 2), (None, "x " * 100_000, 3)], "doc_id bigint, text string, score int")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    for module in (qc, tx):
        model = module.fit(df, table)
        rows = module.score(df, model).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
        assert module.score(df.limit(0), model).collect() == []
    assert tx.keep_clean(df, tx.Lexicon({"x": 3.0})).columns == df.columns
