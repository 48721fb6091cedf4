import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seaweft.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id bigint, text string, ids string, decoded int"
TEXTS = ["", None, "a", "It's the 1st  day;\n\n we'll see \t ", "éàü ñ 日本語 🙂🙂 ​", "aaaa" * 3000, "x" * 200_000, "<|endoftext|> don't", " ", "\n \n", "It's the 1st  day;\n\n we'll see \t "]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_finds_only_its_keys(ranks):
    h = byte_bpe.PerfectHash(ranks)
    assert sorted(h.find(k) for k in ranks) == list(range(len(ranks)))
    assert all(h.find(k + b"\x00\xff") == -1 for k in list(ranks)[:2000])


def test_merge_equals_library_on_random_bytes(ranks, library):
    rng = random.Random(1)
    for _ in range(400):
        piece = bytes(rng.choice(b"thenrsatio ABC\xc3\xa9\xff") for _ in range(rng.randint(1, 60)))
        assert byte_bpe.merge(piece, ranks) == library._core_bpe.encode_single_piece(piece)


def test_encode_decode_equal_library(spark, library):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a", "x", 1)], SCHEMA)
    got = {r.doc_id: r for r in byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or "")
        assert bytes(got[i].decoded).decode() == (t or "") and got[i].n_tokens == len(got[i].ids) // 4


def test_memo_generations_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 3)
    codec = byte_bpe.Codec(ranks, PATTERN)
    for t in TEXTS + TEXTS:
        assert np.frombuffer(codec.encode(t or ""), "<u4").tolist() == library.encode_ordinary(t or "")


def test_query_on_all_documents(spark, library, sf_dir):
    from seaweft.llm.queries import op7_byte_bpe
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []
