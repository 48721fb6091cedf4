from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from seaweft.llm import byte_bpe, mixing, quality_rules, toxicity
from tests.llm.test_simhash import brute_classes, sets_of, similar_pairs

ROOT = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], ROOT).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [s.collect() for s in steps]
    texts = {r.doc_id: r.text for r in rows[0]}
    ids = [{r.doc_id for r in part} for part in rows]

    lex = toxicity.fit(docs, labels)
    assert ids[1] == {d for d, t in texts.items() if lex.score(*lex.raw(t)) < 0.3}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(truth.get(d) == 1 for d in ids[1]) < 0.5 * sum(truth.values())
    assert sum(truth.get(d) == 0 for d in ids[0] - ids[1]) <= 0.02 * len(truth)

    forest = quality_rules.fit(steps[1], labels)
    assert ids[2] == {d for d, k in zip([r.doc_id for r in rows[1]], quality_rules._judge([r.text for r in rows[1]], forest)[3]) if k}

    sets = sets_of({r.doc_id: r.text for r in rows[2]})
    want = brute_classes(sets, similar_pairs(sets))
    assert ids[3] == {d for d, low in want.items() if d == low} and len(rows[3]) == len(ids[3]) < len(ids[2])
    assert len({texts[d] for d in ids[3]}) == len(ids[3])

    times = Counter(r.doc_id for r in rows[4])
    assert times == Counter({r.doc_id: r.copies for r in mixing.mix(steps[3]).collect() if r.copies})
    assert all(r == {x.doc_id: x for x in rows[3]}[r.doc_id] for r in rows[4])

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r.doc_id, r.n_tokens) for r in rows[5]) == Counter((r.doc_id, len(lib.encode_ordinary(r.text))) for r in rows[4])


def test_run_equals_stages_and_takes_an_empty_table(spark, tmp_path):
    root = str(tmp_path / "t")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, null sources, and columns with the names that stages use."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(1, words("a", 60), "x"), (1, words("a", 60), "x"), (1, words("b", 60), "x"), (None, words("c", 60), None), (None, words("c", 60), None), (None, words("d", 60), "y"),
            (2, None, "x"), (3, "", "x"), (4, " \n ", None), (5, words("e", 150_000), "y"), (6, "short", "x"), (7, words("a", 60) + " more", "x")]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, root int, copies int, node int, kept int, part int"
    df = spark.createDataFrame([(d, t, "en", s, 0, *[9] * 6) for d, t, s in rows], kind)
    root = str(tmp_path / "t")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    docs, got = df, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, root).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got.append(docs)
    assert all(g.columns == df.columns for g in got[:-1])
    texts = [Counter((r.doc_id, (r.text or "")[:4]) for r in g.collect()) for g in got[:3]]
    assert sum(texts[0].values()) == len(rows)
    assert texts[1] == Counter((d, t[:4]) for d, t, _ in rows if t and len(t.split()) >= 20)
    assert texts[2] == Counter([(1, "a0 a"), (1, "b0 b"), (None, "c0 c"), (None, "d0 d"), (5, "e0 e")])
    assert got[4].count() == got[3].count() and all(r.size == r.part == 9 for r in got[3].collect())
