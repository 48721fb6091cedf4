import re
from collections import Counter

import pytest

from seaweft.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


CASES = ["", None, " \n\t ", "a " * 30, "one two three four five six seven eight nine\n" * 4, "é" * 9 + " x \x1c y", "a\n\n\na\nb\n", "#*$ %&| <>", "a b c d e f g h a b c d e f g h a", "w " * 5000, "\n".join(f"l{i % 3} x" for i in range(40))]


@pytest.mark.parametrize("text", CASES)
def test_counts(text):
    assert quality_rules.counts(text or "") == brute(text)


def test_statistics_have_one_definition_at_every_length():
    for unit in ("A b", "\U0001d400", "Éé ", "ſß", "x", "ǅ", "Ω1 "):
        for n in (1, 20, 63, 64, 65, 80, 5000):
            text = unit * n
            assert quality_rules.capitals(text) == sum(c.isupper() for c in text)
    short, long = ("\U0001d400 " * n for n in (300, 30_000))
    rates = [quality_rules.statistics(t, quality_rules.counts(t))[2] for t in (short, long)]
    assert abs(rates[0] - 0.5) < 0.1 and abs(rates[1] - 1) < 0.1  # capitals / (characters in words + 300)
    plain, lines = ("\n".join(f"line {i % k} here" for i in range(200)) for k in (200, 150))
    assert quality_rules.statistics(lines, quality_rules.counts(lines))[0] > quality_rules.statistics(plain, quality_rules.counts(plain))[0]


def brute_score(forest, x):
    """Paths of one row, tree by tree, node by node."""
    total = 0.0
    for t in range(len(forest.feature)):
        node = 0
        while forest.feature[t, node] >= 0:
            node = int(forest.child[t, node]) + int(x[forest.feature[t, node]] > forest.split[t, node])
        total += forest.path[t, node]
    return 2 ** (-total / len(forest.feature) / forest.scale)


def test_verdict_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_rules.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.apply(docs, forest).collect():
        b = brute(texts[r.doc_id])
        s = brute_score(forest, quality_rules.statistics(texts[r.doc_id], b))
        assert abs(s - r.anomaly) < 1e-9 and r.kept == (not (b[0] < 20 or 100 * b[4] > 30 * b[0]) and s <= forest.threshold)


def test_query_against_brute_force(spark, sf_dir):
    from seaweft.llm.queries import op6_quality_rules
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (r.base_failed and r.kept)


def test_forest_keeps_good_and_drops_odd(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = quality_rules.apply(docs, quality_rules.fit(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_edge_rows(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(CASES)] + [(None, "x", 2), (0, "", 3)], "doc_id bigint, text string, kept int")
    got = quality_rules.apply(df, None).collect()
    assert len(got) == len(CASES) + 2 and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.keep_good(df, None).columns == df.columns
    assert quality_rules.apply(df.limit(0), None).collect() == []
    long = spark.createDataFrame([(1, "Alpha beta, gamma! " * 300_000), (2, " ".join(f"w{i}" for i in range(200_000)))], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.apply(long, None).collect()} == {(1, 900_000, 900_000, False), (2, 200_000, 0, True)}
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_rules.fit(df, none) is None


def test_every_labelled_row_counts(spark):
    """The bad rows come after 12,000 good ones in the order of the ids' hashes, by which rows were once chosen."""
    from pyspark.sql import functions as F
    ids = [r.id for r in spark.range(12_200).orderBy(F.xxhash64("id"), "id").collect()]
    bad = set(ids[-150:])
    docs = [(i, " ".join(f"{'#$|' if i in bad else ''}word{(i * 7 + j) % 97}" for j in range(20 + i % 5))) for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.apply(df, quality_rules.fit(df, labels)).where("kept").collect()}
    assert len(kept & bad) < 15 and len(set(ids) - bad - kept) <= 0.004 * (len(ids) - 150)
