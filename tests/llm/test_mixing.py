import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaweft.llm import mixing


def test_targets_share_the_excess():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 100)])
    # a: weight 5, stops at 20; b: weight 2; c: weight 1; null: weight 5
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 1210)
    assert got["b"] == 200 and got["c"] == pytest.approx(200) and got[None] == pytest.approx(1815 - 420)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_settle_keeps_the_total_and_expectations():
    sizes, parts = [10, 20, 5, 40, 8], [0.3, 0.7, 0.5, 0.25, 0.9]
    total, times = 4000, [0] * 5
    for k in range(total):
        out, at, part = mixing.settle(range(5), sizes, parts, str(k), False)
        held = sum(s * (part if i == at else u) for i, (s, u) in enumerate(zip(sizes, out)))
        assert held == pytest.approx(sum(s * p for s, p in zip(sizes, parts)))
        out, at, _ = mixing.settle(range(5), sizes, parts, str(k), True)
        assert at == -1 and set(out) <= {0, 1}
        times = [a + b for a, b in zip(times, out)]
    assert all(abs(n / total - p) < 0.03 for n, p in zip(times, parts))


def check(rows, most=None):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        t = by.setdefault(r.source, [0, r.target, 0])
        t[0] += r.taken
        t[2] = max(t[2], r.size)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest + 1e-6


def plain_pairs(units, seed):
    """Round (id, size, part) in order, pair by pair: {id: 0 or 1}, and what is left (id, size, part) or None."""
    draws = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))).random(len(units) + 1)
    done, held = {}, None
    for n, (i, size, p) in enumerate(units):
        if not 0 < p < 1 or size == 0:
            done[i] = int(p >= 1)
        elif held is None:
            held = (i, size, p)
        else:
            a, a_size, q = held
            rise, fall = min((1 - q) * a_size, p * size), min(q * a_size, (1 - p) * size)
            q_next, p_next = (q + rise / a_size, p - rise / size) if draws[n] < fall / (rise + fall) else (q - fall / a_size, p + fall / size)
            whole = lambda x: abs(x - round(x)) < 1e-9
            held = None
            for who, s, x in ((a, a_size, q_next), (i, size, p_next)):
                if whole(x):
                    done[who] = round(x)
                else:
                    held = (who, s, x)
    return done, held, draws[-1]


@pytest.mark.parametrize("leaf,fan", [(4096, 512), (16, 4)])
def test_mix_against_plain_loops(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "source", "text", F.xxhash64("doc_id", F.lit(7)).alias("draw"), F.xxhash64("doc_id", F.lit(8)).alias("deal")).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    aim = mixing.targets([(s, sum(size[r.doc_id] for r in by[s])) for s in order])
    want = {}
    width = max(-(-len(v) // leaf) for v in by.values())
    for sid, s in enumerate(order):
        total = sum(size[r.doc_id] for r in by[s])
        rate = aim[s] / total if total else 0.0
        leaves = max(1, -(-len(by[s]) // leaf))
        now = {}
        for r in by[s]:
            want[r.doc_id] = math.floor(rate)
            now.setdefault(r.deal % leaves, []).append((r.draw, size[r.doc_id], r.doc_id, rate - math.floor(rate)))
        level, nodes = 0, width
        while True:
            left = {}
            for node, units in now.items():
                units.sort(key=lambda u: u[:2])
                done, held, last = plain_pairs([(i, n, p) for _, n, i, p in units], f"7/{level}/{sid}/{node}")
                for i, up in done.items():
                    want[i] += up
                if held and nodes == 1:
                    want[held[0]] += int(last < held[2])
                elif held:
                    left.setdefault(node // fan, []).append((next(u[0] for u in units if u[2] == held[0]), held[1], held[0], held[2]))
            if nodes == 1:
                break
            now, level, nodes = left, level + 1, -(-nodes // fan)
    assert {r.doc_id: r.copies for r in mixing.mix(docs).collect()} == want


def test_repeat_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 2), (None, "c", None, 3), (2, None, "x", 4), (3, "w " * 200_000, "y", 5)], "doc_id bigint, text string, source string, copies int")
    mixed = mixing.mix(df)
    times = {(r.doc_id, r.source): r.copies for r in mixed.collect()}
    got = Counter((r.doc_id, r.source, r.copies) for r in mixing.repeat(df, mixed).collect())
    assert got == Counter({(r.doc_id, r.source, r.copies): times[r.doc_id, r.source] for r in df.collect() if times[r.doc_id, r.source]})
    assert mixing.repeat(df.limit(0), mixing.mix(df.limit(0))).collect() == []


@pytest.mark.parametrize("leaf,fan", [(4096, 512), (7, 3)])
def test_sources_come_near_their_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_edge_rows(spark):
    schema = "doc_id bigint, text string, source string, size string, part int"
    df = spark.createDataFrame([(1, "a b c", "s", "", 1), (1, "a b c", "s", "", 1), (None, "x y", None, "", 1), (2, None, "s", "", 1), (3, "", "t", "", 1), (4, "w " * 50, None, "", 1)], schema)
    rows = mixing.mix(df).collect()
    assert len(rows) == 6 and len({r.copies for r in rows if r.doc_id == 1}) == 1
    assert sum(r.size for r in rows) == 58
    out = mixing.repeat(df, mixing.mix(df))
    assert out.columns == df.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(df.limit(0)).collect() == []
    assert {r.taken for r in mixing.mix(df.where("text = ''")).collect()} == {0}
