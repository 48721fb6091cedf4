"""Quality rules: counts over every text, and an isolation forest over statistics made of them.

A forest of trees that split at random isolates odd documents on short paths. The score is 2^(-mean path / expected path);
documents whose score passes a threshold are rejected, and labelled rows calibrate the threshold.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, durable, fit_once, rows_of, text_list

#: Trees; rows of a tree, drawn from all labelled rows.
TREES, TREE_ROWS = 128, 256
#: Rows with a bad label in the sample of a tree.
ODD_ROWS = 4
#: The base rules: least words, and most words in repeated windows, in hundredths.
MIN_WORDS, MAX_REPEAT = 20, 30
#: Share of good labelled rows that the threshold may reject, at most.
MAX_LOST = 0.004
#: Thresholds are multiples of 1 / STEPS, so that counts of all scores have a bounded size.
STEPS = 1_000_000
SPACES, SYMBOLS, WINDOW = " \t\n\v\f\r", b"#*$%&|<>", 8
CAPITALS, _BEYOND_ASCII = bytes(range(65, 91)), re.compile(r"[^\x00-\x7f]+").findall
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of `window` (a power of two) words that the text has twice or more, the first included.

    Windows get exact ranks by doubling: ranks of pairs of words, then of pairs of those.
    """
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    kinds, step = len(known), 1
    while step < window:
        if kinds == len(ranks):
            return 0
        pairs = ranks[:-step] * np.int64(kinds) + ranks[step:]
        found, ranks = np.unique(pairs, return_inverse=True)
        kinds, step = len(found), 2 * step
    twice = np.bincount(ranks, minlength=kinds)[ranks] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[:-window] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """The values of COUNTS for one text; words are runs of anything but ASCII white space."""
    raw = text.encode()
    words = raw.split()
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), len(text) - sum(text.count(c) for c in SPACES), symbols, dup, repeated_words(words)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT * n_words


def statistics(text: str, c: tuple[int, ...]) -> tuple[float, ...]:
    """What the forest sees of a text: rates that don't depend on its length."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = c
    marks = text.count("!") + text.count("?")
    clutter = n_symbols + n_dup / 2 + n_repeat / 20  # apart, repeats of good texts stand out more than those of bad ones
    # the constants keep the rates of short texts from standing out
    return math.log1p(10 * clutter / (n_words + 5)), math.log1p(10 * marks / (n_words + 5)), capitals(text) / (word_chars + 300), min((word_chars + 50) / (n_words + 10), 40.0)


def capitals(text: str) -> int:
    """Upper-case characters, as str.isupper tells."""
    raw = text.encode()
    plain = len(raw) - len(raw.translate(None, CAPITALS))
    return plain if len(raw) == len(text) else plain + sum(map(str.isupper, "".join(_BEYOND_ASCII(text))))


def expected_path(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def depth_limit(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(rows, 2)))) + 2


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[list]:
    """A tree of random splits over the rows of x: (feature, split, left child, path) of each node."""
    nodes: list[list] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, x, 0)]
    while todo:
        at, part, depth = todo.pop()
        low, high = part.min(0), part.max(0)
        open_to = np.flatnonzero(high > low)
        if len(part) < 2 or depth >= limit or not len(open_to):
            nodes[at][3] = depth + expected_path(len(part))
            continue
        f = int(rng.choice(open_to))
        s = float(rng.uniform(low[f], high[f]))
        left = part[:, f] <= s
        nodes[at][:3] = [f, s, len(nodes)]
        todo += [(len(nodes), part[left], depth + 1), (len(nodes) + 1, part[~left], depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    return nodes


@dataclass
class Forest:
    """Trees as arrays (tree, node): what to split on, where, the left child (right follows), and the path at a leaf."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    depth: int
    scale: float
    threshold: float = 1.0

    @classmethod
    def of(cls, trees: list[list[list]], rows: int) -> Forest:
        """The forest of trees that were grown on `rows` rows each."""
        size = max(map(len, trees))
        full = np.array([nodes + [[-1, 0.0, 0, 0.0]] * (size - len(nodes)) for nodes in trees])
        return cls(full[:, :, 0].astype(np.int64), full[:, :, 1], full[:, :, 2].astype(np.int64), full[:, :, 3], depth_limit(rows), expected_path(rows) or 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row, 0 to 1."""
        t = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[t, node]
            right = x[row, np.maximum(f, 0)] > self.split[t, node]
            node = np.where(f < 0, node, self.child[t, node] + right)
        return 2 ** (-self.path[t, node].mean(1) / self.scale)


STATS = ("s0", "s1", "s2", "s3")


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, good, the statistics) of every labelled document that passes the base rules; h is a hash of its id.

    Statistics are made before the join, so that no text is shuffled. Of several labels of an id the highest counts.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("key is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            texts = text_list(b.column(1))
            c = [counts(t) for t in texts]
            ok = np.array([not base_failed(x[0], x[4]) for x in c], bool)
            x = np.array([statistics(t, n) for t, n, k in zip(texts, c, ok) if k]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), *map(pa.array, x.T)], ["key", *STATS])

    found = source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATS))
    marks = labels.select(F.col(id_col).alias("key"), (F.col("quality").cast("int") != 0).alias("good")).where("key is not null and good is not null")
    return found.join(marks.groupBy("key").agg(F.max("good").alias("good")), "key").select(F.xxhash64("key").alias("h"), "good", *STATS)


def _mixed(h: np.ndarray, tree: int) -> np.ndarray:
    """The place of each row in a tree's draw: its hash mixed with the tree's number."""
    x = h.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _threshold(step: np.ndarray, good: np.ndarray, n: np.ndarray) -> float:
    """The threshold with the best balanced accuracy among those that reject at most MAX_LOST of the good rows; of equal ones the lowest."""
    tries, at = np.unique(step, return_inverse=True)
    above = [np.bincount(at, n * (good == k), len(tries)) for k in (True, False)]
    totals = [a.sum() for a in above]
    ok, bad = (t - np.cumsum(a) for t, a in zip(totals, above))
    gain = np.where(ok <= int(MAX_LOST * totals[0]), bad / totals[1] - ok / totals[0], -np.inf)
    best = int(gain.argmax())
    return float((tries[best] + tries[best + 1]) // 2 / STEPS) if best + 1 < len(tries) else float(tries[best] / STEPS) + 0.01


def fit(docs: DataFrame, labels: DataFrame, **cols: str) -> Forest | None:
    """The forest of all documents that have a label in `quality`, and its threshold by the scores of all of them.

    Each tree is a task's; its rows are the first of all good rows in an order of its own, and a few bad ones likewise: odd
    rows must stay rare. Without rows of either label nothing is rejected.
    """
    x = durable(labelled(docs, labels, **cols))
    spark = x.sparkSession
    total = x.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    if total.n < 8:
        return None
    mixed = 0 < total.good < total.n
    rows = min(TREE_ROWS, total.good if mixed else total.n)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first rows of a task in each tree's order."""
        held = {}
        for b in rows_of(batches):
            h, good, *s = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            s = np.stack(s, 1)
            for odd in (False, True):
                part = (~good if odd else good) if mixed else np.full(len(h), not odd)
                for tree in range(TREES if part.any() else 0):
                    place, mine = _mixed(h[part].view(np.int64), tree), s[part]
                    if (tree, odd) in held:
                        place, mine = np.concatenate([held[tree, odd][0], place]), np.concatenate([held[tree, odd][1], mine])
                    first = np.argsort(place, kind="stable")[: ODD_ROWS if odd else rows]
                    held[tree, odd] = place[first], mine[first]
        for (tree, odd), (place, mine) in held.items():
            k = len(place)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, tree, np.int32)), pa.array(np.full(k, odd)), pa.array(place.view(np.int64)), *map(pa.array, mine.T.copy())], ["tree", "odd", "place", *STATS])

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        pdf = pdf.assign(place=pdf.place.to_numpy().astype(np.uint64)).sort_values(["place", *STATS])
        part = pd.concat([pdf[~pdf.odd].head(rows), pdf[pdf.odd].head(ODD_ROWS)])
        nodes = grow_tree(part[list(STATS)].to_numpy(), depth_limit(rows), np.random.default_rng([11, tree]))
        return pd.DataFrame({"tree": [tree], "nodes": [pickle.dumps(nodes, protocol=4)]})

    kinds = "tree int, odd boolean, place bigint, " + ", ".join(f"{s} double" for s in STATS)
    trees = x.mapInArrow(draw, kinds).groupBy("tree").applyInPandas(grow, "tree int, nodes binary").collect()
    forest = Forest.of([pickle.loads(r.nodes) for r in sorted(trees, key=lambda r: r.tree)], rows)
    if mixed:
        shared = spark.sparkContext.broadcast(forest)

        def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in rows_of(batches):
                s = shared.value.score(np.stack([c.to_numpy() for c in b.columns[2:]], 1))
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(np.ceil(s * STEPS).astype(np.int64))], ["good", "step"])

        def choose(rows: list[tuple]) -> float:
            step, good, n = map(np.array, zip(*rows))
            return _threshold(step, good, n)

        tally = x.mapInArrow(steps, "good boolean, step bigint").groupBy("step", "good").agg(F.count("*").alias("n"))
        forest.threshold = fit_once(tally, choose)
    return forest


def _judge(texts: list[str], forest: Forest | None) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    c = [counts(t) for t in texts]
    failed = np.array([base_failed(x[0], x[4]) for x in c], bool)
    s = forest.score(np.array([statistics(t, x) for t, x in zip(texts, c)])) if forest else np.zeros(len(texts))
    return c, failed, s, ~failed & (s <= (forest.threshold if forest else 1.0))


def apply(docs: DataFrame, forest: Forest | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the five counts as long, base_failed, anomaly double, kept) of every text, without a shuffle.

    A null or empty text has no words, so it fails the base rules. Repeated rows are judged each; a null id stays null;
    other columns aren't read. Without a forest (no labelled rows) only the base rules reject.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(forest)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            c, failed, s, kept = _judge(text_list(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in zip(*c)), pa.array(failed), pa.array(s), pa.array(kept)], ["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {kinds}, base_failed boolean, anomaly double, kept boolean")


def keep_good(docs: DataFrame, forest: Forest | None, *, text_col: str = "text") -> DataFrame:
    """The rows whose text is kept, with all their columns and whatever their names.

    A null or empty text goes, as it has no words; repeated rows and null ids are judged like others; texts of any length
    are judged whole; an empty table stays empty. Without a forest only the base rules reject.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(forest)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            yield b.filter(pa.array(_judge(text_list(b.column(at)), shared.value)[3]))

    return docs.mapInArrow(run, docs.schema)
