"""Quality classifier: supervised subword embeddings.

Words and character n-grams (over code points) are hashed to learned vectors. A document is the mean of its words' vectors
and its n-grams' vectors; a softmax over two outputs reads it. Training is stochastic gradient descent in numpy. As the
mean is linear, scoring needs one number for each bucket: the difference that its vector makes between the outputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, fit_once, labelled_sample, rows_of, text_list

#: Labelled rows used for training, at most; size of the vectors; buckets (a power of two) of words and of n-grams.
FIT_ROWS, DIM, BITS, GRAMS = 6_000, 8, 16, (3, 4)
EPOCHS, RATE, DECAY = 5, 0.5, 1e-5
#: Characters of text that are hashed at once, or a little more: a text is cut after white space, and n-grams go across.
SPAN = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True
_CUT = re.compile(r"[ \t\n\v\f\r]").search
_MIX, _WORD_MIX = np.uint32(2654435761), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1024, 0x100000001B3, np.uint64), dtype=np.uint64)
#: Factors of the characters of an n-gram, from the first.
_PLACES = [np.uint32(1), np.uint32(0x01000193), np.uint32(0x01000193**2 % 2**32), np.uint32(0x01000193**3 % 2**32)]
#: The bucket of a word that repeats the one before it.
AGAIN = 0


def word_buckets(raw: np.ndarray, before: int | None = None) -> tuple[np.ndarray, int | None]:
    """Buckets of the words in a span of bytes, and the last word's hash, for the next span's `before`.

    A repeat of the word before has the bucket AGAIN.
    """
    ink = ~_SPACE[raw]
    begins = ink & ~np.concatenate([[False], ink[:-1]])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, before
    at = np.flatnonzero(ink)
    word = np.cumsum(begins)[at] - 1
    place = (at - starts[word]) & 1023
    h = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])))
    out = ((h * _WORD_MIX) >> np.uint64(64 - BITS)).astype(np.int64)
    out[1:][h[1:] == h[:-1]] = AGAIN
    if before is not None and h[0] == before:
        out[0] = AGAIN
    return out, int(h[-1])


def gram_buckets(codes: np.ndarray, before: int = 0) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of code points, an array for each length; they follow the words' buckets.

    Those that end in the first `before` code points belong to the span before.
    """
    code = codes * _PLACES[0]
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            return
        code = code[:-1] + codes[n - 1 :] * _PLACES[n - 1]
        if n in GRAMS:
            yield (((code[max(0, before - n + 1) :] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _MIX) >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS)


def spans(text: str) -> Iterator[tuple[str, str]]:
    """The text in parts of about SPAN, cut after white space, each with the characters before it that n-grams need."""
    start = 0
    while start < len(text):
        end = start + SPAN
        cut = _CUT(text, end) if end < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[max(0, start - max(GRAMS) + 1) : start], text[start:end]
        start = end


def buckets(text: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Buckets of words and of n-grams of each part of a text; together they don't depend on where it is cut."""
    last = None
    for before, part in spans(text):
        words, last = word_buckets(np.frombuffer(part.encode(), np.uint8), last)
        yield words, list(gram_buckets(np.frombuffer((before + part).encode("utf-32-le"), np.uint32), len(before)))


@dataclass
class Model:
    """What each bucket adds to the logit of label 1, and the offset."""

    gain: np.ndarray
    offset: float

    def logit(self, text: str) -> float:
        words = grams = 0.0
        n_words = n_grams = 0
        for ids, lists in buckets(text):
            words, n_words = words + float(self.gain[ids].sum(dtype=np.float64)), n_words + len(ids)
            for ids in lists:
                grams, n_grams = grams + float(self.gain[ids].sum(dtype=np.float64)), n_grams + len(ids)
        return words / max(1, n_words) + grams / max(1, n_grams) + self.offset

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and the share of each in its mean."""
    count = np.zeros(2 << BITS)
    for words, lists in buckets(text):
        for ids in (words, *lists):
            np.add.at(count, ids, 1.0) if len(ids) < 4096 else count.__iadd__(np.bincount(ids, minlength=len(count)))
    half = 1 << BITS
    count[:half] /= max(1.0, count[:half].sum())
    count[half:] /= max(1.0, count[half:].sum())
    ids = np.flatnonzero(count)
    return ids, count[ids].astype(np.float32)


def train(rows: list[tuple], seed: int = 5) -> Model:
    """Train on (key, text, label) rows. With no rows, or one label only, the offset alone tells the share of label 1."""
    rng = np.random.default_rng(seed)
    label = np.array([int(bool(r[2])) for r in rows], np.int64)
    share = float(np.clip(label.mean(), 0.02, 0.98)) if len(label) else 0.5
    offset = float(np.log(share / (1 - share)))
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(2 << BITS, np.float32), offset)
    docs = [features(r[1]) for r in rows]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 << BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.array([0.0, offset], np.float32)
    step, steps = 0, EPOCHS * len(docs)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, share_of = docs[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share_of @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # each bucket moves by its share, scaled so that the document's mean moves by about `rate`
            vectors[ids] -= np.outer(share_of * (rate / max(1e-6, float(share_of @ share_of))), back).astype(np.float32) * np.float32(0.2)
        vectors *= 1 - DECAY
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int | None = 5, held: int = 0, bound: int = FIT_ROWS, **cols: str) -> Model:
    """Train on at most `bound` labelled documents, none of them with crc32(id) mod `mod` = `held`, in one executor task."""
    return fit_once(labelled_sample(docs, labels, label, mod=mod, held=held, bound=bound, **cols), train)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double) of every text: the probability of label 1. One pass, no shuffle.

    A null or empty text has the offset's score. Repeated rows are scored each; a null id stays null; other columns
    aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in rows_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in text_list(b.column(1))], pa.float64())], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
