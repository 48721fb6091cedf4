"""Document fingerprints by I-Match with randomised lexicons.

The lexicon has the terms whose inverse document frequency lies in a band. Terms are known by hashes of 48 bits. A
document's terms are its distinct words in the lexicon, sorted. Each of many random subsets of the lexicon picks some of
them, and the hash of all that it picks is a signature; a subset that picks none gives none. One signature more is of all
distinct words, in the band or not. Subsets differ in rate, so that short and long documents both have subsets that pick a
few terms. Likeness is the share of signatures that agree, in which sparse subsets weigh more.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seaweft.llm.common import bound_batches, rows_of, text_list

#: The band: least and greatest inverse document frequency, ln(documents / documents with the term).
LEAST_IDF, MOST_IDF = math.log(5), math.log(1000)
#: Subsets of the lexicon, and their rates: 1/2 to 2^-RATES.
SUBSETS, RATES = 128, 14
#: Distinct terms a task counts before it passes them on, and terms that a lexicon may have (it is broadcast).
HELD, MOST_TERMS = 300_000, 4_000_000
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SALT = (np.arange(SUBSETS, dtype=np.uint64) + np.uint64(1)) * _STEP
_SHIFT = np.array([63 - k % RATES for k in range(SUBSETS)], np.uint64)
#: Weights of the subsets' signatures (the root of their sparsity), and of that of all words.
_WEIGHT = np.array([*(2.0 ** ((1 + k % RATES) / 2) for k in range(SUBSETS)), 1.0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def memberships(hashes: np.ndarray) -> np.ndarray:
    """Which subsets each term is in, as packed bits; subset k takes a term with chance 1 / 2^(1 + k mod RATES)."""
    out = np.zeros((len(hashes), SUBSETS // 8), np.uint8)
    for i in range(0, len(hashes), 8192):
        out[i : i + 8192] = np.packbits((_mix(hashes[i : i + 8192, None] + _SALT) >> _SHIFT) == 0, axis=1)
    return out


def terms_of(text: str) -> set[int]:
    """Hashes of a text's distinct words; ASCII letters in lower case, split at ASCII white space."""
    return {term_hash(w) for w in set(text.encode().lower().split())}


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 16


def signatures(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """A signature for each subset, of all its picks from the hashes of sorted distinct terms; 0: none."""
    out = np.zeros(SUBSETS, np.uint32)
    subset, term = np.nonzero(np.unpackbits(packed, axis=1).T)
    if len(subset):
        starts = np.flatnonzero(np.concatenate([[True], subset[1:] != subset[:-1]]))
        place = np.arange(len(subset)) - np.repeat(starts, np.diff(np.append(starts, len(subset))))
        total = np.add.reduceat(_mix(hashes[term] ^ (place.astype(np.uint64) * _STEP)), starts)
        out[subset[starts]] = (_mix(total) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


@dataclass
class Lexicon:
    """The terms in the band, sorted."""

    terms: np.ndarray
    _packed: np.ndarray = field(default=None, repr=False)

    def __post_init__(self) -> None:
        self.terms = np.array(self.terms, np.uint64)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "_packed": None}

    def signature(self, text: str) -> np.ndarray:
        """The subsets' signatures, and last that of all distinct words (0: there are none)."""
        if self._packed is None:
            self._packed = memberships(self.terms)
        words = np.array(sorted(terms_of(text)), np.uint64)
        at = np.minimum(np.searchsorted(self.terms, words), max(0, len(self.terms) - 1))
        at = at[self.terms[at] == words] if len(self.terms) else at[:0]
        every = xxhash.xxh3_64_intdigest(words.tobytes()) >> 32 | 1 if len(words) else 0
        return np.append(signatures(self.terms[at], self._packed[at]), np.uint32(every))


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted share of the signatures in either fingerprint that are the same in both; 1 if neither has any.

    Two sparse subsets that pick something agree about as often as the documents share terms; dense ones only if the
    documents have nearly the same terms. So it is 1 for equal fingerprints and falls gently with every difference.
    """
    some = (a != 0) | (b != 0)
    weight = float(_WEIGHT[some].sum())
    return float(_WEIGHT[some & (a == b)].sum()) / weight if weight else 1.0


def fit(docs: DataFrame, *, least_idf: float = LEAST_IDF, most_idf: float = MOST_IDF, text_col: str = "text") -> Lexicon:
    """The lexicon of all documents.

    Every document is counted. The terms that are collected each occur in at least a share exp(-most_idf) of the
    documents, so there are at most (mean distinct terms of a document) * exp(most_idf) of them, however many documents; more
    than MOST_TERMS, which only a corpus of very long documents can have, are an error, as they are broadcast. A null text
    has no terms; repeated rows count each; an empty table has an empty lexicon. Other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[int] = Counter()
        for b in rows_of(batches):
            for t in text_list(b.column(0)):
                held.update(terms_of(t))
            if len(held) > HELD:
                yield flush(held)
                held = Counter()
        if held:
            yield flush(held)

    def flush(held: Counter[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["term", "n"])

    total = docs.count()
    low, high = total * math.exp(-most_idf), total * math.exp(-least_idf)
    band = texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n").between(low, high))
    found = np.array([r.term for r in band.select("term").limit(MOST_TERMS + 1).collect()], np.int64)
    if len(found) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms are in the band: choose a lower most_idf")
    return Lexicon(np.sort(found))


def fingerprint(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text, in one pass. A null text is the empty text, whose fingerprint is all zeros.

    Equal texts have equal fingerprints, and no others do but those with the same distinct words. Texts of any length are
    taken whole; a null id stays null; repeated rows have a row each; other columns aren't read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to_text(shared.value.signature(t)) for t in text_list(b.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def ranged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, extra, doc_id, text): all rows by descending id in parts, each part sorted in one partition, with one row more.

    The extra row of a part is the first row of the next part (of the first part, after the last), so each row's next
    document is in its partition. Equal ids are ordered by a hash of the text, null ids come last, a null text is the empty
    text. There are as many parts as the session has shuffle partitions; ids that many rows share are cut by the hash. One
    id and hash a part reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.bitwise_not(F.xxhash64("text")).alias("hash"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "hash")
    heads = rows.select(key.alias("key")).repartitionByRange(n, F.col("key").desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max("key").alias("head")).collect()
    bounds = sorted(tuple(r.head) for r in heads)

    @F.arrow_udf("bigint")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:  # twice the part, and 1 more for what the part begins with
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist()):
            own = (i is not None, i, h)
            at = bisect_left(bounds, own)
            out.append(2 * (len(bounds) - 1 - at) + (bounds[at] == own))
        return pa.array(out, pa.int64())

    placed = rows.withColumn("at", place(F.col("doc_id"), F.col("hash"))).withColumn("part", F.shiftright("at", 1))
    first = placed.where(F.col("at") % 2 == 1).groupBy("part").agg(F.min(F.struct("text", "doc_id", "hash")).alias("first"))
    extra = first.select(F.pmod(F.col("part") - 1, F.lit(max(1, len(bounds)))).alias("part"), F.lit(True).alias("extra"), "first.doc_id", "first.text", "first.hash")
    every = placed.select("part", F.lit(False).alias("extra"), "doc_id", "text", "hash").unionByName(extra)
    ordered = every.repartition(n, "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), "text")
    return ordered.select("part", "extra", "doc_id", "text")


EDITED = "doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited one, whose second half is the beginning of the next document.

    Next is by descending id, after the last the first; a single document is next to itself. See `ranged` for the order
    of ties and nulls. Repeated rows are documents like others; ids may be of any type; other columns aren't read; an empty
    table gives no rows. Rows are streamed, so a task holds two texts and a batch.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType

    def pair(lex: Lexicon, a: tuple, b: tuple) -> tuple:
        text, after = a[1], b[1]
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        sig = lex.signature(edited)
        return a[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(a[2]), to_text(sig), likeness(a[2], sig), likeness(a[2], b[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        held: tuple | None = None
        for b in rows_of(batches):
            out = []
            for part, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                row = (doc_id, text, lex.signature(text), part)
                if held is not None and held[3] == part:
                    out.append(pair(lex, held, row))
                held = None if extra else row
            yield _batch(out)

    def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
        kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in EDITED.split(", ")])

    return ranged(docs, id_col=id_col, text_col=text_col).mapInArrow(run, EDITED.format(kind=kind.simpleString()))
