"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs and accented letters to their base letter, digits and signs that stand for letters
to those letters, drops invisible characters and turns punctuation into single spaces. Lexicon entries are word beginnings.
Hits inside an exception phrase don't count. The weights of the hits are summed, normalised by length and calibrated.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, fit_once, labelled_sample, rows_of, text_list

#: Labelled rows the lexicon is learned from, at most.
FIT_ROWS = 12_000
#: Precision and evidence (likelihood ratio statistic) that a learned entry needs: the strictest that does about as well as
#: the best on half of the rows, learned on the other half. Lengths of learned word beginnings.
SETTINGS, STEM = ((0.8, 28.0), (0.6, 24.0), (0.4, 20.0)), range(4, 10)
#: Log loss that counts as about as well, rows that settings are compared on, and rows below which the first one is taken.
CLOSE, TRIED, FEW = 0.004, 3000, 200
POWERS = (0.05, 0.1, 0.2, 0.35, 0.5)
#: General insults, and phrases in which such a word isn't one.
SEED_TERMS = ("idiot", "moron", "imbecile", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumbass", "retard", "bastard", "bitch", "asshole", "faggot", "whore", "slut")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "circus clown", "class clown", "sore loser", "worthless stock", "worthless currency", "stupid simple", "keep it simple stupid")
#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = dict(zip("абвеѕіјкмнорстухузԁɡһӏαβεικνορτυχωη", "abbesijkmhopctyxyzdghlabeiknoptuxwn"))
LEET = dict(zip("0134578@$€", "oieastbase"))


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        out[c] = base if base.isalnum() else " "
    for c in range(0x300, 0x370):
        out[c] = None
    out |= {ord(c): " " for c in "\t\n\v\f\r.,;:!?\"()[]{}<>|/\\*#%&=+~^`_-'"} | {c: " " for c in range(0x2010, 0x2028)}
    out |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
    return out | {ord(a): b for a, b in (HOMOGLYPHS | LEET).items()}


TABLE = _table()


def fold(text: str) -> str:
    """The folded words, each with one space before it, and a space at the end."""
    return " " + " ".join(text.lower().translate(TABLE).split()) + " "


@dataclass
class Lexicon:
    """Entries with weights, exception phrases, and the calibration from a document's hits to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    power: float = 0.1
    slope: float = 1.5
    offset: float = -3.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(" " + fold(term).strip(), (len(fold(term)) - 1, w))
            for phrase in self.exceptions:
                a.add_word(fold(phrase)[:-1], (len(fold(phrase)) - 1, None))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of the heaviest entry at each place where one begins, exceptions taken out."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if not spared or not found:
            return found
        # the furthest end of the phrases that begin up to each place decides, so this is linear but for sorting
        spared.sort()
        starts, ends = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        return {s: w for s, w in found.items() if not (k := bisect_right(starts, s)) or ends[k - 1] < s}

    def raw(self, text: str) -> tuple[float, int]:
        """Summed weight and number of words."""
        folded = fold(text)
        return sum(self.hits(folded).values()), folded.count(" ") - 1

    def score(self, weight: float, words: int) -> float:
        x = self.slope * weight / (1 + words / 100) ** self.power + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def evidence(a: int, b: int, na: int, nb: int) -> float:
    """Likelihood ratio statistic of `a` of `na` against `b` of `nb`."""
    def ll(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)
    p = (a + b) / (na + nb)
    return 2 * (ll(a, na, a / na) + ll(b, nb, b / nb) - ll(a, na, p) - ll(b, nb, p)) if 0 < p < 1 else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, float, float]:
    """Slope, offset and log loss of a logistic curve, by damped Newton steps."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= step / max(1.0, float(np.abs(step).max()))
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


@dataclass
class Tally:
    """Numbers of toxic and other rows that have each word beginning."""

    toxic: Counter[str]
    other: Counter[str]
    n_toxic: int
    n_other: int

    @classmethod
    def of(cls, rows: list[tuple]) -> Tally:
        out = cls(Counter(), Counter(), 0, 0)
        for _, text, label in rows:
            words = set(fold(text).split())
            (out.toxic if label else out.other).update({w[:k] for w in words for k in STEM if len(w) >= k} | {w for w in words if 3 <= len(w) < STEM[0]})
            out.n_toxic, out.n_other = out.n_toxic + bool(label), out.n_other + (not label)
        return out

    def __add__(self, more: Tally) -> Tally:
        return Tally(self.toxic + more.toxic, self.other + more.other, self.n_toxic + more.n_toxic, self.n_other + more.n_other)

    def weight(self, s: str) -> float:
        return math.log((self.toxic[s] + 0.5) / (self.n_toxic + 1)) - math.log((self.other[s] + 0.5) / (self.n_other + 1))

    def lexicon(self, precision: float, least: float, prior: float = 3.0) -> Lexicon:
        """Seed terms, and the word beginnings that mark toxic rows: those of most evidence, the longest of equals."""
        found = []
        for s, k in self.toxic.items():
            m = self.other[s]
            if self.n_other and k >= 3 and k >= precision * (k + m):
                g = evidence(k, m, self.n_toxic, self.n_other)
                if g >= least:
                    found.append((-g, -len(s), s))
        chosen: dict[str, float] = {}
        taken: set[str] = set()
        for *_, s in sorted(found):
            heads = {s[:k] for k in range(1, len(s) + 1)}
            if s not in taken and not heads & chosen.keys():
                chosen[s] = self.weight(s)
                taken |= heads
        seeds = {s: prior for s in SEED_TERMS}
        for s in SEED_TERMS:  # a seed term that the labels contradict loses its weight
            if self.other[s[: STEM[-1]]]:
                seeds[s] = max(0.0, min(prior, self.weight(s[: STEM[-1]])))
        return Lexicon({s: w for s, w in (seeds | chosen).items() if w > 0})


def tune(lexicon: Lexicon, rows: list[tuple]) -> float:
    """Calibrate a lexicon on rows of both labels; the log loss. The mildest normalisation that fits about as well as the best."""
    y = np.array([bool(label) for *_, label in rows], float)
    raw = np.array([lexicon.raw(text) for _, text, _ in rows], float)
    fits = []
    for power in POWERS:
        slope, offset, loss = calibrate(raw[:, 0] / (1 + raw[:, 1] / 100) ** power, y)
        fits.append((loss, power, slope, offset))
    loss, lexicon.power, lexicon.slope, lexicon.offset = next(f for f in fits if f[0] <= min(fits)[0] + CLOSE)
    return loss


def learn(rows: list[tuple]) -> Lexicon:
    """A lexicon from (key, text, label) rows, calibrated on them; without rows of both labels, the seed terms as they are."""
    halves = rows[::2], rows[1::2]
    tallies = [Tally.of(h) for h in halves]
    setting = SETTINGS[0]
    tried = halves[1][:TRIED]
    if len(rows) >= FEW and all(t.n_toxic and t.n_other for t in tallies) and len({bool(r[2]) for r in tried}) == 2:
        losses = [tune(tallies[0].lexicon(*s), tried) for s in SETTINGS]
        setting = next(s for s, x in zip(SETTINGS, losses) if x <= min(losses) + CLOSE)
    both = tallies[0] + tallies[1]
    lexicon = both.lexicon(*setting)
    if both.n_toxic and both.n_other:
        tune(lexicon, rows)
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, *, mod: int | None = 4, held: int = 2, bound: int = FIT_ROWS, **cols: str) -> Lexicon:
    """Learn a lexicon from at most `bound` labelled documents, none of them with crc32(id) mod `mod` = `held`."""
    return fit_once(labelled_sample(docs, labels, "toxic", mod=mod, held=held, bound=bound, **cols), learn)


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score double, n_hits int, n_words long) of every text, in one pass and without a shuffle.

    A null or empty text has no hits and the score of that. Repeated rows are scored each; a null id stays null. Only
    the text counts: other columns aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        for b in rows_of(batches):
            out = []
            for t in text_list(b.column(1)):
                folded = fold(t)
                hits, words = lex.hits(folded), max(0, folded.count(" ") - 1)
                out.append((lex.score(sum(hits.values()), words), len(hits), words))
            s, h, w = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(h, pa.int32()), pa.array(w, pa.int64())], ["doc_id", "score", "n_hits", "n_words"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, n_hits int, n_words bigint")


def keep_clean(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns and whatever their names.

    A null or empty text has no hits and stays, unless the calibration puts that at the threshold; repeated rows and null ids
    are judged like others; texts of any length are judged whole; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        for b in rows_of(batches):
            yield b.filter(pa.array([lex.score(*lex.raw(t)) < threshold for t in text_list(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
