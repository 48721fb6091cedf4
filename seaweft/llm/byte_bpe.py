"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself a token is resolved by two hashes
and one comparison. Tier two merges the bytes of a missed pre-token over a linked list, with a heap that always gives
the pair of lowest rank, leftmost first, so a pre-token of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, rows_of, text_list

#: Distinct pre-tokens a worker remembers, in each of two generations, and the longest it remembers.
MEMO, MEMO_CHARS = 150_000, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class PerfectHash:
    """Minimal perfect hash from keys to 0..n-1 by hash and displace.

    Keys are thrown into n buckets. A bucket of several keys looks for a seed that sends each of its keys to a free slot,
    the largest buckets first; a bucket of one key takes any free slot, written as a negative displacement.
    """

    def __init__(self, keys: Iterable[bytes]):
        keys = list(keys)
        n = self.n = len(keys)
        buckets: dict[int, list[bytes]] = {}
        for k in keys:
            buckets.setdefault(xxhash.xxh64_intdigest(k, 0) % n, []).append(k)
        self.displace = [0] * n
        self.keys: list[bytes | None] = [None] * n
        single = []
        for b, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:
                single.append((b, members[0]))
                continue
            d = 1
            while True:
                slots = [xxhash.xxh64_intdigest(k, d) % n for k in members]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for s, k in zip(slots, members):
                self.keys[s] = k
        free = (s for s in range(n) if self.keys[s] is None)
        for b, k in single:
            s = next(free)
            self.displace[b] = -s - 1
            self.keys[s] = k

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't one of the keys."""
        d = self.displace[xxhash.xxh64_intdigest(key, 0) % self.n]
        s = -d - 1 if d < 0 else xxhash.xxh64_intdigest(key, d) % self.n
        return s if self.keys[s] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens that a pre-token's bytes merge to.

    `end[i]` is the end of the token that starts at i, 0 if none starts there; `back[i]` is where the token before it
    starts. An entry of the heap is stale if what starts at i no longer has the rank it was pushed with.
    """
    n, get = len(piece), ranks.get
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or get(piece[i : end[mid]]) != r:
            continue
        last = end[i] = end[mid]
        end[mid] = 0
        if last < n:
            back[last] = i
            if (r := get(piece[i : end[last]])) is not None:
                heapq.heappush(heap, (r, i))
        if (j := back[i]) >= 0 and (r := get(piece[j:last])) is not None:
            heapq.heappush(heap, (r, j))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes texts to ids packed as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.hash, self.split = ranks, PerfectHash(ranks), regex.compile(pattern).findall
        self.slot_rank = [ranks[k] for k in self.hash.keys]
        self.token = {r: k for k, r in ranks.items()}
        self._start()

    def _start(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.split.__self__.pattern, "hash": self.hash}

    def __setstate__(self, state: dict) -> None:
        self.ranks, self.hash, self.split = state["ranks"], state["hash"], regex.compile(state["pattern"]).findall
        self.slot_rank = [self.ranks[k] for k in self.hash.keys]
        self.token = {r: k for k, r in self.ranks.items()}
        self._start()

    def piece(self, text: str) -> bytes:
        """Packed ids of one pre-token."""
        raw = text.encode()
        slot = self.hash.find(raw)
        ids = [self.slot_rank[slot]] if slot >= 0 else merge(raw, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        young, old, out = self.young, self.old, []
        for t in self.split(text):
            ids = young.get(t)
            if ids is None:
                ids = old.get(t)
                if ids is None:
                    ids = self.piece(t)
                if len(t) <= MEMO_CHARS:
                    young[t] = ids
            out.append(ids)
        if len(young) > MEMO:  # what wasn't used for a generation goes
            self.young, self.old = {}, young
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: (doc_id, n_tokens long, ids binary of little-endian unsigned 32-bit integers).

    The rank file is read on the driver and broadcast; its size is the vocabulary's, whatever the corpus. There is no
    shuffle. A null text is the empty text and has no ids; a null id stays null; repeated rows are encoded each.
    Other columns aren't read, so their names can't clash.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.value
        for b in rows_of(batches):
            ids = [codec.encode(t) for t in text_list(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, *, ids_col: str = "ids") -> DataFrame:
    """The given rows with `decoded` (binary), the bytes that their ids stand for; null ids decode to no bytes.

    A column that is already called decoded is replaced.
    """
    spark = encoded.sparkSession
    bound_batches(spark)
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast({r: k for k, r in ranks.items()})
    source = encoded.drop("decoded")
    at = source.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token: Callable[[int], bytes] = shared.value.__getitem__
        for b in rows_of(batches):
            texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    return source.mapInArrow(run, _plus(source, "decoded binary"))


def _plus(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: (doc_id, n_tokens long, ids_sha256, decoded_sha256, both lower-case hex).

    Both ways are gone in one pass, so that a task has one Python worker with one vocabulary. A null text is the empty
    text: no tokens, and the digests of no bytes. Null ids, repeated rows and other columns are as in `encode`; texts of any
    length are taken whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.value
        for b in rows_of(batches):
            out = []
            for text in text_list(b.column(1)):
                ids = codec.encode(text)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, ids_sha, text_sha = zip(*out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
