"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint of 64 bits is cut into fewer segments than there may be differing bits, so that fingerprints with at most
MAX_BITS differing bits have a segment in which they differ by one bit at most. The index holds each segment once for each
of its bits with that bit as a wildcard; equal entries are candidates, which are compared in whole and verified.

The shuffle deals documents by half segments: a row for each segment and each half of it without the wildcard (a lot), and a
task makes the entries of the other half itself. A candidate is emitted at the first entry only that it has in common, and
only if the task hasn't connected its ends.
Runs of equal entries give all their links if they are short, else a spanning forest of tested links; in a run above
BLOCK everything is tied to one row, untested. Ties make families, in which tested links decide (`verified`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, durable, join_hot, rows_of, text_list
from seaweft.operators.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of a document for shingle similarities of SIMILAR or more, and the share of all their bits within which a
#: candidate's shingles are compared (at 0.8 a pair differs in 15.2 % on average, with a deviation of 1.6 %).
WIDTH, SIMILAR, MOST_APART = 8, 0.8, 0.195
#: Length of a run up to which its links are listed, and up to which it is compared.
LISTED, BLOCK = 32, 4096
#: Rows of a lot that one task compares, beyond which its entries are dealt out; rows compared at once.
LOT, CHUNK = 1 << 18, 1 << 16
#: Shingles (and a few for each document besides) that are verified in one task at once.
WEIGHT, EACH = 1 << 20, 32
#: Shingles whose bits are counted at once, and words whose hashes a worker remembers.
STEP, MEMO = 1 << 16, 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def segments(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(first bit, end) of the fewest segments, two at least, of which one differs by at most one bit."""
    n = max(2, max_bits // 2 + 1)
    edge = [round(64 * i / n) for i in range(n + 1)]
    return list(zip(edge, edge[1:]))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def majority(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """`width` fingerprints of 64 bits: the first of the hashes, the others of these hashes mixed anew.

    A bit is 1 if it is set in over half of the hashes.
    """
    ones, n = np.zeros((width, 64), np.int64), len(hashes)
    for k in range(0, n, STEP):
        h = hashes[k : k + STEP]
        for w in range(width):
            x = _remix(h, w) if w else h
            ones[w] += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8")[:, 0]


def _remix(h: np.ndarray, w: int) -> np.ndarray:
    x = (h ^ np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of the XXH64 of a text's word shingles, repeats included; 0 for a text without words."""
    words = words_of(text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: max(1, len(words) - shingle + 1)].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return int(majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, ends)], np.uint64))[0])


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def shingles(text: str, size: int, memo: Words) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words; a shorter text is one shingle, one without words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += (h[k : k + n] ^ np.uint64(k)) * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
    return np.unique(_remix(out, 9))


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of every text; a null or empty text has fingerprint 0. A null id stays null."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            fps = np.array([fingerprint(t, shingle) for t in text_list(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint")


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each value begins, with the end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, offsets - offsets[0]


def _longs(column: pa.Array, width: int) -> np.ndarray:
    return bytes_of(column)[0].copy().view(np.uint64).reshape(-1, width)


class Index:
    """Lots and entries of fingerprints, and what makes a candidate a link."""

    def __init__(self, max_bits: int, width: int, most: int, listed_to: int = LISTED, block: int = BLOCK):
        self.parts, self.width, self.most, self.listed_to, self.block = segments(max_bits), width, most, listed_to, block
        self.low = np.array([a for a, _ in self.parts], np.uint64)
        self.half = np.array([(b - a) // 2 for a, b in self.parts], np.uint64)
        self.size = np.array([b - a for a, b in self.parts], np.uint64)

    def lots(self, sigs: np.ndarray) -> list[np.ndarray]:
        """A lot of every row for each fingerprint, segment, and half without the wildcard."""
        out = []
        for w in range(self.width):
            for s, (low, high) in enumerate(self.parts):
                value = (sigs[:, w] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
                half = (high - low) // 2
                head = w << 44 | s << 37
                out.append(np.uint64(head) | (value >> np.uint64(half)))  # the wildcard is in the lower half
                out.append(np.uint64(head | 1 << 36) | (value & np.uint64((1 << half) - 1)))
        return out

    def free(self, lots: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of a lot: the half of its segment that may have the wildcard, and the bits of that."""
        w, s = (lots >> np.uint64(44)).astype(np.int64), ((lots >> np.uint64(37)) & np.uint64(127)).astype(np.int64)
        upper = (lots >> np.uint64(36)) & np.uint64(1)
        bits = np.where(upper == 1, self.size[s] - self.half[s], self.half[s])
        shift = self.low[s] + np.where(upper == 1, self.half[s], np.uint64(0))
        return (sigs[np.arange(len(sigs)), w] >> shift) & ((np.uint64(1) << bits) - np.uint64(1)), bits

    def near(self, x: np.ndarray) -> np.ndarray:
        """Whether differing bits (rows of x) are few enough."""
        return np.bitwise_count(x).sum(1, dtype=np.int64) <= self.most

    def first(self, x: np.ndarray, lots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether pairs with the differing bits x have no entry in common before that of the lot with wildcard `at`."""
        place = (lots >> np.uint64(37)).astype(np.int64)
        place = (place >> 7) * len(self.parts) + (place & 127)
        out = np.ones(len(x), bool)
        for w in range(self.width):
            for s, (low, high) in enumerate(self.parts):
                here = w * len(self.parts) + s
                if not (out & (place >= here)).any():
                    continue
                part = x[:, w] & np.uint64(((1 << (high - low)) - 1) << low)
                shared = np.bitwise_count(part) <= 1
                out &= ~((place > here) & shared)
                upper = (lots >> np.uint64(36)) & np.uint64(1)
                out &= ~((place == here) & (part == 0) & ((upper == 1) | (at > 0)))
        return out

    def links(self, lots: np.ndarray, nodes: np.ndarray, sigs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, tested) of whole lots, sorted by lot."""
        number = np.cumsum(np.concatenate([[0], lots[1:] != lots[:-1]])).astype(np.uint64)
        free, bits = self.free(lots, sigs)
        out = []
        for at in range(int(bits.max(initial=0))):
            rows = np.flatnonzero(bits > at)
            keys = number[rows] << np.uint64(32) | (free[rows] & ~np.uint64(1 << at))
            order = np.argsort(keys, kind="stable")
            out += self.runs(keys[order], rows[order], lots, nodes, sigs, np.full(len(lots), at, np.int64))
        return out

    def runs(self, keys: np.ndarray, rows: np.ndarray, lots: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, tested) of runs of equal sorted keys; `rows` are places in the other arrays."""
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(edge)
        pairs = []
        short = np.repeat((size > 1) & (size <= self.listed_to), size)
        if short.any():
            k, r = keys[short], rows[short]
            for d in range(1, int(size[(size > 1) & (size <= self.listed_to)].max())):
                i = np.flatnonzero(k[d:] == k[:-d])
                pairs.append((r[i], r[i + d]))
        out = []
        for i in np.flatnonzero(size > max(1, self.listed_to)):
            members = rows[edge[i] : edge[i + 1]]
            if size[i] <= self.block:
                pairs += forest(members, sigs, self.near)
            else:
                out += self.tie(members[0], members[1:], lots, nodes, sigs, at)
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            x = sigs[a] ^ sigs[b]
            ok = np.flatnonzero(self.near(x))
            ok = ok[self.first(x[ok], lots[a[ok]], at[a[ok]])]
            if len(ok):
                out.append((nodes[a[ok]], nodes[b[ok]], np.ones(len(ok), bool)))
        return out

    def tie(self, hub: int, members: np.ndarray, lots: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Members of a run tied to its first row; near ones only where the run is the first that they share."""
        x = sigs[members] ^ sigs[hub]
        near = self.near(x)
        ok = ~near
        ok[near] = self.first(x[near], np.full(int(near.sum()), lots[hub]), at[members[near]])
        some = members[ok]
        return [(np.full(len(some), nodes[hub]), nodes[some], near[ok])] if len(some) else []


class Trees:
    """What a task has linked so far, so that it passes on no link that adds nothing; begun anew when it has grown large."""

    def __init__(self, most: int = 1 << 18):
        self.above: dict[int, int] = {}
        self.most = most

    def _root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def new(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the links (a, b, tested) that join something, the tested ones first."""
        if len(self.above) > self.most:
            self.above.clear()
        a, b, tested = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(~tested, kind="stable")
        a, b, tested = a[order], b[order], tested[order]
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = self._root(x), self._root(y)
            if x != y:
                self.above[max(x, y)] = min(x, y)
                keep[i] = True
        return a[keep], b[keep], tested[keep]


def forest(rows: np.ndarray, sigs: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the near pairs of a run: each row is compared with those that no tree has reached yet."""
    left, out = rows, []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            a = todo.pop()
            close = near(sigs[left] ^ sigs[a])
            if close.any():
                found = left[close]
                out.append((np.full(len(found), a), found))
                todo += list(found[::-1])
                left = left[~close]
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], list[np.ndarray]], most: int, chunk: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of sorted batches, cut where a run of equal first columns ends. What has more than `most` rows of one run
    held is given up with True, in parts if it goes on; so no more than `most` rows of a run and a batch are held."""
    held: list[list[np.ndarray]] = []
    long, n = None, 0
    for b in rows_of(batches):
        cols = read(b)
        if long is not None:
            more = int(np.searchsorted(cols[0] != long, True))
            if more:
                yield [c[:more] for c in cols], True
            cols = [c[more:] for c in cols]
            if not len(cols[0]):
                continue
            long = None
        held.append(cols)
        n += len(cols[0])
        if n < min(chunk, most):
            continue
        cols = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.flatnonzero(cols[0] == cols[0][-1])[0])  # where the last run begins
        if cut:
            yield [c[:cut] for c in cols], False
        held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if n > most:
            long = cols[0][-1]
            yield held[0], True
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)], False


def _emit(a: np.ndarray, b: np.ndarray, tested: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(tested), pa.nulls(len(a), pa.int64())], ["a", "b", "tested", "lot"])


def links(kinds: DataFrame, *, max_bits: int = MAX_BITS, width: int = 1, most: int | None = None, listed_to: int = LISTED, block: int = BLOCK, lot: int = LOT, chunk: int = CHUNK) -> DataFrame:
    """(a, b, tested), durable: links between distinct nodes, enough to reach whatever is linked.

    `kinds` has node (bigint) and sig, the bytes of `width` fingerprints. Two nodes are linked if they share an entry and
    differ by at most `most` bits in all (`max_bits` if None). Links that aren't tested may tie others besides.
    """
    bound_batches(kinds.sparkSession)
    index = Index(max_bits, width, max_bits if most is None else most, listed_to, block)
    per_row = 2 * width * len(index.parts)
    out = "a bigint, b bigint, tested boolean, lot bigint"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            sigs = _longs(b.column(1), width)
            for part in range(0, b.num_rows, 512):  # the rows of a batch grow by the number of lots
                few = b.slice(part, 512)
                of = pa.array(np.tile(np.arange(few.num_rows), per_row))
                lots = np.concatenate(index.lots(sigs[part : part + 512])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lots), few.column(0).take(of), few.column(1).take(of)], ["lot", "node", "sig"])

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        return [*(c.to_numpy(zero_copy_only=False) for c in b.columns[:-1]), _longs(b.column(b.num_columns - 1), width)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given_up, trees = None, Trees()
        for (lots, nodes, sigs), long in whole_runs(batches, read, lot, chunk):
            if long:
                if lots[0] != given_up:
                    given_up = lots[0]
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.array([given_up])], ["a", "b", "tested", "lot"])
            elif found := index.links(lots.view(np.uint64), nodes, sigs):
                yield from _emit(*trees.new(found))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            lots, nodes, sigs = read(b)
            free, bits = index.free(lots.view(np.uint64), sigs)
            for at in range(int(bits.max())):
                rows = np.flatnonzero(bits > at)
                entry = _remix(lots[rows].view(np.uint64) ^ (free[rows] & ~np.uint64(1 << at)) << np.uint64(20) ^ np.uint64(at << 56), 3)
                yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(np.full(len(rows), at)), *(b.column(i).take(pa.array(rows)) for i in range(3))], ["entry", "at", "lot", "node", "sig"])

    def compare_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: tuple | None = None
        trees = Trees()
        for cols, long in whole_runs(batches, read, block, chunk):
            entries, at, lots, nodes, sigs = cols
            lots = lots.view(np.uint64)
            if not long:
                found = index.runs(entries, np.arange(len(entries)), lots, nodes, sigs, at)
            else:
                if hub is None or hub[0] != entries[0]:
                    hub = entries[0], [c[:1] for c in cols[1:]]
                joined = [np.concatenate(x) for x in zip(hub[1], (at, lots.view(np.int64), nodes, sigs))]
                mine = np.flatnonzero(joined[2] != joined[2][0])
                found = index.tie(0, mine, joined[1].view(np.uint64), joined[2], joined[3], joined[0])
            if found:
                yield from _emit(*trees.new(found))

    dealt = kinds.select("node", "sig").mapInArrow(deal, "lot bigint, node bigint, sig binary")
    found = durable(dealt.repartition("lot").sortWithinPartitions("lot", "node").mapInArrow(compare, out))
    heavy = found.where("lot is not null").select("lot")
    listed = found.where("lot is null").drop("lot")
    if heavy.isEmpty():
        return listed
    entries = dealt.join(heavy.distinct(), "lot").mapInArrow(spread, "entry bigint, at bigint, lot bigint, node bigint, sig binary")
    more = entries.repartition("entry").sortWithinPartitions("entry", "node").mapInArrow(compare_entries, out)
    return durable(listed.unionByName(more.drop("lot")))


def settle(comps: np.ndarray, sigs: np.ndarray, grams: np.ndarray, edges: np.ndarray, near: Callable[[np.ndarray], np.ndarray], similar: float | None) -> list[tuple[int, int]]:
    """Pairs (places) that connect what near and similar rows connect, besides rows of one component already.

    Row i has the shingles grams[edges[i] : edges[i + 1]]. Rows of small components are compared with those of larger ones
    that they aren't connected with yet.
    """
    known, label = np.unique(comps, return_inverse=True)
    order = np.argsort(np.bincount(label)[label], kind="stable")
    label, sigs = label[order], sigs[order]
    sizes = np.diff(edges)[order]
    out: list[tuple[int, int]] = []
    if similar is not None:
        words, ids = np.unique(grams, return_inverse=True)
        mark = np.zeros(len(words), np.int64)
        own = [ids[edges[i] : edges[i + 1]] for i in order]
    trees = len(known)
    for i in range(len(order)):
        if trees == 1:
            break
        left = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if len(left):
            left = left[near(sigs[left] ^ sigs[i])]
        if len(left) and similar is not None:
            small, large = np.minimum(sizes[left], sizes[i]), np.maximum(sizes[left], sizes[i])
            left = left[small >= similar * large - 1e-9]
            if len(left):
                mark[own[i]] = 1
                ends = np.concatenate([[0], np.cumsum(sizes[left])])
                shared = np.concatenate([[0], np.cumsum(mark[np.concatenate([own[j] for j in left])])])
                shared = shared[ends[1:]] - shared[ends[:-1]]
                mark[own[i]] = 0
                left = left[shared >= similar * (sizes[left] + sizes[i] - shared) - 1e-9]
        for j in left:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                trees -= 1
                out.append((int(order[i]), int(order[j])))
    return out


def verified(ties: DataFrame, values: DataFrame, index: Index, similar: float | None, *, weight: int = WEIGHT) -> DataFrame:
    """(node, root) of what tested links connect, inside the families that ties (a, b) make.

    `values` has node, size, sig and grams of the nodes of all families. A family of more than `weight` is settled in
    parts, then the parts' components by a member of each; a family that still has several is settled by pairs of parts,
    except two parts of one component. So a large group of copies costs no more than its size, and no link is lost.
    """
    width = index.width
    families = durable(components(ties).withColumnRenamed("root", "family"))
    sized = durable(families.join(values.select("node", (F.col("size") + EACH).alias("w")), "node"))
    out = "a bigint, b bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def one() -> Iterator[pa.RecordBatch]:
            nodes, comps, sigs, grams, sizes = (np.concatenate(x) for x in zip(*held))
            found = settle(comps, sigs, grams, np.concatenate([[0], np.cumsum(sizes)]), index.near, similar)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        last = None
        for b in rows_of(batches):
            keys = b.column(0).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for i, j in zip(edge, edge[1:]):
                if held and keys[i] != last:
                    yield from one()
                    held = []
                part, last = b.slice(i, j - i), keys[i]
                data, offsets = bytes_of(part.column(4))
                held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), _longs(part.column(3), width), data.copy().view(np.uint64), np.diff(offsets) // 8))
        if held:
            yield from one()

    def settled(runs: DataFrame) -> DataFrame:
        rows = runs.join(values.select("node", "sig", "grams"), "node").select("run", "node", "comp", "sig", "grams")
        return durable(rows.repartition("run").sortWithinPartitions("run", "node").mapInArrow(run, out))

    def in_parts(rows: DataFrame) -> DataFrame:
        """(run, node, comp, parts): the rows of a family (node, family, comp, w) in as many parts as their weight needs."""
        parts = rows.groupBy("family").agg(F.ceil(F.sum("w") / F.lit(weight)).cast("int").alias("parts"))
        return join_hot(rows, parts, "family", "node").select(F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("run"), "node", "comp", "parts", "family")

    one = in_parts(sized.withColumn("comp", F.col("node")))
    edges = settled(one)
    large = durable(one.where("parts > 1").select("family").distinct())
    if large.isEmpty():
        return components(edges)
    rest = durable(sized.join(large, "family"))

    def with_comps() -> DataFrame:
        roots = components(edges).select("node", F.col("root").alias("comp"))
        return rest.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    edges = durable(edges.unionByName(settled(in_parts(durable(with_comps().where("node = comp"))))))
    named = durable(with_comps())
    several = named.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("family")
    named = durable(named.join(several, "family"))
    if named.isEmpty():
        return components(edges)
    # parts of large components are their own; small components share parts
    half = weight // 2
    kinds = named.groupBy("family", "comp").agg(F.sum("w").alias("w"))
    own = F.ceil(F.col("w") / F.lit(half)).cast("int")
    kinds = kinds.withColumns({"own": own, "shared": F.ceil(F.sum(F.when(own == 1, F.col("w")).otherwise(0)).over(Window.partitionBy("family")) / F.lit(half)).cast("int")})
    placed = named.drop("w").join(kinds.drop("w"), ["family", "comp"])
    part = F.when(F.col("own") > 1, F.struct(F.col("comp").alias("owner"), F.pmod(F.xxhash64("node"), F.col("own")).alias("i")))
    placed = durable(placed.withColumn("part", part.otherwise(F.struct(F.lit(None).cast("bigint").alias("owner"), F.pmod(F.xxhash64("comp"), F.greatest("shared", F.lit(1))).alias("i")))).select("family", "node", "comp", "part"))
    every = placed.groupBy("family").agg(F.collect_set("part").alias("parts"))
    paired = join_hot(placed, every, "family", "node").withColumn("other", F.explode(F.expr("filter(parts, x -> x.owner is null or part.owner is null or x.owner != part.owner)")))
    pairs = paired.select(F.xxhash64("family", F.least("part", "other"), F.greatest("part", "other")).alias("run"), "node", "comp")
    return components(edges.unionByName(settled(pairs)))


def _roots(found: DataFrame, values: Callable[[DataFrame], DataFrame], index: Index, similar: float | None, weight: int) -> DataFrame:
    """(node, root) of the links: their components if each of them decides, else what is verified inside these."""
    if similar is None and found.where("not tested").isEmpty():
        return components(found.select("a", "b"))
    return verified(found.select("a", "b"), values(found), index, similar, weight=weight)


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, listed_to: int = LISTED, block: int = BLOCK, lot: int = LOT, weight: int = WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint, component_id) of every document; component_id is the smallest doc_id that it reaches.

    Documents whose fingerprints differ in at most `max_bits` bits are linked. A null or empty text has fingerprint 0 and
    is linked like others. Repeated rows are in one component; null ids are passed over for component_id, which is null
    where a component has no other. Other columns aren't read. Only ids and fingerprints are shuffled.
    """
    marked = durable(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col))
    kinds = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = fingerprint_roots(kinds.select("fp"), max_bits=max_bits, listed_to=listed_to, block=block, lot=lot, weight=weight)
    lowest = kinds.join(roots, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = join_hot(roots, lowest, "root", "fp").select("fp", "component_id")
    # checkpointed, so that both sides of the last join are plain shuffles and Spark can split a fingerprint that many rows share
    named = durable(kinds.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_roots(kinds: DataFrame, *, max_bits: int = MAX_BITS, listed_to: int = LISTED, block: int = BLOCK, lot: int = LOT, weight: int = WEIGHT) -> DataFrame:
    """(fp, root) of distinct fingerprints (fp bigint) that have a link: within `max_bits` bits, or by others that are."""
    sig = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # read with its bytes in reverse, which is as good an order of the bits
    nodes = kinds.select(F.col("fp").alias("node"), sig.alias("sig"))
    values = lambda _: nodes.select("node", F.lit(0).alias("size"), "sig", F.lit(b"").alias("grams"))
    found = links(nodes, max_bits=max_bits, listed_to=listed_to, block=block, lot=lot)
    return _roots(found, values, Index(max_bits, 1, max_bits), None, weight).withColumnRenamed("node", "fp")


def near_duplicates_wide(docs: DataFrame, *, shingle: int = 5, similar: float = SIMILAR, width: int = WIDTH, max_bits: int = MAX_BITS, most: float = MOST_APART, listed_to: int = LISTED, block: int = BLOCK, lot: int = LOT, weight: int = WEIGHT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id, root, text_hash) of every document by the similarity of its word shingles.

    Documents are linked if the share of distinct shingles that they have in common (Jaccard) is `similar` or more, which is
    tested exactly. Candidates are those with an entry of one of `width` fingerprints in common that differ in at most a
    share `most` of all bits: at a similarity of 0.8 98 % of the pairs, at 0.82 and above over 99 %. component_id is the
    smallest doc_id that a document reaches; a component's root tells it from others whose smallest id is the same or
    null; text_hash tells rows of one id apart. Texts without words are copies of each other. Null ids, repeated rows and
    other columns are as in `near_duplicates`.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in rows_of(batches):
            sets = [shingles(t, shingle, memo) for t in text_list(b.column(1))]
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            sigs = [majority(s, width).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "node", "size", "sig"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for b in rows_of(batches):
            sets = [shingles(t, shingle, memo).tobytes() for t in text_list(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], ["node", "size", "sig", "grams"])

    marked = durable(source.mapInArrow(mark, f"doc_id {kind}, text_hash bigint, node bigint, size int, sig binary"))
    # of the rows of a kind, that of the smallest id stands for it, so that its text is read once
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    kinds = durable(marked.groupBy("node").agg(first.alias("first"), F.first("size").alias("size"), F.first("sig").alias("sig")))
    index = Index(max_bits, width, int(most * 64 * width), listed_to, block)

    def values(found: DataFrame) -> DataFrame:
        some = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = kinds.join(some, "node").select("node", "size", "sig", F.col("first.id").alias("id"), F.col("first.hash").alias("hash"))
        texts = source.join(wanted, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "size", "sig", F.coalesce("text", F.lit("")).alias("text"))
        made = texts.mapInArrow(shingled, "node bigint, size int, sig binary, grams binary")
        return durable(made.groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.first("grams").alias("grams")))

    found = links(kinds.where("size > 0"), max_bits=max_bits, width=width, most=index.most, listed_to=listed_to, block=block, lot=lot)
    roots = durable(_roots(found, values, index, similar, weight))
    lowest = kinds.join(roots, "node").groupBy("root").agg(F.min("first.id").alias("component_id"))
    linked = join_hot(roots, lowest, "root", "node").select("node", "component_id", "root")
    named = durable(kinds.join(linked, "node", "left").select("node", F.when(F.col("root").isNull(), F.col("first.id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "node").alias("root")))
    return marked.select("doc_id", "text_hash", "node").join(named, "node").select("doc_id", "component_id", "root", "text_hash")


def hex_of(fp: str) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, rows without an id last; of texts that
    share this id, the lowest by hash.

    `found` has (doc_id, root, text_hash) of every row. Without the last two (`near_duplicates`), one row of each id that
    is its component's smallest is kept, so ids should be unique and not null.
    """
    if "root" in found.columns:
        first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))).alias("low"))
        keep = first.select("low.__id", "low.__hash")
        kept = docs.join(keep, (F.xxhash64(text_col) == F.col("__hash")) & F.col(id_col).eqNullSafe(F.col("__id")))
        once = F.row_number().over(Window.partitionBy("__hash", "__id").orderBy("__hash"))
    else:
        keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
        kept = docs.join(keep, F.col(id_col).eqNullSafe(F.col("__id")))
        once = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(text_col)))
    return kept.withColumn("__row", once).where("__row = 1").select(*docs.columns)
