"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a fraction of its words, so each of its documents should be copied a fractional number of times.
The whole part is certain. The fractional parts are rounded in pairs: mass (fraction times size) moves at random from one
document of a pair to the other until one of the two fractions is 0 or 1; the other goes on to the next pair. Each
expectation stays as it was, and a source's total changes only when its last fraction is rounded, by less than one
document. Groups of documents are rounded apart, and what is left of each meets in a reduction tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaweft.llm.common import bound_batches, durable

#: Documents rounded together at the tree's leaves, and remainders that meet in each node above.
LEAF, FAN = 4096, 512
#: Sources whose targets are broadcast, at most; with more, the targets are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source.

    Sources by code point, null last, have the weights in turn, and share `total` times all words. A target stops at `cap`
    times its source's size; the excess is shared by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = dict(zip((s for s, _ in order), cycle(weights)))
    size = dict(order)
    open_to, left, out = list(weight), total * sum(size.values()), {}
    while open_to:
        unit = left / sum(weight[s] for s in open_to)
        full = [s for s in open_to if unit * weight[s] > cap * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_to}
        out |= {s: cap * size[s] for s in full}
        left -= sum(cap * size[s] for s in full)
        open_to = [s for s in open_to if s not in out]
    return out


def settle(ids: Sequence, sizes: Sequence[int], parts: Sequence[float], seed: str, last: bool) -> tuple[np.ndarray, int, float]:
    """Round `parts` in the given order: 0 or 1 for each document, -1 for the one left, its place (-1: none) and its part.

    With `last`, the one left is rounded as well, up with the chance that its part says.
    """
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little")))
    draws = rng.random(len(ids) + 1).tolist()
    out = np.zeros(len(ids), np.int64)
    at, part = -1, 0.0
    for j, (size, p) in enumerate(zip(sizes, parts)):
        if p <= 0 or p >= 1 or size <= 0:
            out[j] = int(p >= 1)
        elif at < 0:
            at, part = j, p
        else:
            mine = sizes[at]
            room_up, room_down = (1 - part) * mine, part * mine  # what `at` can take and give
            give, take = p * size, (1 - p) * size
            up, down = min(room_up, give), min(room_down, take)
            if draws[j] * (up + down) < down:
                first, part, p = room_up <= give, part + up / mine, p - up / size
                done = (1, 0)
            else:
                first, part, p = room_down <= take, part - down / mine, p + down / size
                done = (0, 1)
            if first:  # the one carried is settled, and the new one is carried instead
                out[at], at, part = done[0], j, p
                if not 0 < part < 1:
                    out[j], at = int(part >= 0.5), -1
            else:
                out[j] = done[1]
    if at >= 0 and last:
        out[at], at = int(draws[-1] < part), -1
    elif at >= 0:
        out[at] = -1
    return out, at, part if at >= 0 else 0.0


NODE = "doc_id {kind}, sid int, node bigint, size bigint, part double, up int"


def _level(frame: DataFrame, kind: str, level: int, seed: int, last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "size"], kind="stable").reset_index(drop=True)
        sid, node = int(pdf.sid[0]), int(pdf.node[0])
        out, at, part = settle(range(len(pdf)), pdf["size"].tolist(), pdf.part.tolist(), f"{seed}/{level}/{sid}/{node}", last)
        pdf["up"] = pd.Series(out).where(out >= 0).astype("Int32")
        if at >= 0:
            pdf.loc[at, "part"] = part
        return pdf[["doc_id", "sid", "node", "size", "part", "up"]]

    keyed = frame.withColumn("draw", F.xxhash64("doc_id", F.lit(seed)))
    return keyed.groupBy("sid", "node").applyInPandas(run, NODE.format(kind=kind))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, cap: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: (doc_id, source, size, source_size, target, copies int, taken long).

    Only ids, sources and sizes are shuffled, never texts. Equal ids of one source are one unit: they have the same
    number of copies. A null text has size 0, a null id and a null source are values like others. Documents without words
    and sources without words have no taken words. The draws depend on the seed and the ids alone, so reruns agree
    whatever the partitioning. Other columns aren't read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sized = durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")))
    found = [(r.source, int(r.size), int(r.n)) for r in sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()]  # a row for each source
    found.sort(key=lambda s: (s[0] is None, s[0] or ""))
    aim = targets([(s, n) for s, n, _ in found], weights, total, cap)
    plan = [(i, s, n, float(aim[s]), aim[s] / n if n else 0.0, max(1, -(-rows // LEAF))) for i, (s, n, rows) in enumerate(found)]
    table = spark.createDataFrame(plan, "sid int, source string, source_size bigint, target double, rate double, leaves bigint")
    small = F.broadcast(table) if len(plan) <= BROADCAST_SOURCES else table
    named = sized.join(small.withColumnRenamed("source", "its"), F.col("source").eqNullSafe(F.col("its")), "left").drop("its")

    units = named.groupBy("doc_id", "sid").agg(F.sum("size").alias("size"), F.first("rate").alias("rate"), F.first("leaves").alias("leaves"))
    now = units.select("doc_id", "sid", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("leaves")).alias("node"), "size", (F.col("rate") - F.floor("rate")).alias("part"))
    width, level, settled = max((p[-1] for p in plan), default=1), 0, []
    while True:
        done = durable(_level(now, kind, level, seed, last=width == 1))
        settled.append(done.where("up is not null"))
        if width == 1:
            break
        now = done.where("up is null").select("doc_id", "sid", F.floor(F.col("node") / FAN).alias("node"), "size", "part")
        width, level = -(-width // FAN), level + 1
    ups = settled[0]
    for more in settled[1:]:
        ups = ups.unionByName(more)
    ups = ups.select(F.col("doc_id").alias("unit"), F.col("sid").alias("unit_sid"), "up")
    joined = named.join(ups, F.col("doc_id").eqNullSafe(F.col("unit")) & (F.col("sid") == F.col("unit_sid")), "left")
    copies = (F.floor("rate").cast("int") + F.coalesce("up", F.lit(0))).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeat(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns.

    Rows of one id and source are repeated alike, null ids and sources too; a document without words has the copies that its
    source's rate and its draw give; an empty table stays empty. Texts are joined once and never copied into arrays. A
    column called like one of the mix's keeps its own values.
    """
    times = mixed.groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("copies").alias("__copies"))
    joined = docs.join(times.where("__copies > 0"), F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")))
    # one row for each copy; only the number is exploded, the text isn't copied into an array
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
