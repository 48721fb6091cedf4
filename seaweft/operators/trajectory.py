"""Tracks by time gaps, Douglas-Peucker tolerances, and how well a track is simplified."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.functions.geometry import farthest

MAX_GAP_MINUTES, MIN_POINTS = 720.0, 5


def _micros(c: str = "base_date_time") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def with_gaps(points: DataFrame) -> DataFrame:
    """Minutes since the vessel's report before (`gap_minutes`)."""
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    return points.withColumn("gap_minutes", (_micros() - F.lag(_micros()).over(w)) / F.lit(6e7))


def with_tracks(points: DataFrame, max_gap: float = MAX_GAP_MINUTES) -> DataFrame:
    """track_seq, from 1 for each vessel: a new track begins where the gap is above the limit; trajectory_id; point_order."""
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    begins = F.when(F.col("gap_minutes").isNull() | (F.col("gap_minutes") > max_gap), 1).otherwise(0)
    tracked = with_gaps(points).withColumn("__b", begins).withColumn("track_seq", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b", "gap_minutes")
    inner = Window.partitionBy("mmsi", "track_seq").orderBy("base_date_time", "event_seq")
    return tracked.withColumn("trajectory_id", F.concat_ws("_", F.col("mmsi").cast("string"), F.col("track_seq").cast("string"))).withColumn("point_order", F.row_number().over(inner) - 1)


def tracks(points: DataFrame, max_gap: float = MAX_GAP_MINUTES, min_points: int = MIN_POINTS) -> DataFrame:
    """Points of the tracks that have enough of them, with n_track."""
    w = Window.partitionBy("mmsi", "track_seq")
    return with_tracks(points, max_gap).withColumn("n_track", F.count("*").over(w)).where(F.col("n_track") >= min_points)


def tolerances(xy: np.ndarray) -> np.ndarray:
    """For each point the tolerance from which Douglas-Peucker drops it; infinite for both ends.

    Where a stretch is split doesn't depend on the tolerance, so one tree of splits serves all: a point's tolerance is the
    least of its distance and its ancestors'. Of equal distances the first point splits.
    """
    n = len(xy)
    tol = np.zeros(n)
    if n <= 2:
        return np.full(n, np.inf)
    tol[[0, -1]] = np.inf
    todo = [(0, n - 1, math.inf)]
    while todo:
        s, e, cap = todo.pop()
        if e - s < 2:
            continue
        at, d = farthest(xy[s + 1 : e], xy[s], xy[e])
        cut, here = s + 1 + at, min(d, cap)
        tol[cut] = here
        if here == 0.0:  # all of the stretch lies on the line: nothing below is above 0 either
            continue
        todo += [(s, cut, here), (cut, e, here)]
    return tol


def with_tolerance(tracked: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """(mmsi, trajectory_id, point_order, event_seq, lon, lat, tolerance): one pass that serves every gamma.

    Tracks are dealt out by key, sorted inside a task, and streamed: a task holds one track and a batch at a time. A track is
    simplified as a whole, as its splits depend on its ends, so the memory of a task follows the longest track.
    """
    cols = ["mmsi", key, "point_order", "event_seq", "lon", "lat"]
    kinds = "mmsi bigint, {} string, point_order int, event_seq bigint, lon double, lat double, tolerance double".format(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Tolerances of whole tracks."""
            table = table.combine_chunks()
            ids = table.column(1).combine_chunks().dictionary_encode()
            codes = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy()
            xy = np.stack([table.column(i).to_numpy().astype(float) for i in (4, 5)], 1)
            edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))
            tol = np.concatenate([tolerances(xy[i:j]) for i, j in zip(edge, edge[1:])])
            yield from table.append_column("tolerance", pa.array(tol)).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            last = b.column(1)[b.num_rows - 1]
            if held and b.column(1)[0] != held[-1].column(1)[0]:
                yield from done(pa.Table.from_batches(held))
                held = []
            cut = pc.index(b.column(1), last).as_py()  # the last track may go on in the next batch
            if cut:
                yield from done(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from done(pa.Table.from_batches(held))

    return tracked.select(*cols).repartition(key).sortWithinPartitions(key, "point_order").mapInArrow(run, kinds)


def keep(gamma: float | Column) -> Column:
    """Whether a point is a feature point at gamma (below 0 counts as 0)."""
    g = F.lit(float(gamma)) if isinstance(gamma, (int, float)) else gamma
    return F.col("tolerance") > F.greatest(g, F.lit(0.0))


def feature_points(tol: DataFrame, gamma: float, key: str = "trajectory_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("point_order")
    return tol.where(keep(gamma)).withColumn("feature_order", F.row_number().over(w) - 1).withColumn("gamma", F.lit(float(gamma)))


def lengths(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, length) of each track: the sum of the distances between its points in order."""
    w = Window.partitionBy(*keys).orderBy("point_order")
    dx, dy = F.col("lon") - F.lag("lon").over(w), F.col("lat") - F.lag("lat").over(w)
    return points.withColumn("__d", F.sqrt(dx * dx + dy * dy)).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"))


def similarity(whole: Column, cut: Column) -> Column:
    """1 less the relative change of length, between 0 and 1; 1 for a track without length."""
    d = 1 - F.abs(cut - whole) / (whole + F.lit(1e-12))
    return F.when(whole <= 1e-12, 1.0).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)))


def metrics(tol: DataFrame, gammas: Sequence[float], w1: float = 1.0, w2: float = 1.0, key: str = "trajectory_id") -> DataFrame:
    """How each track fares at each gamma: points and lengths before and after, dr, dl, loss and ld_score."""
    grid = F.explode(F.array(*(F.lit(float(g)) for g in gammas)))
    before = lengths(tol, [key]).select(key, F.col("n").alias("original_points"), F.col("length").alias("original_length"))
    after = lengths(tol.withColumn("gamma", grid).where(keep(F.col("gamma"))), [key, "gamma"]).select(key, "gamma", F.col("n").alias("compressed_points"), F.col("length").alias("compressed_length"))
    dr = 1 - F.col("compressed_points") / F.col("original_points")
    dl = similarity(F.col("original_length"), F.col("compressed_length"))
    both = after.join(before, key).withColumn("compression_rate_dr", dr).withColumn("distance_similarity_dl", dl)
    return both.withColumn("distance_loss", 1 - F.col("distance_similarity_dl")).withColumn("ld_score", w1 * F.col("compression_rate_dr") + w2 * F.col("distance_similarity_dl"))


def best_gamma(m: DataFrame, gammas: Sequence[float], key: str = "trajectory_id") -> DataFrame:
    """The gamma of the best ld_score for each track; ties go to fewer points, then to the earlier gamma of the list."""
    place = F.array_position(F.array(*(F.lit(float(g)) for g in gammas)), F.col("gamma"))
    w = Window.partitionBy(key).orderBy(F.desc("ld_score"), "compressed_points", place)
    return m.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def descend_gamma(tol: DataFrame, start: float, step: float, least: float = 0.0, most_steps: int = 100, key: str = "trajectory_id", **weights: float) -> DataFrame:
    """Lower gamma step by step while ld_score doesn't fall: the last (trajectory_id, gamma, ld_score) before it does."""
    grid, g = [], start
    while len(grid) < most_steps and g >= least:
        grid.append(g)
        g = start - step * len(grid)
    w = Window.partitionBy(key).orderBy(F.desc("gamma"))
    m = metrics(tol, grid, key=key, **weights).withColumn("__rose", F.coalesce(F.col("ld_score") >= F.lag("ld_score").over(w), F.lit(True)).cast("int"))
    still = m.withColumn("__all", F.min("__rose").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__all = 1")
    return still.groupBy(key).agg(F.min_by(F.struct("gamma", "ld_score", "compressed_points"), "gamma").alias("s")).select(key, "s.*")
