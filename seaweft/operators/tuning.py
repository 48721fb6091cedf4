"""Parameter sweeps of the clustering and of the simplification, with their scores."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.checkpoints import durable
from seaweft.functions.scalar import alignment
from seaweft.operators import grid, network, trajectory

#: The grids of the sweeps.
KS = (20, 30, 50, 80, 120, 200, 300, 500, 800, 1000, 1400)
RS = (5e-6, 1e-5, 2e-5, 3e-5, 5e-5, 8e-5, 1e-4, 1.5e-4, 2e-4, 3e-4, 5e-4, 1e-3)
GAMMAS = (1e-5, 5e-5, 1e-4, 2e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 2e-2, 5e-2, 1e-1)


@dataclass(frozen=True)
class Trial:
    """One combination; the key by which trials are resumed."""

    k: int
    r: float
    neighbor_mode: int
    min_dense_points: int | None = None


def trials(ks: Iterable[int] = KS, rs: Iterable[float] = RS, modes: Iterable[int] = (4, 8), min_dense: Iterable[int | None] = (None,)) -> list[Trial]:
    return [Trial(int(k), float(r), grid.neighbour_mode(m), d) for k, r, m, d in product(ks, rs, modes, min_dense)]


def numbers(text: str) -> list[float]:
    """Numbers of a list written with commas, semicolons or spaces."""
    return [float(x) for x in re.split(r"[,;\s]+", text) if x]


def least_dense(value: object) -> int | None:
    """A minimum of points as a whole number above 0; None if there is none."""
    if value is None or str(value).strip().lower() in ("", "none", "nan"):
        return None
    n = int(float(str(value)))
    return n if n > 0 else None


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Trials without a result yet; the key is typed, so 4 and 4.0 are one mode, and a missing minimum equals another."""
    same = (F.col("w.k") == F.col("d.k")) & (F.col("w.r") == F.col("d.r")) & (F.col("w.neighbor_mode") == F.col("d.neighbor_mode").cast("int")) & F.col("w.min_dense_points").eqNullSafe(F.col("d.min_dense_points").cast("int"))
    return wanted.alias("w").join(done.alias("d"), same, "left_anti")


def latest(results: DataFrame, order: str) -> DataFrame:
    """The last result of each trial."""
    w = Window.partitionBy("k", "r", "neighbor_mode", "min_dense_points").orderBy(F.desc(order))
    return results.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: The weights of the terms of both scores stand in the two expressions below.
def port_score(effective: Column, coverage: Column, largest: Column, speed_term: Column, low: float | None, high: float | None) -> Column:
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.50 * alignment(effective, low, high) + 0.25 * clip(coverage) + 0.20 * (1 - clip(largest)) + 0.05 * speed_term


def waypoint_score(ld: Column, coverage: Column, largest: Column, nodes: Column, edges: Column, moves: Column, low: float | None = None, high: float | None = None) -> Column:
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    pairs = nodes * (nodes - 1)
    density = F.when(nodes > 1, 1 - F.exp(-25.0 * edges / pairs)).otherwise(0.0)
    depth = F.least(F.lit(1.0), moves / F.greatest(edges, F.lit(1)) / 3.0)
    return 0.35 * ld + 0.20 * clip(coverage) + 0.15 * (1 - clip(largest)) + 0.15 * alignment(nodes, low, high) + 0.10 * density + 0.05 * depth


def labelled_cells(cells: DataFrame) -> DataFrame:
    """(kind, clique_x, clique_y, n, cluster_id) of dense cells (kind, neighbor_mode, clique_x, clique_y, n).

    A kind is one grid with one threshold; it has k * k cells at most, whatever the number of points, and is one task's.
    """
    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        at = list(zip(pdf.clique_x.tolist(), pdf.clique_y.tolist()))
        found = grid.label_cells(at, int(pdf.neighbor_mode.iloc[0]))
        return pdf[["kind", "clique_x", "clique_y", "n"]].assign(cluster_id=[found[c] for c in at])

    return cells.groupBy("kind").applyInPandas(label, "kind int, clique_x int, clique_y int, n bigint, cluster_id int")


def sweep_ports(points: DataFrame, wanted: Sequence[Trial], *, min_port_points: int = 5, low: float | None = None, high: float | None = None, speed_term: float = 1.0) -> DataFrame:
    """A row for each trial with its cluster sizes, transitions and score, best first by `score`.

    The points are placed in all grids in one pass, and runs of reports in one cell are collapsed, which changes no
    transition. Trials of one grid share its cells; those with the same threshold and mode share their clusters, which one
    task makes of at most k * k cells. Only bounds and the given trials are on the driver. The score takes the speed term as
    given, because a wall clock gives another result each time.
    """
    spark = points.sparkSession
    b = grid.bounds(points)
    ks = sorted({t.k for t in wanted})
    if b is None or not ks:
        return spark.createDataFrame([], TRIALS)
    at = F.explode(F.array(*map(F.lit, ks)))
    known = points.where("lat is not null and lon is not null").select("mmsi", "base_date_time", "event_seq", "lat", "lon")
    placed = durable(known).withColumn("k", at)
    placed = placed.withColumn("clique_x", b.cell(F.col("k"), "lon")).withColumn("clique_y", b.cell(F.col("k"), "lat")).drop("lat", "lon")
    least = [grid.threshold(b.n, t.r, t.min_dense_points) for t in wanted]
    kinds = {key: i for i, key in enumerate(dict.fromkeys((t.k, n, t.neighbor_mode) for t, n in zip(wanted, least)))}
    kind_table = F.broadcast(spark.createDataFrame([(i, *key) for key, i in kinds.items()], "kind int, k int, threshold bigint, neighbor_mode int"))  # a row a trial at most
    cells = placed.groupBy("k", "clique_x", "clique_y").agg(F.count("*").alias("n"))
    labels = durable(labelled_cells(cells.join(kind_table, "k").where("n >= threshold").select("kind", "neighbor_mode", "clique_x", "clique_y", "n")))
    sizes = labels.groupBy("kind", "cluster_id").agg(F.sum("n").alias("n"))
    shape = sizes.groupBy("kind").agg(
        F.sum("n").alias("inside"), F.count("*").alias("n_clusters"), F.sum((F.col("n") >= min_port_points).cast("long")).alias("effective_ports"),
        F.max("n").alias("largest_cluster_points"), F.median("n").alias("median_cluster_points"),
    )
    w = Window.partitionBy("k", "mmsi").orderBy("base_date_time", "event_seq")
    here = F.struct("clique_x", "clique_y")
    runs = placed.withColumn("__before", F.lag(here).over(w)).where(F.col("__before").isNull() | (F.col("__before") != here)).drop("__before")
    labelled = runs.join(labels.join(kind_table, "kind").select("kind", "k", "clique_x", "clique_y", "cluster_id"), ["k", "clique_x", "clique_y"])
    v = Window.partitionBy("kind", "mmsi").orderBy("base_date_time", "event_seq")
    changes = labelled.withColumn("__before", F.lag("cluster_id").over(v)).where("__before is not null and __before != cluster_id")
    moves = changes.groupBy("kind", "__before", "cluster_id").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("edge_count"), F.sum("n").alias("transition_count"))
    rows = [(i, *astuple(t), n, kinds[t.k, n, t.neighbor_mode]) for i, (t, n) in enumerate(zip(wanted, least), 1)]
    table = spark.createDataFrame(rows, "trial bigint, k int, r double, neighbor_mode int, min_dense_points int, threshold bigint, kind int")
    full = table.join(shape, "kind", "left").join(moves, "kind", "left").drop("kind").fillna(0)
    total = F.lit(b.n).cast("bigint")
    full = full.withColumns({
        "min_dense_points": F.when(F.col("min_dense_points") > 0, F.col("min_dense_points")), "total_points": total,
        "coverage_ratio": F.col("inside") / total, "noise_ratio": 1 - F.col("inside") / total,
        "largest_cluster_share": F.when(F.col("inside") > 0, F.col("largest_cluster_points") / F.col("inside")).otherwise(0.0),
        "mean_cluster_points": F.when(F.col("n_clusters") > 0, F.col("inside") / F.col("n_clusters")).otherwise(0.0),
    })
    score = port_score(F.col("effective_ports"), F.col("coverage_ratio"), F.col("largest_cluster_share"), F.lit(float(speed_term)), low, high)
    return full.withColumn("score", score).select(*(x.split()[0] for x in TRIALS.split(", ")))


SHAPE = (
    "trial bigint, k int, r double, neighbor_mode int, min_dense_points int, threshold bigint, total_points bigint, coverage_ratio double, noise_ratio double, "
    "n_clusters bigint, effective_ports bigint, largest_cluster_points bigint, largest_cluster_share double, mean_cluster_points double, median_cluster_points double"
)
TRIALS = SHAPE + ", edge_count bigint, transition_count bigint, score double"


def ranked(results: DataFrame) -> DataFrame:
    """Trials by score, the best first; equal scores by trial, or by gamma and weights."""
    ties = ["trial"] if "trial" in results.columns else ["gamma", "w1", "w2"]
    return results.orderBy(F.desc_nulls_last("score"), *ties)


def best(results: DataFrame) -> DataFrame:
    return ranked(results).limit(1)


def best_params(results: DataFrame | None = None, *, cli: tuple[int, float, int] | None = None, summary: dict | None = None, default: Trial = Trial(1400, 5e-6, 4)) -> Trial:
    """Parameters by precedence: given ones, a summary's best trial, the table's best score, the default."""
    if cli is not None:
        return Trial(int(cli[0]), float(cli[1]), grid.neighbour_mode(cli[2]))
    if summary and summary.get("best_trial"):
        t = summary["best_trial"]
        return Trial(int(t["k"]), float(t["r"]), grid.neighbour_mode(t["neighbor_mode"]), t.get("min_dense_points"))
    row = best(results).first() if results is not None else None
    return Trial(int(row.k), float(row.r), grid.neighbour_mode(row.neighbor_mode), row.min_dense_points) if row else default


def by_parameter(results: DataFrame, name: str) -> DataFrame:
    """Mean and best score and number of trials for each value of a parameter, the best mean first."""
    return results.groupBy(name).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n_trials")).orderBy(F.desc("mean_score"), name)


def compare(results: DataFrame, names: Sequence[str] = ("gamma", "w1", "w2")) -> DataFrame:
    """(parameter, value, mean_score, max_score, n_trials) of each value of each of the parameters."""
    out = None
    for name in names:
        one = results.groupBy(F.col(name).cast("double").alias("value")).agg(F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.count("*").alias("n_trials")).select(F.lit(name).alias("parameter"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def sweep_waypoints(tol: DataFrame, gammas: Sequence[float], trial: Trial, *, weights: Sequence[tuple[float, float]] = ((1.0, 1.0),), low: float | None = None, high: float | None = None) -> DataFrame:
    """A row for each gamma and pair of weights: compression, clusters of the feature points, network, and score.

    `tol` has the tolerances of all points (see trajectory.with_tolerance), so each gamma is a filter, and all gammas go
    through the same few jobs together; one task makes the clusters of a gamma, of k * k cells at most. Weights change the score only.
    """
    spark, k = tol.sparkSession, trial.k
    tol = durable(tol)
    total = trajectory.lengths(tol, ["trajectory_id"]).agg(F.count("*").alias("trajectories"), F.sum("n").alias("original_points"), F.sum("length").alias("whole")).first()
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.lit(float(x)).alias("gamma")) for i, x in enumerate(gammas))))
    feats = durable(tol.withColumn("__g", every).withColumns({"g": F.col("__g.g"), "gamma": F.col("__g.gamma")}).drop("__g").where(trajectory.keep(F.col("gamma"))))
    extent = {r.g: grid.Bounds(r.x0, r.x1, r.y0, r.y1, r.n) for r in feats.groupBy("g").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.count("*").alias("n")).collect()}
    if not extent:
        return spark.createDataFrame([], "gamma double, feature_points bigint, n_clusters bigint, largest_cluster_points bigint, nodes bigint, edges bigint, transitions bigint, trajectories bigint, original_points bigint, w1 double, w2 double, compression_rate_dr double, distance_similarity_dl double, cluster_coverage double, largest_cluster_share double, ld_score double, score double")

    def cell(axis: str) -> Column:
        out = F.lit(None).cast("int")
        for g, b in extent.items():
            out = F.when(F.col("g") == g, b.cell(k, axis)).otherwise(out)
        return out

    placed = feats.withColumn("clique_x", cell("lon")).withColumn("clique_y", cell("lat"))
    limits = [(g, g, trial.neighbor_mode, grid.threshold(b.n, trial.r, trial.min_dense_points), float(gammas[g]), b.n) for g, b in extent.items()]
    limit = spark.createDataFrame(limits, "g int, kind int, neighbor_mode int, threshold bigint, gamma double, feature_points bigint")  # a row a gamma
    cells = placed.groupBy("g", "clique_x", "clique_y").agg(F.count("*").alias("n")).join(F.broadcast(limit), "g").where("n >= threshold")
    found = durable(labelled_cells(cells.select("kind", "neighbor_mode", "clique_x", "clique_y", "n")))
    # clusters of all gammas have ids of their own
    labels = found.select(F.col("kind").alias("g"), "clique_x", "clique_y", (F.col("kind") * F.lit(k * k) + F.col("cluster_id")).cast("int").alias("cluster_id"))
    clustered = placed.join(labels, ["g", "clique_x", "clique_y"])
    sizes = found.groupBy("kind", "cluster_id").agg(F.sum("n").alias("n")).groupBy(F.col("kind").alias("g")).agg(F.sum("n").alias("inside"), F.count("*").alias("n_clusters"), F.max("n").alias("largest_cluster_points"))
    base = limit.select("g", "gamma", "feature_points").join(sizes, "g", "left").fillna(0)
    hulls = durable(network.boundaries(clustered))
    group = F.floor(F.col("cluster_id") / (k * k)).cast("int").alias("g")
    nodes = hulls.groupBy(group).agg(F.count("*").alias("nodes"))
    moved = network.transitions(clustered, hulls.select(F.col("cluster_id").alias("port_id")), keys=("g", "mmsi", "trajectory_id"), order=("point_order",))
    edges = moved.withColumn("g", F.floor(F.col("source_port") / (k * k)).cast("int")).groupBy("g", "source_port", "target_port").agg(F.count("*").alias("n")).groupBy("g").agg(F.count("*").alias("edges"), F.sum("n").alias("transitions"))
    cut = trajectory.lengths(feats, ["g", "trajectory_id"]).groupBy("g").agg(F.sum("length").alias("cut"))
    out = base.join(nodes, "g", "left").join(edges, "g", "left").join(cut, "g", "left").fillna(0, ["nodes", "edges", "transitions"]).drop("g")
    grid_w = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("w1"), F.lit(float(b)).alias("w2")) for a, b in weights)))
    n, whole = F.lit(int(total.original_points or 0)), F.lit(float(total.whole or 0.0))
    x = out.withColumn("__w", grid_w).withColumns({
        "trajectories": F.lit(int(total.trajectories)), "original_points": n, "w1": F.col("__w.w1"), "w2": F.col("__w.w2"),
        "compression_rate_dr": 1 - F.col("feature_points") / F.greatest(n, F.lit(1)),
        "distance_similarity_dl": F.least(F.greatest(1 - F.abs(F.col("cut") - whole) / F.greatest(whole, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0)),
        "cluster_coverage": F.col("inside") / F.greatest(F.col("feature_points"), F.lit(1)),
        "largest_cluster_share": F.when(F.col("inside") > 0, F.col("largest_cluster_points") / F.col("inside")).otherwise(0.0),
    }).drop("__w", "cut")
    x = x.withColumn("ld_score", F.col("w1") * F.col("compression_rate_dr") + F.col("w2") * F.col("distance_similarity_dl"))
    return x.withColumn("score", waypoint_score(F.col("ld_score"), F.col("cluster_coverage"), F.col("largest_cluster_share"), F.col("nodes"), F.col("edges"), F.col("transitions"), low, high)).drop("inside")


def port_score_value(effective: int, coverage: float, largest: float, runtime: float, low: float | None, high: float | None) -> float:
    """The port score of one trial with its run time, for a single row."""
    if low is None and high is None:
        count = 0.5
    else:
        low, high = sorted((low if low is not None else high, high if high is not None else low))
        gap = max(low - effective, effective - high, 0)
        count = math.exp(-gap / max(10.0, high - low))
    return 0.5 * count + 0.25 * min(max(coverage, 0.0), 1.0) + 0.2 * (1 - min(max(largest, 0.0), 1.0)) + 0.05 / (1 + max(runtime, 0.0))
