"""Grid-density clustering (CLIQUE): cells, dense cells, and clusters of dense cells that touch."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.checkpoints import durable
from seaweft.operators.components import components

#: Cells that one task clusters, at most. A grid of k has at most k * k cells, whatever the number of points.
TASK_CELLS = 4_000_000
SPAN_FLOOR = 1e-12


@dataclass(frozen=True)
class Bounds:
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    n: int

    def cell(self, k: int | Column, axis: str) -> Column:
        """Index of the cell along an axis: truncated, and the maximum belongs to the last cell."""
        low, high = (self.lon_min, self.lon_max) if axis == "lon" else (self.lat_min, self.lat_max)
        k = F.lit(k) if isinstance(k, int) else k
        at = F.floor((F.col(axis) - F.lit(low)) / F.lit(max(high - low, SPAN_FLOOR)) * k.cast("double")).cast("int")
        return F.least(F.greatest(at, F.lit(0)), k - 1)


def bounds(points: DataFrame) -> Bounds | None:
    """Extent and number of points with coordinates; None if there are none."""
    r = points.where("lat is not null and lon is not null").agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat"), F.count("*")).first()
    return Bounds(*map(float, r[:4]), int(r[4])) if r[4] else None


def threshold(n: int, r: float, min_dense: int | None = None) -> int:
    """Points that make a cell dense."""
    return int(min_dense) if min_dense else max(1, math.ceil(r * n))


def neighbour_mode(mode: int | float | str) -> int:
    m = int(float(mode))
    if m not in (4, 8):
        raise ValueError(f"neighbour mode is 4 or 8, not {mode}")
    return m


def offsets(mode: int) -> list[tuple[int, int]]:
    """Half of the neighbours; the other half are their opposites."""
    return [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if mode == 8 else [])


def with_cells(points: DataFrame, b: Bounds, k: int) -> DataFrame:
    if k < 2:
        raise ValueError("a grid needs two cells a side at least")
    return points.withColumn("clique_x", b.cell(k, "lon")).withColumn("clique_y", b.cell(k, "lat"))


def label_cells(cells: Iterable[tuple[int, int]], mode: int) -> dict[tuple[int, int], int]:
    """Cluster of each dense cell; clusters are numbered by their smallest (x, y)."""
    cells = sorted(cells)
    root = {c: c for c in cells}

    def find(c: tuple[int, int]) -> tuple[int, int]:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x, y in cells:
        for dx, dy in offsets(mode):
            other = (x + dx, y + dy)
            if other in root:
                a, b = find((x, y)), find(other)
                root[max(a, b)] = min(a, b)
    number = {r: i for i, r in enumerate(c for c in cells if find(c) == c)}
    return {c: number[find(c)] for c in cells}


def cluster_cells(dense: DataFrame, k: int, mode: int, task_cells: int = TASK_CELLS) -> DataFrame:
    """(clique_x, clique_y, cluster_id) of dense cells: in one task while the grid bounds their number, else by Spark."""
    if k * k <= task_cells:
        def label(pdf: pd.DataFrame) -> pd.DataFrame:
            at = list(zip(pdf.clique_x.tolist(), pdf.clique_y.tolist()))
            found = label_cells(at, mode)
            return pdf.assign(cluster_id=[found[c] for c in at])

        return dense.select("clique_x", "clique_y").groupBy(F.lit(0).alias("all")).applyInPandas(label, "clique_x int, clique_y int, cluster_id int")
    key = F.col("clique_x").cast("long") * k + F.col("clique_y")
    nodes = dense.select("clique_x", "clique_y", key.alias("a"))
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets(mode))))
    moved = nodes.withColumn("d", steps).select("a", (F.col("clique_x") + F.col("d.dx")).alias("clique_x"), (F.col("clique_y") + F.col("d.dy")).alias("clique_y"))
    edges = moved.join(nodes.withColumnRenamed("a", "b"), ["clique_x", "clique_y"]).select("a", "b")
    rooted = nodes.join(components(edges).withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    numbered = number(rooted.select("root").distinct(), "root", "cluster_id")
    return rooted.join(numbered, "root").select("clique_x", "clique_y", "cluster_id")


def number(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their rank from 0: ranges are numbered in parallel, each from where the one before ends."""
    ranges = durable(values.select(column).repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    starts, total = [], 0
    for r, n in sorted(map(tuple, ranges.groupBy("__range").count().collect())):
        starts.append((r, total))
        total += n
    offsets = F.broadcast(values.sparkSession.createDataFrame(starts, "__range int, __start bigint"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    return ranges.withColumn("__rank", rank).join(offsets, "__range").select(column, (F.col("__rank") + F.col("__start")).cast("int").alias(name))


def clique(points: DataFrame, k: int = 30, r: float = 8e-5, mode: int = 4, min_dense: int | None = None) -> DataFrame:
    """The points with clique_x, clique_y and cluster_id, -1 where their cell isn't dense. Points without a place are dropped."""
    mode = neighbour_mode(mode)
    known = points.where("lat is not null and lon is not null")
    b = bounds(points)
    if b is None:
        return known.withColumns({"clique_x": F.lit(0), "clique_y": F.lit(0), "cluster_id": F.lit(-1)})
    placed = with_cells(known, b, k)
    dense = placed.groupBy("clique_x", "clique_y").count().where(F.col("count") >= threshold(b.n, r, min_dense))
    labels = cluster_cells(dense, k, mode)
    small = F.broadcast(labels) if k * k <= TASK_CELLS // 4 else labels
    return placed.join(small, ["clique_x", "clique_y"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).select(*points.columns, "clique_x", "clique_y", "cluster_id")


def grid_density(points: DataFrame, grid_size: float = 0.01, min_points: int = 10) -> DataFrame:
    """CLIQUE by cell size in degrees, eight neighbours and a fixed number of points."""
    return clique(points, max(2, round(360 / grid_size)), mode=8, min_dense=min_points)


def dense_units_1d(points: DataFrame, column: str, width: float, share: float = 0.15) -> DataFrame:
    """(unit, n): bins along one axis that hold at least a share of the points."""
    n = points.where(F.col(column).isNotNull()).count()
    return points.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("unit")).agg(F.count("*").alias("n")).where(F.col("n") >= share * n)
