"""Voyages: what a vessel does between leaving one port and reaching another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.checkpoints import durable

#: Distance from a port that counts as being there, and ports that are broadcast, at most.
RADIUS, BROADCAST_PORTS = 0.05, 100_000


def label_ports(points: DataFrame, ports: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Points with `port`, -1 away from all. Of several ports nearer than the radius the one with the highest `ordinal` counts.

    A distance join by buckets as wide as the radius: a port is in nine of them, a point in one. Each bucket is one row with
    a list of its ports, so points are joined once and keep their partitioning where the ports are few enough to be
    broadcast (they are counted first).
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("int")
    steps = F.explode(F.array(*(F.lit(i) for i in (-1, 0, 1))))
    p = durable(ports.select("ordinal", F.col("port_id").alias("port"), F.col("lon").alias("px"), F.col("lat").alias("py"), bucket("lon").alias("x"), bucket("lat").alias("y")))
    few = p.count() <= BROADCAST_PORTS
    p = p.withColumn("i", steps).withColumn("j", steps).select((F.col("x") + F.col("i")).alias("__bx"), (F.col("y") + F.col("j")).alias("__by"), F.struct("ordinal", "port", "px", "py").alias("at"))
    buckets = p.groupBy("__bx", "__by").agg(F.collect_list("at").alias("__ports"))

    def inside(at: Column) -> Column:
        dx, dy = F.col("lon") - at.px, F.col("lat") - at.py
        return F.sqrt(dx * dx + dy * dy) < radius

    near = F.array_max(F.transform(F.filter("__ports", inside), lambda at: F.struct(at.ordinal, at.port)))
    q = points.withColumn("__bx", bucket("lon")).withColumn("__by", bucket("lat"))
    hits = q.join(F.broadcast(buckets) if few else buckets, ["__bx", "__by"], "left")
    return hits.withColumn("port", F.coalesce(near.port, F.lit(-1))).drop("__bx", "__by", "__ports")


def islands(labelled: DataFrame) -> DataFrame:
    """(mmsi, island, port, n, start): runs of equal port along a vessel's reports."""
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    before = F.lag("port").over(w)
    cut = labelled.withColumn("__new", F.when(before.isNull() | (before != F.col("port")), 1).otherwise(0))
    return cut.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def voyages(labelled: DataFrame, min_points: int = 2) -> DataFrame:
    """(mmsi, src_port, dst_port, island, n_points, line): islands at sea between two different ports."""
    runs = islands(labelled)
    line = F.sort_array(F.collect_list(F.when(F.col("port") == -1, F.struct("base_date_time", "event_seq", "lon", "lat"))))
    table = runs.groupBy("mmsi", "island").agg(F.first("port").alias("port"), F.count("*").alias("n_points"), line.alias("line"))
    w = Window.partitionBy("mmsi").orderBy("island")
    near = table.withColumn("src_port", F.lag("port").over(w)).withColumn("dst_port", F.lead("port").over(w))
    kept = near.where((F.col("port") == -1) & (F.col("src_port") != F.col("dst_port")) & (F.col("src_port") != -1) & (F.col("dst_port") != -1) & (F.col("n_points") >= min_points))
    return kept.select("mmsi", "src_port", "dst_port", "island", "n_points", F.transform("line", lambda p: F.struct(p.lon.alias("lon"), p.lat.alias("lat"))).alias("line"))
