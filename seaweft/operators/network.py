"""Port polygons, nodes and directed edges of a network."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seaweft.functions.geometry import area_centroid, convex_hull

#: Parts in which the hull of a cluster is made first, so that a large cluster isn't one task's.
PARTS = 16
HULL = "cluster_id int, n_points bigint, ring array<struct<lon:double,lat:double>>, area_deg2 double, lon double, lat double"


def boundaries(clustered: DataFrame) -> DataFrame:
    """Convex hull of each cluster, with area and centroid.

    A cluster needs four distinct points, two distinct longitudes and two distinct latitudes; a hull without area is none.
    Of the points at one longitude only the lowest and the highest can be corners; hulls of parts are merged.
    """
    points = clustered.where("cluster_id != -1").select("cluster_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    distinct = points.groupBy("cluster_id", "lon", "lat").agg(F.count("*").alias("n"))
    ends = distinct.groupBy("cluster_id", "lon").agg(F.min("lat").alias("low"), F.max("lat").alias("high"), F.count("*").alias("kinds"), F.sum("n").alias("n"))
    sums = ends.groupBy("cluster_id").agg(F.sum("n").alias("n_points"), F.sum("kinds").alias("kinds"), F.count("*").alias("lons"), F.min("low").alias("low"), F.max("high").alias("high"))
    fit = sums.where("kinds >= 4 and lons >= 2 and low < high").select("cluster_id", "n_points")
    corners = ends.withColumn("part", F.pmod(F.xxhash64("lon"), F.lit(PARTS))).withColumn("lat", F.explode(F.array_distinct(F.array("low", "high")))).select("cluster_id", "part", "lon", "lat")

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(pdf[["lon", "lat"]].to_numpy(float))
        return pd.DataFrame({"cluster_id": pdf.cluster_id.iloc[0], "lon": hull[:, 0], "lat": hull[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(pdf[["lon", "lat"]].to_numpy(float))
        area, lon, lat = area_centroid(hull) if len(hull) > 2 else (0.0, 0.0, 0.0)
        if area <= 0:
            return pd.DataFrame(columns=["cluster_id", "n_points", "ring", "area_deg2", "lon", "lat"])
        ring = [{"lon": float(x), "lat": float(y)} for x, y in [*hull, hull[0]]]
        return pd.DataFrame({"cluster_id": [pdf.cluster_id.iloc[0]], "n_points": [pdf.n_points.iloc[0]], "ring": [ring], "area_deg2": [area], "lon": [lon], "lat": [lat]})

    halves = corners.groupBy("cluster_id", "part").applyInPandas(partial, "cluster_id int, lon double, lat double")
    return halves.join(fit, "cluster_id").groupBy("cluster_id").applyInPandas(whole, HULL)


def polygon_json(ring: str = "ring") -> Column:
    """GeoJSON polygon of a closed ring."""
    coords = F.array(F.transform(F.col(ring), lambda p: F.array(p.lon, p.lat)))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")))


def port_nodes(hulls: DataFrame, count_name: str = "stationary_points") -> DataFrame:
    """(port_id, lat, lon, area_deg2, count) for each polygon, at its centroid."""
    return hulls.select(F.col("cluster_id").alias("port_id"), "lat", "lon", "area_deg2", F.col("n_points").alias(count_name))


def waypoint_nodes(clustered: DataFrame, hulls: DataFrame) -> DataFrame:
    """Nodes with feature_points; if no cluster has a polygon, mean places with area 0 instead."""
    nodes = port_nodes(hulls, "feature_points")
    means = clustered.where("cluster_id != -1").groupBy(F.col("cluster_id").alias("port_id")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.lit(0.0).alias("area_deg2"), F.count("*").alias("feature_points"))
    none = hulls.agg(F.count("*").alias("hulls"))  # one row, so the product below has at most a row for each cluster
    return nodes.unionByName(means.crossJoin(F.broadcast(none)).where("hulls = 0").drop("hulls"))


def transitions(clustered: DataFrame, valid: DataFrame | None = None, *, keys: Sequence[str] = ("mmsi",), order: Sequence[str] = ("base_date_time", "event_seq")) -> DataFrame:
    """(mmsi, source_port, target_port) for each change of cluster along a vessel's (or a track's) points.

    Points of noise and of clusters that aren't in `valid` (port_id) are dropped before runs are collapsed, so a vessel
    that passes such a cluster goes straight to the next one.
    """
    seen = clustered.where("cluster_id != -1")
    if order[0] in seen.columns and order[0] == "base_date_time":
        seen = seen.where("base_date_time is not null")
    if valid is not None:
        seen = seen.join(valid.select(F.col("port_id").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = seen.withColumn("__before", F.lag("cluster_id").over(w)).where("__before is null or __before != cluster_id")
    return runs.withColumn("target_port", F.lead("cluster_id").over(w)).where("target_port is not null").select("mmsi", F.col("cluster_id").alias("source_port"), "target_port")


def edges(clustered: DataFrame, valid: DataFrame | None = None, **kw: Sequence[str]) -> DataFrame:
    """(source_port, target_port, transition_count, unique_vessels)."""
    return transitions(clustered, valid, **kw).groupBy("source_port", "target_port").agg(F.count("*").alias("transition_count"), F.countDistinct("mmsi").alias("unique_vessels"))


def place_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the places of both ends; an edge with an unknown end is dropped."""
    end = lambda p: nodes.select(F.col("port_id").alias(f"{p}_port"), F.col("lat").alias(f"{p}_lat"), F.col("lon").alias(f"{p}_lon"))
    return found.join(end("source"), "source_port").join(end("target"), "target_port")


def summary(nodes: DataFrame, found: DataFrame, count_name: str) -> DataFrame:
    """One row: nodes, edges, transitions, mean points of a node, most vessels of an edge, map centre (20, 0 if empty)."""
    a = nodes.agg(F.count("*").alias("n_nodes"), F.avg(count_name).alias("mean_points"), F.coalesce(F.avg("lat"), F.lit(20.0)).alias("centre_lat"), F.coalesce(F.avg("lon"), F.lit(0.0)).alias("centre_lon"))
    b = found.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("transition_count"), F.lit(0)).alias("n_transitions"), F.max("unique_vessels").alias("max_vessels"))
    return a.crossJoin(b)  # a row each

