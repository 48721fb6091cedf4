"""Whole runs: ports, waypoints and corridors of a table of reports, of one region or of all."""

from __future__ import annotations

from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.checkpoints import durable
from seaweft.functions import geometry
from seaweft.operators import corridor, features, grid, ingest, network, sampling, trajectory, tuning
from seaweft.schema import canonical
from seaweft.sources import readers, sinks


@dataclass(frozen=True)
class Region:
    """A region's polygon, cluster parameters, and the numbers of ports and waypoints that it is expected to have."""

    name: str
    rings: tuple | None = None
    ports: tuple[int | None, int | None] = (None, None)
    waypoints: tuple[int | None, int | None] = (None, None)
    trial: tuning.Trial = field(default_factory=lambda: tuning.Trial(1400, 5e-6, 4))
    min_port_points: int = 100
    gammas: tuple[float, ...] = tuning.GAMMAS
    weights: tuple[tuple[float, float], ...] = ((1.0, 1.0),)


@dataclass
class Layer:
    clustered: DataFrame
    hulls: DataFrame
    nodes: DataFrame
    edges: DataFrame


def reports_of(raw: DataFrame, region: Region | None = None, sog_max: float = ingest.SOG_MAX, max_points: int | None = None) -> DataFrame:
    """Valid reports under canonical names, inside the region if it has a polygon; event_seq breaks ties of time.

    `max_points` is for trials on a part: the first reports by vessel and time. Without it nothing is left out.
    """
    df = canonical(raw, keep_others="event_seq" in raw.columns)
    if "event_seq" not in df.columns:
        df = df.withColumn("event_seq", F.xxhash64(*df.columns))
    good = ingest.valid(ingest.drop_null_core(df), sog_max)
    good = clip(good, region.rings) if region and region.rings else good
    return good if max_points is None else sampling.first_reports(good, max_points)


def clip(df: DataFrame, rings: list) -> DataFrame:
    return df.where(geometry.within(rings, F.col("lon"), F.col("lat")))


def run_ports(points: DataFrame, trial: tuning.Trial, *, stationary_only: bool = True) -> Layer:
    """Stationary reports, clusters, polygons, nodes at their centroids, and edges between them."""
    start = ingest.stationary(points) if stationary_only else points
    clustered = durable(grid.clique(start, trial.k, trial.r, trial.neighbor_mode, trial.min_dense_points))
    hulls = durable(network.boundaries(clustered))
    nodes = network.port_nodes(hulls)
    return Layer(clustered, hulls, nodes, network.edges(clustered, nodes))


def run_waypoints(points: DataFrame, trial: tuning.Trial, gamma: float, *, max_gap: float = trajectory.MAX_GAP_MINUTES, min_points: int = trajectory.MIN_POINTS) -> Layer:
    """Tracks, feature points at gamma, clusters of these, polygons, nodes, and edges along tracks."""
    tol = trajectory.with_tolerance(trajectory.tracks(ingest.track_input(points), max_gap, min_points))
    clustered = durable(grid.clique(durable(trajectory.feature_points(tol, gamma)), trial.k, trial.r, trial.neighbor_mode, trial.min_dense_points))
    hulls = durable(network.boundaries(clustered))
    nodes = network.waypoint_nodes(clustered, hulls)
    return Layer(clustered, hulls, nodes, network.edges(clustered, nodes, keys=("mmsi", "trajectory_id"), order=("feature_order",)))


def run_corridors(points: DataFrame, layer: Layer, *, m: int = 15, radius: float = 0.05, strip: float = 2.0, band: float = 3.0) -> DataFrame:
    return corridor.routes(corridor.fit_slices(points, layer.nodes, layer.edges, m=m, radius=radius, strip=strip, band=band))


def tune_ports(points: DataFrame, region: Region, wanted: list[tuning.Trial] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Scores of the trials that have none yet, and the scores that there were (of repeated ones the last by `attempt`)."""
    todo = wanted or tuning.trials()
    if done is not None:
        keys = points.sparkSession.createDataFrame([(i, *astuple(t)) for i, t in enumerate(todo)], "place int, k int, r double, neighbor_mode int, min_dense_points int")
        todo = [todo[r.place] for r in tuning.pending(keys, done).orderBy("place").select("place").collect()]  # given trials only
        done = tuning.latest(done, "attempt") if "attempt" in done.columns else done
    new = tuning.sweep_ports(ingest.stationary(points), todo, min_port_points=region.min_port_points, low=region.ports[0], high=region.ports[1])
    return new if done is None else done.unionByName(new, allowMissingColumns=True)


def tune_waypoints(points: DataFrame, region: Region) -> DataFrame:
    """Scores of the region's gammas and weights."""
    tol = trajectory.with_tolerance(trajectory.tracks(ingest.track_input(points)))
    return tuning.sweep_waypoints(tol, region.gammas, region.trial, weights=region.weights, low=region.waypoints[0], high=region.waypoints[1])


def read_layer(spark: SparkSession, folder: str) -> Layer:
    """The nodes and edges that `export` wrote in a folder, for corridors of ports or waypoints of an earlier run."""
    nodes = readers.table_csv(spark, f"{folder}/nodes", "port_id int, lat double, lon double, area_deg2 double, n bigint")
    edges = readers.table_csv(spark, f"{folder}/edges", "source_port int, target_port int, transition_count bigint, unique_vessels bigint")
    none = spark.createDataFrame([], network.HULL)
    return Layer(none.select("cluster_id"), none, nodes, edges)


def daily_job(spark: SparkSession, glob: str, to: str, max_files: int | None = None, sog_max: float = ingest.SOG_MAX) -> DataFrame:
    """Features of each daily file in `to`/processed_<file>, and a summary (file, rows_in, rows_out, columns, vessels).

    The loop is over files, which are jobs of their own; `max_files` takes the first by name. The summary is written to
    `to`/processing_summary.
    """
    rows = []
    for path in readers.files(spark, glob, max_files):
        raw = readers.daily_csv(spark, path)
        name = path.rsplit("/", 1)[-1].split(".")[0]
        out = f"{to.rstrip('/')}/processed_{name}"
        features.engineer(ingest.first_report(ingest.valid_features(reports_of(raw, sog_max=sog_max)))).write.mode("overwrite").parquet(out)
        made = spark.read.parquet(out)
        n, vessels = made.agg(F.count("*"), F.countDistinct("mmsi")).first()
        rows.append((name, raw.count(), n, len(made.columns), vessels))
    summary = spark.createDataFrame(rows, "file string, rows_in bigint, rows_out bigint, columns int, vessels bigint")
    sinks.single_csv(summary, f"{to.rstrip('/')}/processing_summary")
    return summary


def network_features(run_id: str, **layers: DataFrame) -> DataFrame:
    """(run_id, layer, geometry, properties): nodes, edges and routes of a run as GeoJSON features of one table."""
    out = None
    for name, df in layers.items():
        if "line" in df.columns:
            shape = sinks.line_json("line")
        elif "source_lat" in df.columns:
            ends = F.array(F.array("source_lon", "source_lat"), F.array("target_lon", "target_lat"))
            shape = F.to_json(F.struct(F.lit("LineString").alias("type"), ends.alias("coordinates")))
        else:
            shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
        others = [c for c in df.columns if c not in ("line", "corridor", "ring")]
        one = df.select(F.lit(run_id).alias("run_id"), F.lit(name).alias("layer"), shape.alias("geometry"), F.to_json(F.struct(*others)).alias("properties"))
        out = one if out is None else out.unionByName(one)
    return out


def export(layer: Layer, folder: str, routes: DataFrame | None = None) -> None:
    """nodes, edges (CSV) and boundaries (GeoJSON) in a folder; routes and corridors if given."""
    sinks.single_csv(layer.nodes, f"{folder}/nodes")
    sinks.single_csv(layer.edges, f"{folder}/edges")
    sinks.text_file(sinks.boundaries_geojson(layer.hulls), f"{folder}/boundaries")
    if routes is not None:  # hulls of a layer that was read are empty
        sinks.text_file(sinks.routes_geojson(routes), f"{folder}/rlsn_routes")
        sinks.text_file(sinks.corridors_geojson(routes), f"{folder}/rlsn_boundaries")
