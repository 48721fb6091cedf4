"""Queries of ingest, clustering, networks, tracks, corridors, voyages and sweeps, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.checkpoints import durable, shared_dir
from seaweft.functions import geometry
from seaweft.operators import corridor, grid, ingest, network, sampling, trajectory, tuning, voyage
from seaweft.plans import sql
from seaweft.plans.fixture import AIS, ais
from seaweft.plans.registry import query
from seaweft.sources import readers, sinks

K, R, MODE = 200, 1e-3, 8
LAB = sql.STILL + sql.clique("st", K, R, MODE)
HULL = LAB + sql.hull("lab")
PORT_MOVES = HULL + sql.moves("(SELECT * FROM lab WHERE cluster_id IN (SELECT cluster_id FROM hull))")
TRACKS = sql.VALID + sql.tracks()
TOL = TRACKS + sql.TOLERANCE
GAMMA, GAMMAS = 0.05, (0.01, 0.05, 0.5)
FEAT = TOL + f", ft AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY point_order) - 1 AS feature_order FROM tol WHERE tolerance > {GAMMA!r}::DOUBLE)"
#: A five-sided test region around two of the ports, and a triangle with a port's grid points on its edge.
REGION = [[[-102.0, 18.0], [-75.0, 18.0], [-75.0, 33.0], [-88.0, 40.0], [-102.0, 33.0], [-102.0, 18.0]]]
SQUARE = [[[-100.0, 20.0], [-99.0, 20.0], [-99.0, 21.0], [-100.0, 21.0], [-100.0, 20.0]]]
b64 = lambda c: F.col(c).cast("bigint").alias(c)


def valid(s: SparkSession, d: str) -> DataFrame:
    return ingest.valid(ais(s, d))


def still(s: SparkSession, d: str) -> DataFrame:
    return ingest.stationary(valid(s, d))


def ports(s: SparkSession, d: str) -> DataFrame:
    """The reports with their clusters, checkpointed: polygons, nodes and edges all begin here."""
    return durable(grid.clique(still(s, d), K, R, MODE))


def tol(s: SparkSession, d: str) -> DataFrame:
    return trajectory.with_tolerance(trajectory.tracks(valid(s, d)))


def _long(df: DataFrame) -> DataFrame:
    """Integers as bigint, for a stable schema."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- flagship

@query("m0_port_edges", LAB + sql.moves("(SELECT * FROM lab WHERE cluster_id <> -1)") + " " + sql.EDGES.format(mv="mv"))
def _(s, d):
    return _long(network.edges(ports(s, d)))


# ---------------------------------------------------------------- sources, projections, filters

_DAYS = "SELECT CAST(date_trunc('day', base_date_time) AS DATE) AS day, navstatus::BIGINT AS navstatus, count(*) AS n FROM {t} GROUP BY ALL"


@query("src2_build_parquet", sql.VALID + " " + _DAYS.format(t="valid"))
def _(s, d):
    base = f"{shared_dir(s).rstrip('/')}/etl-{uuid.uuid4().hex}"
    raw = {"MMSI": "mmsi", "BaseDateTime": "base_date_time", "LAT": "lat", "LON": "lon", "SOG": "sog", "COG": "cog", "Status": "navstatus"}
    ais(s, d).select(*(F.col(c).cast("string").alias(n) for n, c in raw.items())).write.option("header", True).csv(f"{base}/csv")
    readers.build_parquet(s, f"{base}/csv/*.csv", f"{base}/std")
    return _long(readers.reports(s, f"{base}/std").groupBy(F.to_date("base_date_time").alias("day"), "navstatus").agg(F.count("*").alias("n")))


@query("snk1_partitioned_by_day", sql.STILL + " " + _DAYS.format(t="st"))
def _(s, d):
    path = f"{shared_dir(s).rstrip('/')}/days-{uuid.uuid4().hex}"
    sinks.by_day(still(s, d), path)
    return _long(s.read.parquet(path).groupBy("day", "navstatus").agg(F.count("*").alias("n")))


@query("prj2_coerce", "SELECT event_type, count(TRY_CAST(event_type AS BIGINT)) AS n_number, count(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS n_value, count(TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP)) AS n_time FROM events GROUP BY 1")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    text = e.select("event_type", F.col("value").cast("string").alias("v"), F.col("ts").cast("string").alias("t"))
    return text.groupBy("event_type").agg(F.count(F.col("event_type").try_cast("bigint")).alias("n_number"), F.count(F.col("v").try_cast("double")).alias("n_value"), F.count(F.col("t").try_cast("timestamp_ntz")).alias("n_time"))


@query("prj4_resolve_columns", AIS + " SELECT count(*) AS n, count(DISTINCT mmsi) AS vessels, round(sum(sog), 3) AS sum_sog, sum(navstatus)::BIGINT AS sum_status FROM ais")
def _(s, d):
    from seaweft.schema import canonical
    odd = ais(s, d).withColumnsRenamed({"mmsi": "MMSI", "base_date_time": "BaseDateTime", "lat": "Latitude", "lon": "Longitude", "sog": "Speed Over Ground", "cog": "COG", "navstatus": "Navigation Status"})
    c = canonical(odd)
    return c.agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"), F.round(F.sum("sog"), 3).alias("sum_sog"), F.sum("navstatus").alias("sum_status"))


@query("flt1_null_core", "SELECT count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS b FROM events) WHERE a IS NOT NULL AND b IS NOT NULL")
def _(s, d):
    a = ais(s, d).withColumn("mmsi", F.when(F.col("event_seq") % 7 != 0, F.col("mmsi"))).withColumn("sog", F.when(F.col("event_seq") % 5 != 0, F.col("sog")))
    return ingest.drop_null_core(a).agg(F.count("*").alias("n"))


@query("flt2_validity", sql.VALID + " SELECT navstatus::BIGINT AS navstatus, count(*) AS n, round(sum(lat), 3) AS sum_lat FROM valid GROUP BY 1")
def _(s, d):
    return _long(valid(s, d).groupBy("navstatus").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("sum_lat")))


@query("flt3_drop_report", AIS + """ SELECT count(*) AS rows_in, count(*) FILTER (lat BETWEEN -90 AND 90 AND sog BETWEEN 0 AND 15) AS rows_out, 0::BIGINT AS dropped_null_core,
    count(*) FILTER (NOT lat BETWEEN -90 AND 90) AS dropped_invalid_geo, 0::BIGINT AS dropped_invalid_nav, count(*) FILTER (NOT sog BETWEEN 0 AND 15) AS dropped_invalid_sog, 0::BIGINT AS dropped_invalid_cog FROM ais""")
def _(s, d):
    return ingest.drop_report(ais(s, d), sog_max=15.0)


@query("flt4_feature_validity", AIS + " SELECT count(*) AS n FROM ais WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND sog BETWEEN 0 AND 100 AND cog BETWEEN 0 AND 360")
def _(s, d):
    return ingest.valid_features(ais(s, d)).agg(F.count("*").alias("n"))


@query("flt5_stationary", sql.STILL + " SELECT mmsi, count(*) AS n, min(sog) AS min_sog, max(sog) AS max_sog FROM st GROUP BY 1")
def _(s, d):
    return still(s, d).groupBy("mmsi").agg(F.count("*").alias("n"), F.min("sog").alias("min_sog"), F.max("sog").alias("max_sog"))


@query("flt6_stationary_sql", sql.STILL + " SELECT navstatus::BIGINT AS navstatus, count(*) AS n FROM st GROUP BY 1")
def _(s, d):
    return _long(s.sql("SELECT navstatus, count(*) AS n FROM {v} WHERE navstatus IN (1, 5) AND sog < 0.5D AND mmsi IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 GROUP BY 1", v=valid(s, d)))


@query("flt7_track_input", AIS + " SELECT count(*) AS n FROM ais WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def _(s, d):
    return ingest.track_input(ais(s, d)).agg(F.count("*").alias("n"))


@query("flt8_bounding_box", sql.VALID + " SELECT count(*) AS n, min(lon) AS min_lon, max(lat) AS max_lat FROM valid WHERE lon BETWEEN -100 AND -80 AND lat BETWEEN 20 AND 35")
def _(s, d):
    return ingest.in_box(valid(s, d), -100, 20, -80, 35).agg(F.count("*").alias("n"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"))


@query("flt11_anchored_moored", sql.VALID + " SELECT count(*) FILTER (navstatus = 1 AND sog < 0.5E0) AS anchored, count(*) FILTER (navstatus = 5 AND sog < 0.5E0) AS moored FROM valid")
def _(s, d):
    return ingest.stationary_report(valid(s, d))


# ---------------------------------------------------------------- joins and regions

@query("jn2_first_vessels", sql.VALID + ", f AS (SELECT DISTINCT mmsi FROM valid ORDER BY 1 LIMIT 20) SELECT mmsi, count(*) AS n FROM valid JOIN f USING (mmsi) GROUP BY 1")
def _(s, d):
    return sampling.first_vessels(valid(s, d), 20).groupBy("mmsi").agg(F.count("*").alias("n"))


@query("jn3_semi_join", HULL + " SELECT cluster_id, count(*) AS n FROM lab WHERE cluster_id IN (SELECT cluster_id FROM hull WHERE n_points >= 590) GROUP BY 1")
def _(s, d):
    p = ports(s, d)
    return _long(p.join(network.boundaries(p).where("n_points >= 590").select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n")))


def _edges_sql(rings):
    return "(VALUES " + ", ".join(f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for r in rings for a, b in zip(r, r[1:])) + ") AS e(x1, y1, x2, y2)"


def _clip_sql(rings, boundary):
    edge = "max(CASE WHEN (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) = 0 AND lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END)"
    ray = "sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2"
    keep = f"({ray} = 1 OR {edge} = 1)" if boundary else f"{ray} = 1 AND {edge} = 0"
    return sql.VALID + f", hit AS (SELECT event_seq, any_value(mmsi) AS mmsi FROM valid, {_edges_sql(rings)} GROUP BY event_seq HAVING {keep}) SELECT mmsi, count(*) AS n FROM hit GROUP BY 1"


@query("jn4_within_region", _clip_sql(REGION, False))
def _(s, d):
    return valid(s, d).where(geometry.within(REGION, F.col("lon"), F.col("lat"))).groupBy("mmsi").agg(F.count("*").alias("n"))


@query("jn5_intersects_region", _clip_sql(SQUARE, True))
def _(s, d):
    return valid(s, d).where(geometry.intersects(SQUARE, F.col("lon"), F.col("lat"))).groupBy("mmsi").agg(F.count("*").alias("n"))


@query("jn8_edge_places", PORT_MOVES + ", ed AS (" + sql.EDGES.format(mv="mv") + """) SELECT source_port, target_port, transition_count, round(a.lat, 6) AS source_lat, round(a.lon, 6) AS source_lon, round(b.lat, 6) AS target_lat, round(b.lon, 6) AS target_lon
    FROM ed JOIN hull a ON source_port = a.cluster_id JOIN hull b ON target_port = b.cluster_id""")
def _(s, d):
    p = ports(s, d)
    nodes = network.port_nodes(network.boundaries(p))
    e = network.place_edges(network.edges(p, nodes), nodes)
    return _long(e.select("source_port", "target_port", "transition_count", *(F.round(c, 6).alias(c) for c in ("source_lat", "source_lon", "target_lat", "target_lon"))))


# ---------------------------------------------------------------- clustering

@query("agg1_bounds", sql.STILL + " SELECT min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max, count(*) AS n FROM st")
def _(s, d):
    return still(s, d).agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.count("*").alias("n"))


@query("agg2_cell_counts", LAB + " SELECT cx::BIGINT AS clique_x, cy::BIGINT AS clique_y, count(*) AS n FROM lab GROUP BY ALL")
def _(s, d):
    st = still(s, d)
    return _long(grid.with_cells(st, grid.bounds(st), K).groupBy("clique_x", "clique_y").agg(F.count("*").alias("n")))


@query("alg2_clique", LAB + " SELECT event_seq, cx::BIGINT AS clique_x, cy::BIGINT AS clique_y, cluster_id::BIGINT AS cluster_id FROM lab")
def _(s, d):
    return _long(ports(s, d).select("event_seq", "clique_x", "clique_y", "cluster_id"))


@query("alg2_clique_four_neighbours", sql.STILL + sql.clique("st", 1400, 2e-3, 4) + " SELECT cluster_id::BIGINT AS cluster_id, count(*) AS n, count(DISTINCT (cx, cy)) AS cells FROM lab GROUP BY 1")
def _(s, d):
    p = grid.clique(still(s, d), 1400, 2e-3, 4)
    return _long(p.groupBy("cluster_id").agg(F.count("*").alias("n"), F.countDistinct("clique_x", "clique_y").alias("cells")))


@query("alg2_clique_distributed", LAB + " SELECT cluster_id::BIGINT AS cluster_id, min(cx)::BIGINT AS x, min(cy)::BIGINT AS y, count(DISTINCT (cx, cy)) AS cells FROM lab WHERE cluster_id <> -1 GROUP BY 1")
def _(s, d):
    st = still(s, d)
    b = grid.bounds(st)
    dense = grid.with_cells(st, b, K).groupBy("clique_x", "clique_y").count().where(F.col("count") >= grid.threshold(b.n, R))
    return _long(grid.cluster_cells(dense, K, MODE, task_cells=0).groupBy("cluster_id").agg(F.min("clique_x").alias("x"), F.min("clique_y").alias("y"), F.count("*").alias("cells")))


@query("alg3_grid_density", sql.STILL + sql.clique("st", 720, 0.0, 8, least=10) + " SELECT cluster_id::BIGINT AS cluster_id, count(*) AS n FROM lab GROUP BY 1")
def _(s, d):
    return _long(grid.grid_density(still(s, d), 0.5, 10).groupBy("cluster_id").agg(F.count("*").alias("n")))


@query("alg16_dense_units_1d", sql.STILL + " SELECT floor(lon / 5E0)::BIGINT AS unit, count(*) AS n FROM st GROUP BY 1 HAVING count(*) >= 0.15E0 * (SELECT count(*) FROM st)")
def _(s, d):
    return grid.dense_units_1d(still(s, d), "lon", 5.0)


@query("agg4_cluster_sizes", LAB + """, z AS (SELECT cluster_id, count(*) AS n FROM lab WHERE cluster_id <> -1 GROUP BY 1)
    SELECT count(*) AS clusters, max(n) AS largest, round(avg(n), 6) AS mean_size, median(n)::DOUBLE AS median_size, count(*) FILTER (n >= 590) AS large FROM z""")
def _(s, d):
    z = ports(s, d).where("cluster_id != -1").groupBy("cluster_id").agg(F.count("*").alias("n"))
    return z.agg(F.count("*").alias("clusters"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.median("n").alias("median_size"), F.count_if(F.col("n") >= 590).alias("large"))


@query("agg19_distinct_places", LAB + " SELECT cluster_id::BIGINT AS cluster_id, count(DISTINCT (lon, lat)) AS places, count(DISTINCT lon) AS lons, count(DISTINCT mmsi) AS vessels FROM lab GROUP BY 1")
def _(s, d):
    return _long(ports(s, d).groupBy("cluster_id").agg(F.countDistinct("lon", "lat").alias("places"), F.countDistinct("lon").alias("lons"), F.countDistinct("mmsi").alias("vessels")))


# ---------------------------------------------------------------- polygons and networks

@query("alg4_boundaries", HULL + " SELECT cluster_id::BIGINT AS cluster_id, n_points::BIGINT AS n_points, round(area_deg2, 6) AS area_deg2, round(lon, 6) AS lon, round(lat, 6) AS lat FROM hull")
def _(s, d):
    h = network.boundaries(ports(s, d))
    return _long(h.select("cluster_id", "n_points", *(F.round(c, 6).alias(c) for c in ("area_deg2", "lon", "lat"))))


@query("snk4_boundaries_geojson", HULL + " SELECT (SELECT count(*) FROM hull)::BIGINT AS features, 'FeatureCollection' AS kind")
def _(s, d):
    v = sinks.boundaries_geojson(network.boundaries(ports(s, d)))
    parsed = F.from_json("value", "type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>")
    closed = F.size(F.filter(parsed.features, lambda f: F.element_at(f.geometry.coordinates[0], 1) == F.element_at(f.geometry.coordinates[0], -1)))
    return v.select(closed.cast("bigint").alias("features"), parsed["type"].alias("kind"))


@query("plsn_nodes", HULL + " SELECT cluster_id::BIGINT AS port_id, n_points::BIGINT AS stationary_points, round(lat, 6) AS lat, round(lon, 6) AS lon, round(area_deg2, 6) AS area_deg2 FROM hull")
def _(s, d):
    n = network.port_nodes(network.boundaries(ports(s, d)))
    return _long(n.select("port_id", "stationary_points", *(F.round(c, 6).alias(c) for c in ("lat", "lon", "area_deg2"))))


@query("agg3_plsn_edges", PORT_MOVES + " " + sql.EDGES.format(mv="mv"))
def _(s, d):
    p = ports(s, d)
    return _long(network.edges(p, network.port_nodes(network.boundaries(p))))


@query("agg17_network_summary", PORT_MOVES + ", ed AS (" + sql.EDGES.format(mv="mv") + """) SELECT (SELECT count(*) FROM hull) AS n_nodes, (SELECT round(avg(n_points), 6) FROM hull) AS mean_points, round((SELECT avg(lat) FROM hull), 6) AS centre_lat,
    round((SELECT avg(lon) FROM hull), 6) AS centre_lon, count(*) AS n_edges, sum(transition_count)::BIGINT AS n_transitions, max(unique_vessels) AS max_vessels FROM ed""")
def _(s, d):
    p = ports(s, d)
    nodes = network.port_nodes(network.boundaries(p))
    return network.summary(nodes, network.edges(p, nodes), "stationary_points").select("n_nodes", *(F.round(c, 6).alias(c) for c in ("mean_points", "centre_lat", "centre_lon")), "n_edges", "n_transitions", "max_vessels")


@query("agg5_fallback_centroids", LAB + " SELECT cluster_id::BIGINT AS port_id, count(*) AS feature_points, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, 0E0 AS area_deg2 FROM lab WHERE cluster_id <> -1 GROUP BY 1")
def _(s, d):
    p = ports(s, d)
    return _long(network.waypoint_nodes(p, network.boundaries(p).limit(0)).select("port_id", "feature_points", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "area_deg2"))


@query("win4_run_collapse", LAB + sql.moves("(SELECT * FROM lab WHERE cluster_id <> -1)") + " SELECT mmsi, count(*) AS runs FROM r GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    return ports(s, d).where("cluster_id != -1").withColumn("b", F.lag("cluster_id").over(w)).where("b is null or b != cluster_id").groupBy("mmsi").agg(F.count("*").alias("runs"))


@query("win5_next_port", LAB + sql.moves("(SELECT * FROM lab WHERE cluster_id <> -1)") + " SELECT mmsi, source_port::BIGINT AS source_port, target_port::BIGINT AS target_port, count(*) AS n FROM mv GROUP BY ALL")
def _(s, d):
    return _long(network.transitions(ports(s, d)).groupBy("mmsi", "source_port", "target_port").agg(F.count("*").alias("n")))


@query("win10_ranked_nodes", HULL + """, k AS (SELECT cluster_id::BIGINT AS port_id, n_points, row_number() OVER (ORDER BY n_points DESC, cluster_id) AS rank, count(*) OVER () AS total, max(n_points) OVER () AS most FROM hull)
    SELECT port_id, rank, CASE WHEN (rank - 1) / total::DOUBLE < 0.1 THEN '#ef4444' WHEN (rank - 1) / total::DOUBLE < 0.4 THEN '#f59e0b' ELSE '#22c55e' END AS colour, round(5E0 + 17E0 * sqrt(n_points::DOUBLE / most), 6) AS radius FROM k""")
def _(s, d):
    n = sinks.ranked_nodes(network.port_nodes(network.boundaries(ports(s, d))), "stationary_points")
    return _long(n.select("port_id", "rank", "colour", F.round("radius", 6).alias("radius")))


# ---------------------------------------------------------------- tracks

@query("win1_gap_minutes", TRACKS + " SELECT event_seq, round(gap_minutes, 3) AS gap_minutes FROM g0")
def _(s, d):
    return trajectory.with_gaps(valid(s, d)).select("event_seq", F.round("gap_minutes", 3).alias("gap_minutes"))


@query("win2_gap_sessions", TRACKS + " SELECT event_seq, trajectory_id, point_order FROM g2")
def _(s, d):
    return _long(trajectory.with_tracks(valid(s, d)).select("event_seq", "trajectory_id", "point_order"))


@query("win2_session_window_check", TRACKS + " SELECT mmsi, count(DISTINCT track_seq) AS n_tracks FROM g1 GROUP BY 1")
def _(s, d):
    sessions = valid(s, d).groupBy("mmsi", F.session_window(F.col("base_date_time").cast("timestamp"), "720 minutes").alias("w")).agg(F.count("*").alias("n"))
    return sessions.groupBy("mmsi").agg(F.count("*").alias("n_tracks"))


@query("alg14_tracks", TRACKS + " SELECT trajectory_id, mmsi, count(*) AS n, round(min(lon), 6) AS min_lon, round(max(lat), 6) AS max_lat FROM trk GROUP BY ALL")
def _(s, d):
    return trajectory.tracks(valid(s, d)).groupBy("trajectory_id", "mmsi").agg(F.count("*").alias("n"), F.round(F.min("lon"), 6).alias("min_lon"), F.round(F.max("lat"), 6).alias("max_lat"))


_LEN = "SELECT {k}, count(*) AS n, coalesce(sum(sqrt(pow(lon - plon, 2) + pow(lat - plat, 2))), 0) AS length FROM (SELECT *, lag(lon) OVER (PARTITION BY {k} ORDER BY point_order) AS plon, lag(lat) OVER (PARTITION BY {k} ORDER BY point_order) AS plat FROM {t}) GROUP BY {k}"


@query("agg15_track_length", TRACKS + " SELECT trajectory_id, n, round(length, 6) AS length FROM (" + _LEN.format(k="trajectory_id", t="trk") + ")")
def _(s, d):
    return trajectory.lengths(trajectory.tracks(valid(s, d)), ["trajectory_id"]).select("trajectory_id", "n", F.round("length", 6).alias("length"))


@query("alg5_tolerances", TOL + " SELECT event_seq, trajectory_id, CASE WHEN isinf(tolerance) THEN -1 ELSE round(tolerance, 6) END AS tolerance FROM tol")
def _(s, d):
    inf = F.col("tolerance") == F.lit(float("inf"))
    return tol(s, d).select("event_seq", "trajectory_id", F.when(inf, -1.0).otherwise(F.round("tolerance", 6)).alias("tolerance"))


@query("alg5_feature_points", FEAT + " SELECT event_seq, trajectory_id, feature_order FROM ft")
def _(s, d):
    return _long(trajectory.feature_points(tol(s, d), GAMMA).select("event_seq", "trajectory_id", "feature_order"))


_M = TOL + ", gm AS (SELECT unnest([" + ", ".join(f"{g!r}::DOUBLE" for g in GAMMAS) + "]) AS gamma), fg AS (SELECT gamma, tol.* FROM tol, gm WHERE tolerance > gamma), a AS (" + _LEN.format(k="trajectory_id, gamma", t="fg") + "), o AS (" + _LEN.format(k="trajectory_id", t="tol") + """),
    m AS (SELECT trajectory_id, gamma, a.n AS compressed_points, o.n AS original_points, 1 - a.n / o.n::DOUBLE AS dr, CASE WHEN o.length <= 1E-12 THEN 1E0 ELSE least(greatest(1 - abs(a.length - o.length) / (o.length + 1E-12), 0), 1) END AS dl FROM a JOIN o USING (trajectory_id))"""


@query("alg6_ld_metrics", _M + " SELECT trajectory_id, gamma, original_points, compressed_points, round(dr, 6) AS compression_rate_dr, round(dl, 6) AS distance_similarity_dl, round(dr + dl, 6) AS ld_score FROM m")
def _(s, d):
    m = trajectory.metrics(tol(s, d), GAMMAS)
    return m.select("trajectory_id", "gamma", "original_points", "compressed_points", *(F.round(c, 6).alias(c) for c in ("compression_rate_dr", "distance_similarity_dl", "ld_score")))


@query("alg7_best_gamma", _M + " SELECT gamma, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY round(dr + dl, 9) DESC, compressed_points, gamma) AS rn FROM m) WHERE rn = 1 GROUP BY 1")
def _(s, d):
    m = trajectory.metrics(tol(s, d), GAMMAS).withColumn("ld_score", F.round("ld_score", 9))
    return trajectory.best_gamma(m, GAMMAS).groupBy("gamma").agg(F.count("*").alias("n"))


@query("alg8_descend_gamma", _M.replace("[" + ", ".join(f"{g!r}::DOUBLE" for g in GAMMAS) + "]", "[" + ", ".join(f"{0.5 - 0.1 * i!r}::DOUBLE" for i in range(5)) + "]") + """, x AS (SELECT *, coalesce(dr + dl >= lag(dr + dl) OVER (PARTITION BY trajectory_id ORDER BY gamma DESC), true) AS rose FROM m),
    y AS (SELECT *, bool_and(rose) OVER (PARTITION BY trajectory_id ORDER BY gamma DESC ROWS UNBOUNDED PRECEDING) AS still FROM x) SELECT trajectory_id, round(min(gamma), 6) AS gamma FROM y WHERE still GROUP BY 1""")
def _(s, d):
    return trajectory.descend_gamma(tol(s, d), 0.5, 0.1, least=0.05).select("trajectory_id", F.round("gamma", 6).alias("gamma"))


_NL = FEAT + sql.clique("ft", 100, 2e-3, 8, "n") + sql.hull("nlab", "n") + sql.moves("(SELECT * FROM nlab WHERE cluster_id IN (SELECT cluster_id FROM nhull))", "mmsi, trajectory_id", "feature_order", "n")


def waypoints(s: SparkSession, d: str) -> DataFrame:
    return grid.clique(durable(trajectory.feature_points(tol(s, d), GAMMA)), 100, 2e-3, 8)


@query("nlsn_nodes", _NL + " SELECT cluster_id::BIGINT AS port_id, n_points::BIGINT AS feature_points, round(lat, 6) AS lat, round(lon, 6) AS lon, round(area_deg2, 6) AS area_deg2 FROM nhull")
def _(s, d):
    c = waypoints(s, d)
    return _long(network.waypoint_nodes(c, network.boundaries(c)).select("port_id", "feature_points", *(F.round(x, 6).alias(x) for x in ("lat", "lon", "area_deg2"))))


@query("nlsn_edges", _NL + " " + sql.EDGES.format(mv="nmv"))
def _(s, d):
    c = waypoints(s, d)
    return _long(network.edges(c, network.waypoint_nodes(c, network.boundaries(c)), keys=("mmsi", "trajectory_id"), order=("feature_order",)))


_V = sql.VALID + """, trk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq) - 1 AS point_order, count(*) OVER (PARTITION BY mmsi) AS n_track, CAST(mmsi AS VARCHAR) AS trajectory_id FROM valid)""" + sql.TOLERANCE


@query("alg15_whole_vessel_tracks", _V + " SELECT mmsi, count(*) AS n FROM tol WHERE tolerance > 0.001E0 GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    whole = valid(s, d).withColumn("trajectory_id", F.col("mmsi").cast("string")).withColumn("point_order", F.row_number().over(w) - 1)
    return trajectory.feature_points(trajectory.with_tolerance(whole), 0.001).groupBy("mmsi").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- corridors and voyages

def _corridor_sql(m, radius, strip):
    return PORT_MOVES + ", ed AS (" + sql.EDGES.format(mv="mv") + f"""), g AS (SELECT source_port AS source, target_port AS target, a.lon AS sx, a.lat AS sy, b.lon - a.lon AS dx, b.lat - a.lat AS dy, sqrt(pow(b.lon - a.lon, 2) + pow(b.lat - a.lat, 2)) AS length
        FROM ed JOIN hull a ON source_port = a.cluster_id JOIN hull b ON target_port = b.cluster_id),
    sl AS (SELECT g.*, i AS slice, dx / length AS vx, dy / length AS vy, sx + i / {m + 1}E0 * dx AS cx, sy + i / {m + 1}E0 * dy AS cy FROM g, unnest(range(1, {m + 1})) u(i) WHERE length >= 1E-7),
    nr AS (SELECT source, target, slice, length, (lon - cx) * vx + (lat - cy) * vy AS along, (lat - cy) * vx - (lon - cx) * vy AS across, cx, cy, vx, vy FROM sl JOIN valid ON lon BETWEEN cx - {radius}E0 AND cx + {radius}E0 AND lat BETWEEN cy - {radius}E0 AND cy + {radius}E0),
    ft AS (SELECT source, target, slice, any_value(cx) AS cx, any_value(cy) AS cy, any_value(vx) AS vx, any_value(vy) AS vy, count(*) AS n_square, count(*) FILTER (abs(along) < length / {strip * m}E0) AS n_strip,
        avg(across) FILTER (abs(along) < length / {strip * m}E0) AS mu, stddev_pop(across) FILTER (abs(along) < length / {strip * m}E0) AS sigma FROM nr GROUP BY ALL
        HAVING count(*) >= 10 AND count(*) FILTER (abs(along) < length / {strip * m}E0) >= 5)"""


_FIT = " SELECT source::BIGINT AS source, target::BIGINT AS target, slice::BIGINT AS slice, n_square, n_strip, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM ft"


def _fitted(s, d, **kw):
    p = ports(s, d)
    nodes = network.port_nodes(network.boundaries(p))
    return corridor.fit_slices(valid(s, d), nodes, network.edges(p, nodes), **kw)


@query("alg9_corridor_slices", _corridor_sql(10, 1.0, 2.0) + _FIT)
def _(s, d):
    return _long(_fitted(s, d, m=10, radius=1.0).select("source", "target", "slice", "n_square", "n_strip", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma")))


@query("alg9_corridor_wide_strip", _corridor_sql(15, 0.5, 1.5) + _FIT)
def _(s, d):
    return _long(_fitted(s, d, m=15, radius=0.5, strip=1.5).select("source", "target", "slice", "n_square", "n_strip", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma")))


@query("alg9_routes", _corridor_sql(10, 1.0, 2.0) + """ SELECT source::BIGINT AS source, target::BIGINT AS target, count(*) AS n_slices, 2 * count(*) + 1 AS ring_points,
    round(sum(cx - vy * mu), 4) AS sum_lon, round(sum(cy + vx * mu), 4) AS sum_lat FROM ft GROUP BY ALL""")
def _(s, d):
    r = corridor.routes(_fitted(s, d, m=10, radius=1.0))
    total = lambda c: F.round(F.aggregate(F.transform("line", lambda p: p[c]), F.lit(0.0), lambda a, x: a + x), 4)
    return _long(r.select("source", "target", "n_slices", F.size("corridor").alias("ring_points"), total("lon").alias("sum_lon"), total("lat").alias("sum_lat")))


@query("agg14_gaussian_fit", sql.VALID + " SELECT mmsi, round(avg(sog), 6) AS mu, round(stddev_pop(sog), 6) AS sigma FROM valid GROUP BY 1")
def _(s, d):
    return valid(s, d).groupBy("mmsi").agg(F.round(F.avg("sog"), 6).alias("mu"), F.round(F.stddev_pop("sog"), 6).alias("sigma"))


_PORTS = """, po AS (SELECT row_number() OVER (ORDER BY cluster_id) AS ordinal, cluster_id AS port, lon AS px, lat AS py FROM hull),
    lb AS (SELECT v.*, coalesce((SELECT arg_max(port, ordinal) FROM po WHERE sqrt(pow(v.lon - px, 2) + pow(v.lat - py, 2)) < 0.3E0), -1) AS port FROM valid v),
    i0 AS (SELECT *, lag(port) OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq) AS pp FROM lb),
    i1 AS (SELECT *, sum(CASE WHEN pp IS NULL OR pp <> port THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq ROWS UNBOUNDED PRECEDING) AS island FROM i0),
    i2 AS (SELECT mmsi, island, any_value(port) AS port, count(*) AS n_points, sum(lon) AS lon FROM i1 GROUP BY ALL),
    i3 AS (SELECT *, lag(port) OVER (PARTITION BY mmsi ORDER BY island) AS src_port, lead(port) OVER (PARTITION BY mmsi ORDER BY island) AS dst_port FROM i2)"""


def _labelled(s, d):
    from pyspark.sql import Window
    nodes = network.port_nodes(network.boundaries(ports(s, d))).withColumn("ordinal", F.row_number().over(Window.orderBy("port_id")))
    return voyage.label_ports(valid(s, d), nodes, 0.3)


@query("jn7_port_labels", HULL + _PORTS + " SELECT port::BIGINT AS port, count(*) AS n FROM lb GROUP BY 1")
def _(s, d):
    return _long(_labelled(s, d).groupBy("port").agg(F.count("*").alias("n")))


@query("win6_islands", HULL + _PORTS + " SELECT mmsi, max(island)::BIGINT AS islands FROM i1 GROUP BY 1")
def _(s, d):
    return voyage.islands(_labelled(s, d)).groupBy("mmsi").agg(F.max("island").alias("islands"))


@query("alg10_voyages", HULL + _PORTS + " SELECT mmsi, src_port::BIGINT AS src_port, dst_port::BIGINT AS dst_port, island::BIGINT AS island, n_points, round(lon, 4) AS sum_lon FROM i3 WHERE port = -1 AND src_port <> dst_port AND src_port <> -1 AND dst_port <> -1 AND n_points >= 2")
def _(s, d):
    v = voyage.voyages(_labelled(s, d))
    return _long(v.select("mmsi", "src_port", "dst_port", "island", "n_points", F.round(F.aggregate(F.transform("line", lambda p: p.lon), F.lit(0.0), lambda a, x: a + x), 4).alias("sum_lon")))


# ---------------------------------------------------------------- sweeps

_TRIALS = tuning.trials((50, 200), (1e-3, 2e-2), (4, 8))


def _sweep_sql():
    parts, out = [], []
    for i, t in enumerate(_TRIALS, 1):
        p = f"t{i}_"
        parts.append(sql.clique("st", t.k, t.r, t.neighbor_mode, p) + sql.moves(f"(SELECT * FROM {p}lab WHERE cluster_id <> -1)", p=p))
        z = f"(SELECT cluster_id, count(*) AS n FROM {p}lab WHERE cluster_id <> -1 GROUP BY 1)"
        out.append(f"""SELECT {i}::BIGINT AS trial, {t.k}::BIGINT AS k, {t.r!r}::DOUBLE AS r, {t.neighbor_mode}::BIGINT AS neighbor_mode, (SELECT count(*) FROM st) AS total_points,
            coalesce(sum(n), 0)::DOUBLE / (SELECT count(*) FROM st) AS coverage_ratio, count(*) AS n_clusters, count(*) FILTER (n >= 5) AS effective_ports, coalesce(max(n), 0) AS largest_cluster_points,
            coalesce(max(n)::DOUBLE / sum(n), 0) AS largest_cluster_share, coalesce(median(n), 0)::DOUBLE AS median_cluster_points,
            (SELECT count(DISTINCT (source_port, target_port)) FROM {p}mv) AS edge_count, (SELECT count(*) FROM {p}mv) AS transition_count FROM {z}""")
    return sql.STILL + "".join(parts) + ", tr AS (" + " UNION ALL ".join(out) + ")"


_ALIGN = "CASE WHEN effective_ports BETWEEN 5 AND 10 THEN 1E0 ELSE exp(-(CASE WHEN effective_ports < 5 THEN 5 - effective_ports ELSE effective_ports - 10 END) / 10E0) END"
_SCORE = f"round(0.5E0 * {_ALIGN} + 0.25E0 * coverage_ratio + 0.2E0 * (1 - largest_cluster_share) + 0.05E0, 6)"


@query("alg11_port_sweep", _sweep_sql() + f" SELECT trial, k, r, neighbor_mode, total_points, round(coverage_ratio, 6) AS coverage_ratio, n_clusters, effective_ports, largest_cluster_points::BIGINT AS largest_cluster_points, median_cluster_points, edge_count, transition_count, {_SCORE} AS score FROM tr")
def _(s, d):
    t = tuning.sweep_ports(still(s, d), _TRIALS, low=5, high=10)
    return _long(t.select("trial", "k", "r", "neighbor_mode", "total_points", F.round("coverage_ratio", 6).alias("coverage_ratio"), "n_clusters", "effective_ports", "largest_cluster_points", "median_cluster_points", "edge_count", "transition_count", F.round("score", 6).alias("score")))


@query("agg8_score_by_parameter", _sweep_sql() + f" SELECT k, round(avg({_SCORE}), 5) AS mean_score, round(max({_SCORE}), 5) AS max_score, count(*) AS n_trials FROM tr GROUP BY 1")
def _(s, d):
    t = tuning.by_parameter(tuning.sweep_ports(still(s, d), _TRIALS, low=5, high=10), "k")
    return _long(t.select("k", F.round("mean_score", 5).alias("mean_score"), F.round("max_score", 5).alias("max_score"), "n_trials"))


@query("top2_best_trial", _sweep_sql() + f" SELECT trial, k, r, neighbor_mode FROM tr ORDER BY {_SCORE} DESC, trial LIMIT 1")
def _(s, d):
    t = tuning.sweep_ports(still(s, d), _TRIALS, low=5, high=10).withColumn("score", F.round("score", 6))
    return _long(tuning.best(t).select("trial", "k", "r", "neighbor_mode"))


def _waypoint_sql():
    parts, out = [], []
    for i, g in enumerate(GAMMAS):
        p = f"w{i}_"
        parts.append(f", {p}f AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY point_order) - 1 AS feature_order FROM tol WHERE tolerance > {g!r}::DOUBLE)" + sql.clique(f"{p}f", 100, 2e-3, 8, p) + sql.hull(f"{p}lab", p) + sql.moves(f"(SELECT * FROM {p}lab WHERE cluster_id IN (SELECT cluster_id FROM {p}hull))", "mmsi, trajectory_id", "feature_order", p))
        out.append(f"""SELECT {g!r}::DOUBLE AS gamma, (SELECT count(*) FROM {p}f) AS feature_points, (SELECT count(*) FROM tol) AS original_points, (SELECT count(*) FROM {p}lab WHERE cluster_id <> -1) AS inside,
            (SELECT count(DISTINCT cluster_id) FROM {p}lab WHERE cluster_id <> -1) AS n_clusters, (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM {p}lab WHERE cluster_id <> -1 GROUP BY cluster_id)) AS most, (SELECT count(*) FROM {p}hull) AS nodes,
            (SELECT count(DISTINCT (source_port, target_port)) FROM {p}mv) AS edges, (SELECT count(*) FROM {p}mv) AS transitions, (SELECT sum(length) FROM ({_LEN.format(k='trajectory_id', t=p + 'f')})) AS cut, (SELECT sum(length) FROM ({_LEN.format(k='trajectory_id', t='tol')})) AS whole""")
    return TOL + "".join(parts) + ", rw AS (" + " UNION ALL ".join(out) + "), pw AS (SELECT unnest([{'w1': 1E0, 'w2': 1E0}, {'w1': 0.5E0, 'w2': 2E0}], recursive := true)), " + """
        sc AS (SELECT *, w1 * (1 - feature_points / original_points::DOUBLE) + w2 * least(greatest(1 - abs(cut - whole) / whole, 0), 1) AS ld FROM rw, pw)
        SELECT gamma, w1, w2, feature_points, n_clusters, nodes, edges, transitions, round(ld, 6) AS ld_score,
          round(0.35E0 * ld + 0.2E0 * inside / feature_points + 0.15E0 * (1 - most::DOUBLE / inside) + 0.075E0 + 0.1E0 * CASE WHEN nodes > 1 THEN 1 - exp(-25E0 * edges / (nodes * (nodes - 1))) ELSE 0 END + 0.05E0 * least(1E0, transitions::DOUBLE / greatest(1, edges) / 3), 6) AS score FROM sc"""


@query("alg12_waypoint_sweep", _waypoint_sql())
def _(s, d):
    t = tuning.sweep_waypoints(tol(s, d), GAMMAS, tuning.Trial(100, 2e-3, 8), weights=((1.0, 1.0), (0.5, 2.0)))
    return _long(t.select("gamma", "w1", "w2", "feature_points", "n_clusters", "nodes", "edges", "transitions", F.round("ld_score", 6).alias("ld_score"), F.round("score", 6).alias("score")))


@query("agg10_score_by_weight", f"SELECT w1, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score, count(*) AS n_trials FROM ({_waypoint_sql()}) GROUP BY 1")
def _(s, d):
    t = tuning.sweep_waypoints(tol(s, d), GAMMAS, tuning.Trial(100, 2e-3, 8), weights=((1.0, 1.0), (0.5, 2.0)))
    t = tuning.by_parameter(t.withColumn("score", F.round("score", 6)), "w1")
    return t.select("w1", F.round("mean_score", 5).alias("mean_score"), F.round("max_score", 5).alias("max_score"), "n_trials")
