"""Queries of sources, sinks and small aggregates that the others don't show by themselves, each with its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.checkpoints import durable, shared_dir
from seaweft.functions import scalar
from seaweft.operators import corridor, grid, ingest, network, trajectory, tuning
from seaweft.plans import core_queries as core
from seaweft.plans import pipeline, sql
from seaweft.plans.core_queries import _long, ports, still, valid
from seaweft.plans.fixture import AIS, ais
from seaweft.plans.registry import query
from seaweft.sources import readers, sinks


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text_csv(s: SparkSession, d: str, names: dict[str, str], path: str) -> DataFrame:
    df = ais(s, d).select(*(F.col(c).cast("string").alias(n) for n, c in names.items()))
    df.write.option("header", True).csv(path)
    return df


_SUMS = " SELECT navstatus::BIGINT AS navstatus, count(*) AS n, round(sum(lat), 3) AS sum_lat FROM ais GROUP BY 1"


@query("src1_raw_csv_scan", AIS + _SUMS)
def _(s, d):
    path = _folder(s, "raw")
    _text_csv(s, d, {"Status": "navstatus", "MMSI": "mmsi", "BaseDateTime": "base_date_time", "LAT": "lat", "LON": "lon", "SOG": "sog", "COG": "cog"}, path)
    std = ingest.standardise(readers.raw_csv(s, f"{path}/*.csv"))
    return _long(std.groupBy("navstatus").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("sum_lat")))


@query("src3_daily_csv", AIS + _SUMS)
def _(s, d):
    path = _folder(s, "daily")
    _text_csv(s, d, {"mmsi": "mmsi", "base_date_time": "base_date_time", "longitude": "lon", "latitude": "lat", "sog": "sog", "cog": "cog", "status": "navstatus", "Unnamed: 17": "event_seq"}, path)
    from seaweft.schema import canonical
    return _long(canonical(readers.daily_csv(s, f"{path}/*.csv")).groupBy("navstatus").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("sum_lat")))


@query("src4_load_reports", AIS + " SELECT count(*) AS n, min(lat) AS min_lat, max(lon) AS max_lon FROM ais")
def _(s, d):
    path = _folder(s, "reports")
    ais(s, d).withColumnsRenamed({"lat": "LAT", "lon": "LON", "mmsi": "MMSI"}).write.parquet(path)
    return readers.reports(s, path).agg(F.count("*").alias("n"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"))


@query("src5_column_projection", "SELECT count(*) AS n, round(sum(value), 3) AS total FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("value").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("src6_sql_file_scan", "SELECT event_type, count(*) AS n, max(value) AS most FROM events WHERE value > 10 GROUP BY 1")
def _(s, d):
    return s.sql(f"SELECT event_type, count(*) AS n, max(value) AS most FROM parquet.`{d}/events.parquet` WHERE value > 10 GROUP BY 1")


@query("src7_schema_names", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM events)")
def _(s, d):
    return s.createDataFrame([(n,) for n in readers.column_names(s, f"{d}/events.parquet")], "name string")


@query("src8_footer_row_count", "SELECT count(*) AS n FROM events")
def _(s, d):
    return s.createDataFrame([(readers.row_count(s, f"{d}/events.parquet"),)], "n bigint")


@query("src9_region_clip", core._clip_sql(core.REGION, False))
def _(s, d):
    import json
    path = _folder(s, "region")
    text = json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": core.REGION}}]}, indent=1)
    s.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return pipeline.clip(valid(s, d), readers.region(s, path)).groupBy("mmsi").agg(F.count("*").alias("n"))


@query("snk3_edges_csv", core.PORT_MOVES + " " + sql.EDGES.format(mv="mv"))
def _(s, d):
    p, path = ports(s, d), _folder(s, "edges")
    sinks.single_csv(network.edges(p, network.port_nodes(network.boundaries(p))), path)
    return readers.table_csv(s, path, "source_port bigint, target_port bigint, transition_count bigint, unique_vessels bigint")


@query("snk2_daily_summary", sql.VALID + " SELECT CAST(date_trunc('day', base_date_time) AS DATE) AS day, count(*) AS n, count(DISTINCT mmsi) AS vessels, round(avg(sog), 6) AS mean_sog FROM valid GROUP BY 1")
def _(s, d):
    return valid(s, d).groupBy(F.to_date("base_date_time").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("mmsi").alias("vessels"), F.round(F.avg("sog"), 6).alias("mean_sog"))


@query("snk5_routes_geojson", core._corridor_sql(5, 1.0, 2.0) + " SELECT count(*)::BIGINT AS vertices, count(DISTINCT (source, target)) AS routes FROM ft")
def _(s, d):
    p = ports(s, d)
    nodes = network.port_nodes(network.boundaries(p))
    r = durable(corridor.routes(corridor.fit_slices(valid(s, d), nodes, network.edges(p, nodes), m=5, radius=1.0)))
    kind = "type string, features array<struct<properties:struct<source:int,target:int>,geometry:struct<type:string,coordinates:array<array<double>>>>>"
    g = F.from_json("value", kind).features
    sizes = F.aggregate(F.transform(g, lambda f: F.size(f.geometry.coordinates)), F.lit(0), lambda a, x: a + x)
    return sinks.routes_geojson(r).select(sizes.cast("bigint").alias("vertices"), F.size(g).cast("bigint").alias("routes"))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    return tuning.sweep_ports(still(s, d), core._TRIALS, low=5, high=10).withColumn("score", F.round("score", 6))


_TR = core._sweep_sql()


@query("snk6_top_trials", _TR + f" SELECT trial, {core._SCORE} AS score FROM tr ORDER BY {core._SCORE} DESC, trial LIMIT 3")
def _(s, d):
    top = sinks.trial_summary(durable(_sweep(s, d)), top=3)["top_3"]
    return s.createDataFrame([(t["trial"], t["score"]) for t in top], "trial bigint, score double")


@query("snk7_append_and_resume", _TR + f" SELECT k, r, neighbor_mode, {core._SCORE} AS score FROM tr")
def _(s, d):
    path, wanted = _folder(s, "trials"), core._TRIALS
    for part in (wanted[:3], wanted):  # the second run does what the first left
        done = s.read.parquet(path) if part is wanted else None
        have = {(r.k, r.r, r.neighbor_mode) for r in done.collect()} if done is not None else set()
        todo = [t for t in part if (t.k, t.r, t.neighbor_mode) not in have]
        sinks.append_trials(tuning.sweep_ports(still(s, d), todo, low=5, high=10), path)
    return _long(s.read.parquet(path).select("k", "r", "neighbor_mode", F.round("score", 6).alias("score")))


@query("agg6_track_sizes", sql.VALID + sql.tracks() + " SELECT n_track, count(*) AS n FROM trk GROUP BY 1")
def _(s, d):
    return trajectory.tracks(valid(s, d)).groupBy("n_track").agg(F.count("*").alias("n"))


@query("agg7_compression_totals", core._M + " SELECT gamma, sum(original_points)::BIGINT AS original_points, sum(compressed_points)::BIGINT AS compressed_points FROM m GROUP BY 1")
def _(s, d):
    return trajectory.metrics(core.tol(s, d), core.GAMMAS).groupBy("gamma").agg(F.sum("original_points").alias("original_points"), F.sum("compressed_points").alias("compressed_points"))


@query("agg9_coverage_by_r", _TR + " SELECT r, round(avg(coverage_ratio), 6) AS coverage FROM tr GROUP BY 1")
def _(s, d):
    return _sweep(s, d).groupBy("r").agg(F.round(F.avg("coverage_ratio"), 6).alias("coverage"))


@query("agg11_series_by_combination", _TR + " SELECT k, neighbor_mode, list(n_clusters ORDER BY r)::VARCHAR AS series FROM tr GROUP BY ALL")
def _(s, d):
    series = F.transform(F.sort_array(F.collect_list(F.struct("r", "n_clusters"))), lambda x: x.n_clusters.cast("string"))
    return _long(_sweep(s, d).groupBy("k", "neighbor_mode").agg(F.concat(F.lit("["), F.concat_ws(", ", series), F.lit("]")).alias("series")))


@query("agg12_file_bounds", "SELECT count(*) AS n, min(value) AS low, max(value) AS high FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("agg13_distinct_vessels", sql.VALID + " SELECT mmsi FROM valid GROUP BY 1")
def _(s, d):
    return valid(s, d).select("mmsi").distinct()


@query("agg21_distinct_counts", core.LAB + sql.tracks("lab") + " SELECT (SELECT count(DISTINCT cluster_id) FROM lab WHERE cluster_id <> -1) AS clusters, (SELECT count(DISTINCT mmsi) FROM lab) AS vessels, (SELECT count(DISTINCT trajectory_id) FROM trk) AS tracks")
def _(s, d):
    p = ports(s, d)
    one = p.agg(F.countDistinct(F.when(F.col("cluster_id") != -1, F.col("cluster_id"))).alias("clusters"), F.countDistinct("mmsi").alias("vessels"))
    return one.crossJoin(trajectory.tracks(p).agg(F.countDistinct("trajectory_id").alias("tracks")))  # a row each


@query("alg13_service_sweep", _TR + " SELECT k, r, n_clusters, round(1 - coverage_ratio, 6) AS noise_ratio FROM tr WHERE neighbor_mode = 4")
def _(s, d):
    return _long(_sweep(s, d).where("neighbor_mode = 4").select("k", "r", "n_clusters", F.round("noise_ratio", 6).alias("noise_ratio")))


@query("srt2_edges_by_count", core.LAB + sql.moves("(SELECT * FROM lab WHERE cluster_id <> -1)") + ", ed AS (" + sql.EDGES.format(mv="mv") + ") SELECT source_port::BIGINT AS source_port, target_port::BIGINT AS target_port, row_number() OVER (ORDER BY transition_count DESC, source_port, target_port) AS place FROM ed")
def _(s, d):
    from pyspark.sql import Window
    e = network.edges(ports(s, d))
    return _long(e.select("source_port", "target_port", F.row_number().over(Window.orderBy(F.desc("transition_count"), "source_port", "target_port")).alias("place")))


@query("srt3_latest_runs", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


@query("set3_anchored_or_moored", sql.VALID + " SELECT count(*) AS n FROM valid WHERE (navstatus = 1 AND sog < 0.5E0) OR (navstatus = 5 AND sog < 0.5E0)")
def _(s, d):
    v = valid(s, d)
    both = ingest.stationary(v, (1,)).select("event_seq").union(ingest.stationary(v, (5,)).select("event_seq")).distinct()
    return both.agg(F.count("*").alias("n"))


@query("fn13_chord_distance", core.TRACKS + """, x AS (SELECT t.*, a.lon AS ax, a.lat AS ay, b.lon - a.lon AS dx, b.lat - a.lat AS dy FROM trk t JOIN trk a ON a.trajectory_id = t.trajectory_id AND a.point_order = 0 JOIN trk b ON b.trajectory_id = t.trajectory_id AND b.point_order = b.n_track - 1),
    y AS (SELECT *, CASE WHEN dx * dx + dy * dy <= 1E-20 THEN 0 ELSE least(greatest(((lon - ax) * dx + (lat - ay) * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM x)
    SELECT trajectory_id, round(max(sqrt(pow(lon - ax - t * dx, 2) + pow(lat - ay - t * dy, 2))), 6) AS most FROM y GROUP BY 1""")
def _(s, d):
    from pyspark.sql import Window
    w = Window.partitionBy("trajectory_id").orderBy("point_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = trajectory.tracks(valid(s, d)).withColumns({"ax": F.first("lon").over(w), "ay": F.first("lat").over(w), "bx": F.last("lon").over(w), "by": F.last("lat").over(w)})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = dx * dx + dy * dy
    part = F.when(size <= 1e-20, 0.0).otherwise(F.least(F.greatest(((F.col("lon") - F.col("ax")) * dx + (F.col("lat") - F.col("ay")) * dy) / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    gap = F.sqrt(F.pow(F.col("lon") - F.col("ax") - part * dx, 2) + F.pow(F.col("lat") - F.col("ay") - part * dy, 2))
    return t.groupBy("trajectory_id").agg(F.round(F.max(gap), 6).alias("most"))


@query("fn17_trial_names", "SELECT unnest(['k50_r0p001_n4', 'k50_r0p001_n8', 'k50_r0p02_n4', 'k50_r0p02_n8', 'k200_r0p001_n4', 'k200_r0p001_n8', 'k200_r0p02_n4', 'k200_r0p02_n8']) AS name")
def _(s, d):
    return s.createDataFrame([(scalar.method_id(t.k, t.r, t.neighbor_mode),) for t in core._TRIALS], "name string")


@query("fn19_well_known_text", sql.VALID + " SELECT event_seq, printf('POINT (%.5f %.5f)', lon, lat) AS wkt FROM valid")
def _(s, d):
    return valid(s, d).select("event_seq", F.format_string("POINT (%.5f %.5f)", "lon", "lat").alias("wkt"))


@query("api5_network_features", core.PORT_MOVES + ", ed AS (" + sql.EDGES.format(mv="mv") + ") SELECT 'nodes' AS layer, count(*) AS n, 'Point' AS shape FROM hull UNION ALL SELECT 'edges', count(*), 'LineString' FROM ed")
def _(s, d):
    p = ports(s, d)
    nodes = network.port_nodes(network.boundaries(p))
    all_layers = pipeline.network_features("run", nodes=nodes, edges=network.place_edges(network.edges(p, nodes), nodes))
    return all_layers.groupBy("layer", F.get_json_object("geometry", "$.type").alias("shape")).agg(F.count("*").alias("n"))


@query("api6_whole_ports_run", core.PORT_MOVES + " " + sql.EDGES.format(mv="mv"))
def _(s, d):
    raw = ais(s, d).withColumnsRenamed({"mmsi": "MMSI", "base_date_time": "BaseDateTime", "navstatus": "Status"})
    return _long(pipeline.run_ports(pipeline.reports_of(raw), tuning.Trial(core.K, core.R, core.MODE)).edges)


@query("jn1_cell_labels", core.LAB + " SELECT cluster_id::BIGINT AS cluster_id, navstatus::BIGINT AS navstatus, count(*) AS n FROM lab GROUP BY ALL")
def _(s, d):
    return _long(grid.clique(still(s, d), core.K, core.R, core.MODE).groupBy("cluster_id", "navstatus").agg(F.count("*").alias("n")))
