import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaweft.functions import geometry
from seaweft.operators import components, corridor, grid, network, trajectory, tuning, voyage
from seaweft.plans import pipeline

XY = "lon double, lat double, cluster_id int, mmsi bigint"


def points(spark, xy, cluster=0):
    return spark.createDataFrame([(float(x), float(y), cluster, 1) for x, y in xy], XY)


def cells(spark, xy, **kw):
    return {(r.lon, r.lat): r.cluster_id for r in grid.clique(points(spark, xy).drop("cluster_id"), **kw).collect()}


def test_corners_touch_in_mode_eight_only(spark):
    xy = [(0, 0), (1.5, 1.5), (10, 10)]
    assert len({c for c in cells(spark, xy, k=10, r=0.1, mode=4).values()}) == 3
    found = cells(spark, xy, k=10, r=0.1, mode=8)
    assert found[0, 0] == found[1.5, 1.5] != found[10, 10]


def test_thresholds(spark):
    assert grid.threshold(3, 0.1) == 1 and grid.threshold(4164, 1e-3) == 5 and grid.threshold(10, 0.5, 2) == 2
    xy = [(0, 0)] * 3 + [(10, 10)] * 2
    assert cells(spark, xy, k=5, min_dense=3) == {(0, 0): 0, (10, 10): -1}
    with pytest.raises(ValueError):
        cells(spark, xy, k=1)
    assert grid.neighbour_mode("4.0") == 4
    with pytest.raises(ValueError):
        grid.neighbour_mode(6)


def test_no_extent_and_no_points(spark):
    assert cells(spark, [(3, 3)] * 4, k=7) == {(3, 3): 0}
    assert grid.clique(points(spark, []).drop("cluster_id")).collect() == []


def test_task_and_spark_number_clusters_alike(spark):
    rng = random.Random(5)
    dense = spark.createDataFrame(sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(320)}), "clique_x int, clique_y int")
    for mode in (4, 8):
        a = {tuple(r) for r in grid.cluster_cells(dense, 30, mode).collect()}
        assert a == {tuple(r) for r in grid.cluster_cells(dense, 30, mode, task_cells=0).collect()}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[200 + i] for i in range(50)} == {100}


@pytest.mark.parametrize("xy", [[(0, 0), (1, 0), (0, 1)], [(0, 0)] * 4, [(1, y) for y in range(5)], [(i, i) for i in range(5)], [(x, 2) for x in range(5)]])
def test_no_polygon(spark, xy):
    assert network.boundaries(points(spark, xy)).collect() == []


def test_hull_area_and_centroid(spark):
    rng = random.Random(2)
    xy = [(0, 0), (4, 0), (4, 2), (0, 2)] + [(rng.random() * 4, rng.random() * 2) for _ in range(300)]
    r = network.boundaries(points(spark, xy)).first()
    assert (r.n_points, round(r.area_deg2, 9), round(r.lon, 9), round(r.lat, 9)) == (304, 8.0, 2.0, 1.0)
    assert len(r.ring) == 5 and r.ring[0] == r.ring[-1]


def visits(spark, seq, mmsi=1):
    return spark.createDataFrame([(mmsi, i, c) for i, c in enumerate(seq)], "mmsi bigint, event_seq bigint, cluster_id int")


@pytest.mark.parametrize("seq,valid,want", [([0, 0, -1, 0, 1], [0, 1], [(0, 1, 1)]), ([0, 5, 0], [0], []), ([0, 5, 1], [0, 1], [(0, 1, 1)]), ([0, 1, 0, 1], [0, 1], [(0, 1, 2), (1, 0, 1)])])
def test_transitions(spark, seq, valid, want):
    nodes = spark.createDataFrame([(v,) for v in valid], "port_id int")
    got = network.edges(visits(spark, seq), nodes, order=("event_seq",)).collect()
    assert sorted((r.source_port, r.target_port, r.transition_count) for r in got) == want


def test_within_leaves_the_boundary_out(spark):
    ring = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (3.0, 1.0)], "x double, y double")
    r = df.select(geometry.within(ring, F.col("x"), F.col("y")).alias("w"), geometry.intersects(ring, F.col("x"), F.col("y")).alias("i")).collect()
    assert [x.w for x in r] == [False, False, True, False] and [x.i for x in r] == [True, True, True, False]


def reports(spark, minutes):
    df = spark.createDataFrame([(1, m * 60_000_000, i, float(i), 0.0) for i, m in enumerate(minutes)], "mmsi bigint, us bigint, event_seq bigint, lon double, lat double")
    return df.withColumn("base_date_time", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


def test_gap_is_strict_and_short_tracks_go(spark):
    df = reports(spark, [0, 720, 1440])
    assert {r.trajectory_id for r in trajectory.with_tracks(df).collect()} == {"1_1"}
    late = df.where("event_seq = 2").withColumn("base_date_time", F.expr("base_date_time + interval 1 microsecond"))
    assert {r.trajectory_id for r in trajectory.with_tracks(df.where("event_seq < 2").unionByName(late)).collect()} == {"1_1", "1_2"}
    assert trajectory.tracks(reports(spark, range(4))).count() == 0 and trajectory.tracks(reports(spark, range(5))).count() == 5


def simplify(xy, eps):
    """Douglas-Peucker for one tolerance, by its definition."""
    if len(xy) <= 2:
        return list(range(len(xy)))
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        d = [float(geometry.segment_distance(xy[i : i + 1], xy[s], xy[e])[0]) for i in range(s + 1, e)]
        at = max(range(len(d)), key=lambda i: (d[i], -i))
        if d[at] > eps:
            keep.add(s + 1 + at)
            todo += [(s, s + 1 + at), (s + 1 + at, e)]
    return sorted(keep)


def test_tolerances_serve_every_gamma():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 12, 40):
        for xy in (rng.integers(0, 4, (n, 2)).astype(float), np.zeros((n, 2)), rng.random((n, 2))):
            tol = trajectory.tolerances(xy)
            for g in (-1.0, 0.0, 0.1, 0.5, 1.0):
                assert np.flatnonzero(tol > max(g, 0.0)).tolist() == simplify(xy, max(g, 0.0))


def test_corridor_minima(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 0.0, 0.0)], "port_id int, lon double, lat double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "source_port int, target_port int")
    strip = [(1.0, 0.01 * i) for i in range(5)]
    fit = lambda extra: corridor.fit_slices(spark.createDataFrame(strip[: 4 if extra < 0 else 5] + [(1.45, 0.0)] * abs(extra), "lon double, lat double"), nodes, edges, m=1, radius=0.5, strip=10.0).collect()
    assert fit(4) == [] and fit(-6) == []
    (r,) = fit(5)
    assert (r.source, r.target, r.n_square, r.n_strip) == (0, 1, 10, 5) and r.mu == pytest.approx(0.02) and r.sigma == pytest.approx(0.01 * math.sqrt(2))
    route = corridor.routes(corridor.fit_slices(spark.createDataFrame(strip + [(1.45, 0.0)] * 5, "lon double, lat double"), nodes, edges, m=1, radius=0.5, strip=10.0)).first()
    assert route.n_slices == 1 and len(route.corridor) == 3 and route.corridor[0] == route.corridor[-1]


def test_voyages(spark):
    ports = spark.createDataFrame([(0, 10, 0.0, 0.0), (1, 11, 1.0, 0.0), (2, 12, 0.01, 0.0)], "ordinal int, port_id int, lon double, lat double")
    lons = [0.0, 0.3, 0.6, 1.0, 0.5, 1.0]
    df = spark.createDataFrame([(1, i, float(i), x, 0.0) for i, x in enumerate(lons)], "mmsi bigint, event_seq bigint, base_date_time double, lon double, lat double")
    labelled = voyage.label_ports(df, ports)
    assert [r.port for r in labelled.orderBy("event_seq").collect()] == [12, -1, -1, 11, -1, 11]
    (v,) = voyage.voyages(labelled).collect()
    assert (v.src_port, v.dst_port, v.n_points, [p.lon for p in v.line]) == (12, 11, 2, [0.3, 0.6])


def test_scores_equal_published_ones(spark):
    assert tuning.port_score_value(0, 1.0, 0.17543859649122806, 0.00899040000513196, 30, 200) == pytest.approx(0.883578482267868, abs=1e-9)
    ld, share = 1.6833150347925265, 0.29867326436743435
    got = spark.range(1).select(tuning.waypoint_score(F.lit(ld), F.lit(1.0), F.lit(share), F.lit(556), F.lit(351), F.lit(541)).alias("s")).first().s
    assert got == pytest.approx(0.9978514007741028, abs=1e-9)


def test_alignment_of_expected_counts(spark):
    from seaweft.functions.scalar import alignment
    one = lambda v, lo, hi: spark.range(1).select(alignment(F.lit(v), lo, hi).alias("a")).first().a
    assert one(5, None, None) == 0.5 and one(5, 10, 1) == 1.0 and one(5, None, 5) == 1.0
    assert one(0, 30, 200) == pytest.approx(math.exp(-30 / 170)) and one(25, 5, None) == pytest.approx(math.exp(-2))


def test_best_params_precedence(spark):
    table = spark.createDataFrame([(1, 20, 1e-5, 4, None, 0.2), (2, 30, 1e-4, 8, None, 0.9)], "trial int, k int, r double, neighbor_mode int, min_dense_points int, score double")
    assert tuning.best_params(table, cli=(9, 0.1, 8)) == tuning.Trial(9, 0.1, 8)
    assert tuning.best_params(table, summary={"best_trial": {"k": 5, "r": 0.5, "neighbor_mode": "4.0"}}) == tuning.Trial(5, 0.5, 4)
    assert tuning.best_params(table) == tuning.Trial(30, 1e-4, 8) and tuning.best_params() == tuning.Trial(1400, 5e-6, 4)


def test_whole_runs(spark, tmp_path):
    from seaweft.plans.fixture import ais
    points = pipeline.reports_of(ais(spark, "/root/testdata/sf0.01"))
    layer = pipeline.run_ports(points, tuning.Trial(200, 1e-3, 8))
    routes = pipeline.run_corridors(points, layer, m=5, radius=1.0)
    pipeline.export(layer, str(tmp_path), routes)
    assert spark.read.text(f"{tmp_path}/rlsn_routes").first().value.startswith('{"type":"FeatureCollection"')
    feats = pipeline.network_features("run", nodes=layer.nodes, edges=network.place_edges(layer.edges, layer.nodes), routes=routes)
    assert feats.groupBy("layer").count().count() == 3
    done = pipeline.tune_ports(points, pipeline.Region("all"), tuning.trials((50,), (1e-3,), (4, 8)))
    again = pipeline.tune_ports(points, pipeline.Region("all"), tuning.trials((50, 60), (1e-3,), (4, 8)), done)
    assert (done.count(), again.count()) == (2, 4)


def test_presets_and_grids():
    from seaweft.plans.regions import REGIONS
    assert len(tuning.trials()) == 264 and len(tuning.GAMMAS) == 12
    assert sorted(REGIONS) == [1, 2, 3, 4, 5] and len(REGIONS[1].weights) == 16 and REGIONS[2].trial == tuning.Trial(500, 3e-4, 8)
