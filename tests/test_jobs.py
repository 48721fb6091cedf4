"""Runs of the command line and the daily job, readers' limits, and durable tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seaweft import checkpoints, cli
from seaweft.operators import components, features, trajectory, tuning
from seaweft.plans import pipeline, regions
from seaweft.plans.fixture import ais
from seaweft.sources import readers, sinks

HEADER = "mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_name,imo,call_sign,vessel_type,status,length,width,draft,cargo,transceiver"


def day(path, d, vessels=4):
    rows = [f"{200000000 + v},2025-01-{d:02d}T{h:02d}:00:00,{-80 - v - h / 50},{25 + h / 60},{h % 7}.5,{h * 10}.0,1,N,I,C,70,0,1,1,1,1,A" for v in range(vessels) for h in range(20)]
    path.write_text("\n".join([HEADER, *rows, rows[0]]) + "\n")


def test_daily_job_takes_the_first_files_and_writes_a_summary(spark, tmp_path):
    for d in (3, 1, 2):
        day(tmp_path / f"ais-2025-01-{d:02d}.csv", d, vessels=d + 1)
    glob = str(tmp_path / "ais-*.csv")
    assert [p.rsplit("/", 1)[-1] for p in readers.files(spark, glob, 2)] == ["ais-2025-01-01.csv", "ais-2025-01-02.csv"]
    got = pipeline.daily_job(spark, glob, str(tmp_path / "out"), 2).orderBy("file").collect()
    assert [(r.file, r.rows_in, r.rows_out, r.vessels) for r in got] == [("ais-2025-01-01", 41, 40, 2), ("ais-2025-01-02", 61, 60, 3)]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/processing_summary")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/processed_ais-2025-01-01")).count() == 40
    assert "TRANSCEIVER" in readers.daily_csv(spark, glob, 1).columns


def test_newest_and_missing_columns(spark, tmp_path):
    import os
    for i, name in enumerate(("b.json", "a.json")):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_000_000 + i, 1_000_000 + i))
    assert readers.newest(spark, str(tmp_path / "*.json")).endswith("/a.json")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, str(tmp_path / "*.none"))
    spark.range(3).select(F.lit(1.0).alias("LAT"), F.lit(2.0).alias("LON")).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="mmsi"):
        readers.reports(spark, str(tmp_path / "p"))
    assert readers.reports(spark, str(tmp_path / "p"), needed=("lat", "lon")).count() == 3


def test_command_line_runs_with_a_preset_and_reads_networks_back(spark, tmp_path, monkeypatch, sf_dir):
    monkeypatch.setattr(cli.session, "build", lambda *_, **__: spark)
    reports = str(tmp_path / "reports")
    ais(spark, sf_dir).write.parquet(reports)
    used = []
    monkeypatch.setattr(pipeline, "run_ports", lambda points, trial, run=pipeline.run_ports: used.append(trial) or run(points, trial))
    cli.main(["ports", "--input", reports, "--out", str(tmp_path / "ports"), "--preset", "2"])
    assert used == [regions.REGIONS[2].trial]
    cli.main(["ports", "--input", reports, "--out", str(tmp_path / "ports"), "--preset", "2", "--k", "30", "--r", "0.001", "--mode", "8"])
    assert used[1] == tuning.Trial(30, 0.001, 8)
    layer = pipeline.read_layer(spark, str(tmp_path / "ports"))
    assert layer.nodes.count() > 0 and layer.edges.count() > 0
    cli.main(["corridors", "--input", reports, "--out", str(tmp_path / "routes"), "--network", f"ports={tmp_path / 'ports'}", "--slices", "3", "--radius", "1.0"])
    text = spark.read.text(str(tmp_path / "routes/ports/rlsn_routes")).first()[0]
    assert json.loads(text)["type"] == "FeatureCollection"


def test_trials_are_resumed_and_repeated_results_count_once(spark, sf_dir):
    points = ais(spark, sf_dir)
    wanted = tuning.trials((20, 30), (1e-3,), (4,))
    region = pipeline.Region("r", min_port_points=5)
    first = pipeline.tune_ports(points, region, wanted[:1])
    twice = first.withColumn("attempt", F.lit(1)).unionByName(first.withColumn("attempt", F.lit(2)).withColumn("score", F.lit(9.0)))
    got = pipeline.tune_ports(points, region, wanted, done=twice).collect()
    assert sorted((r.k, r.score == 9.0) for r in got) == [(20, True), (30, False)]


def test_sweep_against_plain_loops(spark, sf_dir):
    """Cluster sizes of every trial, cell by cell in Python."""
    from collections import Counter

    from seaweft.operators import grid
    points = ais(spark, sf_dir).where("lat is not null and lon is not null")
    b = grid.bounds(points)
    rows = [(r.lon, r.lat) for r in points.select("lon", "lat").collect()]
    wanted = tuning.trials((5, 40), (1e-3, 5e-3, 0.9), (4, 8))
    for r in tuning.sweep_ports(points, wanted).collect():
        cell = lambda v, lo, hi: min(max(int((v - lo) / max(hi - lo, 1e-12) * r.k), 0), r.k - 1)  # noqa: B023, E731
        cells = Counter((cell(x, b.lon_min, b.lon_max), cell(y, b.lat_min, b.lat_max)) for x, y in rows)
        dense = {c: n for c, n in cells.items() if n >= r.threshold}
        sizes, left = [], set(dense)
        while left:
            todo, size = [left.pop()], 0
            while todo:
                x, y = todo.pop()
                size += dense[x, y]
                near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (r.neighbor_mode == 8 or i * j == 0)} & left
                left -= near
                todo += near
            sizes.append(size)
        assert (r.n_clusters, r.largest_cluster_points, round(r.coverage_ratio * r.total_points)) == (len(sizes), max(sizes, default=0), sum(sizes))


def test_tolerances_stream_over_batches(spark):
    rng = random.Random(2)
    rows = [(1, f"t{t}", i, i, rng.random(), rng.random()) for t in range(40) for i in range(rng.choice([1, 2, 3, 90]))]
    df = spark.createDataFrame(rows, "mmsi bigint, trajectory_id string, point_order int, event_seq bigint, lon double, lat double")
    results = []
    for n in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        results.append({(r.trajectory_id, r.point_order): r.tolerance for r in trajectory.with_tolerance(df).collect()})
    assert results[0] == results[1] and len(results[0]) == len(rows)
    assert trajectory.with_tolerance(df.limit(0)).collect() == []


def test_whole_table_fill_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), f"2025-01-01 00:{i // 60:02d}:{i % 60:02d}", i, float(i) if rng.random() < 0.05 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "mmsi int, base_date_time string, event_seq int, sog double")
    ordered = sorted(rows, key=lambda r: r[:3])
    want, last = {}, None
    for r in ordered:
        last = r[3] if r[3] is not None else last
        want[r[2]] = last
    for r in reversed(ordered):
        last = r[3] if r[3] is not None else last
        want[r[2]] = last if want[r[2]] is None else want[r[2]]
    first = next(r[3] for r in ordered if r[3] is not None)
    want = {k: first if v is None else v for k, v in want.items()}
    assert {r.event_seq: r.sog for r in features.fill(df, ["sog"], whole_table=True).collect()} == want


def test_fill_has_no_frame_that_begins_at_each_row(spark):
    """Such a frame is gone through anew for each row, which takes the square of a range."""
    df = spark.createDataFrame([(1, "2025-01-01 00:00:00", i, None if i < 3 else float(i)) for i in range(6)], "mmsi int, base_date_time string, event_seq int, sog double")
    for whole in (False, True):
        filled = features.fill(df, ["sog"], whole_table=whole)
        assert "currentrow$(), unboundedfollowing$()" not in filled._jdf.queryExecution().optimizedPlan().toString().lower()
        assert [r.sog for r in filled.orderBy("event_seq").collect()] == [3.0, 3.0, 3.0, 3.0, 4.0, 5.0]


def test_one_hot_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(features, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError):
        features.one_hot(spark.range(5).select(F.col("id").cast("string").alias("c")), "c")


def test_durable_tables_have_their_true_size(spark):
    df = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    for _ in range(6):
        df = checkpoints.durable(df.join(df.withColumnRenamed("b", "c"), "a").select("a", "b"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 10**6


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(Session())


def test_catalog_tables_and_status(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS t_runs")
    for i, status in enumerate(("running", "completed")):
        sinks.log_status(spark, "t_runs", "r1", status, i)
    sinks.log_status(spark, "t_runs", "r2", "failed", 0)
    assert [r.run_id for r in sinks.runs_with(spark.table("t_runs"), "completed").collect()] == ["r1"]
    spark.sql("DROP TABLE IF EXISTS t_nodes")
    sinks.save_table(spark.range(2), "t_nodes", "r1")
    sinks.save_table(spark.range(3), "t_nodes", "r2")
    assert spark.table("t_nodes").where("run_id = 'r2'").count() == 3
    spark.sql("DROP TABLE t_runs")
    spark.sql("DROP TABLE t_nodes")


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    order = list(range(3000))
    rng.shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    assert {r.root for r in components.components(edges).collect()} == {0}


def test_service_records_and_background_runs(spark, tmp_path):
    from seaweft import service
    store = service.Store(spark, str(tmp_path / "service"))
    assert store.read("users").count() == 0
    store.add("users", user_id=7, name="a", email="a@x", seq=1)
    store.add("users", user_id=7, name="b", email="a@x", seq=2)
    assert store.get("users", 7)["name"] == "b" and store.latest("users").count() == 1
    with pytest.raises(KeyError):
        store.get("users", 8)
    day(tmp_path / "d.csv", 1)
    with pytest.raises(ValueError):
        service.upload(store, 7, str(tmp_path / "d.txt"))
    with pytest.raises(KeyError):
        service.upload(store, 8, str(tmp_path / "d.csv"))
    assert service.uploaded(store, service.upload(store, 7, str(tmp_path / "d.csv"))).count() == 81
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    assert store.get("regions", service.add_region(store, "r", json.dumps(square)))["name"] == "r"
    back = service.Background(store)
    assert back.start("one", "plsn", lambda: spark.range(5).count()).result(60) == 5
    with pytest.raises(ZeroDivisionError):
        back.start("two", "nlsn", lambda: 1 / 0).result(60)
    with pytest.raises(ValueError):
        back.start("three", "none", lambda: None)
    assert {(r.run_id, r.status) for r in store.latest("runs").collect()} == {("one", "completed"), ("two", "failed")}
    assert "division" in store.get("runs", "two")["note"]


def test_parameter_helpers():
    assert tuning.numbers("1e-3, 0.5;2") == [1e-3, 0.5, 2.0] and tuning.numbers("") == []
    with pytest.raises(ValueError):
        tuning.numbers("a,b")
    assert [tuning.least_dense(x) for x in (None, "", "none", 0, -3, "7", 4.0)] == [None, None, None, None, None, 7, 4]


def test_points_can_be_limited(spark, sf_dir):
    assert pipeline.reports_of(ais(spark, sf_dir), max_points=17).count() == 17
