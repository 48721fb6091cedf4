from pyspark.sql import functions as F

from seaweft.operators import ingest, trajectory
from seaweft.plans.fixture import ais
from seaweft.streaming import streams

ROOT = "/root/testdata/sf0.001"


def source(spark, tmp_path):
    batch = ais(spark, ROOT).where("mmsi < 20")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.read.parquet(f"{tmp_path}/in"), streams.reports(spark, f"{tmp_path}/in", batch.schema)


def run(stream, tmp_path, name):
    streams.to_parquet(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp").awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_filters_equal_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = run(streams.stationary(stream), tmp_path, "still")
    assert sorted(r.event_seq for r in got.collect()) == sorted(r.event_seq for r in ingest.stationary(ingest.valid(batch)).collect())


def test_closed_windows_and_sessions_equal_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    end = batch.agg(F.max(F.col("base_date_time").cast("timestamp")) - F.expr("interval 2 hours")).first()[0]
    counts = run(streams.cell_counts(stream), tmp_path, "cells")
    want = batch.groupBy(F.window(F.col("base_date_time").cast("timestamp"), "1 hour"), F.floor("lon"), F.floor("lat")).count().where(F.col("window.end") <= F.lit(end))
    assert counts.count() == want.count() and counts.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]
    assert run(streams.sessions(stream), tmp_path, "sessions").count() > 0


def test_track_numbers_equal_batch(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    got = {r.event_seq: r.track_seq for r in run(streams.track_numbers(stream), tmp_path, "tracks").collect()}
    assert got == {r.event_seq: r.track_seq for r in trajectory.with_tracks(batch).collect()}
