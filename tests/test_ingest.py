import json

import pytest
from pyspark.sql import functions as F

from seaweft.functions import scalar
from seaweft.operators import features, ingest
from seaweft.schema import canonical
from seaweft.sources import readers

COLS = "mmsi bigint, base_date_time timestamp_ntz, lat double, lon double, sog double, cog double, navstatus int, event_seq bigint"


def frame(spark, rows):
    return spark.createDataFrame([], COLS) if not rows else spark.sql(" UNION ALL ".join(f"SELECT {r[0]}L mmsi, TIMESTAMP_NTZ '{r[1]}' base_date_time, {r[2]}D lat, {r[3]}D lon, {r[4]}D sog, {r[5]}D cog, {r[6]} navstatus, {i}L event_seq" for i, r in enumerate(rows)))


T = "2024-01-01 00:00:00"


@pytest.mark.parametrize("row,ok", [((1, T, 90, 180, 102.4, 360, 15), True), ((1, T, -90, -180, 0, 0, 0), True), ((1, T, 90.1, 0, 1, 1, 1), False), ((1, T, 0, 0, 104, 1, 1), False), ((1, T, 0, 0, 1, 360.1, 1), False), ((1, T, 0, 0, 1, 1, 16), False)])
def test_validity_bounds(spark, row, ok):
    assert ingest.valid(frame(spark, [row])).count() == int(ok)


def test_speed_limit_is_a_parameter(spark):
    df = frame(spark, [(1, T, 0, 0, 104, 1, 1), (1, T, 0, 0, 105.1, 1, 1)])
    assert ingest.valid(df, 105.0).count() == 1


def test_stationary_is_strict(spark):
    df = frame(spark, [(1, T, 0, 0, 0.5, 0, 1), (1, T, 0, 0, 0.49, 0, 1), (1, T, 0, 0, 0.1, 0, 5), (1, T, 0, 0, 0.1, 0, 0)])
    assert ingest.stationary(df).count() == 2
    assert ingest.stationary(df, statuses=(0,)).count() == 1
    r = ingest.stationary_report(df).first()
    assert (r.anchored, r.moored) == (1, 1)


def test_drop_categories_overlap(spark):
    df = frame(spark, [(1, T, 91, 0, 200, 0, 1), (1, T, 0, 0, 1, 400, 99), (1, T, 0, 0, 1, 1, 1)]).unionByName(frame(spark, [(1, T, 0, 0, 1, 1, 1)]).withColumn("sog", F.lit(None).cast("double")))
    r = ingest.drop_report(df).first()
    assert (r.rows_in, r.rows_out, r.dropped_null_core, r.dropped_invalid_geo, r.dropped_invalid_nav, r.dropped_invalid_sog, r.dropped_invalid_cog) == (4, 1, 1, 1, 1, 1, 1)


def test_unparsable_values_become_null(spark):
    df = spark.createDataFrame([("12", "2024-01-01 00:00:00", "x", "1", "1", "1", "1.0"), ("z", "never", "1", "1", "", "1", None)], "MMSI string, BaseDateTime string, LAT string, LON string, SOG string, COG string, Status string")
    a, b = ingest.standardise(df).collect()
    assert a.mmsi == 12 and a.lat is None and a.navstatus == 1
    assert b.mmsi is None and b.base_date_time is None and b.sog is None and b.navstatus is None
    with pytest.raises(KeyError):
        ingest.standardise(df.drop("COG"))


def test_first_candidate_column_wins(spark):
    df = spark.createDataFrame([(7, 8, 1.5)], "vessel_id int, mmsi int, Latitude double")
    r = canonical(df).first()
    assert (r.mmsi, r.lat) == (8, 1.5)


def test_first_report_by_sequence(spark):
    df = frame(spark, [(1, T, 1, 0, 1, 1, 1), (1, T, 2, 0, 1, 1, 1), (2, T, 3, 0, 1, 1, 1)])
    assert sorted(r.lat for r in ingest.first_report(df).collect()) == [1.0, 3.0]


def test_build_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("BaseDateTime,MMSI,LAT,LON,SOG,COG,Status,Extra\n2024-01-01 00:00:00,1,10,20,1,1,1,x\n2024-01-01T00:00:01,1,10,20,500,1,1,x\nbad,1,10,20,1,1,1,x\n")
    out = str(tmp_path / "out")
    counts = readers.build_parquet(spark, str(tmp_path / "*.csv"), out)
    assert (counts["rows_in"], counts["rows_out"], counts["dropped_null_core"], counts["dropped_invalid_sog"]) == (3, 1, 1, 1)
    df = spark.read.parquet(out)
    assert df.columns == ["MMSI", "BASEDATETIME", "LAT", "LON", "SOG", "COG", "NAVSTATUS"] and dict(df.dtypes)["LAT"] == "float" and df.count() == readers.row_count(spark, out) == 1
    with pytest.raises(FileExistsError):
        readers.build_parquet(spark, str(tmp_path / "*.csv"), out)
    with pytest.raises(FileNotFoundError):
        readers.build_parquet(spark, str(tmp_path / "no*.csv"), out + "2")
    with pytest.raises(ValueError):
        readers.build_parquet(spark, str(tmp_path / "*.csv"), out, compression="none")
    assert readers.column_names(spark, str(tmp_path / "a.csv"))[:2] == ["BaseDateTime", "MMSI"]


def test_regions(spark, tmp_path):
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    for i, g in enumerate((poly, {"type": "Feature", "geometry": poly}, {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": poly}]})):
        (tmp_path / f"{i}.geojson").write_text(json.dumps(g, indent=1))
        assert readers.region(spark, str(tmp_path / f"{i}.geojson")) == poly["coordinates"]


def test_speed_and_course(spark):
    df = frame(spark, [(1, "2024-01-01 00:00:00", 0, 0, 0, 359, 1), (1, "2024-01-01 00:01:00", 0, 0, 5, 1, 1), (1, "2024-01-01 00:02:00", 0, 0, 5.01, 181, 1), (2, "2024-01-01 00:03:00", 0, 0, 25, 10, 1), (2, "2024-01-01 00:04:00", 0, 0, 100, 10, 1), (2, "2024-01-01 00:05:00", 0, 0, 15, 22.5, 1)])
    rows = features.changes(features.places(df)).orderBy("event_seq").collect()
    assert [r.speed_category for r in rows] == ["Stationary", "Stationary", "Slow", "Medium", "Fast", "Slow"]
    assert [r.coursechange for r in rows] == [0, 2, 180, 0, 0, 12.5]
    assert [r.directionquadrant for r in rows] == ["N", "N", "S", "N", "N", "NE"]
    assert features.scale(df, ["lat"]).first().lat_scaled == 0.0
    assert features.engineer(df).count() == 6


def test_colours_and_names(spark):
    row = spark.range(1).select(scalar.score_colour(F.lit(1.0), F.lit(0.0), F.lit(1.0)).alias("a"), scalar.score_colour(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("b")).first()
    assert (row.a, row.b) == ("rgba(34,197,94,0.25)", "")
    assert scalar.method_id(30, 8e-05, 4) == "k30_r8e-05_n4" and scalar.method_id(30, 0.001, 8) == "k30_r0p001_n8" and scalar.gamma_token(0.001) == "0p001"
