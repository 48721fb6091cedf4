"""Queries on tolerances against their SQL, on vessels whose tracks have points at equal distances to the last bit or so."""

import duckdb
import pytest

from seaweft.plans import catalog
from tests.test_queries import plain

#: Vessels of sf0.1, beyond 1,499 of copies with shifted keys.
VESSELS = (519, 1193, 1666, 2236, 3297, 4949, 5583, 6002, 8417, 12574, 20778, 45239, 47637)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("vessels")
    duckdb.sql(f"""COPY (SELECT event_id + v // 1500 * 100000 AS event_id, ts, v AS user_id, event_type, value, props
        FROM '/root/testdata/sf0.1/events.parquet', (SELECT unnest({list(VESSELS)}::BIGINT[]) AS v) WHERE user_id = v % 1500 ORDER BY event_id) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


def differs(spark, root, name):
    df = catalog.QUERIES[name](spark, root)
    cols = sorted(df.columns)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{root}/events.parquet'")
        want = c.sql(catalog.ORACLE_SQL[name]).select(*cols).fetchall()
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    return rows(want) != rows(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", [
    "alg12_waypoint_sweep",
    "alg5_feature_points",
    "alg5_tolerances",
    "alg6_ld_metrics",
    "alg8_descend_gamma",
    "nlsn_nodes",
])
def test_ties_are_those_of_sql(spark, root, name):
    assert not differs(spark, root, name)


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Vessels of which every report is there six times."""
    path = tmp_path_factory.mktemp("copied")
    duckdb.sql(f"""COPY (SELECT event_id + i * 100000 AS event_id, ts, user_id, event_type, value, props
        FROM '/root/testdata/sf0.1/events.parquet', range(6) r(i) WHERE user_id IN (31, 101, 104, 262, 598, 1396) ORDER BY event_id) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


@pytest.mark.parametrize("name", ["alg15_whole_vessel_tracks", "agg7_compression_totals", "alg7_best_gamma"])
def test_ties_of_repeated_reports_are_those_of_sql(spark, copied, name):
    assert not differs(spark, copied, name)


def test_best_gammas_are_those_of_sql(spark, tmp_path):
    """Two vessels of a copy with shifted keys; each has a track whose best gamma is another if equal distances split otherwise."""
    duckdb.sql(f"""COPY (SELECT event_id + v // 1500 * 100000 AS event_id, ts, v AS user_id, event_type, value, props
        FROM '/root/testdata/sf0.1/events.parquet', (SELECT unnest([4000, 5378]::BIGINT[]) AS v) WHERE user_id = v % 1500 ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    assert not differs(spark, str(tmp_path), "alg7_best_gamma")
