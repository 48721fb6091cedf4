"""Parts of DuckDB queries that several oracles share; each begins with a comma and defines tables."""

from __future__ import annotations

from seaweft.plans.fixture import AIS

VALID = AIS + """, valid AS (SELECT * FROM ais WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180
    AND sog BETWEEN 0 AND 102.4E0 AND cog BETWEEN 0 AND 360 AND navstatus BETWEEN 0 AND 15)"""
STILL = VALID + ", st AS (SELECT * FROM valid WHERE navstatus IN (1, 5) AND sog < 0.5E0)"


def clique(source: str, k: int, r: float, mode: int, p: str = "", least: int | None = None) -> str:
    """{p}lab: the points of `source` with cx, cy and cluster_id."""
    need = str(least) if least else f"(SELECT greatest(1, ceil({r!r}::DOUBLE * n)) FROM {p}b)"
    touch = f"abs(d.cx - w.cx) <= 1 AND abs(d.cy - w.cy) <= 1" if mode == 8 else "abs(d.cx - w.cx) + abs(d.cy - w.cy) <= 1"
    cell = lambda a, o: f"CAST(least(greatest(floor(({a} - {o}0) / {o}s * {k}E0), 0), {k - 1}) AS INTEGER)"
    return f""",
    {p}b AS (SELECT min(lon) AS x0, greatest(max(lon) - min(lon), 1E-12) AS xs, min(lat) AS y0, greatest(max(lat) - min(lat), 1E-12) AS ys, count(*) AS n FROM {source}),
    {p}p AS (SELECT s.*, {cell('lon', 'x')} AS cx, {cell('lat', 'y')} AS cy FROM {source} s, {p}b),
    {p}d AS MATERIALIZED (SELECT cx, cy FROM {p}p GROUP BY cx, cy HAVING count(*) >= {need}),
    {p}w(cx, cy, ox, oy) AS (SELECT cx, cy, cx, cy FROM {p}d UNION SELECT d.cx, d.cy, w.ox, w.oy FROM {p}w w JOIN {p}d d ON {touch}),
    {p}c AS (SELECT cx, cy, dense_rank() OVER (ORDER BY o) - 1 AS cluster_id FROM (SELECT cx, cy, min((ox, oy)) AS o FROM {p}w GROUP BY cx, cy)),
    {p}lab AS (SELECT p.*, coalesce(c.cluster_id, -1) AS cluster_id FROM {p}p p LEFT JOIN {p}c c USING (cx, cy))"""


def hull(lab: str, p: str = "") -> str:
    """{p}hull: cluster_id, n_points, area_deg2, lon, lat of the clusters of `lab` that have a polygon."""
    return f""",
    {p}u AS (SELECT cluster_id, lon, lat, count(*) AS n FROM {lab} WHERE cluster_id <> -1 GROUP BY ALL),
    {p}fit AS (SELECT cluster_id, sum(n) AS n_points, min(lon) AS fx, min(lat) AS fy FROM {p}u GROUP BY cluster_id HAVING count(*) >= 4 AND count(DISTINCT lon) >= 2 AND count(DISTINCT lat) >= 2),
    {p}e AS (SELECT cluster_id, lon, unnest([lo, hi]) AS lat FROM (SELECT cluster_id, lon, min(lat) AS lo, max(lat) AS hi FROM {p}u GROUP BY ALL)),
    {p}v AS (SELECT DISTINCT e.cluster_id, lon - fx AS x, lat - fy AS y FROM {p}e e JOIN {p}fit USING (cluster_id)),
    {p}s AS (SELECT a.cluster_id, a.x AS x1, a.y AS y1, z.x AS x2, z.y AS y2 FROM {p}v a JOIN {p}v z ON a.cluster_id = z.cluster_id AND (a.x, a.y) <> (z.x, z.y)
        WHERE NOT EXISTS (SELECT 1 FROM {p}v q WHERE q.cluster_id = a.cluster_id AND (q.x, q.y) <> (a.x, a.y) AND (q.x, q.y) <> (z.x, z.y)
            AND ((z.x - a.x) * (q.y - a.y) - (z.y - a.y) * (q.x - a.x) < -1E-12
              OR (abs((z.x - a.x) * (q.y - a.y) - (z.y - a.y) * (q.x - a.x)) <= 1E-12 AND (q.x - a.x) * (z.x - q.x) + (q.y - a.y) * (z.y - q.y) > 0)))),
    {p}hull AS (SELECT cluster_id, any_value(n_points) AS n_points, sum(x1 * y2 - x2 * y1) / 2 AS area_deg2,
            any_value(fx) + sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lon,
            any_value(fy) + sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS lat
        FROM {p}s JOIN {p}fit USING (cluster_id) GROUP BY cluster_id HAVING sum(x1 * y2 - x2 * y1) > 1E-12)"""


def moves(source: str, keys: str = "mmsi", order: str = "base_date_time, event_seq", p: str = "") -> str:
    """{p}mv: mmsi, source_port, target_port for each change of cluster along the points of `source`."""
    return f""",
    {p}r AS (SELECT * FROM (SELECT *, lag(cluster_id) OVER (PARTITION BY {keys} ORDER BY {order}) AS pc FROM {source}) WHERE pc IS NULL OR pc <> cluster_id),
    {p}mv AS (SELECT * FROM (SELECT mmsi, cluster_id AS source_port, lead(cluster_id) OVER (PARTITION BY {keys} ORDER BY {order}) AS target_port FROM {p}r) WHERE target_port IS NOT NULL)"""


EDGES = "SELECT source_port, target_port, count(*) AS transition_count, count(DISTINCT mmsi) AS unique_vessels FROM {mv} GROUP BY ALL"


def tracks(source: str = "valid", gap: float = 720.0, least: int = 5) -> str:
    """trk: the points of `source` in tracks with enough points."""
    w = "OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq)"
    return f""",
    g0 AS (SELECT *, (epoch_us(base_date_time) - lag(epoch_us(base_date_time)) {w}) / 6E7 AS gap_minutes FROM {source}),
    g1 AS (SELECT *, sum(CASE WHEN gap_minutes IS NULL OR gap_minutes > {gap!r}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq ROWS UNBOUNDED PRECEDING) AS track_seq FROM g0),
    g2 AS (SELECT *, mmsi || '_' || track_seq AS trajectory_id, row_number() OVER (PARTITION BY mmsi, track_seq ORDER BY base_date_time, event_seq) - 1 AS point_order, count(*) OVER (PARTITION BY mmsi, track_seq) AS n_track FROM g1),
    trk AS MATERIALIZED (SELECT * FROM g2 WHERE n_track >= {least})"""


#: tol: trajectory_id, point_order, lon, lat, tolerance (infinite at the ends) of the points of trk.
_SPLIT = """SELECT z.tid, z.s, z.e, arg_min(q.i, (-q.d, q.i)) AS k, least(max(q.d), z.cap) AS tol FROM ({ranges}) z JOIN LATERAL (
        SELECT i, CASE WHEN dx * dx + dy * dy <= 1E-20 THEN sqrt(px * px + py * py)
            ELSE sqrt(pow(px - dx * least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0E0), 1E0), 2) + pow(py - dy * least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0E0), 1E0), 2)) END AS d
        FROM (SELECT c.point_order AS i, c.lon - a.lon AS px, c.lat - a.lat AS py, b.lon - a.lon AS dx, b.lat - a.lat AS dy FROM xy c, xy a, xy b
            WHERE c.trajectory_id = z.tid AND a.trajectory_id = z.tid AND b.trajectory_id = z.tid AND a.point_order = z.s AND b.point_order = z.e AND c.point_order > z.s AND c.point_order < z.e)) q ON true
    GROUP BY z.tid, z.s, z.e, z.cap"""
TOLERANCE = """,
    xy AS MATERIALIZED (SELECT trajectory_id, point_order, lon, lat FROM trk),
    dp(tid, s, e, k, tol) AS (""" + _SPLIT.format(ranges="SELECT trajectory_id AS tid, 0::BIGINT AS s, max(point_order) AS e, 'infinity'::DOUBLE AS cap FROM xy GROUP BY trajectory_id") + """
        UNION ALL """ + _SPLIT.format(ranges="SELECT tid, unnest([s, k]) AS s, unnest([k, e]) AS e, tol AS cap FROM dp") + """),
    tol AS MATERIALIZED (SELECT t.mmsi, t.trajectory_id, t.point_order, t.event_seq, t.lon, t.lat,
        CASE WHEN t.point_order = 0 OR t.point_order = t.n_track - 1 THEN 'infinity'::DOUBLE ELSE dp.tol END AS tolerance
        FROM trk t LEFT JOIN dp ON dp.tid = t.trajectory_id AND dp.k = t.point_order)"""
