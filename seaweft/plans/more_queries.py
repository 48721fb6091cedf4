"""Queries of features, windows, limits, samples, sets, reports and generic relational operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seaweft.functions import scalar
from seaweft.operators import features, ingest, sampling, tuning
from seaweft.plans import sql
from seaweft.plans.core_queries import _long, valid
from seaweft.plans.fixture import ais
from seaweft.plans.registry import query
from seaweft.sources import sinks

_W = "OVER (PARTITION BY mmsi ORDER BY base_date_time, event_seq)"


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- features

@query("fn1_haversine", sql.VALID + " SELECT event_seq, round(2 * 6371E0 * asin(sqrt(pow(sin(radians(lat - 32E0) / 2), 2) + cos(radians(32E0)) * cos(radians(lat)) * pow(sin(radians(lon + 77E0) / 2), 2))), 4) AS km FROM valid")
def _(s, d):
    return valid(s, d).select("event_seq", F.round(scalar.haversine_km(F.col("lat"), F.col("lon")), 4).alias("km"))


@query("fn2_compass", sql.VALID + """ SELECT CASE WHEN cog >= 22.5 AND cog < 67.5 THEN 'NE' WHEN cog >= 67.5 AND cog < 112.5 THEN 'E' WHEN cog >= 112.5 AND cog < 157.5 THEN 'SE' WHEN cog >= 157.5 AND cog < 202.5 THEN 'S'
    WHEN cog >= 202.5 AND cog < 247.5 THEN 'SW' WHEN cog >= 247.5 AND cog < 292.5 THEN 'W' WHEN cog >= 292.5 AND cog < 337.5 THEN 'NW' ELSE 'N' END AS direction, count(*) AS n, min(cog) AS low, max(cog) AS high FROM valid GROUP BY 1""")
def _(s, d):
    return valid(s, d).groupBy(scalar.compass(F.col("cog")).alias("direction")).agg(F.count("*").alias("n"), F.min("cog").alias("low"), F.max("cog").alias("high"))


@query("fn3_calendar", """SELECT event_id AS event_seq, hour(ts) AS hour, day(ts) AS day, (isodow(ts) - 1) AS dayofweek, month(ts) AS month, week(ts) AS week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END::BIGINT AS isweekend,
    CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'Morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'Afternoon' WHEN hour(ts) BETWEEN 18 AND 23 THEN 'Evening' ELSE 'Night' END AS timeofday FROM events""")
def _(s, d):
    return _long(features.calendar(ais(s, d)).select("event_seq", "hour", "day", "dayofweek", "month", "week", "isweekend", "timeofday"))


@query("fn5_speed_category", sql.VALID + " SELECT CASE WHEN sog BETWEEN 0 AND 5 THEN 'Stationary' WHEN sog <= 15 THEN 'Slow' WHEN sog <= 25 THEN 'Medium' WHEN sog <= 100 THEN 'Fast' END AS category, count(*) AS n FROM valid GROUP BY 1")
def _(s, d):
    return valid(s, d).groupBy(scalar.speed_category(F.col("sog")).alias("category")).agg(F.count("*").alias("n"))


@query("fn6_maritime_zone", sql.VALID + """ SELECT CASE WHEN lat > 24 AND lat < 31 AND lon > -87 AND lon < -80 THEN 'Gulf of Mexico' WHEN lat > 39 AND lat < 45 AND lon > -76 AND lon < -70 THEN 'Northeast Coast'
    WHEN lat > 33 AND lat < 36 AND lon > -79 AND lon < -75 THEN 'Mid-Atlantic' WHEN lat > 47 AND lat < 50 AND lon > -125 AND lon < -120 THEN 'Pacific Northwest' ELSE 'Other' END AS zone, count(*) AS n FROM valid GROUP BY 1""")
def _(s, d):
    return valid(s, d).groupBy(scalar.maritime_zone(F.col("lat"), F.col("lon")).alias("zone")).agg(F.count("*").alias("n"))


_CHANGES = sql.VALID + f", ch AS (SELECT *, coalesce(sog - lag(sog) {_W}, 0) AS speedchange, coalesce(least(abs(cog - lag(cog) {_W}), 360 - abs(cog - lag(cog) {_W})), 0) AS coursechange FROM valid)"


@query("win7_changes", _CHANGES + " SELECT event_seq, round(speedchange, 6) AS speedchange, round(coursechange, 6) AS coursechange FROM ch")
def _(s, d):
    return features.changes(valid(s, d)).select("event_seq", F.round("speedchange", 6).alias("speedchange"), F.round("coursechange", 6).alias("coursechange"))


_GAPS = sql.VALID + ", gp AS (SELECT * EXCLUDE (sog), CASE WHEN event_seq % 3 = 0 THEN sog END AS sog FROM valid)"


def _gaps(s, d):
    return valid(s, d).withColumn("sog", F.when(F.col("event_seq") % 3 == 0, F.col("sog")))


def _fill_sql(keys, order):
    part = f"PARTITION BY {keys}" if keys else ""
    return f" SELECT event_seq, coalesce(last_value(sog IGNORE NULLS) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING), first_value(sog IGNORE NULLS) OVER ({part} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sog FROM gp"


@query("win8_fill_by_vessel", _GAPS + _fill_sql("mmsi", "base_date_time, event_seq"))
def _(s, d):
    return features.fill(_gaps(s, d), ["sog"]).select("event_seq", "sog")


@query("win8_fill_whole_table", _GAPS + _fill_sql("", "mmsi, base_date_time, event_seq"))
def _(s, d):
    return features.fill(_gaps(s, d), ["sog"], whole_table=True).select("event_seq", "sog")


@query("win9_first_report", "SELECT user_id AS mmsi, min(event_id) AS event_seq FROM (SELECT user_id, date_trunc('hour', ts) AS h, event_id FROM events) GROUP BY user_id, h")
def _(s, d):
    hourly = ais(s, d).withColumn("base_date_time", F.date_trunc("hour", "base_date_time"))
    return ingest.first_report(hourly).select("mmsi", "event_seq")


@query("fn12_imputation", _GAPS + """, gm AS (SELECT * EXCLUDE cog, CASE WHEN event_seq % 5 = 0 THEN NULL ELSE round(cog / 30) * 30 END AS cog FROM gp)
    SELECT event_seq, coalesce(sog, (SELECT median(sog) FROM gm))::DOUBLE AS sog, coalesce(cog, (SELECT cog FROM gm WHERE cog IS NOT NULL GROUP BY cog ORDER BY count(*) DESC, cog LIMIT 1))::DOUBLE AS cog FROM gm""")
def _(s, d):
    gaps = _gaps(s, d).withColumn("cog", F.when(F.col("event_seq") % 5 != 0, F.round(F.col("cog") / 30) * 30))
    return features.impute(gaps).select("event_seq", "sog", "cog")


@query("agg16_quantiles_mode", sql.VALID + " SELECT round(quantile_cont(sog, 0.25), 6) AS q1, round(median(sog), 6) AS q2, round(quantile_cont(sog, 0.75), 6) AS q3, (SELECT cog FROM valid GROUP BY cog ORDER BY count(*) DESC, cog LIMIT 1) AS mode_cog FROM valid")
def _(s, d):
    return valid(s, d).agg(F.round(F.percentile("sog", 0.25), 6).alias("q1"), F.round(F.median("sog"), 6).alias("q2"), F.round(F.percentile("sog", 0.75), 6).alias("q3"), F.mode("cog", True).alias("mode_cog"))


@query("fn8_outlier_clip", _CHANGES + """, q AS (SELECT quantile_cont(speedchange, 0.25) AS a, quantile_cont(speedchange, 0.75) AS b FROM ch)
    SELECT event_seq, round(least(greatest(speedchange, a - 0.5E0 * (b - a)), b + 0.5E0 * (b - a)), 6) AS speedchange FROM ch, q""")
def _(s, d):
    return features.clip_outliers(features.changes(valid(s, d)), ["speedchange"], 0.5).select("event_seq", F.round("speedchange", 6).alias("speedchange"))


@query("fn9_min_max_scaling", sql.VALID + " SELECT event_seq, round((lat - (SELECT min(lat) FROM valid)) / (SELECT max(lat) - min(lat) FROM valid), 6) AS lat_scaled FROM valid")
def _(s, d):
    return features.scale(valid(s, d), ["lat"]).select("event_seq", F.round("lat_scaled", 6).alias("lat_scaled"))


@query("fn10_factorise", sql.VALID + ", z AS (SELECT *, CASE WHEN cog < 120 THEN 'low' WHEN cog < 240 THEN 'mid' ELSE 'high' END AS band FROM valid), f AS (SELECT band, row_number() OVER (ORDER BY min((mmsi, base_date_time, event_seq))) - 1 AS band_encoded FROM z GROUP BY 1) SELECT band, band_encoded, count(*) AS n FROM z JOIN f USING (band) GROUP BY ALL")
def _(s, d):
    z = valid(s, d).withColumn("band", F.when(F.col("cog") < 120, "low").when(F.col("cog") < 240, "mid").otherwise("high"))
    return _long(features.factorise(z, "band").groupBy("band", "band_encoded").agg(F.count("*").alias("n")))


@query("fn11_one_hot", "SELECT event_id AS event_seq, event_type = 'error' AS event_type_error, event_type = (SELECT max(event_type) FROM events) AS is_last FROM events")
def _(s, d):
    e = table(s, d, "events")
    hot = features.one_hot(e, "event_type")
    return hot.select(F.col("event_id").alias("event_seq"), "event_type_error", F.col(hot.columns[-1]).alias("is_last"))


@query("features_daily_job", _CHANGES + " SELECT count(*) AS n, round(avg((lat - (SELECT min(lat) FROM valid)) / (SELECT max(lat) - min(lat) FROM valid)), 6) AS mean_lat_scaled, round(sum(coursechange), 3) AS sum_course FROM ch")
def _(s, d):
    out = features.engineer(ingest.first_report(valid(s, d)))
    return out.agg(F.count("*").alias("n"), F.round(F.avg("lat_scaled"), 6).alias("mean_lat_scaled"), F.round(F.sum("coursechange"), 3).alias("sum_course"))


# ---------------------------------------------------------------- sort, limit, sample, sets

@query("lim1_first_reports", sql.VALID + " SELECT event_seq FROM valid ORDER BY mmsi, base_date_time, event_seq LIMIT 500")
def _(s, d):
    return sampling.first_reports(valid(s, d), 500).select("event_seq")


@query("top1_longest_tracks", sql.VALID + sql.tracks() + " SELECT trajectory_id, count(*) AS n FROM trk GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    from seaweft.operators import trajectory
    return trajectory.tracks(valid(s, d)).groupBy("trajectory_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "trajectory_id").limit(10)


@query("smp1_hash_sample")
def _(s, d):
    return sampling.sample_rows(valid(s, d), 400).select("event_seq", "lon", "lat")


@query("smp2_share_sample")
def _(s, d):
    return sampling.sample_share(valid(s, d), 0.1).select("event_seq")


@query("smp3_track_sample")
def _(s, d):
    from seaweft.operators import trajectory
    return sampling.sample_tracks(trajectory.tracks(valid(s, d)), 50).select("trajectory_id", "event_seq")


@query("fn16_map_points")
def _(s, d):
    return sampling.map_points(valid(s, d), 400)


@query("set1_union_of_days", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events")
    both = e.where(F.dayofmonth("ts") <= 10).unionByName(e.where(F.dayofmonth("ts") > 10))
    return both.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("set4_pending_trials", "SELECT k, r, neighbor_mode FROM (SELECT unnest([20, 30, 50]::BIGINT[]) AS k), (SELECT unnest([1E-5, 1E-4]) AS r), (SELECT unnest([4, 8]::BIGINT[]) AS neighbor_mode) WHERE NOT (k = 30 AND neighbor_mode = 4)")
def _(s, d):
    wanted = s.createDataFrame([(t.k, t.r, t.neighbor_mode, t.min_dense_points) for t in tuning.trials((20, 30, 50), (1e-5, 1e-4), (4, 8))], "k int, r double, neighbor_mode int, min_dense_points int")
    done = s.createDataFrame([(30, r, "4.0", None) for r in (1e-5, 1e-4)], "k int, r double, neighbor_mode string, min_dense_points int").withColumn("neighbor_mode", F.col("neighbor_mode").cast("double"))
    return _long(tuning.pending(wanted, done).select("k", "r", "neighbor_mode"))


@query("set5_parameter_grid", "SELECT k, r, m FROM (SELECT unnest([20, 30]::BIGINT[]) AS k), (SELECT unnest([1E-5, 1E-4]) AS r), (SELECT unnest([4, 8]::BIGINT[]) AS m)")
def _(s, d):
    return s.createDataFrame([(t.k, t.r, t.neighbor_mode) for t in tuning.trials((20, 30), (1e-5, 1e-4), (4, 8))], "k bigint, r double, m bigint")


@query("set6_union_of_layers", sql.STILL + " SELECT 'reports' AS layer, count(*) AS n FROM valid UNION ALL SELECT 'stationary', count(*) FROM st UNION ALL SELECT 'moving', count(*) FROM valid WHERE navstatus = 0")
def _(s, d):
    v = valid(s, d)
    layers = {"reports": v, "stationary": ingest.stationary(v), "moving": v.where("navstatus = 0")}
    out = None
    for name, df in layers.items():
        one = df.agg(F.lit(name).alias("layer"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk10_latest_status", "SELECT user_id::VARCHAR AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def _(s, d):
    log = table(s, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("note"), F.col("event_id").alias("seq"))
    return sinks.latest_status(log).select("run_id", "status", "seq")


def _status_log(s, d):
    return table(s, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("status"), F.lit(None).cast("string").alias("note"), F.col("event_id").alias("seq"))


@query("flt12_completed_runs", "SELECT run_id FROM (SELECT user_id::VARCHAR AS run_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1) WHERE status = 'purchase'")
def _(s, d):
    return sinks.runs_with(_status_log(s, d), "purchase").select("run_id")


@query("fn20_edge_style", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
      CASE WHEN l_discount::DOUBLE / 0.1E0 < 0.33E0 THEN '#3b82f6' WHEN l_discount::DOUBLE / 0.1E0 < 0.66E0 THEN '#f59e0b' ELSE '#ef4444' END AS colour,
      round(1E0 + 7E0 * (l_quantity::DOUBLE / 50E0), 6) AS width, round(5E0 + 17E0 * sqrt(greatest(l_quantity::DOUBLE, 1E0) / 50E0), 6) AS radius,
      'rgba(' || floor(255E0 + l_quantity::DOUBLE / 50E0 * -221E0)::BIGINT || ',' || floor(59E0 + l_quantity::DOUBLE / 50E0 * 138E0)::BIGINT || ',' || floor(59E0 + l_quantity::DOUBLE / 50E0 * 35E0)::BIGINT || ',0.25)' AS score_colour FROM lineitem""")
def _(s, d):
    n, share = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") / F.lit(0.1)
    return _long(table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.edge_colour(share).alias("colour"), F.round(scalar.edge_width(n, F.lit(50.0)), 6).alias("width"),
        F.round(scalar.node_radius(n, F.lit(50.0)), 6).alias("radius"), scalar.score_colour(n, F.lit(0.0), F.lit(50.0)).alias("score_colour"),
    ))


# ---------------------------------------------------------------- the relational operators on the generic tables

@query("rel_edge_aggregation", "SELECT o_custkey, count(*) AS n_items, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("n_items"), F.countDistinct("l_suppkey").alias("n_suppliers"))


@query("rel_first_row_of_key", "SELECT l_orderkey, min(l_linenumber)::BIGINT AS l_linenumber FROM lineitem GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return _long(table(s, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_linenumber"))


@query("rel_run_length", "SELECT o_custkey, count(*) AS changes FROM (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NULL OR p <> o_orderstatus GROUP BY 1")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").withColumn("p", F.lag("o_orderstatus").over(w)).where("p is null or p != o_orderstatus").groupBy("o_custkey").agg(F.count("*").alias("changes"))


@query("rel_lookup_join", "SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(s, d):
    j = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


@query("rel_anti_join", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n"))
