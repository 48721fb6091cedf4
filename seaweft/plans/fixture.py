"""Vessel-like reports made of the `events` table, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Everything but the seconds of a time is written the same in both engines; constants are doubles in both.
_BODY = """
    SELECT mmsi, base_date_time, event_seq,
      CASE WHEN event_type = 'error' AND event_seq % 50 = 0 THEN 91E0 ELSE lata + fr * (latb - lata) + (event_seq % 13 - 6) * 1E-2 END AS lat,
      lona + fr * (lonb - lona) + (event_seq % 11 - 5) * 1E-2 AS lon,
      CASE WHEN still THEN (event_seq % 6) * 1E-1 ELSE CAST(8 + event_seq % 10 AS DOUBLE) END AS sog,
      CAST((event_seq * 37) % 361 AS DOUBLE) AS cog,
      CASE WHEN NOT still THEN 0 WHEN event_seq % 2 = 0 THEN 1 ELSE 5 END AS navstatus
    FROM (SELECT *, -100E0 + 7E0 * ((pa * 5) % 11) AS lona, 20E0 + 3E0 * ((pa * 7) % 9) AS lata, -100E0 + 7E0 * ((pb * 5) % 11) AS lonb, 20E0 + 3E0 * ((pb * 7) % 9) AS latb,
            (ph < 24E0 OR (ph >= 48E0 AND ph < 72E0)) AS still,
            CASE WHEN ph < 24E0 THEN 0E0 WHEN ph < 48E0 THEN (ph - 24E0) / 24E0 WHEN ph < 72E0 THEN 1E0 ELSE (96E0 - ph) / 24E0 END AS fr
          FROM (SELECT *, hh - 96E0 * floor(hh / 96E0) AS ph FROM (
              SELECT user_id AS mmsi, ts AS base_date_time, event_id AS event_seq, event_type, user_id % 7 AS pa, (user_id * 3 + 1) % 7 AS pb,
                {seconds} / 3600E0 + user_id * 13E0 AS hh FROM {events})))
"""
_SPARK = _BODY.format(seconds="(cast(unix_micros(cast(ts as timestamp)) as double) / 1E6)", events="{events}")
#: The same as the beginning of a DuckDB query.
AIS = "WITH RECURSIVE ais AS (" + _BODY.format(seconds="(cast(epoch_us(ts) as double) / 1E6)", events="events") + ")"


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports; only the five columns that they need are read."""
    return spark.sql(_SPARK, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
