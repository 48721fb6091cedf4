"""Writers of results: Parquet by day, CSV, GeoJSON, trials, catalog tables and a plain HTML report."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seaweft.operators.network import polygon_json
from seaweft.operators.tuning import ranked


def by_day(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    """Reports in a folder for each day; a query for a day reads its folder alone."""
    df.withColumn("day", F.to_date("base_date_time")).repartition("day", F.pmod(F.xxhash64("mmsi"), F.lit(8))).write.mode(mode).partitionBy("day").option("compression", compression).parquet(path)


def single_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def features_geojson(df: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """(value) one line of text: a FeatureCollection. The rows are polygons or routes, few by nature."""
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), F.col(geometry), F.lit("}"))
    crs = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"EPSG:4326"}},"features":['
    return df.agg(F.concat(F.lit(crs), F.concat_ws(",", F.sort_array(F.collect_list(feature))), F.lit("]}")).alias("value"))


def boundaries_geojson(hulls: DataFrame) -> DataFrame:
    return features_geojson(hulls.withColumn("g", polygon_json("ring")), "g", "cluster_id")


def line_json(line: str) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(F.col(line), lambda p: F.array(p.lon, p.lat)).alias("coordinates")))


def routes_geojson(routes: DataFrame) -> DataFrame:
    return features_geojson(routes.withColumn("g", line_json("line")), "g", "source", "target")


def corridors_geojson(routes: DataFrame) -> DataFrame:
    return features_geojson(routes.withColumn("g", polygon_json("corridor")), "g", "source", "target")


def text_file(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)


def append_trials(results: DataFrame, path: str) -> None:
    """Results so far, added to the trials table."""
    results.write.mode("append").parquet(path)


def trial_summary(results: DataFrame, top: int = 10) -> dict:
    """best_trial, top trials and number of trials."""
    rows = [r.asDict() for r in ranked(results).limit(top).collect()]
    return {"n_trials": results.count(), "best_trial": rows[0] if rows else None, f"top_{top}": rows}


def save_table(df: DataFrame, name: str, run_id: str | None = None) -> None:
    """Add rows to a catalog table, under a run's id if given."""
    (df if run_id is None else df.withColumn("run_id", F.lit(run_id))).write.mode("append").saveAsTable(name)


def log_status(spark: SparkSession, table: str, run_id: str, status: str, seq: int, note: str | None = None) -> None:
    """Statuses are appended; the latest one is the run's."""
    spark.createDataFrame([(run_id, status, seq, note)], "run_id string, status string, seq bigint, note string").write.mode("append").saveAsTable(table)


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("note", "seq").alias("note"), F.max("seq").alias("seq"))


def runs_with(log: DataFrame, status: str) -> DataFrame:
    """Runs whose latest status is the given one."""
    return latest_status(log).where(F.col("status") == status)


def ranked_nodes(nodes: DataFrame, count_name: str) -> DataFrame:
    """Nodes with rank (from 1), share rank and colour, the busiest first."""
    from seaweft.functions.scalar import node_radius, rank_colour
    w = Window.orderBy(F.desc(count_name), "port_id")  # nodes are few: one for each polygon
    every = Window.partitionBy()
    rank = F.row_number().over(w)
    return nodes.withColumn("rank", rank).withColumn("colour", rank_colour(F.col("rank") - 1, F.count("*").over(every))).withColumn("radius", node_radius(F.col(count_name), F.max(count_name).over(every)))


def report_html(title: str, **tables: DataFrame) -> str:
    """A page of tables, for results that are small by nature."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(json.dumps(v, default=str))}" for v in r) for r in df.collect())
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>")
    return "".join(parts)
