"""Command line: etl, daily, ports, waypoints, corridors, tune, compare, features.

    python -m seaweft.cli ports --input reports.parquet --out out --k 1400 --r 5e-6 --mode 4 [--region region.geojson]
    python -m seaweft.cli tune-waypoints --input reports.parquet --out out --preset 1 --region region_1.geojson
    python -m seaweft.cli daily --input 'days/*.csv' --out out --max-files 3
    python -m seaweft.cli corridors --input reports.parquet --out out --network ports=run/ports waypoints=run/waypoints
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from seaweft import session
from seaweft.operators import features, ingest, tuning
from seaweft.plans import pipeline
from seaweft.plans.regions import REGIONS
from seaweft.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seaweft")
    p.add_argument("task", choices=["etl", "daily", "ports", "waypoints", "corridors", "tune-ports", "tune-waypoints", "compare", "features"])
    p.add_argument("--input", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--region")
    p.add_argument("--k", type=int)
    p.add_argument("--r", type=float)
    p.add_argument("--mode", type=int, default=4, choices=[4, 8])
    p.add_argument("--gamma", type=float, default=5e-3)
    p.add_argument("--slices", type=int, default=15)
    p.add_argument("--radius", type=float, default=0.05)
    p.add_argument("--expected", type=int, nargs=2, help="ports that there should be")
    p.add_argument("--expected-waypoints", type=int, nargs=2, help="waypoints that there should be")
    p.add_argument("--preset", type=int, choices=sorted(REGIONS), help="parameters of a region; its polygon comes from --region")
    p.add_argument("--network", nargs="*", default=[], metavar="NAME=FOLDER", help="folders with the nodes and edges whose corridors are made")
    p.add_argument("--done", help="results of trials that aren't run again")
    p.add_argument("--newest", action="store_true", help="of what --summary matches, take the newest")
    p.add_argument("--max-points", type=int, help="reports to take, the first by vessel and time, for a trial")
    p.add_argument("--gammas", help="gammas of tune-waypoints, as a list")
    p.add_argument("--max-files", type=int, help="daily files to take, the first by name")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--compression", default="zstd")
    p.add_argument("--sog-max", type=float, default=ingest.SOG_MAX)
    p.add_argument("--summary", help="a tuning summary whose best trial is used")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session.build()
    if a.task == "etl":
        print(json.dumps(readers.build_parquet(spark, a.input, a.out, compression=a.compression, overwrite=a.overwrite, sog_max=a.sog_max)))
        return
    if a.task == "daily":
        pipeline.daily_job(spark, a.input, a.out, a.max_files, a.sog_max)
        return
    rings = readers.region(spark, a.region) if a.region else None
    path = readers.newest(spark, a.summary) if a.summary and a.newest else a.summary
    summary = json.loads("\n".join(r[0] for r in spark.read.text(path).collect())) if path else None
    region = replace(REGIONS[a.preset] if a.preset else pipeline.Region(a.region or "all"), rings=rings)
    if a.expected or a.expected_waypoints:
        region = replace(region, ports=tuple(a.expected or region.ports), waypoints=tuple(a.expected_waypoints or region.waypoints))
    trial = tuning.best_params(cli=(a.k, a.r, a.mode) if a.k and a.r else None, summary=summary, default=region.trial)
    region = replace(region, trial=trial, gammas=tuple(tuning.numbers(a.gammas)) if a.gammas else region.gammas)
    points = pipeline.reports_of(spark.read.parquet(readers.must_exist(spark, a.input)), region, a.sog_max, a.max_points)
    if a.task == "features":
        features.engineer(ingest.first_report(ingest.valid_features(points))).write.mode("overwrite").parquet(a.out)
    elif a.task == "ports":
        pipeline.export(pipeline.run_ports(points, trial), a.out)
    elif a.task == "waypoints":
        pipeline.export(pipeline.run_waypoints(points, trial, a.gamma), a.out)
    elif a.task == "corridors" and a.network:
        for name, folder in (x.split("=", 1) for x in a.network):
            layer = pipeline.read_layer(spark, folder)
            pipeline.export(layer, f"{a.out}/{name}", pipeline.run_corridors(points, layer, m=a.slices, radius=a.radius))
    elif a.task == "corridors":
        layer = pipeline.run_ports(points, trial)
        pipeline.export(layer, a.out, pipeline.run_corridors(points, layer, m=a.slices, radius=a.radius))
    else:
        done = spark.read.parquet(a.done) if a.done else None
        result = pipeline.tune_ports(points, region, done=done) if a.task == "tune-ports" else pipeline.tune_waypoints(points, region)
        if a.task == "compare":
            result = tuning.compare(result)
        result.write.mode("overwrite").parquet(a.out)
        if a.task != "compare":
            print(json.dumps(sinks.trial_summary(spark.read.parquet(a.out)), default=str))


if __name__ == "__main__":
    main()
