"""Readers of raw and standard tables, regions and results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.functions.geometry import rings_of
from seaweft.operators import ingest
from seaweft.schema import RAW_CSV, canonical

#: Names of the 17 columns of the 2025 daily files, and the standard names they get.
DAILY_NAMES = {
    "mmsi": "MMSI", "base_date_time": "BASEDATETIME", "longitude": "LON", "latitude": "LAT", "sog": "SOG", "cog": "COG",
    "heading": "HEADING", "vessel_name": "VESSELNAME", "imo": "IMO", "call_sign": "CALLSIGN", "vessel_type": "VESSELTYPE",
    "status": "NAVSTATUS", "length": "LENGTH", "width": "WIDTH", "draft": "DRAFT", "cargo": "CARGO", "transceiver": "TRANSCEIVER",
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob has a file, in any store that Spark can read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def must_exist(spark: SparkSession, path: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return path


def raw_csv(spark: SparkSession, glob: str) -> DataFrame:
    """Raw daily files as text columns; the header decides which column is which, so their order may differ."""
    df = spark.read.option("header", True).csv(must_exist(spark, glob))
    return df.select(*(F.col(n) for n in RAW_CSV.names if n in df.columns))


def files(spark: SparkSession, glob: str, most: int | None = None) -> list[str]:
    """Paths that a glob has, sorted, the first `most` of them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(must_exist(spark, glob))
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(str(x.getPath().toString()) for x in found)[:most]


def newest(spark: SparkSession, glob: str) -> str:
    """The path of a glob that was changed last; of equals the last by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(must_exist(spark, glob))
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return max((int(x.getModificationTime()), str(x.getPath().toString())) for x in found)[1]


def daily_csv(spark: SparkSession, glob: str, max_files: int | None = None) -> DataFrame:
    """2025 daily files (the first `max_files` by name): unnamed columns dropped, the others under standard names."""
    df = spark.read.option("header", True).csv(files(spark, glob, max_files))
    kept = [c for c in df.columns if c.strip() and not c.startswith(("Unnamed", "_c"))]
    return df.select(*kept).withColumnsRenamed(DAILY_NAMES)


def reports(spark: SparkSession, path: str, needed: Sequence[str] = ("lat", "lon", "mmsi")) -> DataFrame:
    """A Parquet table of reports under canonical names; columns that aren't asked for aren't read.

    Without one of the `needed` columns there is nothing to work on, which is an error.
    """
    out = canonical(spark.read.parquet(must_exist(spark, path)))
    if missing := [c for c in needed if c not in out.columns]:
        raise ValueError(f"{path} has no column for {', '.join(missing)}")
    return out


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Columns of a Parquet table or of a CSV file's header."""
    return (spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)).columns


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table, from its footers."""
    return spark.read.parquet(path).count()


def region(spark: SparkSession, path: str) -> list[list[list[float]]]:
    """Rings of a GeoJSON file's polygon."""
    text = "\n".join(r[0] for r in spark.read.text(must_exist(spark, path), wholetext=True).collect())
    return rings_of(json.loads(text))


def table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(must_exist(spark, path))


def build_parquet(spark: SparkSession, glob: str, to: str, *, compression: str = "zstd", block_bytes: int = 128 << 20, overwrite: bool = False, sog_max: float = ingest.SOG_MAX) -> dict[str, int]:
    """Raw CSV to valid standard reports in Parquet; returns the drop counts."""
    if compression not in ("zstd", "snappy", "gzip", "brotli"):
        raise ValueError(f"unknown compression: {compression}")
    if exists(spark, to) and not overwrite:
        raise FileExistsError(to)
    std = ingest.standardise(raw_csv(spark, glob))
    counts = ingest.drop_report(std, sog_max).first().asDict()
    names = {"mmsi": "MMSI", "base_date_time": "BASEDATETIME", "lat": "LAT", "lon": "LON", "sog": "SOG", "cog": "COG", "navstatus": "NAVSTATUS"}
    good = ingest.narrow(ingest.valid(ingest.drop_null_core(std), sog_max)).withColumnsRenamed(names)
    good.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).option("parquet.block.size", block_bytes).parquet(to)
    return counts
