"""What a service around the engine needs: users, uploads, regions, runs in the background, and their results.

Records are appended to Parquet tables of one folder that all executors share; the last record of a key counts.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.functions.geometry import rings_of
from seaweft.sources import readers

#: Columns of each table, the key first; seq orders the records of a key.
TABLES = {
    "users": "user_id bigint, name string, email string, seq bigint",
    "uploads": "upload_id bigint, user_id bigint, path string, kind string, seq bigint",
    "regions": "region_id bigint, name string, polygon string, seq bigint",
    "runs": "run_id string, user_id bigint, stage string, status string, note string, seq bigint",
    "tuning_results": "run_id string, k int, r double, neighbor_mode int, min_dense_points int, score double, seq bigint",
}
STAGES = ("plsn", "nlsn", "rlsn")


class Store:
    """Tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        """Add records; columns that they lack are null."""
        names = [x.split()[0] for x in TABLES[table].split(", ")]
        kinds = dict(x.split() for x in TABLES[table].split(", "))
        rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names)).write.mode("append").parquet(self.path(table))

    def add(self, table: str, **values: object) -> None:
        self.append(table, self.spark.createDataFrame([tuple(values.values())], ", ".join(x for n in values for x in TABLES[table].split(", ") if x.split()[0] == n)))

    def read(self, table: str) -> DataFrame:
        """All records; none if nothing was ever added."""
        if not readers.exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(self.path(table))

    def latest(self, table: str) -> DataFrame:
        """The last record of each key."""
        key, *others = (x.split()[0] for x in TABLES[table].split(", "))
        return self.read(table).groupBy(key).agg(F.max_by(F.struct(*others), "seq").alias("last")).select(key, "last.*")

    def get(self, table: str, key: object) -> dict:
        name = TABLES[table].split()[0]
        row = self.latest(table).where(F.col(name) == F.lit(key)).first()
        if row is None:
            raise KeyError(f"{table} has no {key}")
        return row.asDict()

    def next_seq(self, table: str) -> int:
        return int(self.read(table).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]) + 1


def upload(store: Store, user_id: int, path: str) -> int:
    """Register a Parquet or CSV file of a known user; returns its id."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in ("parquet", "csv"):
        raise ValueError(f"neither Parquet nor CSV: {path}")
    store.get("users", user_id)
    seq = store.next_seq("uploads")
    store.add("uploads", upload_id=seq, user_id=user_id, path=readers.must_exist(store.spark, path), kind=kind, seq=seq)
    return seq


def uploaded(store: Store, upload_id: int) -> DataFrame:
    """The rows of an upload."""
    found = store.get("uploads", upload_id)
    return store.spark.read.parquet(found["path"]) if found["kind"] == "parquet" else store.spark.read.option("header", True).csv(found["path"])


def add_region(store: Store, name: str, geojson: str) -> int:
    """Keep a region; its GeoJSON must have a polygon."""
    if not rings_of(json.loads(geojson)):
        raise ValueError("no polygon")
    seq = store.next_seq("regions")
    store.add("regions", region_id=seq, name=name, polygon=geojson, seq=seq)
    return seq


class Background:
    """Stages of the analysis in threads, each in a scheduler pool of its own; what becomes of them is in table `runs`."""

    def __init__(self, store: Store, workers: int = 2):
        self.store, self.threads = store, ThreadPoolExecutor(workers)

    def start(self, run_id: str, stage: str, job: Callable[[], object], user_id: int | None = None) -> Future:
        """Begin a stage; its status goes from queued to running to completed or failed, with the error as a note."""
        if stage not in STAGES:
            raise ValueError(f"no stage {stage}")
        log = lambda seq, status, note=None: self.store.add("runs", run_id=run_id, user_id=user_id, stage=stage, status=status, note=note, seq=seq)
        log(1, "queued")

        def run() -> object:
            self.store.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{run_id}")
            log(2, "running")
            try:
                out = job()
            except Exception:
                log(3, "failed", traceback.format_exc().splitlines()[-1])
                raise
            log(3, "completed")
            return out

        return self.threads.submit(run)
