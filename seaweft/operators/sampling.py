"""Samples and limits that give the same rows each time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seaweft.operators.ingest import geo_ok

#: Ids of a sample that are broadcast, at most.
BROADCAST_IDS = 100_000


def sample_rows(df: DataFrame, n: int, key: Sequence[str] = ("event_seq",), seed: int = 42) -> DataFrame:
    """n rows, those with the lowest hash of their key: a sample for a map, whatever the partitioning."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def sample_share(df: DataFrame, share: float, key: Sequence[str] = ("event_seq",), seed: int = 42) -> DataFrame:
    """About a share of the rows, by a threshold on the hash of the key: no shuffle."""
    return df.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def _small(ids: DataFrame, n: int) -> DataFrame:
    """n ids, broadcast if n is small."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def first_vessels(df: DataFrame, n: int) -> DataFrame:
    """Reports of the n vessels with the lowest number."""
    return df.join(_small(df.select("mmsi").distinct().orderBy("mmsi").limit(n), n), "mmsi", "left_semi")


def sample_tracks(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All points of n tracks."""
    ids = df.select("trajectory_id").distinct().orderBy(F.xxhash64("trajectory_id", F.lit(seed)), "trajectory_id").limit(n)
    return df.join(_small(ids, n), "trajectory_id", "left_semi")


def first_reports(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy("mmsi", "base_date_time", "event_seq").limit(n)


def map_points(df: DataFrame, n: int, digits: int = 5) -> DataFrame:
    """Rounded 32-bit places of a sample, for a map."""
    return sample_rows(df.where(geo_ok()), n).select(F.round(F.col("lat").cast("float"), digits).alias("lat"), F.round(F.col("lon").cast("float"), digits).alias("lon"))
