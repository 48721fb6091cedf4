"""Standard columns, validity rules and the stationary filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaweft.schema import RAW_NAMES, STANDARD, require

CORE = tuple(STANDARD)
SOG_MAX = 102.4


def standardise(df: DataFrame) -> DataFrame:
    """Raw daily columns under standard names, coerced (what can't be cast is null). Every raw column must be there."""
    require(df, *RAW_NAMES)
    kinds = dict(zip(RAW_NAMES, STANDARD.values()))
    cast = {n: F.col(n).try_cast("double").try_cast("smallint") if kinds[n] == "smallint" else F.col(n).try_cast(kinds[n]) for n in RAW_NAMES}
    return df.select(*(cast[raw].alias(canon) for raw, canon in zip(RAW_NAMES, STANDARD)))


def narrow(df: DataFrame) -> DataFrame:
    """Storage types of the standard table: 32-bit floats and a 16-bit status."""
    small = {"lat": "float", "lon": "float", "sog": "float", "cog": "float", "navstatus": "smallint", "mmsi": "bigint"}
    return df.select(*(F.col(c).cast(small[c]).alias(c) if c in small else F.col(c) for c in df.columns))


def drop_null_core(df: DataFrame, columns: Sequence[str] = CORE) -> DataFrame:
    return df.na.drop(subset=list(columns))


def geo_ok() -> Column:
    return F.col("lat").between(-90.0, 90.0) & F.col("lon").between(-180.0, 180.0)


def valid(df: DataFrame, sog_max: float = SOG_MAX) -> DataFrame:
    """Positions on the globe with plausible speed, course and status; every bound belongs to its range."""
    return df.where(geo_ok() & F.col("sog").between(0.0, sog_max) & F.col("cog").between(0.0, 360.0) & F.col("navstatus").between(0, 15))


def valid_features(df: DataFrame, sog_max: float = 100.0) -> DataFrame:
    """The rule of the feature job: no status, and vessel and time must be there."""
    return df.where(geo_ok() & F.col("sog").between(0.0, sog_max) & F.col("cog").between(0.0, 360.0)).na.drop(subset=["mmsi", "lat", "lon", "base_date_time"])


def drop_report(df: DataFrame, sog_max: float = SOG_MAX) -> DataFrame:
    """One row of counts: read, kept, null in a core column, and invalid by rule. A row may break several rules."""
    full = F.lit(True)
    for c in CORE:
        full = full & F.col(c).isNotNull()
    rules = {"geo": geo_ok(), "nav": F.col("navstatus").between(0, 15), "sog": F.col("sog").between(0.0, sog_max), "cog": F.col("cog").between(0.0, 360.0)}
    every = full
    for r in rules.values():
        every = every & r
    return df.agg(
        F.count("*").alias("rows_in"), F.count_if(every).alias("rows_out"), F.count_if(~full).alias("dropped_null_core"),
        *(F.count_if(full & ~r).alias(f"dropped_invalid_{n}") for n, r in rules.items()),
    )


def stationary(df: DataFrame, statuses: Sequence[int] = (1, 5), sog_below: float = 0.5) -> DataFrame:
    """Reports of vessels at anchor or moored: status as given, speed strictly below, everything else known."""
    keep = F.col("navstatus").isin(*statuses) & (F.col("sog") < sog_below) & F.col("mmsi").isNotNull() & geo_ok()
    if "base_date_time" in df.columns:
        keep = keep & F.col("base_date_time").isNotNull()
    return df.where(keep)


def stationary_report(df: DataFrame, sog_below: float = 0.5) -> DataFrame:
    """Anchored and moored reports, counted before the other conditions."""
    slow = F.col("sog") < sog_below
    return df.agg(F.count_if((F.col("navstatus") == 1) & slow).alias("anchored"), F.count_if((F.col("navstatus") == 5) & slow).alias("moored"))


def track_input(df: DataFrame) -> DataFrame:
    """What trajectories are made of: vessel, place and time known and on the globe."""
    return df.where(F.col("mmsi").isNotNull() & geo_ok() & F.col("base_date_time").isNotNull())


def in_box(df: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float) -> DataFrame:
    """Inclusive range filter; both ranges reach the Parquet scan."""
    return df.where(F.col("lon").between(lon_min, lon_max) & F.col("lat").between(lat_min, lat_max))


def first_report(df: DataFrame, order: str = "event_seq") -> DataFrame:
    """The first of the reports of one vessel at one time, by an explicit order."""
    from pyspark.sql import Window
    w = Window.partitionBy("mmsi", "base_date_time").orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
