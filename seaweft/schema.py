"""Column names and types of vessel position reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical names, with the names that sources use for them; the first that a table has is taken.
CANDIDATES: dict[str, tuple[str, ...]] = {
    "mmsi": ("MMSI", "mmsi", "vessel_id"),
    "base_date_time": ("BASEDATETIME", "BaseDateTime", "base_date_time", "Timestamp", "DATETIME", "datetime", "timestamp_updated", "timestamp_created", "TIMESTAMP"),
    "lat": ("LAT", "Latitude", "latitude", "lat", "latitude_approximate"),
    "lon": ("LON", "Longitude", "longitude", "lon", "longitude_approximate"),
    "sog": ("SOG", "Speed Over Ground", "speed", "sog", "sog_approximate"),
    "cog": ("COG", "Course Over Ground", "course", "cog"),
    "navstatus": ("NAVSTATUS", "Status", "Navigation Status", "STATUS", "status", "navigational_status", "navstatus"),
}
#: Names of the raw daily files, in the order of the standard table.
RAW_NAMES = {"MMSI": "MMSI", "BaseDateTime": "BASEDATETIME", "LAT": "LAT", "LON": "LON", "SOG": "SOG", "COG": "COG", "Status": "NAVSTATUS"}
RAW_CSV = T.StructType([T.StructField(n, T.StringType()) for n in RAW_NAMES])
STANDARD = {"mmsi": "bigint", "base_date_time": "timestamp_ntz", "lat": "double", "lon": "double", "sog": "double", "cog": "double", "navstatus": "smallint"}


def resolve(df: DataFrame, *names: str) -> dict[str, str]:
    """Canonical name to the column that `df` has for it; a name without a column is left out."""
    have = set(df.columns)
    return {n: next(c for c in CANDIDATES[n] if c in have) for n in names or CANDIDATES if any(c in have for c in CANDIDATES[n])}


def canonical(df: DataFrame, *, keep_others: bool = False) -> DataFrame:
    """The known columns under canonical names and types; what can't be cast is null."""
    found = resolve(df)
    cols = [F.col(f"`{c}`").try_cast(STANDARD[n]).alias(n) for n, c in found.items()]
    others = [F.col(f"`{c}`") for c in df.columns if keep_others and c not in found.values() and c not in found]
    return df.select(*cols, *others)


def require(df: DataFrame, *names: str) -> DataFrame:
    """`df` itself; raises if one of its columns is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"missing columns: {missing}")
    return df
