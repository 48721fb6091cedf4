"""The daily feature job: calendar, zones, changes, imputation, clipping, scaling and encoding.

Scaled values go to new columns, and gaps are filled within a vessel, so that raw values stay usable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seaweft.checkpoints import durable
from seaweft.functions import scalar
from seaweft.operators.grid import number

#: Columns that one-hot encoding may make of one.
MOST_COLUMNS = 5_000


def calendar(df: DataFrame) -> DataFrame:
    """Hour, day, weekday (Monday 0), month, ISO week, weekend, time of day."""
    t = F.col("base_date_time")
    return df.withColumns({
        "hour": F.hour(t), "day": F.day(t), "dayofweek": F.weekday(t), "month": F.month(t), "week": F.weekofyear(t),
        "isweekend": (F.weekday(t) >= 5).cast("int"), "timeofday": scalar.time_of_day(F.hour(t)),
    })


def places(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "speed_category": scalar.speed_category(F.col("sog")), "maritimezone": scalar.maritime_zone(F.col("lat"), F.col("lon")),
        "directionquadrant": scalar.compass(F.col("cog")), "distfromreference": scalar.haversine_km(F.col("lat"), F.col("lon")),
    })


def changes(df: DataFrame) -> DataFrame:
    """Change of speed and course since the vessel's report before; 0 for its first."""
    w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
    return df.withColumns({
        "speedchange": F.coalesce(F.col("sog") - F.lag("sog").over(w), F.lit(0.0)),
        "coursechange": scalar.course_change(F.col("cog"), F.lag("cog").over(w)),
    })


def fill(df: DataFrame, columns: Sequence[str], *, whole_table: bool = False) -> DataFrame:
    """Fill gaps forward, then backward, along a vessel's reports (or, as one sequence, along the whole table).

    Only rows before the first known value are filled backward, so that value is the first of all: a frame that starts at
    the current row would be gone through anew for each row.

    The whole table is cut into ranges of the sequence. Each is filled by a window of its own; what it takes from the
    ranges before and after it is found among one row for each range.
    """
    if not whole_table:
        w = Window.partitionBy("mmsi").orderBy("base_date_time", "event_seq")
        past, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(every)) for c in columns})
    order = ["mmsi", "base_date_time", "event_seq"]
    ranges = durable(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ends = ranges.groupBy("__range").agg(*(f(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))).v.alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    # a row for each range, in one task: as many as there are shuffle partitions
    every = Window.orderBy("__range")
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), every.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select("__range", *(F.col(f"__lo_{c}").alias(f"__own_{c}") for c in columns), *(F.last(f"__hi_{c}", ignorenulls=True).over(before).alias(f"__before_{c}") for c in columns), *(F.first(f"__lo_{c}", ignorenulls=True).over(after).alias(f"__after_{c}") for c in columns))
    past = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranges.join(F.broadcast(carried), "__range")
    filled = joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(f"__before_{c}"), F.col(f"__own_{c}"), F.col(f"__after_{c}")) for c in columns})
    return filled.select(*df.columns)


def impute(df: DataFrame, medians: Sequence[str] = ("sog",), modes: Sequence[str] = ("cog",)) -> DataFrame:
    """Nulls of speed-like columns become the median, those of course-like ones the smallest mode."""
    aggs = [F.median(c).alias(f"__{c}") for c in medians] + [F.mode(c, True).alias(f"__{c}") for c in modes]
    if not aggs:
        return df
    one = df.agg(*aggs).first()
    return df.fillna({c: float(one[f"__{c}"]) for c in (*medians, *modes) if one[f"__{c}"] is not None})


def clip_outliers(df: DataFrame, columns: Sequence[str] = ("sog", "cog", "speedchange"), factor: float = 3.0) -> DataFrame:
    """Values beyond `factor` interquartile ranges from the quartiles become that bound."""
    one = df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns)).first()
    for c in columns:
        if one[c] and one[c][0] is not None:
            q1, q3 = one[c]
            df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(q1 - factor * (q3 - q1))), F.lit(q3 + factor * (q3 - q1)))))
    return df


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`<column>_scaled`, between 0 and 1 over the table; a constant column gives 0."""
    one = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for c in columns:
        lo, hi = one[f"lo_{c}"], one[f"hi_{c}"]
        out[f"{c}_scaled"] = F.col(c) * 0.0 if lo is None or hi == lo else (F.col(c) - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return df.withColumns(out)


def factorise(df: DataFrame, column: str, order: Sequence[str] = ("mmsi", "base_date_time", "event_seq")) -> DataFrame:
    """`<column>_encoded`: codes in the order in which values first appear; null is a value."""
    first = durable(df.groupBy(column).agg(F.min(F.struct(*order)).alias("__first")))
    codes = first.join(number(first, "__first", f"{column}_encoded"), "__first").select(F.col(column).alias("__value"), f"{column}_encoded")
    return df.join(F.broadcast(codes) if first.count() <= 10_000 else codes, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """`<column>_<value>` for every value but the first in order; more than MOST_COLUMNS values are an error."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect())
    if len(values) > MOST_COLUMNS:
        raise ValueError(f"{column} has over {MOST_COLUMNS} values: too many to be a column each")
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)) for v in values[1:]})


def engineer(df: DataFrame, *, scaled: Sequence[str] = ("lat", "lon", "sog", "cog", "speedchange", "coursechange", "distfromreference"), encoded: Sequence[str] = ("timeofday", "maritimezone", "directionquadrant", "speed_category"), hot: Sequence[str] = ("timeofday", "maritimezone", "directionquadrant")) -> DataFrame:
    """All features of valid, deduplicated reports."""
    # every later step needs figures of the whole table, so what they are taken from is made once
    out = durable(changes(places(calendar(df))))
    out = durable(scale(clip_outliers(impute(out)), scaled))
    for c in encoded:
        out = factorise(out, c)
    out = durable(out)
    for c in hot:
        out = one_hot(out, c)
    return out
