"""Reports as a stream: the batch filters, counts of cells by time, and sessions of vessels. An addition of this engine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from seaweft.operators import ingest


def reports(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stationary(stream: DataFrame) -> DataFrame:
    """Valid stationary reports: the filters have no state, so they are the batch ones."""
    return ingest.stationary(ingest.valid(stream))


def cell_counts(stream: DataFrame, degrees: float = 1.0, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, x, y, n) by tumbling windows of event time; reports later than the watermark are dropped."""
    timed = stream.withColumn("t", F.col("base_date_time").cast("timestamp")).withWatermark("t", late)
    cell = [F.floor(F.col(c) / degrees).alias(n) for c, n in (("lon", "x"), ("lat", "y"))]
    return timed.groupBy(F.window("t", window), *cell).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "x", "y", "n")


def sessions(stream: DataFrame, gap: str = "720 minutes", late: str = "2 hours") -> DataFrame:
    """(mmsi, start, end, n) of a vessel's reports without a longer gap, once the watermark has passed them."""
    timed = stream.withColumn("t", F.col("base_date_time").cast("timestamp")).withWatermark("t", late)
    return timed.groupBy("mmsi", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n")).select("mmsi", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def track_numbers(stream: DataFrame, max_gap_minutes: float = 720.0) -> DataFrame:
    """(mmsi, event_seq, track_seq) for each report as it comes, by state that holds a vessel's last time and track."""
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, track = state.get if state.exists else (None, 0)
        for pdf in [pd.concat(list(parts)).sort_values(["us", "event_seq"])]:
            out = []
            for us in pdf.us:
                if last is None or (us - last) / 6e7 > max_gap_minutes:
                    track += 1
                last = us
                out.append(track)
            state.update((int(last), int(track)))
            yield pd.DataFrame({"mmsi": key[0], "event_seq": pdf.event_seq.to_numpy(), "track_seq": out})

    source = stream.select("mmsi", "event_seq", F.unix_micros(F.col("base_date_time").cast("timestamp")).alias("us"))
    return source.groupBy("mmsi").applyInPandasWithState(step, "mmsi bigint, event_seq bigint, track_seq bigint", "last bigint, track bigint", "append", GroupStateTimeout.NoTimeout)


def to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that takes what is there, writes it to Parquet exactly once and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
