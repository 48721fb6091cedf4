"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaweft.checkpoints import durable, shared_dir

__all__ = ["bound_batches", "crc_mod", "durable", "fit_once", "join_hot", "labelled_sample", "read_table", "rows_of", "shared_dir", "text_list"]

#: Rows and bytes that one Arrow batch may hold, which bounds what a Python worker keeps at once.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def join_hot(left: DataFrame, right: DataFrame, key: str, by: str, salts: int = 16) -> DataFrame:
    """Inner join on `key`, which is unique in `right`, with the rows of a key in `left` dealt over several tasks by `by`."""
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"]).drop("__salt")


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key written as text, modulo `mod`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, mod: int | None, held: int, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text, label) of at most `bound` labelled documents, the lowest by a hash of the id.

    Rows with crc32(id) mod `mod` equal to `held` are never used (mod None: no row is held out). The bound holds for
    distinct ids, so the broadcast side has at most `bound` rows of two numbers at any corpus size.
    """
    kept = labels.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label is not null")
    if mod is not None:
        kept = kept.where(crc_mod(F.col("key"), mod) != held)
    chosen = kept.groupBy("key").agg(F.max("label").alias("label")).orderBy(F.xxhash64("key"), "key").limit(bound)
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "key")


def fit_once(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """Run `fit` over the bounded sample in a single executor task and return the model it makes.

    The rows are sorted first, so the same rows give the same model whatever the partitioning.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), key=repr)
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(rows), protocol=4)]})

    bound_batches(sample.sparkSession)
    made = sample.repartition(1).mapInArrow(task, "model binary").first()
    return pickle.loads(made[0]) if made else fit([])  # Spark may drop the task of an empty sample


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (b for b in batches if b.num_rows)


def text_list(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
