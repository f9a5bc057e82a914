"""Helpers that the training-data operators share: table reading, checkpointing, input sizing."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import give_back, ship

#: Bytes of a batch that a Python worker is given at once, unless the session asks for less.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Matches one character of a word (Java regular expression).
WORD_CHAR = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; a local one only in a session without executors."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def partitions_for(docs: DataFrame, column: str = "text", target_bytes: int = 16 << 20) -> int:
    """How many partitions of about target_bytes the column makes; at least the session's cores."""
    total = docs.agg(F.sum(F.octet_length(F.col(column))).alias("b")).first()["b"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // target_bytes))


def words_of(text):
    """Words of a text column, as an array without empty strings; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without the columns that an operator adds: what it adds replaces a column of the same name."""
    lower = {n.lower() for n in names}
    if not any(c.lower() in lower for c in docs.columns):
        return docs
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in lower])


def arrow_map(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a worker gives back the memory of a task at its end."""
    spark = df.sparkSession
    ship(spark)
    if int("".join(filter(str.isdigit, spark.conf.get(BATCH_CONF))) or 0) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)
