"""Token ids in Parquet list columns, laid out for selective reads.

Rows lie in ascending key order over the files, in row groups and pages of controlled size with page indexes, and ids
are dictionary-encoded. Lengths and positions are columns of their own, so that planning reads (how many tokens, which
file holds token i) never touch the ids, and a range of keys or of tokens is read by row group and page.

`start` is counted in two steps: within a file while it is written, and over files from one total per file.

Defined results: a null or empty text has only its end id; rows with equal keys are ordered by a hash of their texts and
may lie in several files, so that a key of many texts (null, say) is no file of its own; a null key comes first; an empty table writes a file without rows; other columns aren't written.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import default_path, encoded
from .common import arrow_map, partitions_for, read, shared_dir

END = 1
#: Files up to which their positions are broadcast (some 50 bytes each).
BROADCAST_FILES = 1_000_000
#: Bytes of a row group and of a page, rows of a page, and the codec.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> None:
    """Encode every text, append the end id, and write (key, part, start_in_part, n_tokens, ids) in key order."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in batches:
            for a, b, ids, at in encoded(batch.column(2), path, end):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(written + at[:-1]), pa.array(np.diff(at)), lists], names=["k", "p", "s", "n", "ids"]
                )
                written += int(at[-1])

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions_for(docs, text), *order).sortWithinPartitions(*order, "text")
    ordered = ordered.select("doc_id", F.spark_partition_id().alias("part"), "text")
    kind = docs.schema[key].dataType.simpleString()
    arrow_map(ordered, run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(folder)


def positions(files: DataFrame) -> DataFrame:
    """(part, before, n, longest): ids in all files before each one, in it, and in its longest row. Reads no ids.

    One row per file goes through the window.
    """
    totals = files.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n"), F.max("n_tokens").alias("longest"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).cast("long").alias("before"), "n", "longest")


def _placed(files: DataFrame) -> DataFrame:
    """The files' rows with `start`, counted over all files."""
    at = positions(files).select("part", "before")
    few = files.select("part").distinct().count() <= BROADCAST_FILES
    return files.join(F.broadcast(at) if few else at, "part").withColumn("start", F.col("start_in_part") + F.col("before"))


def lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every row: a read of metadata columns alone."""
    return _placed(spark.read.parquet(folder).drop("ids")).select("doc_id", "start", "n_tokens")


def tokens_between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(doc_id, start, ids) of the ids number first up to last (exclusive) of the whole corpus, cut to them, by document.

    The range's files come from their totals; within a file, rows are sought by bounds on start_in_part that Parquet
    holds against its row groups and pages, so that ids elsewhere aren't read.
    """
    files = spark.read.parquet(folder)
    # The least and greatest file of the range, and its longest row: one row comes to the driver.
    met = positions(files).where((F.col("before") < last) & (F.col("before") + F.col("n") > first))
    low = F.struct("part", "before", "longest")
    at, to, n = met.agg(F.min(low), F.max(low), F.count("*")).first()
    empty = first >= last or not n
    if empty:
        rows = files.where("false").withColumn("start", F.lit(0).cast("long"))
    elif at.part == to.part:
        inside = (F.col("part") == at.part) & (F.col("start_in_part") > first - at.before - at.longest) & (F.col("start_in_part") < last - at.before)
        rows = files.where(inside).withColumn("start", F.col("start_in_part") + F.lit(at.before))
    else:
        inside = (F.col("part") > at.part) & (F.col("part") < to.part)
        inside |= (F.col("part") == at.part) & (F.col("start_in_part") > first - at.before - at.longest)
        inside |= (F.col("part") == to.part) & (F.col("start_in_part") < last - to.before)
        some = files.where(inside)
        rows = some.join(F.broadcast(met.select("part", "before")) if n <= BROADCAST_FILES else met.select("part", "before"), "part").withColumn("start", F.col("start_in_part") + F.col("before"))
    rows = rows.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    take = (F.least(F.lit(last), F.col("start") + F.col("n_tokens")) - F.col("start")).cast("int") - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def documents_between(spark: SparkSession, folder: str, low, high) -> DataFrame:
    """(doc_id, n_tokens, ids) of the keys from low to high, both included: sought by page, as files lie in key order."""
    return spark.read.parquet(folder).where(F.col("doc_id").between(low, high)).select("doc_id", "n_tokens", "ids")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = np.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums)], names=["d", "s", "n", "c"])


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row of the files."""
    files = spark.read.parquet(folder)
    kind = files.schema["doc_id"].dataType.simpleString()
    rows = _placed(files).select("doc_id", "start", "n_tokens", "ids")
    return arrow_map(rows, _checked, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document written as ids and read back."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "documents"), folder)
    return read_back(spark, folder)
