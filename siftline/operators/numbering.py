"""Numbers in order within groups of any size: no task holds a whole group.

Rows are dealt by ranges of (keys, order), so that a large group lies in many ranges. A row's number is its place among its
group's rows of its range, plus the rows of the group in the ranges before. A range that begins within a group is the only
kind that needs such an offset, so that there are fewer offsets than ranges, whatever the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders


def numbered_rows(rows: DataFrame, keys: list[str], order: list[Column | str], into: str = "n", ranges: int | None = None) -> DataFrame:
    """rows with `into`, from 1 in order within the groups of keys; null keys are a group. Equal rows of the order are numbered in any order."""
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id())
    # Written, as ranges are cut by a sample and must be the same for counts and rows.
    path = folders.shared(spark, "ranges")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), before.alias("_before")).where("_before IS NOT NULL")
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    # Fewer than ranges rows.
    met = dealt.join(F.broadcast(offsets), same, "left")
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbered = met.withColumn(into, place + F.coalesce("_before", F.lit(0)))
    return numbered.drop("_range", "_of", "_before", *[f"_k{i}" for i in range(len(keys))])
