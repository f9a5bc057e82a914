"""Tables in buckets by key, upserted by rewriting the buckets of the new keys alone.

A batch's rows go, with the old rows of their buckets that it doesn't replace, into a new folder; one row of the log then
says which buckets are read from there. A batch whose id the log knows changes nothing, so that it can be sent again after
a failure; a folder without its row is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import exists

LOG = "version long, batch string, folder string, buckets array<int>, count int"


class BucketTable:
    """A table in a folder, by key; count buckets, fixed by the first batch."""

    def __init__(self, spark: SparkSession, folder: str, key: str, count: int = 64):
        self.spark, self.folder, self.key, self.count = spark, folder, key, count
        self.batches: set[str] = set()
        #: Where each bucket is read from.
        self.places: dict[int, str] = {}
        self.version = 0
        if exists(spark, f"{folder}/log"):
            for r in spark.read.schema(LOG).parquet(f"{folder}/log").orderBy("version").collect():  # a row per batch
                self.batches.add(r.batch)
                self.version, self.count = r.version, r["count"]
                self.places.update(dict.fromkeys(r.buckets, r.folder))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.count)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None before the first batch."""
        some = [b for b in (self.places if buckets is None else buckets) if b in self.places]
        by: dict[str, list[str]] = {}
        for b in some:
            by.setdefault(self.places[b], []).append(f"{self.places[b]}/_b={b}")
        whole = None
        for _, paths in sorted(by.items()):
            part = self.spark.read.option("mergeSchema", "true").parquet(*paths)
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
        return whole

    def upsert(self, new: DataFrame, batch: str) -> list[int]:
        """Rows of new replace those with their key; returns the buckets rewritten. Of rows of new that share a key the greatest stays.

        Columns that one side lacks are null there.
        """
        if batch in self.batches:
            return []
        own = new.groupBy(F.col(f"`{self.key}`").alias("_key")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in new.columns])).alias("_row")).select("_row.*").withColumn("_b", self._bucket())
        touched = sorted(r[0] for r in own.select("_b").distinct().collect())  # at most count numbers
        if not touched:
            return []
        old = self.read(touched)
        rows = own
        if old is not None:
            keys = own.select(F.col(f"`{self.key}`").alias("_key"))
            kept = old.join(keys, F.col(f"`{self.key}`").eqNullSafe(F.col("_key")), "left_anti").withColumn("_b", self._bucket())
            rows = own.unionByName(kept, allowMissingColumns=True)
        place = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.repartition("_b").write.partitionBy("_b").parquet(place)
        self.version += 1
        self.spark.createDataFrame([(self.version, batch, place, touched, self.count)], LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.batches.add(batch)
        self.places.update(dict.fromkeys(touched, place))
        return touched
