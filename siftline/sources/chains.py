"""Event logs as folders of JSON lines that keep their hashes, grow by commits, and are verified file by file.

A line is the text that an event's hash covers, with the hash put behind it, so that numbers, accents and nesting come back
as they were hashed. An append takes up each chain at its stored head, writes one segment by Spark's own committed text
write, then the new heads, and at last one row that names both: what has no such row was lost and is never read.

Verifying reads the files that are new or that changed in size or time since they were last verified, and keeps a row
per file and chain: its numbers, the hash before its first event and its last. Links between files are checked over these rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit
from .folders import exists

_STRING = r'"(?:[^"\\]|\\.)*+"'
#: The layout of a line: keys in order, the hash last; its third group is the metadata as it stands.
LINE = rf'^\{{"event":{_STRING},"event_id":{_STRING},"metadata":(\{{.*\}}),"previous_hash":{_STRING},"session_id":{_STRING},"timestamp":{_STRING},"hash":"[0-9a-f]{{64}}"\}}$'
_FIELDS = "event string, event_id string, previous_hash string, session_id string, timestamp string, hash string"
COMMIT = "version long, segment string, heads string"
CHECKED = "file string, length long, modified timestamp, chain string, first long, last long, n long, previous string, head string, bad long, message string, good string"


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with the fields of an event, metadata as it was hashed. Lines of another layout are read by their JSON.

    A line that isn't JSON, or lacks a hash, has null fields.
    """
    own = F.regexp_extract(value, f"(?s){LINE}", 1)
    rows = lines.withColumn("_e", F.from_json(value, _FIELDS)).withColumn("_own", F.when(own != "", own))
    other = audit.metadata_of(F.when(F.col("_own").isNull(), F.col(value)))
    return rows.select(*[F.col(c) for c in lines.columns if c != value], "_e.*", F.coalesce("_own", other).alias("metadata"))


class ChainLog:
    """A log in a folder. Each session is a chain of its own, or all events are one."""

    def __init__(self, spark: SparkSession, folder: str, by_session: bool = True):
        self.spark, self.folder, self.by_session = spark, folder, by_session

    def _commits(self) -> list:
        path = f"{self.folder}/commits"
        if not exists(self.spark, path):
            return []
        return self.spark.read.schema(COMMIT).parquet(path).orderBy("version").collect()  # one row per append

    def _chain(self) -> Column:
        return F.col("session_id") if self.by_session else F.lit("log")

    def heads(self) -> DataFrame:
        """(chain, seq, hash): the last event of each chain, as the appends stored it."""
        paths = [c.heads for c in self._commits()]
        kind = "chain string, seq long, hash string"
        rows = self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)
        return rows.groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))

    def append(self, events: DataFrame, seq: str) -> None:
        """One more segment: events (seq, session_id, timestamp, event, metadata) in order of seq, after what is stored."""
        version, name = len(self._commits()) + 1, uuid.uuid4().hex
        segment, heads = f"{self.folder}/segments/{name}", f"{self.folder}/heads/{name}"
        rows = audit.append(events.withColumn("chain", self._chain()), "chain", seq, heads=self.heads())
        text = rows.select(audit.event_line(*map(F.col, audit.HASHED), digest=F.col("hash")).alias("value"))
        text.write.text(segment)
        new = self._events([segment]).groupBy("chain").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
        new.write.parquet(heads)
        self.spark.createDataFrame([(version, segment, heads)], COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")

    def _events(self, paths: list[str]) -> DataFrame:
        about = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_path", "file_size", "file_modification_time")]
        rows = parsed(self.spark.read.text(paths).where(F.trim("value") != "").select("value", *about))
        return rows.withColumn("chain", self._chain()).withColumn("seq", F.regexp_extract("event_id", r"^evt_(\d+)$", 1).try_cast("long"))

    def read(self) -> DataFrame:
        """(chain, seq, and an event's fields) of all committed segments."""
        names = [c.split()[0] for c in audit.CHAIN.split(", ")]
        paths = [c.segment for c in self._commits()]
        if not paths:
            return self.spark.createDataFrame([], f"chain string, seq long, {audit.CHAIN}")
        return self._events(paths).select("chain", "seq", *names)

    def _checked(self) -> DataFrame:
        path = f"{self.folder}/checked"
        return self.spark.read.schema(CHECKED).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], CHECKED)

    def files(self) -> DataFrame:
        """(file, length, modified) of the committed segments; contents aren't read."""
        paths = [c.segment for c in self._commits()]
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths)
        return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))

    def due(self) -> list[str]:
        """Files to be hashed: new ones, and those whose size or time changed."""
        known = self._checked().select("file", "length", "modified").distinct()
        return [r.file for r in self.files().join(known, ["file", "length", "modified"], "left_anti").select("file").collect()]

    def verify(self) -> DataFrame:
        """Per chain n_events, ok, message and head, as audit.verify over all events; hashes only files that are due."""
        if not self._commits():
            return self.spark.createDataFrame([], "chain string, n_events long, ok boolean, message string, head string")
        due = self.due()
        if due:
            self._check(due)
        # A file's rows of its present size and time: what was known of an older one doesn't count.
        rows = self._checked().join(self.files(), ["file", "length", "modified"], "left_semi")
        over = Window.partitionBy("chain").orderBy("first", "file")
        rows = rows.withColumn("_before", F.coalesce(F.lag("head").over(over), F.lit(audit.GENESIS)))
        event = lambda n: F.concat(F.lit("Event evt_"), F.lpad(n.cast("string"), F.greatest(F.lit(6), F.length(n.cast("string"))), F.lit("0")))
        broken = (F.col("previous") != F.col("_before")) | F.col("previous").isNull()
        worst = F.when(broken, F.struct(F.col("first").alias("at"), F.concat(event(F.col("first")), F.lit(" has invalid previous_hash")).alias("message"), F.col("_before").alias("good")))
        worst = worst.when(F.col("bad").isNotNull(), F.struct(F.col("bad").alias("at"), F.col("message").alias("message"), F.col("good").alias("good")))
        found = rows.withColumn("_w", worst).groupBy("chain").agg(F.sum("n").alias("n_events"), F.min("_w").alias("w"), F.max_by("head", F.struct("last", "file")).alias("head"))
        # What the appends stored is the other half: a chain that lost its tail, or all of its files, ends early.
        met = found.join(self.heads().select(F.col("chain").alias("_c"), F.col("hash").alias("_stored")), F.col("chain").eqNullSafe(F.col("_c")), "full")
        cut = F.col("w").isNull() & (F.col("head").isNull() | (F.col("head") != F.col("_stored")))
        fine = F.concat(F.col("n_events").cast("string"), F.lit(" audit events verified"))
        return met.select(
            F.coalesce("chain", "_c").alias("chain"), F.coalesce("n_events", F.lit(0)).alias("n_events"), (F.col("w").isNull() & ~cut).alias("ok"),
            F.when(cut, "Chain ends before the session's last event").otherwise(F.coalesce("w.message", fine)).alias("message"), F.coalesce("w.good", "head", F.lit(audit.GENESIS)).alias("head"),
        )

    def _check(self, files: list[str]) -> None:
        rows = self._events(files).withColumnRenamed("_file_path", "file").withColumn("seq", F.coalesce("seq", F.lit(0)))
        ends = rows.groupBy("file", "chain").agg(
            F.first("_file_size").alias("length"), F.first("_file_modification_time").alias("modified"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"),
            F.min_by("previous_hash", "seq").alias("previous"), F.max_by("hash", "seq").alias("head"),
        )
        inner = audit.verify(rows, ["file", "chain"], first=F.col("previous_hash")).select(
            F.col("file").alias("_f"), F.col("chain").alias("_c"), "ok", F.when(~F.col("ok"), F.col("message")).alias("message"), F.when(~F.col("ok"), F.col("head")).alias("good")
        )
        met = ends.join(inner, (F.col("file") == F.col("_f")) & F.col("chain").eqNullSafe(F.col("_c")))
        bad = F.when(F.col("message").isNotNull(), F.coalesce(F.regexp_extract("message", r"evt_(\d+)", 1).try_cast("long"), F.lit(0)))
        met.withColumn("bad", bad).select(*[c.split()[0] for c in CHECKED.split(", ")]).write.mode("append").parquet(f"{self.folder}/checked")
