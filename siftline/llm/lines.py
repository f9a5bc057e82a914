"""Line deduplication against levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of LEAST_CHARS code points or
more count, as 128 bits of hash. A `LineIndex` is a folder of runs. A run is a table of (key, documents, greatest
document), dealt by key and sorted. Each batch of documents adds one run of its own at level 0; when FANOUT
runs lie on a level, they are merged into one run on the next, so that an entry is rewritten once a level: 32 bytes for a
different line, whatever its length. A log beside the runs says which of them count: a run becomes visible by the row that
names it and those it replaces, in one write, and what a lost job left is never read.

Lines are cleaned by a join of a batch's lines with the merged runs: those of a key that LEAST_DOCS documents hold go, except in the
greatest document that holds it. The documents' texts move once, to meet the numbers of the lines that they lose.

Defined results: a null or empty text is one empty line; a text keeps its last \\n as an empty line; a line that stands twice
in a document counts once there and stays or goes in both places; rows that share an id are one document, and each keeps
its own text; rows without an id are one document before all others; ids are integers; an empty table gives an empty one;
columns of the input stay, but for those named like what `clean` adds. A document may be added once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, read, shared_dir, without

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Runs of a level that are merged into one of the next, and batches that op12 deals the documents into.
FANOUT, BATCHES = 3, 6
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, docs long, last long"


def key_of(line: Column) -> Column:
    """A line stripped at both ends, with A-Z in lower case. (lower() is the same for ASCII, and faster.)"""
    bare = F.trim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, of, at, h1, h2): the lines of documents whose key is long enough; of tells texts of one id apart, at counts from 0."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.xxhash64(t).alias("of"), F.posexplode(F.split(t, "\n")).alias("at", "line"))
    rows = rows.where(F.length("line") >= least_chars).withColumn("line", key_of(F.col("line"))).where(F.length("line") >= least_chars)
    return rows.select("doc", "of", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


class LineIndex:
    """Levelled sorted runs in a shared folder; opened again, it goes on where it was."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        #: Folders of runs by level, oldest first.
        self.levels: list[list[str]] = []
        self.steps = 0
        if self._exists(f"{folder}/log"):
            gone: set[str] = set()
            log = spark.read.schema(self.LOG).parquet(f"{folder}/log").orderBy("step").collect()  # a row for each batch and merge
            for r in log:
                gone.update(r.replaced)
                self.steps = r.step
            for r in log:
                if r.run not in gone:
                    self._level(r.level).append(r.run)

    LOG = "step long, level int, run string, replaced array<string>"

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _level(self, n: int) -> list[str]:
        while len(self.levels) <= n:
            self.levels.append([])
        return self.levels[n]

    def _write(self, entries: DataFrame, level: int, replaced: list[str]) -> None:
        run = f"{self.folder}/run-{uuid.uuid4().hex}"
        entries.sortWithinPartitions("h1", "h2").write.parquet(run)
        self.steps += 1
        row = self.spark.createDataFrame([(self.steps, level, run, replaced)], self.LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        for runs in self.levels:
            runs[:] = [r for r in runs if r not in replaced]
        self._level(level).append(run)
        for gone in replaced:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(gone)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Entries of runs by key."""
        return self.spark.read.schema(RUN).parquet(*runs).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def entries(self) -> DataFrame:
        """(h1, h2, docs, last) of all runs."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else self.spark.createDataFrame([], RUN)

    def add(self, lines: DataFrame) -> None:
        """One more batch, as lines_of gives them: its own run, then the merges that are due."""
        # Each pair of key and document once; both sums are made before a shuffle, so that a line in every document is no weight.
        pairs = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        own = pairs.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        self._write(own, 0, [])
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                due = list(self.levels[level])
                self._write(self._merged(due), level + 1, due)
            level += 1

    def gone(self, lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(doc, of, at) of lines that go: held by least_docs documents of the index, and by a greater one than their own."""
        # Written out, so that the join deals both sides and can split a line that a third of all documents hold.
        common = self.entries().where(F.col("docs") >= least_docs)
        path = f"{self.folder}/common_{uuid.uuid4().hex}"
        common.write.parquet(path)
        common = self.spark.read.parquet(path).select("h1", "h2", "last")
        return lines.join(common.hint("merge"), ["h1", "h2"]).where(F.col("doc").isNull() | (F.col("doc") < F.col("last"))).select("doc", "of", "at")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, numbers of lines that go) to (row, text without them, lines, lines gone)."""
    for batch in batches:
        out, lines, dropped = [], [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text = text or ""
            lines.append(text.count("\n") + 1)
            dropped.append(len(gone or ()))
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["r", "t", "n", "d"])


def clean(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that go; adds n_lines (before) and n_dropped."""
    docs = without(docs, "n_lines", "n_dropped")
    marks = gone.groupBy("doc", "of").agg(F.collect_set("at").alias("_gone"))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("_doc"),
        F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_of"),
    )
    met = whole.join(marks, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_of") == F.col("of")), "left")
    # The text leaves its row for the pass, and comes back after it.
    slim = met.select(F.col("_row").withField(f"`{text}`", F.lit(None).cast("string")).alias("_row"), F.col("_row").getField(text).alias("_text"), "_gone")
    schema = T.StructType(slim.schema.fields[:2]).add("n_lines", "long").add("n_dropped", "long")
    done = arrow_map(slim, _drop, schema)
    return done.withColumn("_row", F.col("_row").withField(f"`{text}`", F.col("_text"))).select("_row.*", "n_lines", "n_dropped")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS,
          fanout: int = FANOUT) -> DataFrame:
    """docs without the lines that many of them hold, through an index of their own that takes them in batches."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    # The texts are read for their lines once; a batch is a folder of that table.
    found = lines_of(docs, key, text, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)))
    found.write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("doc long, of long, at int, h1 long, h2 long, batch long").parquet(f"{folder}/lines")
    index = LineIndex(spark, folder, fanout)
    for batch in range(batches):
        index.add(lines.where(F.col("batch") == batch))
    return clean(docs, index.gone(lines, least_docs), key, text)


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many of them went, and a digest of what stays."""
    kept = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), c AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT doc_id, i, line, coalesce(doc_id < last, false) AS gone FROM l LEFT JOIN c USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
