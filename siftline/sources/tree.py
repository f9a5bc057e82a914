"""File trees, diffs and logs as tables."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from ..functions.text import n_tokens
from ..operators import audit
from ..operators.paths import denied
from ..workers import ship
from . import chains

# Folders that are never entered, and limits.
PRUNED = {".git", ".siftline", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache"}
MAX_FILES, MAX_BYTES = 500, 1_000_000


class _Slice(InputPartition):
    """Some files, or one folder with all below it."""

    def __init__(self, files: list[str], folder: str | None = None):
        self.files, self.folder = files, folder


class _Reader(DataSourceReader):
    #: Levels of folders that the driver lists; what lies deeper is walked by the tasks.
    LEVELS = 2

    def __init__(self, root: str, most: int, per: int, content: bool = True):
        self.root, self.most, self.per, self.content = root, most, per, content

    def partitions(self) -> list[_Slice]:
        if os.path.isfile(self.root):
            return [_Slice([self.root])]
        slices, level = [], [self.root]
        for depth in range(self.LEVELS):
            below = []
            for folder in level:
                with os.scandir(folder) as entries:
                    entries = sorted(entries, key=lambda e: e.name)
                files = [e.path for e in entries if not e.is_dir(follow_symlinks=False)]
                slices += [_Slice(files[i : i + self.per]) for i in range(0, len(files), self.per)]
                below += [e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name not in PRUNED]
            level = below
        return slices + [_Slice([], folder) for folder in level] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from map(self._row, filter(os.path.isfile, partition.files))
        if partition.folder:
            for top, folders, names in os.walk(partition.folder):
                folders[:] = sorted(f for f in folders if f not in PRUNED)
                yield from map(self._row, filter(os.path.isfile, (os.path.join(top, n) for n in sorted(names))))

    def _row(self, full: str) -> tuple:
        name = os.path.basename(full) if full == self.root else os.path.relpath(full, self.root).replace(os.sep, "/")
        try:
            size = os.path.getsize(full)
            if size > self.most or not self.content:
                return name, size, None
            with open(full, "rb") as f:
                return name, size, f.read()
        except OSError:  # gone or not readable: listed without content
            return name, None, None


class TreeSource(DataSource):
    """format('repo_tree'): (path, size, content) of every file below `path`, hidden ones included; content of files above
    `max_bytes` isn't read and null, nor is any with the option `content` false."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "path string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)), int(self.options.get("files_per_partition", 64)), self.options.get("content", "true") != "false")


@F.pandas_udf(StringType())
def decoded(content):
    """UTF-8 without its invalid bytes."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def tree(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("repo_tree").option("max_bytes", max_bytes).load(path)


def _classified(files: DataFrame, deny: list[str] | None, max_bytes: int) -> DataFrame:
    kind = F.when(denied(F.col("path"), deny), "denied").when(F.col("size").isNull(), "unreadable").when(F.col("size") > max_bytes, "skipped_large").otherwise("scanned")
    return files.withColumn("classification", kind)


def _limited(df: DataFrame, max_files: int) -> DataFrame:
    """What would be scanned beyond the least max_files paths is over_limit."""
    # No filters: they would be put before a repartition of the files, and be worked out where those are read.
    scanned = F.col("classification") == "scanned"
    # A top-k where there are more, not a sort of all files in one task.
    if df.agg(F.count_if(scanned)).first()[0] > max_files:
        last = df.select(F.when(scanned, F.col("path")).alias("path")).orderBy(F.asc_nulls_last("path")).limit(max_files).agg(F.max("path")).first()[0]
        over = scanned & (F.col("path") > F.coalesce(F.lit(last), F.lit("")))
        df = df.withColumn("classification", F.when(over, "over_limit").otherwise(F.col("classification")))
    return df


def _described(df: DataFrame) -> DataFrame:
    scanned = F.col("classification") == "scanned"
    df = df.withColumns({"text": F.when(scanned, decoded(F.when(scanned, F.col("content")))), "content_hash": F.when(scanned, F.sha2("content", 256))})
    return df.withColumn("n_tokens", F.when(scanned, n_tokens(F.col("text"))).otherwise(0)).drop("content")


def manifest(files: DataFrame, deny: list[str] | None = None, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds classification (denied, unreadable, skipped_large, scanned, over_limit), text, content_hash and n_tokens.

    At most max_files files are scanned, in path order; others don't count against it. A null size is a file that couldn't be read.
    """
    ship(files.sparkSession)
    return _described(_limited(_classified(files, deny, max_bytes), max_files))


#: Content that one task reads.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def _probed(root: str):
    """(path, size, classification): what can't be opened is unreadable. Denied and large files aren't touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(2).to_pylist()
            for i, path in enumerate(batch.column(0).to_pylist()):
                if kinds[i] == "scanned":
                    try:
                        open(os.path.join(root, path), "rb").close()
                    except OSError:
                        kinds[i] = "unreadable"
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string())], names=["path", "size", "classification"])

    return run


def _filled(root: str, most: int = BATCH_BYTES):
    """The same with the content of what is scanned, in batches of some BATCH_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, size, kind in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if kind == "scanned":
                    try:
                        with open(os.path.join(root, path), "rb") as f:
                            content = f.read()
                    except OSError:
                        kind = "unreadable"
                rows.append((path, size, kind, content))
                held += len(content or b"")
                if held >= most:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "size", "classification", "content"])


def tree_manifest(spark: SparkSession, root: str, deny: list[str] | None = None, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The manifest of a folder. Names and sizes come first; denied files are never opened, and content is read only of what is
    scanned, dealt over tasks by bytes."""
    spark.dataSource.register(TreeSource)
    ship(spark)
    top = os.path.dirname(root) if os.path.isfile(root) else root
    names = spark.read.format("repo_tree").option("content", "false").option("max_bytes", max_bytes).load(root)
    kinds = _classified(names.select("path", "size"), deny, max_bytes).mapInArrow(_probed(top), "path string, size long, classification string")
    kinds = _limited(kinds, max_files)
    total = kinds.where("classification = 'scanned'").agg(F.sum("size")).first()[0] or 0
    dealt = kinds.repartition(max(1, -(-total // TASK_BYTES)), "path")
    return _described(dealt.mapInArrow(_filled(top), "path string, size long, classification string, content binary"))


def git_diff(spark: SparkSession, folder: str, ref: str | None = None) -> DataFrame:
    """One row with the output of git diff; an error is a RuntimeError."""
    done = subprocess.run(["git", "diff", *([ref] if ref else [])], cwd=folder, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return spark.createDataFrame([("git-diff", done.stdout)], "origin string, text string")


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a log with their sequence, over its files in order of name; blank lines are skipped, a corrupt line has
    null fields, which fails its verification.

    Lines are numbered within each block of a file, and blocks by what lies before them: one row per block is sorted.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    lines = spark.read.text(path).select("value", *at).where(F.trim("value") != "").withColumn("_n", F.monotonically_increasing_id())
    blocks = lines.groupBy("_file", "_block").agg(F.min("_n").alias("_first"), F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(F.broadcast(blocks.select("_file", "_block", "_first", before.alias("_before"))), ["_file", "_block"])
    found = chains.parsed(placed)
    return found.select(*[c.split()[0] for c in audit.CHAIN.split(", ")], (F.col("_n") - F.col("_first") + F.col("_before") + 1).alias("seq"))


def write_log(log: DataFrame, path: str, seq: str = "seq", append: bool = False) -> None:
    """The log as JSON lines in order of seq, in files whose names are in order; an empty log is an error."""
    if log.isEmpty():
        raise LookupError("no events to export")
    body = audit.event_line(*map(F.col, audit.HASHED), digest=F.col("hash"))
    log.orderBy(seq).select(body.alias("value")).write.mode("append" if append else "error").text(path)


def payload(spark: SparkSession, size: int) -> DataFrame:
    """One row of synthetic text of at least size characters, with an email and a fake key in each chunk."""
    chunk = "def handler(user):\n    email = 'person@example.com'\n    key = 'sk_test_fake1234567890'\n    return email, key\n# plain comment line\n"
    return spark.range(1).select(F.repeat(F.lit(chunk), -(-size // len(chunk))).alias("text"))
