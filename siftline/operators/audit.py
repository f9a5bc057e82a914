"""The event log: sanitised metadata, canonical JSON, SHA-256 chains, verification, export.

An event's hash covers its fields and the hash before it, so that appending is a fold in order of sequence: chains run in
parallel, each in order, and a task holds the last hash alone. All else that a hash covers is put together before, in parallel. A chain
of more than STEP events is appended in steps of so many, one after the other, so that no task sorts all of it. Verifying needs no fold: every row is checked against its
neighbour and its own recomputed hash, by runs of the sequence, and the first failure is an aggregate.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import clip, utc_string
from ..sources import folders
from ..workers import ship
from . import numbering

# The first link, and metadata keys whose values are never stored.
GENESIS = "0" * 64
FORBIDDEN = [
    "matched", "match", "value", "secret", "password", "passwd", "token", "credential", "credentials", "private_key", "api_key", "apikey", "raw", "content",
    "text", "prompt",
]
#: What a hash covers, in the order of the functions below.
HASHED = ["event_id", "session_id", "timestamp", "event", "metadata", "previous_hash"]
CHAIN = "event_id string, session_id string, timestamp string, event string, metadata string, previous_hash string, hash string"


def _clean(value):
    if isinstance(value, dict):
        return {k: "[REDACTED]" if str(k).lower() in FORBIDDEN else _clean(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_clean(v) for v in value]
    if isinstance(value, str) and len(value) > 500:
        return value[:497] + "..."
    return value


@F.pandas_udf(StringType())
def canonical(metadata: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, ASCII: the form that is hashed. Null is {}."""
    return metadata.map(lambda m: json.dumps(json.loads(m) if m else {}, sort_keys=True, separators=(",", ":"), default=str))


@F.pandas_udf(StringType())
def sanitized(metadata: pd.Series) -> pd.Series:
    """Canonical JSON without forbidden values and with long strings clipped, at any depth."""
    return metadata.map(lambda m: json.dumps(_clean(json.loads(m)) if m else {}, sort_keys=True, separators=(",", ":"), default=str))


def _metadata(line: str | None) -> str | None:
    try:
        found = json.loads(line).get("metadata") if line else None
    except (ValueError, AttributeError):
        return None
    return None if found is None else json.dumps(found, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def metadata_of(line: pd.Series) -> pd.Series:
    """Canonical metadata of an event's line of any layout; null if there is none."""
    return line.map(_metadata)


def sanitized_map(metadata: Column) -> Column:
    """The same for a flat map of strings, without Python."""
    return F.transform_values(metadata, lambda k, v: F.when(F.lower(k).isin(FORBIDDEN), "[REDACTED]").otherwise(clip(v)))


#: Characters that JSON writes as two.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _escaped(c: Column) -> Column:
    """One character as JSON of ASCII writes it."""
    code = F.ascii(c)
    unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
    rest = code - 0x10000
    out = F.when(code > 0xFFFF, F.concat(unit(F.lit(0xD800) + F.shiftright(rest, 10)), unit(F.lit(0xDC00) + rest.bitwiseAND(F.lit(0x3FF))))).otherwise(unit(code))
    out = F.when((code >= 0x20) & (code < 0x7F), c).otherwise(out)
    for plain, short in _SHORT.items():
        out = F.when(c == F.lit(plain), F.lit(short)).otherwise(out)
    return out


def _quoted(c: Column) -> Column:
    """A JSON string literal in ASCII. Only texts that need an escape are taken apart, into runs that need none and single characters."""
    parts = F.regexp_extract_all(c, F.lit(r'(?s)([\x20\x21\x23-\x5b\x5d-\x7e]+|.)'), F.lit(1))
    body = F.when(c.rlike(r'[^\x20-\x7e]|["\\]'), F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > 1, p).otherwise(_escaped(p))), "")).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _parts(event_id: Column, session_id: Column, timestamp: Column, event: Column, metadata: Column, previous: Column) -> list[Column]:
    """The event's canonical JSON in parts, without its closing brace; metadata is canonical already."""
    parts = {"event": _quoted(event), "event_id": _quoted(event_id), "metadata": metadata, "previous_hash": _quoted(previous), "session_id": _quoted(session_id), "timestamp": _quoted(timestamp)}
    text = [F.lit("{")]
    for i, (k, v) in enumerate(parts.items()):
        text += [F.lit(("," if i else "") + f'"{k}":'), v]
    return text


def event_line(*fields: Column, digest: Column) -> Column:
    """One event as a line of a log: the text that its hash covers, with the hash put behind."""
    return F.concat(*_parts(*fields), F.lit(',"hash":"'), digest, F.lit('"}'))


def event_hash(event_id: Column, session_id: Column, timestamp: Column, event: Column, metadata: Column, previous: Column) -> Column:
    """SHA-256 of the event's canonical JSON."""
    return F.sha2(F.concat(*_parts(event_id, session_id, timestamp, event, metadata, previous), F.lit("}")), 256)


def _or_null(name: str) -> Column:
    return F.coalesce(_quoted(F.col(name)), F.lit("null"))


def own_hash() -> Column:
    """The hash of an event in the columns of HASHED, whose metadata is canonical; null fields are JSON's null, as in `digest`."""
    parts = _parts(*[F.col(name) for name in HASHED])
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("null")) for p in parts], F.lit("}")), 256)


def digest(event_id: str, session_id: str, timestamp: str, event: str, metadata: str, previous: str) -> str:
    """The hash of one event on a worker; metadata is canonical already."""
    body = {"session_id": session_id, "timestamp": timestamp, "event": event, "event_id": event_id, "previous_hash": previous, "metadata": json.loads(metadata)}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def append(events: DataFrame, chain: str, seq: str, head: str = GENESIS, first: int = 1, heads: DataFrame | None = None) -> DataFrame:
    """Chains events in order of seq, one chain per value of `chain`; ids continue from first, hashes from head.

    heads: (chain, seq, hash) of the last event of chains that go on; others begin.

    events: chain, seq, session_id, timestamp, event, metadata (JSON). A chain is as long as its longest session's log.
    """

    ship(events.sparkSession)
    rows = events.select(F.col(chain).alias("c"), F.col(seq).alias("s"), "session_id", "timestamp", "event", sanitized("metadata").alias("metadata"))
    longest = events.groupBy(F.col(chain)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if heads is not None:
        heads = heads.select(F.col("chain").alias("c"), "seq", "hash")
    made = _chained(rows, head, first, heads) if longest <= STEP else _in_steps(rows, longest, head, first, heads)
    return made.withColumnRenamed("c", chain)


def _chained(rows: DataFrame, head: str, first: int, heads: DataFrame | None) -> DataFrame:
    """(c, seq, and an event's fields) of rows (c, s, and what an event holds): one task a chain."""
    if heads is None:
        rows = rows.withColumns({"n": F.lit(first - 1).cast("long"), "h": F.lit(head)})
    else:
        known = heads.select(F.col("c").alias("_of"), F.col("seq").alias("n"), F.col("hash").alias("h"))
        rows = rows.join(known, F.col("c").eqNullSafe(F.col("_of")), "left").drop("_of")
        rows = rows.withColumns({"n": F.coalesce("n", F.lit(first - 1)), "h": F.coalesce("h", F.lit(head))})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, previous, begun = None, 0, head, False
        for batch in batches:
            seqs, ids, before, hashes = [], [], [], []
            for c, start, h, lead, body, end in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5))):
                if not begun or c != at:
                    at, n, previous, begun = c, start, h, True
                n += 1
                own = f"evt_{n:06d}"
                seqs.append(n)
                ids.append(own)
                before.append(previous)
                previous = hashlib.sha256(f"{lead}{own}{body}{previous}{end}".encode()).hexdigest()
                hashes.append(previous)
            made = {"c": batch.column(0), "seq": pa.array(seqs, pa.int64()), "event_id": pa.array(ids, pa.string())}
            made |= {name: batch.column(name) for name in HASHED[1:5]} | {"previous_hash": pa.array(before, pa.string()), "hash": pa.array(hashes, pa.string())}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    # A chain is in one partition and in order there; only its last hash is held.
    dealt = rows.repartition("c").sortWithinPartitions("c", "s")
    lead = F.concat(F.lit('{"event":'), _or_null("event"), F.lit(',"event_id":"'))
    body = F.concat(F.lit('","metadata":'), F.col("metadata"), F.lit(',"previous_hash":"'))
    end = F.concat(F.lit('","session_id":'), _or_null("session_id"), F.lit(',"timestamp":'), _or_null("timestamp"), F.lit("}"))
    parts = dealt.select("c", "n", "h", lead.alias("lead"), body.alias("body"), end.alias("end"), *HASHED[1:5])
    return parts.mapInArrow(fold, f"c {rows.schema['c'].dataType.simpleString()}, seq long, {CHAIN}")


#: Events of a chain that one task sorts and chains.
STEP = 1_000_000


def _in_steps(rows: DataFrame, longest: int, head: str, first: int, heads: DataFrame | None) -> DataFrame:
    """The same for long chains: the events of each chain that are its first STEP, then the next ones, taken up at the last hashes.

    What comes between is written below the shared folder; only the number of events is known to the driver.
    """
    spark = rows.sparkSession
    dealt, out = folders.shared(spark, "steps"), folders.shared(spark, "chained")
    numbered = numbering.numbered_rows(rows, ["c"], ["s"]).withColumn("_step", F.floor((F.col("n") - 1) / STEP).cast("int")).drop("n")
    numbered.write.partitionBy("_step").parquet(dealt)
    for i in range(-(-longest // STEP)):
        made = _chained(spark.read.schema(rows.schema).parquet(f"{dealt}/_step={i}"), head, first, heads)
        made.write.parquet(f"{out}/{i}")
        heads = spark.read.schema(made.schema).parquet(f"{out}/{i}").groupBy("c").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))
    return spark.read.schema(made.schema).parquet(*[f"{out}/{k}" for k in range(i + 1)])


#: Events of a run: what one task looks at in order when a chain is verified.
RUN = 100_000


def verify(log: DataFrame, chain: list[str] | None = None, seq: str = "seq", heads: DataFrame | None = None, first: Column | None = None) -> DataFrame:
    """Per chain: n_events, ok, message and head (the last good hash before a failure).

    Links are checked before hashes. A cut-off tail can only be seen against heads: rows of the chain's columns and
    audit_head, the last hash that a session stored. A chain is cut into runs of RUN numbers of its sequence; the log is read once and
    dealt by runs, each run leaves one row, and its first event is held against the last hash of the run before. first: the hash before a chain's first event,
    where a log is a part of a longer one.
    """
    keys = chain or []
    cols = [F.col(c) for c in ("event_id", "session_id", "timestamp", "event")]
    rows = log.withColumn("_run", F.floor(F.col(seq) / RUN))
    over = Window.partitionBy(*keys, "_run").orderBy(seq)
    start = F.lit(GENESIS) if first is None else first
    rows = rows.withColumns({"_before": F.lag("hash").over(over), "_place": F.row_number().over(over), "_start": start})
    rows = rows.withColumn("_own", event_hash(*cols, F.col("metadata"), F.col("previous_hash")))
    at = F.concat(F.lit("Event "), F.coalesce("event_id", F.lit("without id")), F.lit(" has "))

    def failed(link: Column, fine: Column, seq: Column, at: Column, before: Column) -> Column:
        wrong = F.when(~link, "invalid previous_hash").when(~fine, "invalid hash")
        return F.when(wrong.isNotNull(), F.struct(seq.alias("seq"), F.concat(at, wrong).alias("message"), before.alias("head")))

    before, fine = F.coalesce("_before", "_start"), F.col("hash").eqNullSafe(F.col("_own"))
    inner = F.when(F.col("_place") > 1, failed(F.col("previous_hash").eqNullSafe(before), fine, F.col(seq), at, before))
    begin = F.struct(F.col(seq).alias("seq"), at.alias("at"), F.col("previous_hash").alias("previous"), F.col("_start").alias("start"), fine.alias("fine"))
    # A run's rows are in one partition and in order already: one row per run is left, and goes through the next window.
    ends = rows.groupBy(*keys, "_run").agg(
        F.count("*").alias("_n"), F.min(inner).alias("_worst"), F.min_by(begin, "_place").alias("_b"), F.max_by("hash", seq).alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy(*keys).orderBy("_run")), F.col("_b.start"))
    ends = ends.withColumn("_before", before)
    opening = failed(F.col("_b.previous").eqNullSafe(F.col("_before")), F.col("_b.fine"), F.col("_b.seq"), F.col("_b.at"), F.col("_before"))
    ends = ends.withColumn("_worst", F.coalesce(opening, "_worst"))
    found = ends.groupBy(*keys).agg(F.sum("_n").alias("n_events"), F.min("_worst").alias("_f"), F.max_by("_last", "_run").alias("_head"))
    found = found.select(
        *keys, F.coalesce("n_events", F.lit(0)).alias("n_events"), F.col("_f").isNull().alias("ok"),
        F.coalesce("_f.message", F.concat(F.coalesce("n_events", F.lit(0)).cast("string"), F.lit(" audit events verified"))).alias("message"),
        F.coalesce("_f.head", "_head", F.lit(GENESIS)).alias("head"),
    )
    if heads is None:
        return found
    known = heads.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "audit_head")
    met = found.join(known, F.lit(True) if not keys else [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    cut = F.col("ok") & F.col("audit_head").isNotNull() & (F.col("audit_head") != F.col("head"))
    return met.select(*keys, "n_events", (F.col("ok") & ~cut).alias("ok"), F.when(cut, "Chain ends before the session's last event").otherwise(F.col("message")).alias("message"), "head")


#: Metadata fields of each kind of event, in the order of a session's log. Fixed values.
EVENTS = {
    "session_started": ["tool", "mode", "policy_version"],
    "wrap_invocation": ["adapter", "mode", "execute", "prompt_tokens"],
    "finding": ["finding_type", "severity", "rule", "origin", "path", "line", "recommended_action"],
    "redaction": ["placeholder", "finding_type", "rule", "origin", "path", "line"],
    "egress_observation": ["method", "new_connections", "samples"],
    "policy_decision": ["status", "mode", "egress_method", "files_scanned", "prompt_tokens_scanned"],
    "model_event": ["backend_name", "device_name", "model_role", "status", "latency_ms"],
    "command_event": ["command", "action", "rule", "reason"],
    "session_finished": ["status", "findings", "decisions", "redactions"],
}


def events_of(rows: DataFrame, event: str, session: Column, ts: Column, order: Column | None = None) -> DataFrame:
    """Rows of the event log (session_id, timestamp, event, metadata, ord) of one kind; fields that rows lack are null.

    ord sorts a session's log: kinds in the order of EVENTS, rows of a kind by `order`. No span or matched text is taken.
    """
    have = {c.lower() for c in rows.columns}
    body = F.struct(*[(F.col(f) if f in have else F.lit(None).cast("string")).alias(f) for f in EVENTS[event]])
    place = F.struct(F.lit(list(EVENTS).index(event)).alias("kind"), (F.lit(0) if order is None else order).cast("long").alias("n"))
    return rows.select(session.alias("session_id"), utc_string(ts).alias("timestamp"), F.lit(event).alias("event"), F.to_json(body, {"ignoreNullFields": "false"}).alias("metadata"), place.alias("ord"))


def finding_events(found: DataFrame, session: Column, ts: Column) -> DataFrame:
    """Rows of the event log for findings: no span, no matched text."""
    return events_of(found.withColumn("finding_type", F.col("type")), "finding", session, ts).drop("ord")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with the same key; columns that old lacks are null there."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def tail(log: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The last n events in order (0: all), with metadata clipped for a table."""
    rows = log if n == 0 else log.orderBy(F.desc(seq)).limit(n)
    return rows.withColumn("metadata", clip(F.col("metadata"), 80)).orderBy(seq)
