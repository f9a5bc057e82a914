"""Reports over the event log and sessions: proof, dashboard, scan totals, sets of egress endpoints, benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import egress_label

BLOCKING = ["block", "quarantine"]
# Endpoints that never leave the machine, tools that run a model.
LOCAL = ["127.0.0.1", "::1", "0.0.0.0", "::"]
MODEL_TOOLS = ["wrap", "qwen-coder", "openhands", "generic"]


def sessions_latest(sessions: DataFrame, limit: int = 20) -> DataFrame:
    return sessions.orderBy(F.desc("started_at")).limit(limit)


def event_counts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Conditional counts and last-value-wins fields of a log, per session. log: keys, seq, event, metadata (JSON).

    Strings win if not empty, numbers if not null; an egress observation and a policy decision compete by order.
    """
    field = lambda name: F.get_json_object("metadata", f"$.{name}")
    event, kind, action = F.col("event"), field("finding_type"), F.coalesce(field("recommended_action"), field("action"))
    blocked = lambda t: F.count_if((event == "finding") & (kind == t) & action.isin(BLOCKING))
    decided = event == "policy_decision"

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when & value.isNotNull() & (value != ""), F.col("seq")))

    def last_if(value: Column, when: Column) -> Column:
        ok = when & value.isNotNull() & (value != "")
        return F.when(F.count_if(ok) > 0, last(value, when))

    method = F.when(event == "egress_observation", field("method")).when(decided, field("egress_method"))
    label = F.when(event == "model_event", F.concat_ws("", F.coalesce(field("backend_name"), F.lit("unknown")), F.lit(" ("), F.concat_ws(
        ", ", F.coalesce(field("device_name"), F.lit("unknown")), F.when(field("model_role") != "", field("model_role")), F.coalesce(field("status"), F.lit(""))), F.lit(")")))
    labels = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(label.isNotNull(), F.struct("seq", label.alias("l"))))), lambda x: x["l"]))
    connection = F.from_json(F.when(event == "egress_observation", field("new_connections")), "array<struct<remote_ip:string,remote_port:int>>")
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.size(connection) > 0, F.struct("seq", connection.alias("c"))))), lambda x: x["c"])
    return log.groupBy(*keys).agg(
        F.count_if(event == "finding").alias("findings_total"), blocked("secret").alias("secrets_blocked"), blocked("prompt_injection").alias("injections_blocked"),
        blocked("command_guard").alias("command_guard_blocks"), blocked("path").alias("path_blocks"), F.count_if(event == "redaction").alias("redactions_total"),
        F.count_if((event == "redaction") & (kind == "pii")).alias("sensitive_redactions"), last_if(field("mode"), decided).alias("last_mode"),
        last_if(field("status"), decided).alias("last_status"), last_if(method, F.lit(True)).alias("last_egress"),
        last_if(field("files_scanned"), decided).cast("int").alias("last_files"), last_if(field("prompt_tokens_scanned"), decided).cast("int").alias("last_tokens"),
        labels.alias("model_labels"), F.transform(F.flatten(seen), lambda c: F.concat_ws(":", c["remote_ip"], c["remote_port"].cast("string"))).alias("egress_observed_connections"),
    )


def proof(sessions: DataFrame, log: DataFrame, verified: DataFrame, session_id: str = "latest") -> DataFrame:
    """The report of one session, one row. verified: one row of audit.verify over the whole chain."""
    row = sessions_latest(sessions, 1) if session_id == "latest" else sessions.where(F.col("id") == session_id)
    if row.isEmpty():
        raise LookupError("no sessions found" if session_id == "latest" else f"session not found: {session_id}")
    counts = event_counts(log.join(F.broadcast(row.select(F.col("id").alias("session_id"))), "session_id", "left_semi"), ["session_id"])
    df = row.join(counts, row["id"] == counts["session_id"], "left").drop("session_id")
    df = df.crossJoin(F.broadcast(verified.select("ok", "message", "head")))  # one row each
    egress = F.coalesce("last_egress", F.lit("not-recorded"))
    label, details = egress_label(egress)
    simulated = F.when(F.col("tool").isin(MODEL_TOOLS), "local-mock-coder (simulated, inferred)").otherwise("none recorded")
    backends = F.when(F.size("model_labels") > 0, F.col("model_labels")).otherwise(F.array(simulated))
    notes = F.array(
        F.when(F.exists(backends, lambda b: b.contains("simulated")), "A backend marked as simulated stands for no real model."),
        F.when(egress == "engine-originated", "The engine's own connections are all that was looked at.")
        .when(egress == "not-measured", "Nothing is claimed about network use, as none was measured.")
        .when(egress == "not-recorded", "The log says nothing about network use.")
        .when(egress == "measured-process", "Brief connections may have escaped the samples."),
        F.lit("Scanners miss things; they are one layer among others."), F.lit("The chain is kept here alone: nobody outside holds its head."),
        F.when(~F.col("ok"), "The session's chain did not verify."),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    numbers = ("findings_total", "secrets_blocked", "injections_blocked", "command_guard_blocks", "path_blocks", "redactions_total", "sensitive_redactions")
    return df.select(
        F.col("id").alias("session_id"), "started_at", "tool", F.coalesce("last_mode", "mode").alias("mode"), "policy_version", F.coalesce("last_status", "status").alias("status"),
        F.coalesce("last_files", F.lit(0)).alias("files_scanned"), F.coalesce("last_tokens", F.lit(0)).alias("prompt_tokens_scanned"), *[zero(c) for c in numbers],
        backends.alias("model_backends"), egress.alias("egress_method"), F.coalesce("egress_observed_connections", F.array().cast("array<string>")).alias("egress_observed_connections"),
        label.alias("egress_label"), details.alias("egress_details"), F.col("ok").alias("audit_chain_valid"), F.col("message").alias("audit_message"), F.col("head").alias("audit_head"),
        "output_hash", F.filter(notes, lambda n: n.isNotNull()).alias("limitations"),
    )


def dashboard(sessions: DataFrame, log: DataFrame, verified: DataFrame) -> DataFrame:
    """Counts, the latest session and the state of the chain, one row."""
    counts = log.agg(F.count("*").alias("n_events")).crossJoin(sessions.agg(F.least(F.count("*"), F.lit(1000)).alias("n_sessions"), F.max_by("id", "started_at").alias("latest_session")))
    return counts.crossJoin(verified.select("ok", "message", "head"))  # one row each


def remote_endpoints(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct endpoints of connection samples that leave the machine."""
    kept = samples.where(F.col("local_port").isNotNull() & F.col("remote_ip").isNotNull() & ~F.col("remote_ip").isin(LOCAL))
    return kept.select(*keys, "local_port", "remote_ip", "remote_port").distinct()


def new_endpoints(samples: DataFrame, keys: list[str], phase: str = "phase", baseline: str = "baseline") -> DataFrame:
    """Endpoints seen after the baseline that it doesn't hold."""
    seen = remote_endpoints(samples.where(F.col(phase) != baseline), keys)
    return seen.subtract(remote_endpoints(samples.where(F.col(phase) == baseline), keys))


def rate(timings: DataFrame, seconds: str, payload_bytes: int) -> DataFrame:
    """Mean, median and 95th percentile in ms, and MB per second."""
    s = F.col(seconds)
    return timings.agg(
        F.count("*").alias("iterations"), F.coalesce(F.sum(s), F.lit(0.0)).alias("total_seconds"), F.coalesce(F.avg(s) * 1000, F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.percentile(s, 0.5) * 1000, F.lit(0.0)).alias("p50_ms"), F.coalesce(F.percentile(s, 0.95) * 1000, F.lit(0.0)).alias("p95_ms"),
        F.coalesce(F.lit(payload_bytes / 1e6) * F.count("*") / F.nullif(F.sum(s), F.lit(0.0)), F.lit(0.0)).alias("mb_per_second"),
    )


def plain(row: DataFrame) -> DataFrame:
    """A report as rows of (field, value), in the order of its columns; lists are one row per entry."""
    lists = {f.name for f in row.schema.fields if f.dataType.typeName() == "array"}

    def cells_of(name: str) -> Column:
        cell = lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias("value"))
        return F.transform(F.col(name), cell) if name in lists else F.array(cell(F.col(name)))

    cells = [cells_of(c) for c in row.columns]
    return row.select(F.inline(F.concat(*cells)))


def as_json(row: DataFrame) -> DataFrame:
    """A report as one JSON text per row, null fields included."""
    return row.select(F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"}).alias("json"))


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct rows by keys, the first by order kept whole: an aggregation, not a sort."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(whole, order).alias("_row")).select("_row.*")
