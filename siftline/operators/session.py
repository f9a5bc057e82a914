"""Sessions as rows: their start, the findings, decisions and redactions numbered within them, their counters and their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint, numbered, utc_string
from .numbering import numbered_rows


def started(rows: DataFrame, session: Column, ts: Column, tool: Column | str, mode: str, policy_version: str) -> DataFrame:
    """A session row for each row: running, without an end."""
    tool = F.lit(tool) if isinstance(tool, str) else tool
    null = F.lit(None).cast("string")
    return rows.select(
        session.alias("id"), utc_string(ts).alias("started_at"), null.alias("ended_at"), tool.alias("tool"), F.lit(mode).alias("mode"),
        F.lit(policy_version).alias("policy_version"), F.lit("running").alias("status"), null.alias("output_hash"),
    )


def with_ids(rows: DataFrame, session: str, prefix: str, order: Column) -> DataFrame:
    """rows with `id`: prefix_001 and so on by position in their session, which may hold any share of all rows."""
    return numbered_rows(rows, [session], [order], "id").withColumn("id", numbered(prefix, F.col("id")))


def decisions(found: DataFrame, session: str, policy_version: str) -> DataFrame:
    """One decision for each class of a session's classified findings: the ids it rests on and its reasons, in order."""
    by = found.where("class <> 'none'").groupBy(session, "class").agg(F.array_sort(F.collect_list("id")).alias("finding_ids"), F.array_sort(F.collect_set("rule")).alias("reason_codes"))
    rank = F.array_position(F.array(F.lit("blocked"), F.lit("redactable"), F.lit("warned")), F.col("class"))
    # Three rows a session at most.
    place = F.row_number().over(Window.partitionBy(session).orderBy(rank))
    return by.withColumn("id", numbered("decision", place)).withColumn("policy_version", F.lit(policy_version))


def counters(sessions: DataFrame, **parts: DataFrame) -> DataFrame:
    """sessions with a count for each named table of rows (session_id, ..); 0 where a session has none."""
    for name, rows in parts.items():
        sized = rows.groupBy(F.col("session_id").alias("_of")).agg(F.count("*").alias(name))
        sessions = sessions.join(sized, F.col("id") == F.col("_of"), "left").drop("_of").withColumn(name, F.coalesce(name, F.lit(0)))
    return sessions


def finish(sessions: DataFrame, ts: Column, status: Column, output: Column | None = None) -> DataFrame:
    """sessions ended: status, ended_at, and the hash of the output text where there is one."""
    new = {"ended_at": utc_string(ts), "status": status}
    return sessions.withColumns(new | ({} if output is None else {"output_hash": F.when(output.isNotNull(), fingerprint(output))}))
