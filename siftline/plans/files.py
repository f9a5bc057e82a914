"""A scan of files: denial, limits, findings, totals and a verdict, from a table of (path, size, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import policy as P, scan
from ..sources import tree


def scan_files(files: DataFrame, policy: P.Policy, max_files: int = tree.MAX_FILES, max_bytes: int = tree.MAX_BYTES) -> DataFrame:
    """One row per file: path, classification, content_hash, n_tokens, n_findings, n_blocked, n_redactable and n_warned.

    A denied path is a blocking finding of its own and its content isn't scanned; neither is what exceeds a limit.
    """
    rows = tree.manifest(files, policy.deny, max_files, max_bytes)
    rows = scan.scan(rows, "text", F.concat(F.lit("file:"), "path"), F.col("path"))
    kinds = F.array(*[F.struct(F.lit(r.type).alias("type"), F.lit(r.action).alias("action")) for r in R.TEXT_RULES])
    own = F.transform("findings", lambda f: P.action(policy, F.get(kinds, f["rule"])["type"], F.get(kinds, f["rule"])["action"]))
    denied = F.when(F.col("classification") == "denied", F.array(F.lit("block"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("actions", F.concat(denied, own))
    count = lambda group: F.size(F.filter("actions", lambda a: a.isin(group))).cast("long")
    return rows.select(
        "path", "classification", "content_hash", "n_tokens", F.size("actions").cast("long").alias("n_findings"), count(P.BLOCK).alias("n_blocked"),
        count(P.REDACT).alias("n_redactable"), count(P.WARN).alias("n_warned"),
    )


def totals(scanned: DataFrame, policy: P.Policy, keys: list[str] | None = None) -> DataFrame:
    """Files, tokens, findings and what blocks, with the verdict: blocked, degraded (seen, but only observed) or completed."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_tokens", "n_findings", "n_blocked", "n_redactable", "n_warned")]
    found = scanned.groupBy(*(keys or [])).agg(F.count_if(F.col("classification") == "scanned").alias("files_scanned"), F.count_if(F.col("classification") == "denied").alias("files_denied"), *sums)
    return found.withColumn("status", P.verdict(policy, F.col("n_blocked"), F.col("n_findings")))


def redact_file(files: DataFrame, policy: P.Policy, mode: str = "default") -> DataFrame:
    """Each file with its text redacted: (path, denied, redacted_text, replacements_count, n_blocked).

    A file is denied by its full path, or by any part of it from some folder on; its text then stays unread.
    """
    from ..operators import paths, redact

    whole = F.col("path")
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split(whole, "/"))), lambda i: F.array_join(F.slice(F.split(whole, "/"), i, F.size(F.split(whole, "/"))), "/"))
    rows = files.withColumn("_tails", tails).withColumn("denied", F.exists("_tails", lambda p: paths.denied(p, policy.deny)))
    rows = rows.withColumn("text", F.when(~F.col("denied"), tree.decoded("content"))).drop("content", "_tails")
    out = redact.redact(scan.scan(rows, "text", F.concat(F.lit("file:"), "path"), F.col("path")), mode=mode)
    return out.select("path", "denied", "redacted_text", "replacements_count", "n_blocked")
