"""The gate: a table of requests in, a verdict per request out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import adapters, policy as P, redact, scan

# Exit codes by status, and of the two kinds of failure.
EXIT = {"completed": 0, "degraded": 0, "blocked": 1}
NOT_FOUND, FAILED = 2, 3


def output_text(stdout: Column, stderr: Column) -> Column:
    """What a process said: its output, or its errors if there is none."""
    return F.coalesce(F.nullif(stdout, F.lit("")), stderr)


def _actions(policy: P.Policy, findings: str) -> Column:
    kinds = F.array(*[F.struct(F.lit(r.type).alias("type"), F.lit(r.action).alias("action")) for r in R.TEXT_RULES])
    return F.transform(findings, lambda f: P.action(policy, F.get(kinds, f["rule"])["type"], F.get(kinds, f["rule"])["action"]))


def _count(actions: str, group: list[str]) -> Column:
    return F.size(F.filter(actions, lambda a: a.isin(group)))


def decide(requests: DataFrame, policy: P.Policy, key: str = "request_id", argv: str = "argv", executed: bool = False) -> DataFrame:
    """Scans the prompt of each request and its whole command line, and decides. All in the row: no shuffle.

    Gives key, adapter, prompt, prompt_tokens, n_findings, n_blocked, n_redactable, n_warned, status, exit_code and
    redacted_prompt. With executed, requests also have stdout, stderr and failure ('not-found', or another text) of a
    process that ran for them: its output is scanned as well, and safe_output is what may be shown of it. Where the
    policy keeps all work local nothing was to run, and these are ignored.
    """
    df = requests.withColumns({"adapter": adapters.adapter(F.col(argv)), "prompt": adapters.prompt(F.col(argv)), "command_text": F.array_join(argv, " ")})
    df = scan.scan(df, "prompt", "prompt")
    df = df.withColumn("guarded", scan.findings(F.col("command_text"), F.lit("command"), F.lit(None).cast("string"), R.COMMANDS))
    df = df.withColumn("actions", F.concat(_actions(policy, "findings"), F.transform("guarded", lambda f: F.lit(policy.commands))))
    # Named apart from the counts that redaction adds.
    named = {"n_findings": "c_findings", "n_blocked": "c_blocked", "n_redactable": "c_redactable", "n_warned": "c_warned"}
    df = df.withColumns({"c_findings": F.size("actions"), "c_blocked": _count("actions", P.BLOCK), "c_redactable": _count("actions", P.REDACT), "c_warned": _count("actions", P.WARN)})
    df = redact.redact(df, "prompt", "sensitive")
    df = df.withColumn("redacted_prompt", F.when(F.col("c_redactable") > 0, F.col("redacted_text")).otherwise(F.col("prompt")))
    about, counts = [key, "adapter", "prompt", T.n_tokens(F.col("prompt")).alias("prompt_tokens")], [F.col(c).alias(n) for n, c in named.items()]
    observing = F.lit(policy.mode == "observe-only")
    stopped = ~observing & (F.col("c_blocked") > 0)
    if not executed or policy.mode == "strict-local":
        df = df.withColumn("status", P.verdict(policy, F.col("c_blocked"), F.col("c_findings")))
        return df.select(*about, *counts, "status", F.when(stopped, EXIT["blocked"]).otherwise(EXIT["completed"]).alias("exit_code"), "redacted_prompt")
    failed = F.col("failure").isNotNull()
    df = df.select(*about, *named.values(), "redacted_prompt", stopped.alias("stopped"), "failure", F.when(~stopped & ~failed, output_text(F.col("stdout"), F.col("stderr"))).alias("output_text"))
    df = scan.scan(df, "output_text", "output").withColumn("said", _actions(policy, "findings"))
    df = redact.redact(df, "output_text", "sensitive")
    guarded = ~observing & (_count("said", P.BLOCK) > 0)
    total = F.col("c_findings") + F.size("said")
    status = F.when(F.col("stopped"), "blocked").when(failed, "error").when(guarded, "blocked").when(observing & (total > 0), "degraded").otherwise("completed")
    code = F.when(F.col("status") == "blocked", EXIT["blocked"]).when(F.col("failure") == "not-found", NOT_FOUND).when(F.col("status") == "error", FAILED).otherwise(EXIT["completed"])
    safe = F.when(F.col("status").isin("completed", "degraded"), F.col("redacted_text"))
    said = (F.size("said"), *(_count("said", g) for g in (P.BLOCK, P.REDACT, P.WARN)))
    counts = [(F.col(c) + more).alias(n) for (n, c), more in zip(named.items(), said)]
    df = df.withColumn("status", status).withColumns({"exit_code": code, "safe_output": safe})
    return df.select(key, "adapter", "prompt", "prompt_tokens", *counts, "status", "exit_code", "redacted_prompt", "safe_output")
