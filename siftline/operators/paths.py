"""Path denial by glob patterns."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default patterns.
DEFAULT_DENY = [".env", ".env.*", "**/*.pem", "**/*.key", "**/secrets/**", "~/.ssh/**", "~/.aws/**"]


def glob_regex(pattern: str) -> str:
    """An anchored Java pattern for a shell glob; '*' also crosses '/'."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[\\s\\S]*"
        elif c == "?":
            out += "[\\s\\S]"
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + body[1:] if body[0] == "!" else "\\" + body if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "_/" else "\\" + c
    return f"^{out}$"


def denied(path: Column, patterns: list[str] | None = None, home: str | None = None, cwd: str | None = None, strict: bool = False) -> Column:
    """Does a pattern deny the path, as a whole or by its name?

    '~' patterns are held against the absolute path, as globs and as prefixes. A pattern that starts with .env also
    denies every .env and .env.* name. As '**/x' needs a '/', it doesn't deny a top-level x unless strict.
    """
    home, cwd = home or os.path.expanduser("~"), cwd or os.getcwd()
    name = F.substring_index(path, "/", -1)
    expanded = F.when(path.startswith("~/"), F.concat(F.lit(home), F.substr(path, F.lit(2)))).otherwise(path)
    whole = F.when(expanded.startswith("/"), expanded).otherwise(F.concat(F.lit(cwd + "/"), expanded))
    out = F.lit(False)
    for p in DEFAULT_DENY if patterns is None else patterns:
        if not p:
            continue
        if p.startswith("~"):
            full = home + p[1:]
            out |= whole.rlike(glob_regex(full)) | whole.startswith(re.sub(r"[/*]+$", "", full))
            continue
        out |= path.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
        if strict and p.startswith("**/"):
            out |= path.rlike(glob_regex(p[3:]))
        if p.startswith(".env"):
            out |= (name == ".env") | name.startswith(".env.")
    return F.coalesce(out, F.lit(False))


def path_findings(df: DataFrame, keys: list[str], path: str = "path", patterns: list[str] | None = None, **where) -> DataFrame:
    """A finding for each denied path."""
    null = lambda t: F.lit(None).cast(t)
    return df.where(denied(F.col(path), patterns, **where)).select(
        *keys, F.lit(0).alias("ord"), F.lit("path").alias("type"), F.lit("critical").alias("severity"), F.lit("path_rules").alias("scanner"), F.col(path).alias("origin"),
        F.col(path).alias("path"), null("int").alias("line"), F.lit("denied_path").alias("rule"), F.lit(1.0).alias("confidence"), F.lit("block").alias("recommended_action"),
        F.lit("Path denied by policy").alias("details"), null("int").alias("start"), null("int").alias("end"), null("string").alias("matched"),
    )
