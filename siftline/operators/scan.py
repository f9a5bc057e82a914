"""Span extraction: every rule's matches in a text column, as an array in the row or as a table of findings.

All rules run in one projection over one scan of the table: no shuffle, no Python, and the same on a stream. A finding
is (start, end, rule number) until it is shown; the rule's attributes come from a literal array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

FINDINGS = "array<struct<start:int,end:int,rule:int>>"
PUBLIC = ["type", "severity", "scanner", "origin", "path", "line", "rule", "confidence", "recommended_action", "details"]


def _window(text: Column, start: Column, chars: int) -> Column:
    """Up to chars characters before an offset."""
    return F.substr(text, F.greatest(start - chars, F.lit(0)) + 1, F.least(start, F.lit(chars)))


def untrusted(origin: Column, path: Column) -> Column:
    return (F.coalesce(path, F.lit("")) != "") | F.lower(origin).rlike("|".join(R.UNTRUSTED))


def _keep(rule: R.Rule, text: Column, span: Column, ascii_words: bool) -> Column | None:
    """What more a match must satisfy, if anything."""
    if rule.name in R.NEGATABLE:
        return ~_window(text, span["start"], R.NEGATION_CHARS).rlike(T.java(R.NEGATION, ascii_words))
    if rule.type == "semantic_leak":
        left = F.greatest(span["start"] - R.BENIGN_CHARS, F.lit(0))
        around = F.substr(text, left + 1, span["end"] + R.BENIGN_CHARS - left)
        keep = ~around.rlike(T.java(R.BENIGN, ascii_words))
        if rule.name == R.SUBJECT_RULE:
            keep &= ~_window(text, span["start"], R.SUBJECT_CHARS).rlike(T.java(R.SUBJECT, ascii_words))
        return keep
    return None


def _kept(rule: R.Rule, i: int, text: Column, ascii_words: bool):
    """What is made of a rule's spans: findings, those of them that hold."""

    def kept(found: Column) -> Column:
        if _keep(rule, text, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")), ascii_words) is not None:
            found = F.filter(found, lambda span: _keep(rule, text, span, ascii_words))
        return F.transform(found, lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(i).alias("rule")))

    return kept


def _maybe(rule: R.Rule, low: Column | None, odd: Column | None) -> Column | None:
    if low is None or not rule.needs:
        return None
    some = low.contains(rule.needs[0])
    for need in rule.needs[1:]:
        some |= low.contains(need)
    return some | odd


def findings(text: Column, origin: Column, path: Column, rules: Sequence[R.Rule] = R.TEXT_RULES, low: Column | None = None, odd: Column | None = None, ascii_words: bool = False) -> Column:
    """Findings of a text, by start, end and rule order. low, odd: the text in lower case, and whether it has FOLDING.

    ascii_words: see `scan`; of a text of `T.apart`, and odd is whether it is `T.folding`.
    """
    found = []
    # What is neither, without an origin, is scanned.
    doubted = F.coalesce(untrusted(origin, path), F.lit(True))
    for i, rule in enumerate(rules):
        maybe = _maybe(rule, low, odd)
        if rule.type == "semantic_leak":
            maybe = doubted if maybe is None else doubted & maybe
        found.append(T.spans(text, rule.pattern, maybe, _kept(rule, i, text, ascii_words), FINDINGS, odd if ascii_words else None))
    return F.sort_array(F.concat(*found)).cast(FINDINGS)


def _attributes(rules: Sequence[R.Rule]) -> Column:
    names = ("name", "type", "scanner", "severity", "action", "confidence", "details")
    return F.array(*[F.struct(*[F.lit(getattr(r, n)).cast("double" if n == "confidence" else "string").alias(n) for n in names]) for r in rules])


#: The column that `scan` adds beside `findings`: the origin and path under which a text was scanned.
SOURCE = "finding_source"


def scan(df: DataFrame, text: str = "text", origin: Column | str = "text", path: Column | None = None, rules: Sequence[R.Rule] = R.TEXT_RULES, ascii_words: bool = False) -> DataFrame:
    """df with the columns `findings` and `finding_source` (origin, path). origin: a column, or one name for all rows.

    Columns of df named origin or path stay as they are, and count only where they are given. Words and white space follow
    Unicode; ascii_words: they are read as RE2 does, to whom a letter beyond ASCII ends a word (a hit or a negation beside it may differ).
    """
    origin = F.lit(origin) if isinstance(origin, str) else origin
    path = F.lit(None).cast("string") if path is None else path
    free = lambda name: name if name not in df.columns else free(name + "_")
    low, odd, read = free("_low"), free("_odd"), free("_read") if ascii_words else text
    df = df.withColumn(read, T.apart(F.col(text))) if ascii_words else df
    folds = T.folding(F.col(read)) if ascii_words else F.col(text).rlike(R.FOLDING)
    df = df.withColumns({SOURCE: F.struct(origin.alias("origin"), path.alias("path")), low: F.lower(F.col(read)), odd: folds})
    found = findings(F.col(read), F.col(f"{SOURCE}.origin"), F.col(f"{SOURCE}.path"), rules, F.col(low), F.col(odd), ascii_words)
    return df.withColumn("findings", found).drop(low, odd, *([read] if ascii_words else []))


def listed(scanned: DataFrame, keys: Sequence[str], text: str = "text", rules: Sequence[R.Rule] = R.TEXT_RULES, line: Column | None = None) -> DataFrame:
    """One row per finding, with its span and text: internal, as `matched` holds what must not be shown."""
    named = [F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)]
    rows = scanned.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(f"{SOURCE}.origin").alias("origin"), F.col(f"{SOURCE}.path").alias("path"),
                          F.col("findings").alias("_found"), F.col(text).alias("_text"))
    # Lines and texts are read off the row's blocks before findings become rows, so that no text is copied per finding.
    rows = rows.withColumn("_blocks", F.when(F.size("_found") > 0, T.blocks(F.col("_text")))).withColumn("_before", T.newlines(F.col("_blocks")))
    block, before = F.col("_blocks"), F.col("_before")

    def whole(f: Column) -> Column:
        at = T.line_in(block, before, f["start"]) if line is None else line
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), f["rule"].alias("rule"), at.alias("line"), T.piece(block, f["start"], f["end"]).alias("matched"))

    # Outer, as the filter that is else put before an explode would run all rules twice.
    rows = rows.select("*", F.transform("_found", whole).alias("_listed")).drop("_found", "_text", "_blocks", "_before")
    rows = rows.select("*", F.posexplode_outer("_listed").alias("ord", "f")).drop("_listed").where("f IS NOT NULL")
    rows = rows.withColumn("_r", F.get(_attributes(rules), F.col("f.rule")))
    noted = F.when((F.col("_r.type") == "secret") & F.col("path").rlike(R.SENSITIVE_PATH), "sensitive_path")
    return rows.select(
        *named, "ord", F.col("_r.type").alias("type"), F.col("_r.severity").alias("severity"), F.col("_r.scanner").alias("scanner"), "origin", "path",
        F.col("f.line").alias("line"), F.col("_r.name").alias("rule"), F.col("_r.confidence").alias("confidence"),
        F.col("_r.action").alias("recommended_action"), F.coalesce(F.col("_r.details"), noted).alias("details"),
        F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.col("f.matched").alias("matched"),
    )


def scan_command(df: DataFrame, keys: Sequence[str], command: str = "text", origin: str = "command", ascii_words: bool = False) -> DataFrame:
    """Findings of the command guard: no path, always line 1."""
    return listed(scan(df, command, origin, rules=R.COMMANDS, ascii_words=ascii_words), keys, command, R.COMMANDS, F.lit(1))


def public(found: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What may be shown of findings: neither span nor text."""
    return found.select(*keys, *PUBLIC)


def shown(found: DataFrame) -> DataFrame:
    """Lines for people: severity, type, rule and place of a finding; and the same as JSON."""
    place = F.concat_ws(":", F.coalesce(F.when(F.col("path") != "", F.col("path")), F.col("origin")), F.coalesce(F.col("line").cast("string"), F.lit("-")))
    return found.select(F.concat_ws(" ", F.upper("severity"), "type", "rule", place).alias("plain"), F.to_json(F.struct(*PUBLIC)).alias("json"))


def ordered(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings with their number in the document, as reports list them: by start (none last), end, and rule order."""
    place = F.struct(F.col("start").isNull(), F.coalesce("start", F.lit(0)), F.coalesce("end", F.lit(0)), "ord")
    return found.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(place)))


def with_lines(found: DataFrame, text: Column) -> DataFrame:
    """Findings with a line where they had none and have a start."""
    return found.withColumn("line", F.coalesce("line", F.when(F.col("start").isNotNull(), T.line_at(text, F.col("start")))))
