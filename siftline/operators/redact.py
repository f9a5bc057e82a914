"""Redaction: narrow each finding to its value, number placeholders, choose spans that don't overlap, and splice.

Placeholders are numbered by document and nothing is shuffled. Narrowing and splicing are Column expressions over blocks of
the text; choosing and numbering are one sweep over all findings of an Arrow batch, in n log n, so that a text may hold
any number of findings.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions import rules as R
from ..functions import text as T
from ..workers import ship

MODES = ("default", "sensitive", "all")
# What is never redacted, and the prefix of a placeholder by rule or type.
NEVER = ["prompt_injection", "command_guard", "path"]
PREFIX = {"email_address": "EMAIL", "phone_number_india": "PHONE", "account_identifier": "ACCOUNT"}
PREFIX_BY_TYPE = {"pii": "SENSITIVE", "secret": "SECRET", "semantic_leak": "LEAK"}


def _prefix(rule: R.Rule) -> str:
    return PREFIX.get(rule.name) or PREFIX_BY_TYPE.get(rule.type, "REDACTED")


def _wanted(rule: R.Rule, mode: str) -> bool:
    if rule.type in NEVER:
        return False
    return mode == "all" or mode == "sensitive" and rule.type in ("secret", "pii") or mode == "default" and rule.action == "redact"


def _value(match: Column, kind: Column, name: Column) -> Column:
    """(offset, value, quoted) of the sensitive part of a match: a token, an assigned value, or all of it."""

    def part(offset: Column, value: Column, quoted: Column) -> Column:
        return F.struct(offset.cast("int").alias("offset"), value.alias("value"), quoted.alias("quoted"))

    lead = F.length(F.regexp_extract(match, r"(?U)^(\S+\s+)\S", 1))
    out = part(F.lit(0), match, F.lit(False))
    for separator in ("=", ":"):  # the later one is asked first
        at = F.instr(match, separator)
        named = (at > 0) & F.regexp_replace(F.substr(match, F.lit(1), at - 1), r"(?U)^\s+|\s+$", "").rlike(r"^[A-Za-z_][A-Za-z0-9_\-.]*$")
        rest = F.substr(match, at + 1)
        group = lambda n: F.regexp_extract(rest, r"""(?U)^([\s\S]*?\s*)(['"]?)([^'"\s]+)\2""", n)
        run = (group(3) != "") & ~group(3).startswith("//")
        bare = F.regexp_replace(F.regexp_replace(rest, r"(?U)^\s+|\s+$", ""), r"""^['"]+|['"]+$""", "")
        plain = (bare != "") & ~bare.startswith("//")
        out = (
            F.when(named & run, part(at + F.length(group(1)) + F.length(group(2)), group(3), group(2) != ""))
            .when(named & plain, part(at + F.instr(rest, F.left(bare, F.lit(1))) - 1, bare, F.lit(False)))
            .otherwise(out)
        )
    return F.when((name == "bearer_token") & (lead > 0), part(lead, F.substr(match, lead + 1), F.lit(False))).when(kind == "secret", out).otherwise(
        part(F.lit(0), match, F.lit(False))
    )


PICKED = ArrayType(StructType().add("at", IntegerType()).add("prefix", StringType()).add("n", IntegerType()))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element of a list column, and the elements; null lists have none."""
    return np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0))), column.flatten()


def chosen(row: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which spans stay: of higher rank first, then longer, then earlier in their row; kept if nothing kept before overlaps.

    Rows without an overlap keep all. In the others each span is held against its neighbours in the ordered set of kept ones.
    """
    order = np.lexsort((end, start, row))
    clash = (row[order][1:] == row[order][:-1]) & (start[order][1:] < end[order][:-1])
    keep = ~np.isin(row, row[order][1:][clash])
    rest = np.flatnonzero(~keep)
    rest = rest[np.lexsort((rest, start[rest] - end[rest], -rank[rest], row[rest]))]
    now, starts, ends = -1, [], {}
    for i, r, a, b in zip(rest.tolist(), row[rest].tolist(), start[rest].tolist(), end[rest].tolist()):
        if r != now:
            now, starts, ends = r, [], {}
        at = bisect_right(starts, a)
        if (at == 0 or ends[starts[at - 1]] <= a) and (at == len(starts) or starts[at] >= b):
            insort(starts, a)
            ends[a] = b
            keep[i] = True
    return keep


def numbers(row: np.ndarray, value: pa.Array, prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each span the first of its row with the same value, and that one's number among the row's first ones of its prefix."""
    code = lambda x: np.asarray(x.dictionary_encode().indices)
    _, first, which = np.unique(np.stack((row, code(value))), axis=1, return_index=True, return_inverse=True)
    which, first = which.reshape(-1), np.asarray(first)
    groups = np.stack((row[first], code(prefix)[first]))
    order = np.lexsort((first, groups[1], groups[0]))
    new = np.concatenate(([True], (groups[:, order][:, 1:] != groups[:, order][:, :-1]).any(axis=0)))
    begin = np.flatnonzero(new)
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first)))) + 1
    return first[which], number[which]


@F.arrow_udf(PICKED)
def _picked(start: pa.Array, end: pa.Array, rank: pa.Array, value: pa.Array, prefix: pa.Array) -> pa.Array:
    """The spans of each row that are replaced, in order of their place, with the name of what replaces them."""
    row, starts = _flat(start)
    ends, ranks, prefixes = (_flat(x)[1] for x in (end, rank, prefix))
    kind = pa.list_(pa.struct([("at", pa.int32()), ("prefix", pa.string()), ("n", pa.int32())]))
    if not len(row):
        return pa.array([None if not v else [] for v in start.is_valid().to_pylist()], kind)
    first, n = numbers(row, _flat(value)[1], prefixes)
    keep = np.flatnonzero(chosen(row, *(np.asarray(x).astype(np.int64) for x in (starts, ends, ranks))))
    keep = keep[np.lexsort((np.asarray(starts)[keep], row[keep]))]
    begin = np.searchsorted(row, np.arange(len(start)))
    fields = [pa.array((keep - begin[row[keep]]).astype(np.int32)), prefixes.take(pa.array(first[keep])).cast(pa.string()), pa.array(n[keep].astype(np.int32))]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row[keep], minlength=len(start))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["at", "prefix", "n"])).cast(kind)


def redact(scanned: DataFrame, text: str = "text", mode: str = "default") -> DataFrame:
    """Adds redacted_text, records (placeholder, type, rule, start), replacements_count and n_blocked to scanned rows.

    mode: 'default' takes findings whose action is redact, 'sensitive' all secrets and personal data, 'all' whatever
    can be redacted. n_blocked counts findings with the action block that were not replaced.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    ship(scanned.sparkSession)
    t, rules, b = F.col(text), R.TEXT_RULES, F.col("_blocks")
    about = F.array(*[
        F.struct(F.lit(r.name).alias("name"), F.lit(r.type).alias("type"), F.lit(R.SEVERITIES.index(r.severity)).alias("rank"), F.lit(_prefix(r)).alias("prefix"),
                 F.lit(_wanted(r, mode)).alias("wanted"), F.lit(r.action == "block").alias("blocks"))
        for r in rules
    ])
    numbered = F.transform("findings", lambda f, i: F.struct(f["start"].alias("start"), f["end"].alias("end"), i.alias("ord"), F.get(about, f["rule"]).alias("r")))
    df = scanned.withColumn("_all", numbered).withColumn("_blocks", F.when(F.size("_all") > 0, T.blocks(t)))

    # One step binds what the next one names more than once.
    wanted = F.filter("_all", lambda f: f["r"]["wanted"] & (f["end"] > f["start"]))
    matched = F.transform(wanted, lambda f: F.struct(f["ord"].alias("ord"), f["start"].alias("at"), f["r"].alias("r"), T.piece(b, f["start"], f["end"]).alias("match")))
    df = df.withColumn("_narrow", F.transform(matched, lambda f: F.struct(
        f["ord"].alias("ord"), f["at"].alias("at"), f["r"].alias("r"), _value(f["match"], f["r"]["type"], f["r"]["name"]).alias("v"))))

    def around(n: Column) -> Column:
        def seen(s: Column) -> Column:
            near = T.piece(b, F.greatest(s["start"] - T.BLOCK, F.lit(0)), s["start"])
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), near.alias("near"), T.piece(b, s["end"], s["end"] + 1).alias("after"))

        start = n["at"] + n["v"]["offset"]
        place = T.let(F.struct(start.alias("start"), (start + F.length(n["v"]["value"])).alias("end")), seen)
        return F.struct(n.alias("n"), place.alias("p"))

    def placed(x: Column) -> Column:
        n, p = x["n"], x["p"]
        before = F.right(p["near"], F.lit(1))
        quoted = n["v"]["quoted"] | (p["start"] > 0) & (before == p["after"]) & before.isin("'", '"', "`")
        # An assignment right before the value, on its line. A block's length back tells, unless all of it could stand between.
        far = F.when((p["start"] > T.BLOCK) & p["near"].rlike(r"""^(?U)[\s:='"]*$"""), F.substr(t, F.lit(1), p["start"])).otherwise(p["near"])
        assigned = F.substring_index(far, "\n", -1).rlike(r"""(?U)[A-Za-z0-9_\-.]\s*[:=]\s*['"]?$""")
        return F.struct(
            n["ord"].alias("ord"), p["start"].alias("start"), p["end"].alias("end"), n["v"]["value"].alias("value"), n["r"]["prefix"].alias("prefix"), n["r"]["rank"].alias("rank"),
            n["r"]["type"].alias("type"), n["r"]["name"].alias("rule"), n["r"]["blocks"].alias("blocks"), ((n["r"]["type"] == "secret") & ~quoted & assigned).alias("quote"),
        )

    df = df.withColumn("_spans", F.filter(F.transform(F.transform("_narrow", around), placed), lambda s: s["end"] > s["start"]))
    part = lambda name: F.transform("_spans", lambda s: s[name])
    df = df.withColumn("_picked", _picked(*[part(name) for name in ("start", "end", "rank", "value", "prefix")]))

    def record(p: Column) -> Column:
        s = F.get("_spans", p["at"])
        name = F.concat(F.lit("["), p["prefix"], F.lit("_"), p["n"].cast("string"), F.lit("]"))
        shown = F.when(s["quote"], F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), name.alias("placeholder"), shown.alias("shown"), s["type"].alias("type"), s["rule"].alias("rule"),
                        s["ord"].alias("ord"), s["blocks"].alias("blocks"))

    df = df.withColumn("records", F.transform("_picked", record))

    def splice(r: Column, i: Column) -> Column:
        return F.concat(T.piece(b, F.when(i > 0, F.get("records", i - 1)["end"]).otherwise(0), r["start"]), r["shown"])

    last = F.element_at("records", -1)["end"]
    spliced = F.concat(F.array_join(F.transform("records", splice), ""), F.substr(t, last + 1))
    return df.withColumns({
        "redacted_text": F.when(F.size("records") > 0, spliced).otherwise(t),
        "replacements_count": F.size("records"),
        "n_blocked": F.size(F.filter("_all", lambda f: f["r"]["blocks"])) - F.size(F.filter("records", lambda r: r["blocks"])),
    }).drop("_all", "_narrow", "_spans", "_picked", "_blocks")


def matched_records(records: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the id of the first finding of the same rule, line, and path or origin; 'unknown' without one.

    records: keys, rule, line, path, origin, placeholder. found: keys, finding_id, ord, rule, line, path, origin.
    """
    base = records.withColumn("_n", F.monotonically_increasing_id())
    left, right = base.alias("r"), found.alias("f")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*keys, "rule", "line"]]
    on = same[0]
    for c in same[1:]:
        on &= c
    on &= F.col("r.path").eqNullSafe(F.col("f.path")) | (F.col("r.origin") == F.col("f.origin"))
    joined = left.join(right, on, "left").groupBy("r._n", *[f"r.{c}" for c in records.columns]).agg(F.min_by("f.finding_id", "f.ord").alias("finding_id"))
    return joined.drop("_n").withColumn("finding_id", F.coalesce("finding_id", F.lit("unknown")))
