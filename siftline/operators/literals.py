"""Redaction inside string literals of source code, which leaves the code around them as it is.

A lexer of one pattern per language finds comments and literals from left to right, as whichever begins first holds the
other; a literal's runs are what it says between its quotes, without interpolations. A finding that overlaps a literal
puts its placeholder in place of the first run that it overlaps, and empties its others. Quotes, prefixes and
interpolations stay, and so does all outside of literals: comments, and findings without a literal, which are counted.

Where the new text doesn't hold as many literals as the old one, the text of its row is redacted as plain text instead; so
is that of an unknown language. JavaScript's regular expressions aren't told from divisions: a lone quote in one can hide what
follows on its line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import rules as R
from ..functions import text as T
from ..workers import ship
from . import redact as plain

_ESCAPED = r"\\[\s\S]"
_LINE = [rf"{q}(?:[^{q}\\\n]++|{_ESCAPED})*+{q}" for q in "\"'"]
_LONG = [rf"{q * 3}(?:[^{q}\\]++|{_ESCAPED}|{q}(?!{q}{q}))*+{q * 3}" for q in "\"'"]
#: An interpolation in braces, with braces or a template of one level within.
_INNER = r"\{[^{}`]*(?:(?:\{[^{}`]*\}|`[^`]*`)[^{}`]*)*\}"
#: Comments and literals of a language, and what an interpolation of its literals is.
TOKENS = {
    "python": (rf"#[^\n]*|(?:(?<![A-Za-z0-9_])[rbufRBUF]{{1,2}})?(?:{'|'.join(_LONG + _LINE)})", rf"\{{(?!\{{)[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*\}}"),
    "javascript": (rf"//[^\n]*|/\*[\s\S]*?\*/|{'|'.join(_LINE)}|`(?:[^`\\$]++|{_ESCAPED}|\$(?!\{{)|\${_INNER})*+`", rf"\${_INNER}"),
}
_RUN = {"python": r"(?:[^{\\]|\\[\s\S]|\{\{)+", "javascript": r"(?:[^$\\]|\\[\s\S]|\$(?!\{))+"}
_OPEN = r"^([A-Za-z]*)(\"\"\"|'''|[\"'`])"


def runs(text: Column, blocks: Column, language: str) -> Column:
    """What each literal of a text says, in order: (start, end, of), where of is the literal's start. Comments have none."""
    tokens, inner = TOKENS[language]

    def of(token: Column) -> Column:
        def parts(x: Column) -> Column:
            lead = x["at"] + F.length(x["prefix"]) + F.length(x["quote"])
            body = F.substr(x["said"], F.length(x["prefix"]) + F.length(x["quote"]) + 1, F.length(x["said"]) - F.length(x["prefix"]) - 2 * F.length(x["quote"]))
            run = lambda s: F.struct((lead + s["start"]).alias("start"), (lead + s["end"]).alias("end"), x["at"].alias("of"))
            filled = (x["quote"] == "`") if language != "python" else x["prefix"].rlike("(?i)f")
            pieces = T.spans(body, f"(?:{inner})|{_RUN[language]}")
            said = F.filter(F.transform(pieces, run), lambda r: ~F.substr(x["said"], r["start"] - x["at"] + 1, r["end"] - r["start"]).rlike(f"^(?:{inner})$"))
            whole = F.array(F.struct(lead.alias("start"), (lead + F.length(body)).alias("end"), x["at"].alias("of")))
            return F.when(x["quote"] == "", F.array().cast("array<struct<start:int,end:int,of:int>>")).when(filled, said).otherwise(whole).cast("array<struct<start:int,end:int,of:int>>")

        said = T.piece(blocks, token["start"], token["end"])
        named = T.let(said, lambda s: F.struct(s.alias("said"), token["start"].alias("at"), F.regexp_extract(s, _OPEN, 1).alias("prefix"), F.regexp_extract(s, _OPEN, 2).alias("quote")))
        return T.let(named, parts)

    return F.filter(F.flatten(F.transform(T.spans(text, tokens), of)), lambda r: r["end"] > r["start"])


@F.arrow_udf(ArrayType(StructType().add("a", IntegerType()).add("b", IntegerType())))
def _within(start: pa.Array, end: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """For each span of a row, which of the row's runs it overlaps: from a to b, exclusive. Runs are in order and apart."""
    row, starts = plain._flat(start)
    of, firsts = plain._flat(first)
    ends, lasts = plain._flat(end)[1], plain._flat(last)[1]
    at = lambda r, x: r * (1 << 32) + np.asarray(x).astype(np.int64)
    begin = np.searchsorted(of, row)
    a = np.searchsorted(at(of, lasts), at(row, starts), "right") - begin
    b = np.searchsorted(at(of, firsts), at(row, ends), "left") - begin
    fields = [pa.array(x.astype(np.int32)) for x in (a, np.maximum(a, b))]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(start))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["a", "b"]))


def _by_language(language: Column, value) -> Column:
    return F.when(language == "python", value("python")).when(language.isin("javascript", "typescript"), value("javascript"))


def _count(text: Column, language: str) -> Column:
    """Comments and literals of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U){TOKENS[language][0]}")), F.lit(0))


def redact(scanned: DataFrame, language: Column, text: str = "text", mode: str = "sensitive") -> DataFrame:
    """scanned rows with redacted_text, replacements_count (runs replaced), n_outside (findings without a literal) and in_literals
    (false: the text was redacted as plain text, and n_outside is null)."""
    ship(scanned.sparkSession)
    t, b = F.col(text), F.col("_lit_blocks")
    about = F.array(*[
        F.struct(F.lit(r.type).alias("type"), F.lit(r.name).alias("name"), F.lit(R.SEVERITIES.index(r.severity)).alias("rank"), F.lit(plain._prefix(r)).alias("prefix"), F.lit(plain._wanted(r, mode)).alias("wanted"))
        for r in R.TEXT_RULES
    ])
    asked = F.filter(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.get(about, f["rule"]).alias("r"))), lambda f: f["r"]["wanted"])
    df = plain.redact(scanned, text, mode).select(*[F.col(f"`{c}`") for c in scanned.columns], F.col("redacted_text").alias("_plain"), F.col("replacements_count").alias("_plain_n"))
    df = df.withColumns({"_language": language, "_wanted": asked})
    # A text without findings isn't taken apart.
    some = F.size("_wanted") > 0
    df = df.withColumn("_lit_blocks", F.when(some, T.blocks(t)))
    df = df.withColumn("_runs", F.when(some, _by_language(F.col("_language"), lambda name: runs(t, b, name))))
    of = lambda c, name: F.transform(c, lambda s: s[name])
    df = df.withColumn("_at", _within(*[of(c, name) for c in ("_wanted", "_runs") for name in ("start", "end")]))
    df = df.withColumn("_asked", F.zip_with("_wanted", "_at", lambda f, w: F.struct(f.alias("f"), w.alias("w"), (w["b"] > w["a"]).alias("met"))))
    inside = F.transform(F.filter("_asked", lambda x: x["met"]), lambda x: F.struct(
        x["f"]["start"].alias("start"), x["f"]["end"].alias("end"), x["f"]["r"]["rank"].alias("rank"), T.piece(b, x["f"]["start"], x["f"]["end"]).alias("value"), x["f"]["r"]["prefix"].alias("prefix"), x["w"].alias("w")))
    df = df.withColumn("_inside", inside)
    df = df.withColumn("_names", plain._picked(*[of("_inside", name) for name in ("start", "end", "rank", "value", "prefix")]))

    def edits(p: Column) -> Column:
        f = F.get("_inside", p["at"])
        name = F.concat(F.lit("["), p["prefix"], F.lit("_"), p["n"].cast("string"), F.lit("]"))
        own = F.slice("_runs", f["w"]["a"] + 1, f["w"]["b"] - f["w"]["a"])
        return F.transform(own, lambda r, i: F.struct(r["start"].alias("start"), (i > 0).alias("later"), r["end"].alias("end"), F.when(i == 0, name).otherwise("").alias("put")))

    df = df.withColumn("_every", F.sort_array(F.flatten(F.transform("_names", edits))))
    # A run that several findings overlap is replaced once.
    df = df.withColumn("_edits", F.filter("_every", lambda e, i: (i == 0) | (e["start"] != F.get("_every", i - 1)["start"])))
    put = F.transform("_edits", lambda e, i: F.concat(T.piece(b, F.when(i > 0, F.get("_edits", i - 1)["end"]).otherwise(0), e["start"]), e["put"]))
    spliced = F.concat(F.array_join(put, ""), F.substr(t, F.element_at("_edits", -1)["end"] + 1))
    df = df.withColumn("_new", F.when(F.size("_edits") > 0, spliced).otherwise(t))
    # Literals are counted again in what came out; where their number isn't the same, the text isn't trusted.
    same = _by_language(F.col("_language"), lambda name: (F.size("_edits") == 0) | (_count(F.col("_new"), name) == _count(t, name)))
    df = df.withColumn("in_literals", F.coalesce(same, F.lit(False)))
    fine = F.col("in_literals")
    return df.withColumns({
        "redacted_text": F.when(fine, F.col("_new")).otherwise(F.col("_plain")), "replacements_count": F.when(fine, F.size("_edits")).otherwise(F.col("_plain_n")),
        "n_outside": F.when(fine, F.size(F.filter("_asked", lambda x: ~x["met"]))),
    }).drop("_plain", "_plain_n", "_language", "_lit_blocks", "_runs", "_wanted", "_at", "_asked", "_inside", "_names", "_every", "_edits", "_new")
