"""Quality rules kept as a bitmask ledger.

Every rule is measured and evaluated once per document. Its outcome is one bit of a failure mask that is stored
with the measurements, so that a policy is no more than another mask: applying a new version, or asking what each
rule contributes alone, is bitwise work on the ledger and never reads a text again.

Defined results: a null or empty text has no words and fails the base rules; texts of white space alone count as
empty; repeated rows and repeated ids are judged one by one; other columns of the input pass through `judge`
untouched, whatever their names, and an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_CHAR, read, words_of

SYMBOLS = "#*$%&|<>"

#: Rule name -> failure condition over the measurements, in bit order. All are ratios of counts of the whole text.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)",
    "shouting": "100 * n_bang_words > 40 * n_words",
    "digit_heavy": "100 * n_digits > 40 * word_chars",
}


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rejects: tuple[str, ...] = field(default_factory=lambda: tuple(RULES))

    @property
    def mask(self) -> int:
        return sum(1 << i for i, name in enumerate(RULES) if name in self.rejects)


POLICIES = {
    "base-1": Policy("base-1", ("too_few_words", "repeated_windows")),
    "full-1": Policy("full-1"),
}
BASE, FULL = POLICIES["base-1"], POLICIES["full-1"]


def _repeated(windows: Column) -> Column:
    """Sorted positions of the windows that occur twice or more: whole hashes are sorted with their positions."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = F.size(windows) - 1
    pairs = F.zip_with(F.slice(placed, 1, rest), F.slice(placed, 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, the measurements and `failed`, the bitmask of all RULES."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key), t.alias("_t"), words_of(F.col(text)).alias("_w"))
    # A window is known by a 64-bit hash of its three words; windows are compared within one text only.
    n = F.size("_w")
    triples = F.arrays_zip(F.slice("_w", 1, n - 2), F.slice("_w", 2, n - 2), F.slice("_w", 3, n - 2))
    df = df.withColumn("_h", F.when(n >= 4, F.transform(triples, lambda x: F.xxhash64(x))))
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(repeats, _repeated(F.col("_h"))))
    steps = F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + 3
    t = F.col("_t")
    only = lambda kind: F.length(F.regexp_replace(t, f"[^{kind}]+", "")).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
    df = df.withColumn("_lines", lines)
    df = df.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        only(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        only("0-9").alias("n_digits"),
        F.size(F.filter("_w", lambda w: w.endswith("!!"))).cast("long").alias("n_bang_words"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    # A filter on the verdict would be pushed below the measurements, with a copy of all of them for each mention; it stays
    # above a column that isn't deterministic, which adds nothing here.
    return df.withColumn("failed", mask.cast("long").bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit(0).cast("long"))))


def apply_policy(led: DataFrame, policy: Policy = FULL) -> DataFrame:
    """Adds base_failed and kept under a policy; what fails the base rules is never kept."""
    base = F.col("failed").bitwiseAND(BASE.mask) != 0
    return led.withColumns({"base_failed": base, "kept": ~base & (F.col("failed").bitwiseAND(policy.mask) == 0)})


def ablations(led: DataFrame, policy: Policy = FULL) -> DataFrame:
    """Per rule of the policy: documents failing it, and those that only this rule rejects. One row per rule."""
    masked = led.select(F.col("failed").bitwiseAND(policy.mask).alias("m"))
    # At most 2^rules different masks remain after this aggregation, whatever the number of documents.
    masks = masked.groupBy("m").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r in policy.rejects])
    return (
        masks.select("m", "n", F.inline(rules))
        .groupBy("rule", "bit")
        .agg(
            F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        )
        .withColumn("version", F.lit(policy.version))
    )


def judge(docs: DataFrame, policy: Policy = FULL, text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with docs' own columns. No join: the verdict is made in the row."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = ledger(docs.select(whole.alias("_row"), F.col(f"`{text}`").alias("_text")), "_row", "_text")
    return apply_policy(rows, policy).where("kept").select("_row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the whole documents table under the full policy."""
    return apply_policy(ledger(read(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), m AS (
  SELECT doc_id, t, w, len(w) AS n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n - 1)) AS i FROM m)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), v AS (
  SELECT doc_id, count(*) AS k FROM (SELECT DISTINCT doc_id, i + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY doc_id
), a AS (
  SELECT m.doc_id, n AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits,
         len(list_filter(w, lambda x: x LIKE '%!!')) AS n_bang_words
  FROM m LEFT JOIN v USING (doc_id)
), f AS (
  SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT)
         + 4 * CAST(100 * n_symbols > 30 * n_words AS BIGINT) + 8 * CAST(100 * n_dup_lines > 60 * n_lines AS BIGINT)
         + 16 * CAST(n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS BIGINT)
         + 32 * CAST(100 * n_bang_words > 40 * n_words AS BIGINT) + 64 * CAST(100 * n_digits > 40 * word_chars AS BIGINT) AS failed
  FROM a
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_digits AS BIGINT) AS n_digits, CAST(n_bang_words AS BIGINT) AS n_bang_words, failed,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept
FROM f
"""
