"""Secret scans: fixed patterns, and strings that look random under character Markov models.

Base kinds are patterns. Beyond them, every long run of token characters is scored by first-order Markov models of
characters, one of random strings, one of ordinary identifiers and one of plain numbers (card, order and phone numbers
look random to the second, but are no secrets), each with the chances of a first character, of each next one, and of
ending after each. A run's log-likelihood ratio is that of the random model against the better of the two others; a run
whose ratio exceeds a threshold is a secret of kind `markov`. The models are counted from labelled samples: runs inside
base matches and strings drawn from digests of the rows' ids (random), digits drawn from them and the runs of digits
(numbers), and the other runs outside base matches (ordinary), of a hash-chosen bounded sample of the texts.

The threshold depends on a run's length n: ratios of ordinary runs have about the mean `mean * n` and the deviation
`spread * sqrt(n)`, so that runs of all lengths tell how many deviations above the mean no more than FALSELY of them lie.
A tenth of the different runs decides that, and another tenth, in neither the counts nor the threshold, measures
the shares caught and falsely taken. With fewer than 1 / FALSELY ordinary runs to decide, the greatest is the threshold.

Everything is Column expressions: a text without a hit costs one scan per kind, and only texts with a hit are cut up to
find positions. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans; one without secrets returns as it was; overlapping spans of
different kinds are all reported, and redacted as one; `markov` spans that overlap a base span are not added; repeated rows are
scanned one by one; texts may be of any length; an empty table gives an empty result and a model that accepts nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Base kinds in reporting order: pattern, the group whose length counts, and its least length. Fixed values.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*BASE, "markov"]
#: Least characters of a run that is scored, unless a model says otherwise, and of one that teaches what is ordinary.
RUN_CHARS, LEARN_CHARS = 16, 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Documents that the models learn from, about; share of held-out ordinary runs that may be taken for secrets.
LEARN_DOCS, FALSELY = 4000, 0.0005
#: Private-use characters that mark matches; those of the text itself are replaced, one for one, before.
_S, _E = "\ue000", "\ue001"
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def find(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the pattern's leftmost matches, without overlaps, for which keep(match) holds."""
    plain = F.translate(text, _S + _E, "\ufffd\ufffd")
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_S}$1{_E}"), _S)
    none = F.lit(None).cast(_SPAN)

    def step(state: Column, part: Column) -> Column:
        match = F.substring_index(part, _E, 1)
        hit = part.contains(_E)
        span = F.struct(state["at"].alias("start"), F.lit(kind).alias("kind"), (state["at"] + F.length(match)).alias("stop"))
        found = F.when(hit & keep(match), F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct((state["at"] + F.length(part) - hit.cast("int")).alias("at"), found.alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast(_SPAN)).alias("found"))
    return F.aggregate(parts, start, step, lambda s: s["found"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and then kind."""
    found = []
    for kind, (name, (pattern, group, least)) in enumerate(BASE.items()):
        keep = lambda m, p=pattern, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n
        found.append(F.when(text.rlike(pattern), find(text, pattern, kind, keep)).otherwise(F.array().cast(_SPAN)))
    return F.sort_array(F.concat(*found))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by pair of character codes (0: beginning and end), against identifiers and against numbers;
    how ratios of ordinary runs grow with the length, and how many deviations above that a secret lies; the least
    characters of a run that is scored; and the shares of unseen random runs caught and of ordinary ones falsely taken."""

    table: tuple[float, ...] = ()
    numbers: tuple[float, ...] = ()
    mean: float = 0.0
    spread: float = 0.0
    deviations: float = math.inf
    run_chars: int = RUN_CHARS
    caught: float = 0.0
    falsely: float = 0.0

    def accepts(self, run: Column) -> Column:
        """Whether the run is a secret."""
        n = F.length(run)
        return ratio(run, self.table, self.numbers) > F.greatest(F.lit(0.0), self.mean * n + self.deviations * self.spread * F.sqrt(n))


CODES = len(ALPHABET) + 1


def run_pattern(least: int) -> str:
    """Matches runs of at least so many characters."""
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{least},}}"


def _codes(run: Column) -> Column:
    chars = F.filter(F.split(run, ""), lambda c: c != "")
    return F.concat(F.array(F.lit(0)), F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)), F.array(F.lit(0)))


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", learn_docs: int = LEARN_DOCS) -> DataFrame:
    """(label, run): 1 for random strings, 2 for numbers, 0 for other runs, from about learn_docs documents chosen by a hash
    of the id."""
    share = max(1, docs.count() // learn_docs)
    chosen = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("learn")), F.lit(share)) == 0
    sample = docs.where(chosen).select(F.col(f"`{key}`").cast("string").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    base = "|".join(f"(?:{p})" for p, _, _ in BASE.values())
    runs = lambda t, least: F.regexp_extract_all(t, F.lit(f"({run_pattern(least)})"), F.lit(1))
    tagged = lambda label, found: F.transform(found, lambda run: F.struct(label(run).cast("int").alias("label"), run.alias("run")))
    secret = F.flatten(F.transform(F.regexp_extract_all("t", F.lit(f"({base})"), F.lit(0)), lambda m: runs(m, RUN_CHARS)))
    # Digests in hexadecimal and base 64, and the digits of one, cut to 16 up to 43 characters.
    digest, long = F.sha2(F.concat(F.lit("random"), F.coalesce("k", F.lit(""))), 256), F.pmod(F.xxhash64("k"), F.lit(28)).cast("int") + 16
    drawn = F.array(F.substring(digest, F.lit(1), long), F.substring(F.base64(F.unhex(digest)), F.lit(1), long))
    number = F.array(F.substring(F.translate(digest, "abcdef", ""), F.lit(1), long))
    plain = runs(F.regexp_replace("t", base, " "), LEARN_CHARS)
    kinds = F.concat(
        tagged(lambda run: F.lit(1), F.concat(secret, drawn)), tagged(lambda run: F.lit(2), number),
        tagged(lambda run: F.when(run.rlike("^[0-9]+$"), 2).otherwise(0), plain),
    )
    return sample.select(F.inline(kinds))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", learn_docs: int = LEARN_DOCS, run_chars: int = RUN_CHARS) -> Model:
    """The models of a table, and the threshold that its held-out runs give. run_chars: least characters of a run that is
    scored; 1 scores every run."""
    runs = cut(labelled(docs, key, text, learn_docs).withColumn("fold", F.pmod(F.xxhash64("run", F.lit("fold")), F.lit(10)).cast("int")))
    pairs = F.arrays_zip(F.slice(_codes(F.col("run")), 1, F.length("run") + 1).alias("a"), F.slice(_codes(F.col("run")), 2, F.length("run") + 1).alias("b"))
    # At most 3 * CODES**2 rows come to the driver.
    counts = runs.where("fold > 1").select("label", F.inline(pairs)).groupBy("label", "a", "b").count().collect()
    if not {label for label, *_ in counts} >= {0, 1}:
        return Model()
    seen = [[0.5] * CODES**2 for _ in range(3)]
    for label, a, b, n in counts:
        seen[label][a * CODES + b] += n
    chances = [[math.log(c[i] / sum(c[i - i % CODES : i - i % CODES + CODES])) for i in range(CODES**2)] for c in seen]
    table, numbers = (tuple(round(x - y, 4) for x, y in zip(chances[1], chances[k])) for k in (0, 2))
    # Different runs of the two folds, each scored once.
    held = runs.where("fold < 2").distinct().select("label", "fold", F.length("run").alias("n"), ratio(F.col("run"), table, numbers).alias("ratio"))
    held = cut(held.withColumn("ordinary", F.col("label") != 1))
    deciding = held.where("ordinary AND fold = 0")
    total, chars, ratios, squares = deciding.agg(F.count("*"), F.sum("n"), F.sum("ratio"), F.sum(F.col("ratio") ** 2 / F.col("n"))).first()
    if not total:
        return Model()
    mean = round(ratios / chars, 4)
    # The mean of (ratio - mean * n)**2 / n.
    spread = round(math.sqrt(max(0.0, squares - 2 * mean * ratios + mean**2 * chars) / total), 4) or 1.0
    above = (F.col("ratio") - mean * F.col("n")) / (spread * F.sqrt("n"))
    deviations = deciding.agg(F.max(above) if total * FALSELY < 1 else F.percentile(above, 1 - FALSELY)).first()[0]
    found = Model(table, numbers, mean, spread, round(deviations, 4), run_chars)
    taken = F.col("ratio") > F.greatest(F.lit(0.0), mean * F.col("n") + found.deviations * spread * F.sqrt("n"))
    share_of = lambda which: F.avg(F.when(which, taken.cast("double")))
    caught, falsely = held.where("fold = 1").agg(share_of(~F.col("ordinary") & (F.col("n") >= run_chars)), share_of(F.col("ordinary"))).first()
    return replace(found, caught=caught or 0.0, falsely=falsely or 0.0)


def ratio(run: Column, table: tuple[float, ...], numbers: tuple[float, ...]) -> Column:
    """Log-likelihood ratio of random against the better of identifier and number for a run of ALPHABET's characters."""
    words, digits = (F.split(F.lit(",".join(map(str, t))), ",").cast("array<double>") for t in (table, numbers))

    def step(s: Column, c: Column) -> Column:
        at = s["last"] * CODES + c
        return F.struct(c.alias("last"), (s["word"] + F.get(words, at)).alias("word"), (s["number"] + F.get(digits, at)).alias("number"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("word"), F.lit(0.0).alias("number"))
    codes = _codes(run)
    return F.aggregate(F.slice(codes, 2, F.size(codes)), start, step, lambda s: F.least(s["word"], s["number"]))


def scan(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds _base and _spans (all kinds, with _base) to docs: arrays of (start, kind, stop), by start and then kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array().cast(_SPAN)
    if model.table:
        pattern = run_pattern(model.run_chars)
        runs = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        found = F.when(F.exists(runs, model.accepts), find(t, pattern, len(BASE), model.accepts)).otherwise(found)
    df = docs.withColumns({"_base": base_spans(t), "_markov": found})
    added = F.filter("_markov", lambda m: ~F.exists(F.col("_base"), lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    return df.withColumn("_spans", F.sort_array(F.concat("_base", added))).drop("_markov")


def written(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by the mask; overlapping spans become one mask. All rows stay."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = scan(docs.select(F.struct(*cols).alias("_row"), F.col(f"`{text}`").alias("_text")), model, "_text")

    def step(state: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= state["at"], F.concat(F.substr(F.col("_text"), state["at"] + 1, span["start"] - state["at"]), F.lit(mask)))
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), F.concat(state["done"], F.coalesce(gap, F.lit(""))).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    masked = F.aggregate("_spans", start, step, lambda s: F.concat(s["done"], F.substr(F.col("_text"), s["at"] + 1)))
    new = F.when(F.size("_spans") > 0, masked).otherwise(F.col("_text"))
    return rows.select(F.col("_row").withField(f"`{text}`", new).alias("_row")).select("_row.*")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, learn(docs))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{name}") for i, name in enumerate(BASE)],
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"),
    )
