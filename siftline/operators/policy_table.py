"""Path policies as a table: paths of many tenants held against their tenants' glob rules by joins.

A pattern's literal runs are what its matches can't do without. A run that no '*' precedes stands at a fixed place from the
beginning, one that no '*' follows at a fixed place from the end, any other one somewhere. Each different pattern of a tenant
is met by one of these needles, the one that the fewest patterns of its tenant share, and a path offers its own characters at
the places and of the sizes that needles have. The pattern itself decides in the join, as a regular expression. So a rule sees only
paths that hold its rarest run, and nothing is paired across tenants. Patterns without a literal meet all paths of their tenant.

Rules of one pattern are held against paths once; `denied` adds up their number and never lists them.

As in `paths.denied`, a pattern is held against the whole path and against its name. Globs are fnmatch's: '*' and '?' cross
'/', '[..]' is a set.

Defined results: a null path, tenant, or pattern matches nothing; an empty pattern matches nothing; a rule that is repeated counts once,
also with several patterns; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a needle at a fixed place, places that count as fixed, and sizes of needles that may stand anywhere.
FIXED, PLACES, SOMEWHERE = 8, 64, (1, 2, 3, 6)
#: Patterns sent to every task at most, in bytes; needles whose hashes are, where patterns aren't.
BROADCAST_BYTES, HASHES = 8 << 20, 1 << 20
#: Stand for '*' and for what takes one character.
_ANY, _ONE = "\ue000", "\ue001"
_PARTS = r"(?s)(\[!?\]?[^\]]*\]|.)"
_NEEDLES = "array<struct<way:string,at:int,needle:string>>"


def glob_column(pattern: Column) -> Column:
    """An anchored Java pattern for a glob in a column."""
    parts = F.regexp_extract_all(pattern, F.lit(_PARTS), F.lit(1))

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(2), F.length(p) - 2)
        negated = body.startswith("!")
        inner = F.regexp_replace(F.when(negated, F.substr(body, F.lit(2))).otherwise(body), r"([\\\[\]&^])", r"\\$1")
        group = F.concat(F.lit("["), F.when(negated, "^").otherwise(""), inner, F.lit("]"))
        return F.when(p == "*", r"[\s\S]*").when(p == "?", r"[\s\S]").when((F.length(p) > 2) & p.startswith("["), group).otherwise(F.regexp_replace(p, r"([^\p{Alnum}_/])", r"\\$1"))

    return F.concat(F.lit("^"), F.array_join(F.transform(parts, one), ""), F.lit("$"))


def _needle(way: str | Column, at: Column, needle: Column) -> Column:
    return F.struct((F.lit(way) if isinstance(way, str) else way).alias("way"), at.cast("int").alias("at"), needle.alias("needle"))


def _somewhere(run: Column) -> Column:
    """The first and the last characters of a run that may stand anywhere."""
    size = F.lit(SOMEWHERE[0])
    for n in SOMEWHERE[1:]:
        size = F.when(F.length(run) >= n, n).otherwise(size)
    return F.array(_needle("in", F.lit(0), F.left(run, size)), _needle("in", F.lit(0), F.right(run, size)))


def needles(pattern: Column) -> Column:
    """What a match of a glob must hold: (way, at, needle), where at counts from the beginning (head) or the end (tail)."""
    kind = lambda p: F.when(p == "*", _ANY).when((p == "?") | (F.length(p) > 2) & p.startswith("["), _ONE).otherwise(p)
    marked = F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_PARTS), F.lit(1)), kind), "")

    def of(segment: Column, i: Column, n: Column) -> Column:
        def run(piece: Column, k: Column, pieces: Column) -> Column:
            at = F.length(F.array_join(F.slice(pieces, F.lit(1), k), "?")) + (k > 0).cast("int")
            after, size, more = F.length(segment) - at - F.length(piece), F.least(F.length(piece), F.lit(FIXED)), F.greatest(F.length(piece) - FIXED, F.lit(0))
            head = F.array(_needle("head", at, F.left(piece, size)), _needle("head", at + more, F.right(piece, size)))
            tail = F.array(_needle("tail", after, F.right(piece, size)), _needle("tail", after + more, F.left(piece, size)))
            own = F.when((i == 0) & (at + more <= PLACES), head).when((i > 0) & (i == n - 1) & (after + more <= PLACES), tail)
            return F.when(piece == "", F.array().cast(_NEEDLES)).otherwise(own.otherwise(_somewhere(piece)).cast(_NEEDLES))

        pieces = F.split(segment, _ONE)
        return F.flatten(F.transform(pieces, lambda piece, k: run(piece, k, pieces)))

    segments = F.split(marked, _ANY)
    found = F.array_distinct(F.flatten(F.transform(segments, lambda s, i: of(s, i, F.size(segments)))))
    whole = F.array(_needle("whole", F.lit(0), marked)).cast(_NEEDLES)
    found = F.when(~marked.contains(_ANY) & ~marked.contains(_ONE), whole).otherwise(found)
    return F.when(F.size(found) > 0, found).otherwise(F.array(_needle("all", F.lit(0), F.lit(""))).cast(_NEEDLES))


def _known(rules: DataFrame, tenant: str, rule: str, pattern: str) -> DataFrame:
    """(tenant, rule, pattern), each once."""
    rows = rules.select(F.col(f"`{tenant}`").alias("tenant"), F.col(f"`{rule}`").alias("rule"), F.col(f"`{pattern}`").alias("pattern"))
    return rows.where("tenant IS NOT NULL AND pattern IS NOT NULL AND pattern <> ''").distinct()


def compiled(patterns: DataFrame) -> DataFrame:
    """(tenant, pattern, ...) with regex, way, at and needle: how each pattern is met."""
    every = patterns.select("tenant", "pattern", F.inline(needles(F.col("pattern"))))
    shared = every.groupBy("tenant", "way", "at", "needle").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", (-F.length("needle")).alias("_size"), "way", "at", "needle")).alias("_r")
    best = every.join(shared, ["tenant", "way", "at", "needle"]).groupBy("tenant", "pattern").agg(rarest).select("tenant", "pattern", "_r.way", "_r.at", "_r.needle")
    return patterns.join(best, ["tenant", "pattern"]).withColumn("regex", glob_column(F.col("pattern")))


def _offered(path: Column, name: Column, wanted: Column) -> Column:
    """A path's own needles of the ways, places and sizes that are wanted. What its name ends with or holds, it does too."""

    def own(w: Column) -> Column:
        at, size = w["at"], w["size"]
        head = lambda text: _needle("head", at, F.substr(text, at + 1, size))
        tail = _needle("tail", at, F.substr(path, F.greatest(F.length(path) - at - size, F.lit(0)) + 1, F.least(size, F.length(path) - at)))
        inner = F.transform(F.sequence(F.lit(1), F.length(path) - size + 1), lambda i: _needle("in", F.lit(0), F.substr(path, i, size)))
        fit = F.filter(F.when(w["way"] == "head", F.array(head(path), head(name))).when(w["way"] == "tail", F.array(tail)), lambda n: F.length(n["needle"]) == size)
        whole = F.array(_needle("whole", F.lit(0), path), _needle("whole", F.lit(0), name))
        none = F.array().cast(_NEEDLES)
        return (
            F.when(w["way"].isin("head", "tail"), fit.cast(_NEEDLES)).when(w["way"] == "whole", whole.cast(_NEEDLES)).when(w["way"] == "all", F.array(_needle("all", F.lit(0), F.lit(""))).cast(_NEEDLES))
            .when(F.length(path) >= size, inner.cast(_NEEDLES)).otherwise(none)
        )

    # Not made distinct here: that compares every struct with every other.
    return F.flatten(F.transform(wanted, own))


def _met(paths: DataFrame, patterns: DataFrame, key: str, path: str, tenant: str) -> DataFrame:
    """(id, and a pattern's columns): each path with each pattern of its tenant that matches it, once."""
    known = compiled(patterns)
    rows = paths.select(F.col(f"`{key}`").alias("id"), F.col(f"`{tenant}`").alias("tenant"), F.col(f"`{path}`").alias("path")).where("path IS NOT NULL AND tenant IS NOT NULL")
    rows = rows.withColumn("name", F.substring_index("path", "/", -1))
    size = F.when(F.col("way").isin("whole", "all"), 0).otherwise(F.length("needle")).alias("size")
    # Only needles of places and sizes that some pattern has: at most PLACES * FIXED rows for either end, and a few.
    used = known.groupBy("way", "at", size).agg(F.count("*").alias("n"), F.sum(F.length("regex") + F.length("needle") + 64).alias("bytes")).collect()
    wanted = [F.struct(F.lit(r.way).alias("way"), F.lit(r["at"]).alias("at"), F.lit(r["size"]).alias("size")) for r in used]
    offered = _offered(F.col("path"), F.col("name"), F.array(*wanted)) if wanted else F.array().cast(_NEEDLES)
    rows = rows.select("id", "tenant", "path", "name", F.inline(offered))
    on = ["tenant", "way", "at", "needle"]
    if sum(r["bytes"] for r in used) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    elif sum(r["n"] for r in used) <= HASHES:
        # What no pattern asks for isn't shuffled.
        asked = known.select(F.xxhash64(*on).alias("_h")).distinct()
        rows = rows.withColumn("_h", F.xxhash64(*on)).join(F.broadcast(asked), "_h", "left_semi").drop("_h")
    met = rows.join(known, on).where(F.expr("path rlike regex OR name rlike regex"))
    return met.select("id", *patterns.columns).distinct()


def matches(paths: DataFrame, rules: DataFrame, key: str = "id", path: str = "path", tenant: str = "tenant", rule: str = "rule", pattern: str = "pattern") -> DataFrame:
    """(key, tenant, rule): each path with each rule of its tenant that matches it as a whole or by its name."""
    known = _known(rules, tenant, rule, pattern)
    met = _met(paths, known.select("tenant", "pattern").distinct(), key, path, tenant)
    return met.join(known, ["tenant", "pattern"]).select(F.col("id").alias(key), "tenant", "rule").distinct()


def denied(paths: DataFrame, rules: DataFrame, key: str = "id", path: str = "path", tenant: str = "tenant", rule: str = "rule", pattern: str = "pattern") -> DataFrame:
    """paths with n_rules (how many rules of the tenant match) and denied."""
    known = _known(rules, tenant, rule, pattern)
    # A rule of one pattern is only counted with it; one of several is listed, as it counts once.
    by_rule = known.groupBy("tenant", "rule").agg(F.count("*").alias("_n"), F.collect_set("pattern").alias("_of"))
    listed = F.when(F.col("_n") > 1, F.struct("rule"))
    by_pattern = by_rule.select("tenant", listed.alias("_rule"), F.explode("_of").alias("pattern")).groupBy("tenant", "pattern")
    patterns = by_pattern.agg(F.count_if(F.col("_rule").isNull()).alias("_single"), F.collect_list("_rule").alias("_rules"))
    met = _met(paths, patterns, key, path, tenant)
    each = F.concat(F.array(F.struct(F.lit(None).cast(by_rule.select(listed).schema[0].dataType).alias("_rule"), F.col("_single").alias("_n"))), F.transform("_rules", lambda r: F.struct(r.alias("_rule"), F.lit(1).cast("long").alias("_n"))))
    rows = met.select("id", "tenant", F.inline(each)).groupBy("id", "tenant", "_rule").agg(F.when(F.col("_rule").isNull(), F.sum("_n")).otherwise(1).alias("_n"))
    counted = rows.groupBy(F.col("id").alias("_id")).agg(F.sum("_n").alias("n_rules"))
    found = paths.join(counted, F.col(f"`{key}`") == F.col("_id"), "left").drop("_id")
    return found.withColumn("n_rules", F.coalesce("n_rules", F.lit(0))).withColumn("denied", F.col("n_rules") > 0)
