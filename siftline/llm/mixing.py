"""Mixing sources to target weights by Poisson replication.

A source that should make up the share w of a mixture of T characters, and has s characters, must be repeated
w * T / s times on average. Each document draws its own count from a Poisson distribution with that mean: the
distribution is inverted at a uniform number hashed from (seed, document id), so that a count needs nobody else's and
a lost task draws it again. Documents are exploded by their counts and the copies shuffled globally by another hash.

Means above PART are split into equal parts of at most PART, each drawn from its own hash: a sum of independent Poisson
draws is a Poisson draw, and no inversion then runs into a tail where exp(-mean) vanishes.

Defined results: a null source is a source of its own; a source without characters (null or empty texts only) has no
rate and is left out; sources without a target weight are left out; repeated rows draw alike, as they share an id;
a null id draws as the id ''; empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, without

#: Largest mean that is inverted in one draw, and steps of the inversion: P(X > STEPS | PART) < 1e-12.
PART, STEPS = 8.0, 40
#: Bytes of text that a partition of the shuffled copies holds, about.
PART_BYTES = 64 << 20
#: Sources up to this number are broadcast (a few dozen bytes each); above it, a salted join is used.
BROADCAST_SOURCES, SALTS = 10_000, 64


def hashed(*parts: Column) -> Column:
    """A uniform number in [0, 1) of 48 bits from the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def source_sizes(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Characters and bytes per source, summed before the shuffle."""
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sums = [F.sum(size(said).cast("long")).alias(name) for size, name in ((F.length, "_size"), (F.octet_length, "_bytes"))]
    return docs.groupBy(F.col(f"`{source}`").alias("_source")).agg(*sums)


def source_rates(sizes: DataFrame, weights: dict[str, float] | None, exponent: float, epochs: float) -> DataFrame:
    """Mean repetitions per source. Without weights the target is size ** exponent, so that large sources shrink."""
    sizes = sizes.where("_size > 0")
    if weights is None:
        target = F.pow(F.col("_size").cast("double"), F.lit(exponent))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        target = F.create_map(*pairs)[F.coalesce(F.col("_source"), F.lit(""))]
    aimed = sizes.withColumn("_target", target).where("_target > 0")
    # Two numbers come to the driver.
    targets, size = aimed.agg(F.sum("_target"), F.sum("_size")).first()
    rate = F.lit(epochs) * F.col("_target") / F.lit(targets or 1.0) * F.lit(size or 0) / F.col("_size")
    return aimed.select("_source", "_bytes", rate.alias("rate"))


def poisson(rate: Column, *seed: Column) -> Column:
    """The Poisson count of mean rate at the hash of seed."""
    parts = F.ceil(rate / PART).cast("int")
    mean = rate / parts
    draws = F.transform(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), lambda j: hashed(*seed, j))

    def invert(u: Column) -> Column:
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"), F.lit(0).alias("k"))
        step = lambda s, j: F.when(s["cdf"] > u, s).otherwise(
            F.struct((s["p"] * mean / j).alias("p"), (s["cdf"] + s["p"] * mean / j).alias("cdf"), j.alias("k"))
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["k"])

    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda n, u: n + invert(u))).otherwise(0)


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, *, exponent: float = 0.5, epochs: float = 1.0, seed: int = 17,
    key: str = "doc_id", source: str = "source", text: str = "text", extra: bool = False,
) -> DataFrame:
    """Documents repeated to the target weights, in a global random order.

    weights: target share by source; None aims at size ** exponent. epochs: size of the mixture over that of the
    sources used. extra: also return copy_no, n_copies and shuffle_key, which otherwise go, in place of columns so named.
    """
    docs = without(docs, "copy_no", "n_copies", "shuffle_key") if extra else docs
    spark = docs.sparkSession
    rates = source_rates(cut(source_sizes(docs, source, text)), weights, exponent, epochs)
    # Two numbers, from one small row per source: how many sources there are, and the bytes that their copies make.
    sources, copied = rates.agg(F.count("*"), F.sum(F.col("rate") * F.col("_bytes"))).first()
    rates = rates.select("_source", "rate")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*cols).alias("_row"), F.col(f"`{source}`").alias("_s"), F.col(f"`{key}`").alias("_k"))
    if sources <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("_s").eqNullSafe(F.col("_source")))
    else:
        salted = rates.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        salt = F.pmod(F.xxhash64("_k"), F.lit(SALTS)).cast("int")
        joined = rows.join(salted, F.col("_s").eqNullSafe(F.col("_source")) & (salt == F.col("_salt")))
    counted = joined.withColumn("n_copies", poisson(F.col("rate"), F.lit(seed), F.col("_k"))).where("n_copies > 0")
    copies = counted.select("_row", "_k", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    ordered = copies.withColumn("shuffle_key", hashed(F.lit(seed), F.lit("order"), F.col("_k"), F.col("copy_no")))
    # The key is uniform and unique, so hash partitions are even; the order within and among them is random.
    n = max(spark.sparkContext.defaultParallelism, math.ceil((copied or 0) / PART_BYTES))
    mixed = ordered.repartition(n, "shuffle_key").sortWithinPartitions("shuffle_key")
    return mixed.select("_row.*", "copy_no", "n_copies", "shuffle_key") if extra else mixed.select("_row.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, mixed to the square roots of its sources' sizes at one epoch."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, extra=True).select("doc_id", "source", "text", "copy_no", "n_copies", "shuffle_key")


OP2_SQL = """
WITH RECURSIVE s AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source HAVING sum(length(coalesce(text, ''))) > 0
), r AS (
  SELECT source, 1.0::DOUBLE * (size::DOUBLE ** 0.5) / sum(size::DOUBLE ** 0.5) OVER () * (sum(size) OVER ())::DOUBLE / size::DOUBLE AS rate FROM s
), p AS (
  SELECT source, rate, ceil(rate / 8.0)::INT AS parts, rate / ceil(rate / 8.0) AS mean FROM r
), cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM p
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 39
), t AS (
  SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source
), u AS (
  SELECT d.doc_id, d.source, d.text, t.cs,
         ('0x' || substr(md5('17:' || d.doc_id || ':' || j.j), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN t ON t.source IS NOT DISTINCT FROM d.source,
       LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j) j
), n AS (
  SELECT doc_id, source, text, sum(len(list_filter(cs, lambda c: c <= u)))::INT AS n_copies FROM u GROUP BY doc_id, source, text
)
SELECT doc_id, source, text, copy_no::INT AS copy_no, n_copies,
       ('0x' || substr(md5('17:order:' || doc_id || ':' || copy_no), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy_no FROM n)
"""
