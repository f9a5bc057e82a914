"""Rules of many tenants against fnmatch."""

import fnmatch
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import policy_table

PATTERNS = [".env", ".env.*", "**/*.pem", "*.key", "**/secrets/**", "src/*.py", "a?c/*", "[ab]x/*", "[!a]*.md", "*", "?", "docs/[a-c]*/x", "exact/path.txt", "verylongprefix/deep/*", "*/verylongsuffix.yaml",
            "we[ird", "a]b*", "x{1,2}.t", "dot.+(1)", "é*", "", "[]x]*", "*é"]
PATHS = [".env", "k/.env", ".env.local", "a/b.pem", "b.pem", "x.key", "secrets/y", "a/secrets/y", "src/m.py", "src/n/m.py", "abc/d", "ax/1", "bx/2", "cx/3", "a.md", "b.md", "z", "docs/b1/x", "exact/path.txt",
         "verylongprefix/deep/q", "verylongprefix/q", "p/verylongsuffix.yaml", "we[ird", "a]bc", "x{1,2}.t", "dot.+(1)", "été", "", "line\nbreak.key", "]x1", "café", "\U0001f600/é"]


@pytest.mark.parametrize("limit", [0, 8 << 20])
def test_rules_of_tenants_equal_fnmatch(spark, monkeypatch, limit):
    monkeypatch.setattr(policy_table, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    rules = [(f"t{i % 5}", i, rng.choice(PATTERNS)) for i in range(120)] + [("t1", 900, None), (None, 901, "*")]
    paths = [(i, rng.choice(["t0", "t1", "t2", "t3", "t9", None]), rng.choice([*PATHS, None])) for i in range(400)]
    want = set()
    for key, tenant, path in paths:
        for owner, rule, pattern in rules:
            if path is not None and tenant is not None and pattern and owner == tenant and any(fnmatch.fnmatchcase(x, pattern) for x in (path, path.rsplit("/", 1)[-1])):
                want.add((key, tenant, rule))
    p, r = spark.createDataFrame(paths, "id long, tenant string, path string"), spark.createDataFrame(rules, "tenant string, rule long, pattern string")
    assert {tuple(x) for x in policy_table.matches(p, r).collect()} == want
    got = {x.id: (x.n_rules, x.denied) for x in policy_table.denied(p, r).collect()}
    assert got == {k: (n := sum(w[0] == k for w in want), n > 0) for k, _, _ in paths}
    assert policy_table.matches(p, r.limit(0)).count() == 0 and policy_table.matches(p.limit(0), r).count() == 0


def test_many_rules_take_no_cross_join(spark):
    rules = spark.range(10_000).select((F.col("id") % 100).cast("string").alias("tenant"), F.col("id").alias("rule"), F.concat(F.lit("team"), F.col("id"), F.lit("/*")).alias("pattern"))
    paths = spark.range(50_000).select("id", (F.col("id") % 100).cast("string").alias("tenant"), F.concat(F.lit("team"), F.col("id") % 10_000, F.lit("/f.py")).alias("path"))
    found = policy_table.matches(paths, rules)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.count() == 50_000


def test_rules_without_fixed_ends_take_few_pairs(spark):
    """Globs between stars, behind sets and shared by many rules, met by their rarest run: pairs in proportion to paths."""
    k = F.col("id")
    kinds = F.when(k % 4 == 0, F.concat(F.lit("*f"), k, F.lit(".*"))).when(k % 4 == 1, "**/secrets/**").when(k % 4 == 2, F.concat(F.lit("dir?/[!a]"), k, F.lit("*"))).otherwise("*.key")
    rules = spark.range(100_000, 102_000).select(F.lit("t").alias("tenant"), k.alias("rule"), kinds.alias("pattern"))
    end = F.when(k % 2 == 0, ".key").otherwise(".py")
    paths = spark.range(100_000, 102_000).select("id", F.lit("t").alias("tenant"), F.concat(F.lit("dir"), k % 7, F.when(k % 5 == 0, "/secrets").otherwise(""), F.lit("/f"), k, end).alias("path"))
    want = lambda i: (i % 4 == 0) + 500 * (i % 5 == 0) + (i % 4 == 2 and i % 5 != 0) + 500 * (i % 2 == 0)
    assert {r.id: r.n_rules for r in policy_table.denied(paths, rules).collect()} == {i: want(i) for i in range(100_000, 102_000)}
    known = policy_table.compiled(rules.select("tenant", "pattern").distinct()).groupBy("way", "at", "needle").count()
    assert known.agg(F.max("count")).first()[0] <= 20 and known.where("way = 'all'").isEmpty()


def test_a_rule_of_several_patterns_counts_once(spark):
    rules = spark.createDataFrame([("t", 1, "*.py"), ("t", 1, "a*"), ("t", 1, "a*"), ("t", 2, "a*"), ("t", None, "*p?"), ("t", None, "[a]*")], "tenant string, rule long, pattern string")
    paths = spark.createDataFrame([(1, "t", "a.py"), (2, "t", "b.py"), (2, "t", "a"), (3, "t", "c")], "id long, tenant string, path string")
    assert sorted((r.id, r.path, r.n_rules) for r in policy_table.denied(paths, rules).collect()) == [(1, "a.py", 3), (2, "a", 3), (2, "b.py", 3), (3, "c", 0)]
