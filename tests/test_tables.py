"""Numbers in large groups, and tables that are upserted bucket by bucket."""

from collections import defaultdict

from pyspark.sql import functions as F

from siftline.operators import numbering
from siftline.sources.buckets import BucketTable


def test_numbers_in_a_group_of_all_rows(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 50 < 45 else f"s{i % 7}", (i * 7919) % 3000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, id long").repartition(5)
    want, seen = {}, defaultdict(int)
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] += 1
        want[i] = seen[k]
    got = numbering.numbered_rows(df.withColumn("_key", F.lit("x")), ["k"], ["o", "id"], ranges=8)
    assert got.columns == ["k", "o", "id", "_key", "n"] and {r.id: r.n for r in got.collect()} == want
    down = numbering.numbered_rows(df, ["k"], [F.desc("o"), F.desc("id")], ranges=8)
    assert {r.id: r.n for r in down.collect()} == {i: seen[k] + 1 - want[i] for k, o, i in rows}
    assert numbering.numbered_rows(df.limit(0), ["k"], ["o"]).count() == 0


def test_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    table = BucketTable(spark, folder, "id", 32)
    assert table.read() is None and table.upsert(spark.createDataFrame([], "id long, v string"), "none") == []
    first = spark.range(500).select("id", F.lit("a").alias("v"))
    assert len(table.upsert(first.unionByName(spark.createDataFrame([(None, "n")], "id long, v string")), "b1")) == 32
    rewritten = table.upsert(spark.createDataFrame([(3, "b", 1), (3, "c", 0), (900, "d", 2), (None, "m", 5)], "id long, v string, w int"), "b2")
    assert 1 <= len(rewritten) <= 3
    # Sent again, opened anew: nothing changes.
    again = BucketTable(spark, folder, "id", 7)
    assert again.count == 32 and again.upsert(first, "b2") == [] and again.places == table.places
    got = {r.id: (r.v, r.w) for r in again.read().collect()}
    assert got == {i: ("a", None) for i in range(500)} | {3: ("c", 0), 900: ("d", 2), None: ("m", 5)}
    # What a lost job left isn't read.
    spark.createDataFrame([(1, "x")], "id long, v string").write.parquet(f"{folder}/data/lost/_b=1")
    assert BucketTable(spark, folder, "id").read().count() == 502
