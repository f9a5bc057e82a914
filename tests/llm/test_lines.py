"""Line deduplication against brute force, in batches and levels."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(3)
    common = [f"Line number {i} that stands in a good many of the documents" for i in range(8)]
    common += ["x" * 39, "y" * 40, "ÄÖÜ" + "é" * 40, "Äöü" + "é" * 40]
    docs = [(None, common[0]), (None, common[1] + "\n" + common[0]), (-5, common[0] + "\n\n"), (0, None), (1, ""), (2, "\n"), (3, " \t \r\n" + "y" * 40 + "\x0b")]
    for i in range(4, 160):
        some = [rng.choice(common[: 2 + i % 11]) for _ in range(rng.randrange(6))]
        some = [rng.choice([s, s.upper() if s.isascii() else s, f"  {s}\t", s + "\r"]) for s in some] + [f"own {i} line of text which is long enough to count as one"] * (i % 3)
        rng.shuffle(some)
        docs.append((i, "\n".join(some)))
    docs += [(150, docs[100][1]), (150, docs[101][1]), (151, docs[-1][1]), (200, "\n".join(common[:3] * 2000))]
    return docs


def brute(docs, least=5):
    held, out = defaultdict(set), []
    key = lambda x: x.strip(SPACE).translate(LOW)
    for doc, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(-(10**9) if doc is None else doc)
    for doc, text in docs:
        own, rows = -(10**9) if doc is None else doc, (text or "").split("\n")
        gone = [len(held.get(key(x), ())) >= least and own < max(held[key(x)]) for x in rows]
        out.append((doc, len(rows), sum(gone), "\n".join(x for x, g in zip(rows, gone) if not g)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string")


def test_lines_against_brute_force(docs):
    odd = docs.withColumns({"h1": F.lit("x"), "at": F.lit(1), "N_LINES": F.lit("y"), "_gone": F.lit(2), "a.b": F.lit(3)})
    got = lines.dedup(odd, batches=5, fanout=2)
    assert got.columns == ["doc_id", "text", "h1", "at", "_gone", "a.b", "n_lines", "n_dropped"]
    assert result(got) == brute(corpus())
    assert lines.dedup(docs.limit(0), batches=2).count() == 0


def test_index_levels_reopens_and_ignores_what_was_lost(spark, docs, tmp_path):
    folder, found = f"file://{tmp_path}/index", lines.lines_of(docs).withColumn("batch", F.pmod(F.coalesce("doc", F.lit(0)), F.lit(7)))
    for batch in range(7):
        # Every batch opens the folder anew.
        lines.LineIndex(spark, folder, fanout=2).add(found.where(F.col("batch") == batch))
    index = lines.LineIndex(spark, folder, fanout=2)
    assert [len(level) for level in index.levels] == [1, 1, 1] and index.steps == 7 + 4
    # A run without a row of the log doesn't count.
    spark.createDataFrame([(1, 1, 100, 10**9)], lines.RUN).write.parquet(f"{folder}/run-lost")
    index = lines.LineIndex(spark, folder, fanout=2)
    whole = found.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("docs"), F.max("doc").alias("last"))
    same = lambda df: sorted(map(tuple, df.where("last IS NOT NULL").select("h1", "h2", "last").collect()))
    assert same(index.entries()) == same(whole)
    gone = index.gone(found, 3)
    assert result(lines.clean(docs, gone)) == brute(corpus(), 3)


def test_index_cleans_a_stream_of_batches(spark, docs, tmp_path):
    """Each batch is cleaned of the lines that greater documents before it hold already, then adds its own."""
    index, rows, seen = lines.LineIndex(spark, f"file://{tmp_path}/stream"), [d for d in corpus() if d[0] is not None and d[0] < 150], []
    for part in (rows[100:], rows[50:100], rows[:50]):
        batch = spark.createDataFrame(part, "doc_id long, text string")
        found = lines.lines_of(batch)
        index.add(found)
        seen += part
        assert result(lines.clean(batch, index.gone(found))) == [r for r in brute(seen) if r[0] in {p[0] for p in part}]
