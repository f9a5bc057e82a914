"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import lexical

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "ärger", "naïve", "日本", "x1", "The"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((12, 60, 306))]) + rng.choice(["", ",", "."]) for _ in range(rng.choice((3, 20, 90))))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # copies: ties by id
    docs += [(None, docs[5][1]), (None, None), (2000, None), (2001, ""), (2002, " .,; "), (2003, "w1 " * 70_000), (5, docs[6][1]), (2004, "w" * 300_000 + " w7")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 30))))) for i in range(25)]
    items += [(50, docs[5][1]), (51, None), (52, "nowhere"), (None, "w3 w3 W3 w4"), (3, "w9"), (53, "the THE ärger"), (54, "w" * 300_000)]
    return docs, items


def brute(docs, items, top=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, count, n in held:
            m, score = 100 - 75 + 75 * n * n_docs // n_terms, 0
            for t, q in Counter(terms(text)).items():
                if count[t]:
                    score += q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * count[t] // (1000 * count[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_search_against_all_documents(tables):
    docs, items = tables
    odd = {"ids": F.lit(1), "terms": F.lit("x"), "rank": F.lit(2), "a.b": F.lit(3)}
    assert rows(lexical.ranked(docs.withColumns(odd), items.withColumns(odd))) == brute(*corpus())
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("leaf,block,only", [(1, 40, False), (3, 1 << 20, True)])
def test_small_segments_leaves_and_blocks(spark, tables, tmp_path, leaf, block, only):
    docs, items = tables
    known = np.unique(np.concatenate([lexical._terms(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in corpus()[1] if t]))
    lexical.index(docs, only=known if only else None, segment=3000).write.parquet(f"file://{tmp_path}/index")
    segments = spark.read.schema(lexical.INDEX).parquet(f"file://{tmp_path}/index")
    assert segments.count() > 20
    assert rows(lexical.search(segments, items, top=7, leaf=leaf, block=block)) == brute(*corpus(), top=7)


def test_pieces_of_long_texts_cut_no_term():
    texts = ["", "a b", "é" * 40 + " b", "x " * 50, "", "long" * 30, "a-b" * 30, "日本 " * 9]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = list(zip(*(x.tolist() for x in lexical._terms(data, offsets))))
    parts = [(h, a + o) for a, piece, at in lexical._pieces(data, offsets, 16) for h, o in zip(*(x.tolist() for x in lexical._terms(piece, at)))]
    assert parts == whole and Counter(o for _, o in whole) == Counter(i for i, t in enumerate(texts) for _ in terms(t))


def test_impacts_beyond_64_bits():
    tf, n = np.array([1, 5]), np.array([10**7, 3])
    got = lexical._impacts(tf, n, 3 * 10**10, 10**13)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 3 * 10**10 // 10**13)) for t, m in zip(tf.tolist(), n.tolist())]


def test_bounds_skip_documents():
    """Where a few documents hold the rare terms of an item, most others are never scored."""
    docs = 4096
    row = {"ids": np.arange(docs), "null": np.zeros(docs, bool), "n": np.full(docs, 50), "terms": np.array([1, 2]), "df": np.array([docs, 12]),
           "docs": np.concatenate((np.arange(docs), np.arange(12) * 300)), "tf": np.ones(docs + 12, np.int64)}
    best = lexical._Best(1, 10)
    scored = lexical._search_segment(row, (np.array([0, 2]), np.array([0, 1]), np.array([1, 1])), np.array([1, 2]), np.array([1, 9000]), docs, docs * 50, best, leaf=1)
    assert scored < 80 and best.rows[2].tolist() == [300 * i for i in range(10)]
