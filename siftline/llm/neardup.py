"""MinHash near-duplicate detection with DartMinHash signatures.

A document is a weighted set: its five-word shingles, weighted by how often they occur. Every element owns a strip of
the plane, as wide as its weight, into which darts fall as a Poisson process of unit density; a dart's place, rank and
coordinate are hashed from the element, so all documents that hold the element see the same darts. A document looks only
at ranks below a threshold chosen so that about k ln k + 2k darts fall in its own area, and keeps the earliest dart of each
of the k coordinates: two documents agree in a coordinate with the probability of their weighted Jaccard similarity.
Time is linear in the document plus its darts, not k times the document.

Signatures are cut into bands. Documents that share a band are candidates; every candidate pair whose documents aren't in
one class already is compared exactly, on whole texts, and links (similarity 0.8 or more) are joined into classes. Within a
band's bucket the pairs are not listed: every member is compared with one hub; what then is still apart is compared
across classes, as pairs in small buckets and, in large ones, side by side in squares that count all overlaps as one matrix
product. Both ways compare the same pairs exactly, so that the ways differ in cost only. Documents with equal word
sequences are one node from the start.

Defined results: texts without words (null, empty, white space) are in no class but their own; a text of one to four
words has one shingle, of all its words; repeated texts are one class; repeated ids count as one document each row
of which gets the id's class; empty tables give empty results; columns other than key and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship
from .common import arrow_map, cut, read
from .components import components
from .words import blocks, fixed, mix, powers, text_bytes, word_hashes

SHINGLE = 5
SIMILAR = 0.8
#: k = ROWS * BANDS coordinates. A pair of similarity 0.8 shares no band with a probability of 5 in a million.
ROWS, BANDS = 6, 40
K = ROWS * BANDS

_PLACE = [fixed(f"shingle {i}") | np.uint64(1) for i in range(SHINGLE)]
_SHORT, _COPY, _RANK, _COORD, _BAND, _OWNER = (fixed(x) for x in ("short", "copy", "rank", "coordinate", "band", "owner"))


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts whose words begin at first, and each one's text."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(words)) - first[owner]
    whole = np.flatnonzero(at + SHINGLE <= n[owner])
    total = np.zeros(len(whole), np.uint64)
    for i, place in enumerate(_PLACE):
        total += words[whole + i] * place
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    short = np.full(len(few), _SHORT)
    for i in range(SHINGLE - 1):
        has = n[few] > i
        short[has] = mix(short[has] ^ words[first[few[has]] + i] * _PLACE[i])
    return mix(np.concatenate((total, short))), np.concatenate((owner[whole], few))


def cells(elements: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A weight of w is w cells of width one: the c-th occurrence of an element in a text gets the hash of (element, c)."""
    by = mix(elements ^ (owner.astype(np.uint64) + np.uint64(1)) * _OWNER)
    order = np.argsort(by, kind="stable")
    ranked = by[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(by) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    copy = np.empty(len(by), np.int64)
    copy[order] = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return np.where(copy > 0, mix(elements ^ copy.astype(np.uint64) * _COPY), elements)


def _exponential(x: np.ndarray) -> np.ndarray:
    """Exponential numbers of mean one, from hashes."""
    return -np.log((mix(x ^ _RANK) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)


def signatures(cell: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """An n x k array: the hash of the earliest dart of each coordinate, for each text that has cells (others: 0)."""
    out = np.zeros(n * k, np.uint64)
    weight = np.bincount(owner, minlength=n).astype(np.float64)
    darts = k * np.log(k) + 2.0 * k
    todo = weight > 0
    while todo.any():
        best = np.full(n * k, np.inf)
        limit = np.divide(darts, weight, out=np.zeros(n), where=weight > 0)
        mine = todo[owner]
        seed, who, rank, thrown = cell[mine], owner[mine], np.zeros(int(mine.sum())), []
        # The m-th pass throws the m-th dart of every cell that is still below its text's rank limit.
        while len(seed):
            seed = mix(seed + _COORD)
            rank = rank + _exponential(seed)
            near = rank < limit[who]
            seed, who, rank = seed[near], who[near], rank[near]
            slot = who * k + (mix(seed ^ _COORD) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, rank)
            thrown.append((slot, rank, seed))
        for slot, rank, seed in thrown:
            first = rank == best[slot]
            out[slot[first]] = seed[first]
        # A coordinate without a dart below the limit: look higher, for these texts alone.
        todo = todo & np.isinf(best).reshape(n, k).any(axis=1)
        darts *= 2
    return out.reshape(n, k)


def _digests(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    up, down = powers(len(words) + 1)
    out = []
    for name in ("one", "two"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ fixed(name)) * up[: len(words)], out=sums[1:])
        out.append(mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] ^ np.diff(first).astype(np.uint64)))
    return np.stack(out, axis=1).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weave = np.array([fixed(f"row {i}") | np.uint64(1) for i in range(ROWS)])
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in blocks(offsets):
            words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            elements, owner = shingles(words, first)
            sign = signatures(cells(elements, owner), owner, b - a)
            banded = (sign.reshape(b - a, BANDS, ROWS) * weave).sum(axis=2, dtype=np.uint64)
            banded = mix(banded + np.arange(1, BANDS + 1, dtype=np.uint64) * _BAND).view(np.int64)
            digest = _digests(words, first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(np.bincount(owner, minlength=b - a)), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(banded.ravel()))],
                names=["id", "n_words", "weight", "d1", "d2", "bands"],
            )


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, weight, d1, d2, bands) of every document; weight is the number of shingles."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return arrow_map(rows, _sketch, "id long, n_words long, weight long, d1 long, d2 long, bands array<long>")


def _sets(texts: pa.ChunkedArray) -> list[np.ndarray]:
    """The sorted cells of each text."""
    data, offsets = text_bytes(texts)
    sets: list[np.ndarray] = []
    for a, b in blocks(offsets):
        elements, owner = shingles(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
        cell = cells(elements, owner)
        order = np.lexsort((cell, owner))
        sets += np.split(cell[order], np.searchsorted(owner[order], np.arange(1, b - a)))
    return sets


def _similar(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    """Is the weighted Jaccard similarity of two sorted sets of cells least or more?"""
    if len(one) > len(two):
        one, two = two, one
    if not len(one) >= least * len(two) > 0:
        return False
    at = np.searchsorted(two, one)
    shared = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return shared >= least * (len(one) + len(two) - shared)


def _compared(least: float):
    """For a block of pairs (block, a, b) and the texts (id, block, text) that they name: the similar pairs."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        ids, sets = texts.column("id").to_numpy(), _sets(texts.column("text"))
        order = np.argsort(ids)
        left, right = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy())] for c in ("a", "b"))
        keep = [_similar(sets[x], sets[y], least) for x, y in zip(left.tolist(), right.tolist())]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bytes of text that a block of pairs names, about, if none of its texts are shared.
PAIR_BYTES = 16 << 20


def linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts (id, text) are similar enough, compared exactly.

    Pairs are dealt to even blocks by their first id, and each text goes once to every block that names it: a text that
    many pairs name second, a hub, travels to all blocks, and their pairs are split.
    """
    pairs = cut(pairs)
    size = texts.agg(F.avg(F.octet_length("text"))).first()[0] or 0
    n = int(max(pairs.count() * 2 * size / PAIR_BYTES, pairs.sparkSession.sparkContext.defaultParallelism)) + 1
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(n)))
    named = dealt.select("block", F.col("a").alias("id")).union(dealt.select("block", "b")).distinct().join(texts, "id").toDF("id", "of", "text")
    ship(pairs.sparkSession)
    return dealt.groupBy("block").cogroup(named.groupBy("of")).applyInArrow(_compared(least), "a long, b long")


def _pairs(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _weighs(least: float, x: str, y: str):
    """Similarity is at most the ratio of the weights: an exact bound."""
    return F.least(x, y) >= F.lit(least) * F.greatest(x, y)


#: Members up to which the pairs of a bucket are listed (at most half as many for each), documents of a side, and cells
#: that are counted at once.
LISTED, SIDE, COLUMNS = 64, 512, 4096


def _links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links that join all similar candidates. members: (bucket, id, weight, hub, hub_weight), a row per member of a shared bucket."""
    first = members.where("id <> hub").where(_weighs(least, "weight", "hub_weight")).select(*_pairs("id", "hub")).distinct()
    edges = cut(linked(first, texts, least))
    class_of = cut(components(edges)).withColumnRenamed("id", "_id")
    # Buckets whose members are not yet one class.
    placed = members.join(class_of, F.col("id") == F.col("_id"), "left").select("bucket", "id", "weight", F.coalesce("component", "id").alias("component"))
    apart = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("c")).where("c > 1")
    open_ = cut(placed.join(cut(apart.select("bucket", "n")), "bucket").select("bucket", "id", "weight", "component", "n"))
    few = open_.where(F.col("n") <= LISTED).select("bucket", "id", "weight", "component")
    across = few.join(few.toDF("bucket", "id2", "weight2", "component2"), "bucket").where("component < component2").where(_weighs(least, "weight", "weight2"))
    edges = edges.union(linked(across.select(*_pairs("id", "id2")).distinct(), texts, least))
    many = open_.where(F.col("n") > LISTED)
    return cut(edges if many.isEmpty() else edges.union(_squares(many.drop("n"), texts, least)))


def _overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one shares with each of two, as products of their 0-1 matrices, COLUMNS wide."""
    shared = np.intersect1d(np.concatenate(one), np.concatenate(two))
    out = np.zeros((len(one), len(two)), np.int64)

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cell, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, cell), max(len(shared) - 1, 0))
        hit = shared[at] == cell if len(shared) else np.zeros(len(cell), bool)
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    sides = [(*placed(one), len(one)), (*placed(two), len(two))]
    for begin in range(0, len(shared), COLUMNS):
        grids = []
        for at, owner, n in sides:
            mine = slice(*np.searchsorted(at, (begin, begin + COLUMNS)))
            grid = np.zeros((n, COLUMNS), np.float32)
            grid[owner[mine], at[mine] - begin] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _square(least: float):
    """For the documents of two sides (or one) of a group: a spanning forest of the links between classes that they hold."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, weight, place = (table.column(c).to_numpy() for c in ("id", "side", "weight", "component"))
        up = {int(c): int(c) for c in place}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        low, high = np.flatnonzero(side == one), np.flatnonzero(side == two)
        found = []
        if len(low) and len(high):
            buckets = [np.unique(np.array(x, np.int64)) for x in table.column("buckets").to_pylist()]
            sets = _sets(table.column("text"))
            pick = lambda values, at: [values[i] for i in at.tolist()]
            candidates = _overlaps(pick(buckets, low), pick(buckets, high)) > 0
            shared = _overlaps(pick(sets, low), pick(sets, high))
            similar = shared >= least * (weight[low][:, None] + weight[high][None, :] - shared)
            for i, j in zip(*np.nonzero(candidates & similar & (place[low][:, None] != place[high][None, :]))):
                i, j = low[i], high[j]
                p, q = root(int(place[i])), root(int(place[j]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def _squares(open_: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links across classes between documents that share one of the open buckets (bucket, id, weight, component).

    Documents that buckets tie together form a group. The largest class of a group and the rest are cut into sides by
    bytes and a hash of the id; each pair of sides, but for two of the largest class, is compared in one task, which gives
    a spanning forest of the links found. A document is sent once per side that it is compared with; pairs aren't listed.
    """
    firsts = cut(open_.groupBy("bucket").agg(F.min("id").alias("b")))
    groups = cut(components(open_.select("bucket", F.col("id").alias("a")).join(firsts, "bucket").select("a", "b")).withColumnRenamed("component", "of"))
    nodes = open_.groupBy("id", "weight", "component").agg(F.collect_set("bucket").alias("buckets")).join(groups, "id")
    sized = cut(nodes.join(texts, "id"))
    parts = sized.groupBy("of", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sides = lambda n, size: F.greatest(F.ceil(n / SIDE), F.ceil(size / PAIR_BYTES)).cast("int")
    whole = parts.groupBy("of").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max_by(F.struct("component", "n", "bytes"), F.struct("n", "component")).alias("top"))
    whole = cut(whole.select("of", F.col("top.component").alias("top"), sides(F.col("top.n"), F.col("top.bytes")).alias("tops"), sides(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others")))
    at_top, dealt = F.col("component") == F.col("top"), F.xxhash64("id")
    placed = sized.join(whole, "of").withColumn("side", F.when(at_top, F.pmod(dealt, "tops")).otherwise(F.col("tops") + F.pmod(dealt, "others")).cast("int"))
    last = F.col("tops") + F.col("others") - 1
    sent = placed.withColumn("other", F.explode(F.sequence(F.when(at_top, F.col("tops")).otherwise(0), last)))
    sent = sent.select("of", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"), "side", "id", "component", "weight", "buckets", "text")
    ship(open_.sparkSession)
    return sent.groupBy("of", "one", "two").applyInArrow(_square(least), "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(id, class_id) of every document: class_id is the least id of its class, ids that share a text included."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketch = cut(sketches(docs, key, text))
    worded = sketch.where("n_words > 0 AND id IS NOT NULL")
    # A node for each sequence of words. Bands go with the row of the least id, so that the aggregation holds numbers alone.
    nodes = cut(worded.groupBy("d1", "d2").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    known = cut(worded.join(nodes.select("d1", "d2", "id"), ["d1", "d2", "id"]).select("id", "weight", "bands").dropDuplicates(["id"]))
    banded = known.select("id", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n > 1").drop("n")
    weights = known.select("id", "weight")
    # Written out before the join, so that the join deals both sides itself and can split a bucket that many share.
    shared = cut(hubs.join(weights, "id").select("bucket", F.col("id").alias("hub"), F.col("weight").alias("hub_weight")))
    members = cut(banded.join(shared, "bucket").join(weights, "id").select("bucket", "id", "weight", "hub", "hub_weight"))
    wanted = members.select("id").distinct()
    texts = cut(rows.join(wanted, "id").dropDuplicates(["id"]))
    joined = components(_links(members, texts, least))
    copies = nodes.where("n > 1").select("d1", "d2", F.col("id").alias("node"))
    named = sketch.select("id", "d1", "d2", "n_words").join(copies, ["d1", "d2"], "left")
    named = named.select("id", F.when(F.col("n_words") > 0, F.coalesce("node", "id")).otherwise(F.col("id")).alias("node"))
    return named.join(joined.withColumnRenamed("id", "node"), "node", "left").select("id", F.coalesce("component", "node").alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """docs without the documents that have a near-duplicate of a lower id. A null id is kept."""
    gone = classes(docs, key, text, least).where("id <> class_id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{key}`") == F.col("_gone"), "left_anti")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
