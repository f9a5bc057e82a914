"""Ranked lexical search: best-first over intervals of documents, bounded by range maxima of posting lists.

Documents are indexed in segments of some SEGMENT bytes of text, a row each: ids, terms per document, and a posting list
(documents, occurrences) per term. Terms are runs of ASCII letters and digits and of all that isn't ASCII, with A-Z in lower
case, known by 64-bit hashes. Segments are made where their documents are read, and searched where they are read again:
nothing is shuffled but sums of document frequencies and each task's best documents.

Within a segment, a posting's impact is its share of a score. Over each posting list lies a sparse table of range maxima, so that
a term's greatest impact in any interval of documents, and where it is, takes two looks. An interval's bound is the sum
of these over an item's terms. Intervals of the greatest bounds are taken first, a few for each item at once: the
document of the greatest single impact is scored, and the intervals on its two sides go back with their own bounds. An
interval of at most LEAF documents is scored outright. What is bounded below the item's TOP-th score so far, in this or an
earlier segment of the task, is dropped; equal bounds are not, as ties go by id. Nothing else is left out: results are exact.

Items are searched in blocks of some BLOCK pairs of item and term, which bounds what is sent to the tasks.

Defined results: a null text has no terms; a document or an item without terms ranks nowhere, and only documents with terms
count; scores of 0 aren't listed; rows that share an id are documents, and items, of their own; equal scores go by
ascending id, a null id last; texts may be of any length; empty tables give an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, read, shared_dir
from .words import _FOLDED, span_hashes, text_bytes
from .words import blocks as ranges

TOP, LEAF, WAVE = 10, 64, 16
#: Bytes of text in a segment, bytes that are split into terms at once, pairs of item and term in a block, terms that an index may be narrowed to.
SEGMENT, PIECE, BLOCK, NARROW = 16 << 20, 1 << 20, 1 << 20, 1 << 20
INDEX = "ids array<long>, n array<long>, terms array<long>, df array<int>, docs array<int>, tf array<int>"
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True
_PLACE = 28  # bits of a posting's position below its impact


def _pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets from 0) of ranges of texts; a long text comes in parts that no term spans."""
    for a, b in ranges(offsets, size):
        at, end = int(offsets[a]), int(offsets[b])
        while end - at > size and b == a + 1:
            stop = at + size
            while stop < end and not len(gaps := np.flatnonzero(~_TERM[data[stop : stop + size]])):
                stop += size
            stop = min(stop + int(gaps[0]) if stop < end else end, end)
            yield a, data[at:stop], np.array([0, stop - at])
            at = stop
        yield a, data[at:end], (offsets[a : b + 1] - at).clip(0)


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the text each is in."""
    inside = _TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before, after = np.concatenate(([False], inside)), np.concatenate((inside, [False]))
    starts, ends = np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))
    return span_hashes(data, starts, ends, _FOLDED).view(np.int64), np.searchsorted(offsets, starts, "right") - 1


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences) of each pair."""
    kinds, which = np.unique(hashes, return_inverse=True)
    pairs, n = np.unique(owner * len(kinds) + which, return_counts=True)
    return pairs // max(len(kinds), 1), kinds[pairs % max(len(kinds), 1)], n


def _summed(owner: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same pairs by term, then text, each once."""
    order = np.lexsort((owner, term))
    owner, term, n = owner[order], term[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])))) if len(owner) else np.zeros(0, np.int64)
    return owner[new], term[new], np.add.reduceat(n, new) if len(new) else n


def _lists(values: np.ndarray, bounds, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds), pa.int32()), pa.array(values, kind))


class _Segment:
    """Documents gathered for one row of the index."""

    def __init__(self):
        self.ids, self.count, self.bytes, self.pairs, self.n = [], 0, 0, [], {}

    def row(self) -> pa.RecordBatch:
        owner, term, tf = _summed(*(np.concatenate(x) for x in zip(*self.pairs))) if self.pairs else (np.zeros(0, np.int64),) * 3
        terms, first = np.unique(term, return_index=True)
        sizes = np.zeros(self.count, np.int64)
        for doc, n in self.n.items():
            sizes[doc : doc + len(n)] += n
        ids = pa.concat_arrays(self.ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _lists(sizes, [0, len(sizes)], pa.int64()), _lists(terms, [0, len(terms)], pa.int64()),
                _lists(np.diff(np.append(first, len(term))), [0, len(terms)], pa.int32()), _lists(owner, [0, len(owner)], pa.int32()), _lists(tf, [0, len(tf)], pa.int32()),
            ],
            names=["ids", "n", "terms", "df", "docs", "tf"],
        )


def index(docs: DataFrame, key: str = "doc_id", text: str = "text", only: np.ndarray | None = None, segment: int = SEGMENT) -> DataFrame:
    """Segments of the documents (INDEX). only: sorted hashes of the terms that get posting lists, else all do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Segment()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            done = 0
            for a, piece, at in _pieces(data, offsets, min(PIECE, segment)):
                if now.bytes >= segment and a >= done:
                    yield now.row()
                    now = _Segment()
                if a >= done:
                    ids = batch.column(0).slice(a, len(at) - 1)
                    now.ids.append(ids)
                    now.count, done = now.count + len(ids), a + len(ids)
                base = now.count - (done - a)
                hashes, owner = _terms(piece, at)
                size = np.bincount(owner, minlength=len(at) - 1)
                now.n[base] = now.n[base] + size if base in now.n else size
                if only is not None:
                    hit = only[np.minimum(np.searchsorted(only, hashes), len(only) - 1)] == hashes if len(only) else np.zeros(len(hashes), bool)
                    hashes, owner = hashes[hit], owner[hit]
                doc, term, tf = _counted(hashes, owner)
                now.pairs.append((doc + base, term, tf))
                now.bytes += len(piece)
        if now.count:
            yield now.row()

    return arrow_map(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), run, INDEX)


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, terms, q): the terms of each item with their repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            parts = [(doc + a, term, n) for a, piece, at in _pieces(data, offsets) for doc, term, n in [_counted(*_terms(piece, at))]]
            term, owner, q = _summed(*(np.concatenate(x) for x in zip(*((t, o, n) for o, t, n in parts)))) if parts else (np.zeros(0, np.int64),) * 3
            bounds = np.searchsorted(owner, np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(term, bounds, pa.int64()), _lists(q, bounds, pa.int32())], names=["item", "terms", "q"])

    return arrow_map(items.select(F.col(f"`{key}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")), run, "item long, terms array<long>, q array<int>")


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these lengths laid end to end: the range that each place is in, and its number there."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Best:
    """Each item's best documents so far: item, score, id and whether it is null, in order of rank."""

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.rows = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        #: What a score must reach to matter.
        self.least = np.ones(items, np.int64)

    def meet(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least[item]
        if not good.any():
            return
        rows = tuple(np.concatenate((a, b[good])) for a, b in zip(self.rows, (item, score, ids, null)))
        order = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        item = rows[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.rows = tuple(r[order[rank < self.top]] for r in rows)
        last = rank == self.top - 1
        self.least[item[last]] = rows[1][order][last]


def _impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """Impact of a posting without its term's weight; n: terms of its document. 64-bit, div rounding down."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 63:
        m = np.array([25 + 75 * int(x) * docs // terms for x in n], np.int64)
    else:
        m = 25 + 75 * n * docs // max(terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Table:
    """Posting lists of a segment for a block's terms, with sparse tables of the maxima of their ranges."""

    def __init__(self, row: dict, vocabulary: np.ndarray, weight: np.ndarray, docs: int, terms: int):
        self.count = len(row["ids"])
        mine = np.searchsorted(row["terms"], vocabulary)
        held = row["terms"][np.minimum(mine, len(row["terms"]) - 1)] == vocabulary if len(row["terms"]) else np.zeros(len(vocabulary), bool)
        held &= weight > 0
        first = np.cumsum(row["df"]) - row["df"]
        self.size = np.where(held, row["df"][np.where(held, mine, 0)], 0) if len(row["terms"]) else np.zeros(len(vocabulary), np.int64)
        slot, number = _spread(self.size)
        at = first[mine[slot]] + number
        self.doc, tf = row["docs"][at], row["tf"][at]
        self.value = weight[slot] * _impacts(tf, row["n"][self.doc], docs, terms)
        self.key = slot * self.count + self.doc
        level = self.value << _PLACE | np.arange(len(slot))
        self.levels, step = [level], 1
        while 2 * step <= self.size.max(initial=0):
            level = level.copy()
            np.maximum(level[:-step], level[step:], out=level[:-step])
            self.levels.append(level)
            step *= 2
        self.levels = np.stack(self.levels)

    def range(self, slot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of terms in intervals of documents."""
        return np.searchsorted(self.key, slot * self.count + lo), np.searchsorted(self.key, slot * self.count + hi)

    def most(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greatest value in each range of postings and its document; 0 where the range is empty."""
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        some = b > a
        a, b = np.where(some, a, 0), np.where(some, b, 1)
        best = np.maximum(self.levels[level, a], self.levels[level, b - (1 << level)])
        return np.where(some, best >> _PLACE, 0), self.doc[best & (1 << _PLACE) - 1]


def _search_segment(row: dict, items: tuple[np.ndarray, np.ndarray, np.ndarray], vocabulary: np.ndarray, weight: np.ndarray, docs: int, terms: int, best: _Best, leaf: int = LEAF) -> int:
    """Meet best with a segment's documents; returns how many documents were scored. items: first entry of each item and
    the end, and each entry's place in the vocabulary and repeats."""
    table = _Table(row, vocabulary, weight, docs, terms)
    starts, slots, repeats = items
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    use = table.size[slots] > 0
    owner, slots, repeats = owner[use], slots[use], repeats[use]
    starts = np.searchsorted(owner, np.arange(len(starts)))
    ids, null = row["ids"], row["null"]

    def entries(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of, number = _spread((starts[1:] - starts[:-1])[item])
        return of, starts[item][of] + number

    def bounds(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval, and the document of its greatest single impact."""
        of, entry = entries(item)
        value, doc = table.most(*table.range(slots[entry], lo[of], hi[of]))
        value = value * repeats[entry]
        begin = np.searchsorted(of, np.arange(len(item)))
        top = np.maximum.reduceat(value, begin)
        where = np.flatnonzero(value == top[of])
        where = where[np.searchsorted(of[where], np.arange(len(item)))]
        return np.add.reduceat(value, begin), doc[where]

    def score(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        """Score all documents of intervals."""
        if not len(item):
            return 0
        of, entry = entries(item)
        a, b = table.range(slots[entry], lo[of], hi[of])
        part, number = _spread(b - a)
        place = a[part] + number
        cell, inner = _spread(hi - lo)
        base = np.cumsum(hi - lo) - (hi - lo)
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, (base - lo)[of[part]] + table.doc[place], repeats[entry][part] * table.value[place])
        doc = lo[cell] + inner
        best.meet(item[cell], total, ids[doc], null[doc])
        return len(cell)

    item = np.flatnonzero(np.diff(starts) > 0)
    if not len(item):
        return 0
    lo, hi = np.zeros(len(item), np.int64), np.full(len(item), table.count)
    bound, split = bounds(item, lo, hi)
    scored = 0
    while True:
        alive = bound >= best.least[item]
        if not alive.any():
            return scored
        item, lo, hi, bound, split = (x[alive] for x in (item, lo, hi, bound, split))
        order = np.lexsort((-bound, item))
        item, lo, hi, bound, split = (x[order] for x in (item, lo, hi, bound, split))
        now = np.arange(len(item)) - np.searchsorted(item, item) < WAVE
        whole = now & (hi - lo <= leaf)
        cut = now & ~whole
        # The document of the greatest impact alone, and small intervals whole.
        scored += score(*(np.concatenate(x) for x in ((item[whole], item[cut]), (lo[whole], split[cut]), (hi[whole], split[cut] + 1))))
        side = [np.concatenate(x) for x in ((item[cut], item[cut]), (lo[cut], split[cut] + 1), (split[cut], hi[cut]), (bound[cut], bound[cut]))]
        some = (side[2] > side[1]) & (side[3] >= best.least[side[0]])
        more = [x[some] for x in side[:3]]
        fresh = bounds(*more) if len(more[0]) else (np.zeros(0, np.int64),) * 2
        item, lo, hi, bound, split = (np.concatenate((x[~now], y)) for x, y in zip((item, lo, hi, bound, split), (*more, *fresh)))


def _searching(names: list, items: tuple, vocabulary: np.ndarray, weight: np.ndarray, docs: int, terms: int, top: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(names), top)
        for batch in batches:
            for i in range(len(batch)):
                row = {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}
                row["null"] = np.asarray(row["ids"].is_null())
                row["ids"] = row["ids"].fill_null(0)
                row = {k: np.asarray(v).astype(bool if k == "null" else np.int64) for k, v in row.items()}
                _search_segment(row, items, vocabulary, weight, docs, terms, best, leaf)
        item, score, ids, null = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([names[i] for i in item.tolist()], pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(score)], names=["number", "item", "doc", "score"]
        )

    return run


def search(segments: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(key, rank, doc_id, score): each item's top documents of an index. segments: a written index, as it is read three times."""
    spark = segments.sparkSession
    size = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    total = segments.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))).cast("long").alias("docs"), F.sum(size).alias("terms")).first()
    docs, terms = total["docs"] or 0, total["terms"] or 0
    wanted = _item_terms(items, key, text).where(F.size("terms") > 0)
    pairs = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    found = []
    blocks = -(-pairs // block)
    for b in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == b)
        rows = sorted(mine.collect(), key=lambda r: (r["item"] is None, r["item"] or 0))  # some BLOCK pairs of item and term
        if not rows:
            continue
        flat = np.array([t for r in rows for t in r["terms"]], np.int64)
        vocabulary, slots = np.unique(flat, return_inverse=True)
        known = spark.createDataFrame(pa.table({"term": vocabulary}))
        held = segments.select(F.inline(F.arrays_zip("terms", "df"))).join(F.broadcast(known), F.col("terms") == F.col("term"))
        df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row per term of the block
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) if t in df else 0 for t in vocabulary.tolist()], np.int64)
        starts = np.cumsum([0, *(len(r["terms"]) for r in rows)])
        repeats = np.array([q for r in rows for q in r["q"]], np.int64)
        run = _searching([r["item"] for r in rows], (starts, slots, repeats), vocabulary, weight, docs, terms, top, leaf)
        found.append(arrow_map(segments, run, "number long, item long, doc long, score long").withColumn("block", F.lit(b)))
    if not found:
        found = [spark.createDataFrame([], "number long, item long, doc long, score long, block int")]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    place = F.row_number().over(Window.partitionBy("block", "number").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = every.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias(key), "rank", F.col("doc").alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Each item's top documents, through an index of the documents in the shared folder; it holds all documents, and the
    posting lists of the items' terms, if these are at most NARROW different ones, else of all terms."""
    spark = docs.sparkSession
    terms = _item_terms(items, "item_id", "text").select(F.explode("terms").alias("term")).distinct()
    only = terms.limit(NARROW + 1).toPandas()["term"].to_numpy(np.int64)
    folder = f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    index(docs, only=np.sort(only) if len(only) <= NARROW else None).write.parquet(folder)
    return search(spark.read.schema(INDEX).parquet(folder), items, top=top)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), d AS (
  SELECT doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d
), q AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs
), c AS (
  SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
