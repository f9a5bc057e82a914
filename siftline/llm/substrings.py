"""Substring deduplication by sliding sentence spans.

A text is a row of sentences: words up to one that ends in '.', '!' or '?' or stands last in its line. Long sentences are
cut at words that their neighbourhood alone decides, so that a passage is cut alike wherever it stands: among any WINDOW
words without a sentence's end, the cut comes after the word whose hash with the next one is least. Equal neighbours are
never cut apart by this; only a run of one word gets longer than WINDOW, and is cut every SENTENCE_WORDS words.

A span is a run of sentences (or parts) that holds LEAST_WORDS words and either RUN sentences or SENTENCE_WORDS words, and
that no shorter run of the same beginning or of the same end does; it is known by a 64-bit hash of its words. Every run
that is long enough is thereby covered by spans inside it. A text that holds no such run is one span as a whole. Spans are joined over all documents; where one occurs again,
all occurrences but the first (by document id, then position) are repeated, and every sentence that a repeated span
covers is removed with the white space after it. Of any 51 words that repeat, cuts agree but for at most 8 words at the
beginning and 8 at the end, and spans among them have at most 24 words: none is missed, wherever it is pasted. The
words before the first and after the last cut that agree stay.

Within a document, only a span's first occurrence goes into the global join, so that a key meets each document once.
The least document of a span comes from an aggregation that is summed before its shuffle.

Defined results: a null text stays null and an empty one empty; a text without words has no span; equal
texts repeat wholly, however short, the least id keeps its text; rows that share an id count as one document and are treated alike; a row without an
id only loses what repeats within itself; an empty table gives an empty one; other columns pass through `dedup`,
but for those named like what it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, cut, read, without
from .words import blocks, fixed, mix, powers, span_hashes, text_bytes, word_spans

RUN, LEAST_WORDS, SENTENCE_WORDS, WINDOW = 3, 12, 25, 8
_MARK, _OWNER, _NEXT = np.zeros(256, bool), fixed("span owner"), fixed("next word") | np.uint64(1)
_MARK[[ord("."), ord("!"), ord("?")]] = True


def _sliding(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """The best of every WINDOW neighbours, a power of two."""
    step = 1
    while step < WINDOW:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def _cuts(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a long sentence is cut after the word: it is the least of some WINDOW words that hold no sentence's end."""
    after = np.append(words[1:], np.uint64(0))
    rank = np.where(words == after, ~np.uint64(0), mix(words + after * _NEXT) >> np.uint64(1) | np.uint64(1))
    rank[last] = 0
    edge = np.zeros(WINDOW - 1, np.uint64)
    least = _sliding(np.concatenate((edge, rank, edge)), np.minimum)
    return (_sliding(least, np.maximum) == rank) & ~last & (words != after)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """First byte of each sentence, the words before each and the end, the sentences before each text and the end, word hashes."""
    starts, ends, first = word_spans(data, offsets)
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), none.astype(np.uint64)
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    last = _MARK[data[ends - 1]]
    last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    last[first[1:][first[1:] > 0] - 1] = True
    words = mix(span_hashes(data, starts, ends) ^ fixed("sentence word"))
    begins = np.concatenate(([True], (last | _cuts(words, last))[:-1]))
    # What still is long, a run of one word, is cut every SENTENCE_WORDS words.
    at = np.flatnonzero(begins)
    within = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    at = np.flatnonzero(within % SENTENCE_WORDS == 0)
    return starts[at], np.append(at, n), np.searchsorted(at, first), words


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each span its hash, first sentence and the one after its last, its text, its number in the text, and whether it
    occurred before in its text; then the sentences' first bytes, and the sentences before each text and the end."""
    starts, at, first, words = sentences(data, offsets)
    n = len(starts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.arange(n)
    least, long = (np.searchsorted(at, at[:-1] + k) for k in (LEAST_WORDS, SENTENCE_WORDS))
    end = np.maximum(least, np.minimum(begin + RUN, long))
    # For each end the last beginning that is far enough before it, where no span ends yet.
    stop = begin + 1
    back = np.searchsorted(end, stop, "right") - 1
    more = (back >= first[owner]) & (end[back] != stop) if n else np.zeros(0, bool)
    whole = end <= first[1:][owner]
    begin, end = np.concatenate((begin[whole], back[more])), np.concatenate((end[whole], stop[more]))
    short = np.flatnonzero((np.diff(first) > 0) & (np.bincount(owner[begin], minlength=len(first) - 1) == 0))
    begin, end = np.concatenate((begin, first[short])), np.concatenate((end, first[short + 1]))
    order = np.lexsort((end, begin))
    begin, end = begin[order], end[order]
    up, down = powers(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    a, b = at[begin], at[end]
    span, owner = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), owner[begin]
    _, earliest, which = np.unique(mix(span ^ (owner.astype(np.uint64) + np.uint64(1)) * _OWNER), return_index=True, return_inverse=True)
    number = np.arange(len(span)) - np.searchsorted(owner, owner)
    return span, begin, end, owner, number, earliest[which] < np.arange(len(span)), starts, first


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(1))
        for a, b in blocks(offsets):
            span, _, _, owner, number, again, _, _ = spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            out = np.flatnonzero(~again)
            yield pa.RecordBatch.from_arrays([pa.array(span[out].view(np.int64)), pa.array(ids[a:b][owner[out]]), pa.array(number[out].astype(np.int32))], names=["span", "id", "at"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, marked spans) to (row, text without repeated sentences, sentences, removed)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in blocks(offsets):
            part = batch.slice(a, b - a)
            piece, begin = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, opens, closes, owner, _, gone, at, first = spans(piece, begin)
            marks = part.column(2)
            for i in np.flatnonzero(np.asarray(marks.is_valid())):
                gone[np.searchsorted(owner, i) + np.array(marks[int(i)].as_py(), np.int64)] = True
            n = len(at) + 1
            covered = np.cumsum(np.bincount(opens[gone], minlength=n) - np.bincount(closes[gone], minlength=n))[:-1] > 0
            removed = np.add.reduceat(np.append(covered, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if b > a else np.zeros(0)
            texts = part.column(1).to_pylist()
            for i in np.flatnonzero(removed):
                own, keep = slice(first[i], first[i + 1]), []
                stops = np.append(at[own][1:], begin[i + 1])
                raw = piece[begin[i] : begin[i + 1]].tobytes()
                keep = [raw[: at[first[i]] - begin[i]]]
                keep += [raw[s - begin[i] : e - begin[i]] for s, e, c in zip(at[own], stops, covered[own]) if not c]
                texts[i] = b"".join(keep).decode()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array(np.diff(first).astype(np.int64)), pa.array(np.asarray(removed, np.int64))], names=["r", "t", "n", "m"]
            )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated sentences removed from the text; adds n_sentences and n_removed."""
    docs = without(docs, "n_sentences", "n_removed")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    found = arrow_map(rows.where("id IS NOT NULL"), _emit, "span long, id long, at int")
    # Written out, so that the join below deals both sides itself and can split a span that a third of all documents hold.
    repeated = cut(found.groupBy("span").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("span", "first"))
    marked = found.join(repeated, "span").where("id > first").groupBy("id").agg(F.collect_set("at").alias("_marks"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").cast("long").alias("id"))
    joined = whole.join(marked, "id", "left").select("_row", F.col("_row").getField(text).alias("_text"), "_marks")
    schema = T.StructType(joined.schema.fields[:2]).add("n_sentences", "long").add("n_removed", "long")
    done = arrow_map(joined, _cut_out, schema)
    done = done.withColumn("_row", F.col("_row").withField(f"`{text}`", F.when(F.col("_row").getField(text).isNotNull(), F.col("_text"))))
    return done.select("_row.*", "n_sentences", "n_removed")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal, and how many of its sentences went."""
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("changed", F.col("n_removed") > 0)
