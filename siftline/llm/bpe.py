"""BPE encoding and decoding with a public word-level vocabulary, equal to the tokenizers library's.

A long text is a tree: it is halved at any character down to leaves, which are encoded in parallel, many at a time; then,
from the bottom up, the two sides of each join are reconciled. A window of pieces around the join is encoded again, and
doubled until its first piece is one that the left side has there and its last piece one that the right side has there:
as both sides then agree exactly, the joined ids equal those of the whole. All joins of a level are encoded together.

Leaves and windows are cut where the library's pre-tokenizer cuts them for certain: at ASCII white space, and, in words of
ASCII and Latin-1 letters, digits and marks, between runs of a kind. Every different piece is encoded once per worker
and remembered; a text's ids are gathered from the pieces' ids. A piece that is long itself (no cut for thousands of
characters) is a tree of tokens: leaves are encoded as inner text, windows of tokens are encoded again around each
join, and hold when the two tokens at either seam encode to themselves.

Defined results: a null or empty text, or one of white space, has no ids and decodes to ''; texts may be of any length;
repeated rows encode alike; an empty table gives an empty result; a column named like an added one is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, read, without
from .words import _BYTE, blocks, span_hashes, text_bytes

VOCABULARY = "word_bpe_49k.json"
#: Texts of more bytes are trees of leaves of at most as many, and so are pieces of more characters than half as many.
TEXT_LEAF, LEAF = 4096, 2048
#: Pieces that a worker remembers before it starts afresh (some 40 MB), bytes of text encoded at once, and new pieces at once.
REMEMBERED, BLOCK, NEW = 800_000, 1 << 19, 8192

# Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 lead byte of Latin-1 letters, 5 continuation, 6 any other.
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[0x80:0xC0] = 5
_KIND[0xC3] = 4
_KIND[[ord("'"), ord("<")]] = 6


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of the pieces of texts that begin at offsets (from 0), and pieces before each text.

    A word with a byte of another kind, an apostrophe (contractions) or '<' (special tokens) stays one piece, unfolded.
    """
    kind = _KIND[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    lead = kind == 4
    after_lead = np.concatenate(([False], lead[:-1])) & (kind == 5)
    letter_tail = after_lead & (data != 0x97) & (data != 0xB7)
    odd = (kind == 6) | ((kind == 5) & ~letter_tail)
    odd[:-1] |= lead[:-1] & ~letter_tail[1:]
    if n:
        odd[-1] |= lead[-1]
    kind = np.where(lead | letter_tail, np.uint8(1), kind)
    inside = kind != 0
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    w_start, w_end = np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))
    bad = np.concatenate(([0], np.cumsum(odd)))
    whole = bad[w_end] > bad[w_start]
    # Bytes of whole words, marked by a cumulative sum over their starts and ends.
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, w_start[whole], 1)
    np.add.at(step, w_end[whole], -1)
    in_whole = np.cumsum(step)[:-1] > 0
    change = np.zeros(n + 1, bool)
    if n:
        change[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 2))
        change[1:-1] &= ~(in_whole[1:] & in_whole[:-1] & inside[1:] & inside[:-1])
    change |= cut
    change[[0, n]] = True
    starts = np.flatnonzero(change[:-1] & inside)
    ends = np.flatnonzero(change[1:] & inside) + 1
    folded = data.copy()
    upper = ~in_whole & ((data >= 65) & (data <= 90) | letter_tail & (data >= 0x80) & (data <= 0x9E))
    folded[upper] += 32
    return folded, starts, ends, np.searchsorted(starts, offsets)


class Encoder:
    """The vocabulary at a path, with the pieces seen so far."""

    def __init__(self, path: str):
        # Tasks are parallel already; threads of the library would only add to their memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        model = json.load(open(path))["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.forget()

    def forget(self) -> None:
        """Drop the pieces: sorted hashes, their slots, and by slot where a piece's ids begin and how many they are."""
        self.known, self.slot, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _letters(self, ids: list[int], last: bool) -> str:
        tokens = [self.tokenizer.id_to_token(i) for i in ids]
        if last and tokens:
            tokens[-1] = tokens[-1].removesuffix(self.suffix)
        return "".join(tokens)

    def _plain(self, letters: str, last: bool) -> list[int]:
        if last:
            return [t.id for t in self.tokenizer.model.tokenize(letters)]
        return self.inner.encode(letters, add_special_tokens=False).ids

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of the concatenation of two encoded texts; last: the right one ends the word."""
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            ends = last and len(b) == len(right)
            middle = self._plain(self._letters(a, False) + self._letters(b, ends), ends)
            left_over, right_over = left[: len(left) - len(a)], right[len(b) :]
            holds = True
            if left_over:
                pair, tail = [left_over[-1], middle[0]], ends and len(middle) == 1
                holds = self._plain(self._letters(pair, tail), tail) == pair
            if holds and right_over:
                pair, tail = [middle[-1], right_over[0]], last and len(right_over) == 1
                holds = self._plain(self._letters(pair, tail), tail) == pair
            if holds:
                return left_over + middle + right_over
            width *= 2

    def tree(self, letters: str, leaf: int = LEAF // 2) -> list[int]:
        """Ids of one pre-token, by halves."""
        count = 1
        while len(letters) > count * leaf:
            count *= 2
        bounds = [len(letters) * i // count for i in range(count + 1)]
        leaves = [letters[a:b] for a, b in zip(bounds, bounds[1:])]
        level = [x.ids for x in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)] + [self._plain(leaves[-1], True)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], i + 2 == len(level)) for i in range(0, len(level), 2)]
        return level[0]

    def long(self, text: str) -> list[int]:
        """Ids of a long piece: special tokens are taken out, the rest is normalized and split as the library does."""
        ids, at = [], 0
        marks = re.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) or r"(?!)")
        for found in [*marks.finditer(text), None]:
            part = text[at : found.start() if found else len(text)]
            for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                ids += self.tree(letters) if len(letters) > LEAF else self._plain(letters, True)
            if found:
                ids.append(self.special[found[0]])
                at = found.end()
        return ids

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast([t if len(t) <= LEAF else "" for t in texts], add_special_tokens=False)
        ids = [e.ids if len(t) <= LEAF else self.long(t) for t, e in zip(texts, encoded)]
        first, sizes = self.count, np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        for name, need in (("at", first + len(ids)), ("size", first + len(ids)), ("flat", self.used + len(flat))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate((have, np.zeros(max(need - len(have), len(have) // 2), have.dtype))))
        self.at[first : first + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(ids)] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used, self.count = self.used + len(flat), first + len(ids)

    def slots(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and slots of the pieces of texts that begin at offsets (from 0), and pieces before each text and the end."""
        folded, starts, ends, first = pieces(data, offsets)
        kinds, sample, which = np.unique(span_hashes(folded, starts, ends, _BYTE), return_index=True, return_inverse=True)
        slots = np.full(len(kinds), -1, np.int64)
        if len(self.known):
            where = np.minimum(np.searchsorted(self.known, kinds), len(self.known) - 1)
            slots = np.where(self.known[where] == kinds, self.slot[where], slots)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, begin = folded.tobytes(), self.count
            for at in range(0, len(new), NEW):
                part = new[at : at + NEW]
                self._learn(kinds[part], [raw[a:b].decode() for a, b in zip(starts[sample[part]].tolist(), ends[sample[part]].tolist())])
            into = np.searchsorted(self.known, kinds[new])
            self.known = np.insert(self.known, into, kinds[new])
            slots[new] = np.arange(begin, self.count)
            self.slot = np.insert(self.slot, into, slots[new].astype(np.int32))
        return starts, ends, slots[which], first

    def grown(self, data: np.ndarray, nodes: list[tuple]) -> tuple:
        """The pieces (starts, ends, slots) of a text from those of its leaves, level by level."""
        while len(nodes) > 1:
            pairs = list(zip(nodes[::2], nodes[1::2]))
            joined: list = [None] * len(pairs)
            todo, width = list(range(len(pairs))), 1
            while todo:
                spans = []
                for i in todo:
                    (ls, le, _), (rs, re_, _) = pairs[i]
                    # One piece more than the window on each side: the ones that must come out as they are.
                    from_ = ls[max(len(ls) - width - 1, 0)] if len(ls) else rs[0] if len(rs) else 0
                    to = re_[min(width, len(re_) - 1)] if len(re_) else le[-1] if len(le) else 0
                    spans.append((int(from_), int(to)))
                at = np.concatenate(([0], np.cumsum([b - a for a, b in spans])))
                starts, ends, slots, first = self.slots(np.concatenate([data[a:b] for a, b in spans]), at)
                rest = []
                for k, i in enumerate(todo):
                    left, right = pairs[i]
                    mine = slice(first[k], first[k + 1])
                    shift = spans[k][0] - at[k]
                    middle = (starts[mine] + shift, ends[mine] + shift, slots[mine])
                    keep_l, keep_r = max(len(left[0]) - width - 1, 0), min(width + 1, len(right[0]))
                    agree = len(left[0]) <= width or (len(middle[0]) and middle[0][0] == left[0][keep_l] and middle[1][0] == left[1][keep_l])
                    agree = agree and (len(right[0]) <= width or middle[0][-1] == right[0][keep_r - 1] and middle[1][-1] == right[1][keep_r - 1])
                    if agree:
                        joined[i] = tuple(np.concatenate((x[:keep_l], m, y[keep_r:])) for x, m, y in zip(left, middle, right))
                    else:
                        rest.append(i)
                todo, width = rest, width * 2
            nodes = joined
        return nodes[0]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that begin at offsets (from 0), and the number of ids before each text, with the end."""
        if self.count > REMEMBERED:
            self.forget()
        sizes = np.diff(offsets)
        counts = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes / TEXT_LEAF, 1))).astype(np.int64))
        owner = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        bounds = np.append(offsets[:-1][owner] + sizes[owner] * number // counts[owner], len(data))
        # A character isn't cut: its bytes of continuation go with the one before.
        inside = np.append(data, 0)[bounds] & 0xC0 == 0x80
        while inside.any():
            bounds[inside] -= 1
            inside[inside] = data[bounds[inside]] & 0xC0 == 0x80
        parts, leaves = [], []
        for a, b in blocks(bounds, BLOCK):
            starts, ends, slots, first = self.slots(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            parts.append((starts + bounds[a], ends + bounds[a], slots))
            leaves.append(np.diff(first))
        starts, ends, slots = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ([], [], [])))
        before = np.concatenate(([0], np.cumsum(np.concatenate(leaves)))) if leaves else np.zeros(1, np.int64)
        of_text = np.concatenate(([0], np.cumsum(counts)))
        done, sizes = [], np.diff(before[of_text])
        trees = np.flatnonzero(counts > 1)
        if len(trees):
            at = 0
            for t in trees.tolist():
                cut = before[of_text[t] : of_text[t + 1] + 1]
                done.append(slots[before[of_text[at]] : cut[0]])
                nodes = [(starts[a:b], ends[a:b], slots[a:b]) for a, b in zip(cut, cut[1:])]
                done.append(self.grown(data, nodes)[2])
                sizes[t] = len(done[-1])
                at = t + 1
            done.append(slots[before[of_text[at]] :])
            slots = np.concatenate(done)
        first = np.concatenate(([0], np.cumsum(sizes)))
        size = self.size[slots].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        where = np.arange(total[-1]) + np.repeat(self.at[slots] - total[:-1], size)
        return self.flat[where], total[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, ids, ids before each text and the end) for ranges of a column's texts; end: an id to append to each."""
    tool = encoder(path)
    data, offsets = text_bytes(column)
    for a, b in blocks(offsets, BLOCK):
        ids, at = tool.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        if end is not None:
            ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
        yield a, b, ids, at


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, into: str = "ids") -> DataFrame:
    """docs with a column of the text's ids (array<int>), all other columns kept."""
    docs = without(docs, into)
    path, at = path or default_path(), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ids, first in encoded(batch.column(at), path):
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, into])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """rows with a column of the text that the ids decode to."""
    rows = without(rows, into)
    path, at = path or default_path(), rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path).tokenizer
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = tool.decode_batch([x or [] for x in part.column(at).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, into])

    return arrow_map(rows, run, T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())]))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes and decodes without sending ids or texts back to Spark."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path).tokenizer
        for batch in batches:
            for a, b, ids, first in encoded(batch.column(1), path):
                ids = ids.astype("<u4")
                parts = [ids[x:y] for x, y in zip(first, first[1:])]
                texts = tool.decode_batch([p.tolist() for p in parts], skip_special_tokens=False)
                sums = [[hashlib.sha256(p.tobytes()).hexdigest() for p in parts], [hashlib.sha256(t.encode()).hexdigest() for t in texts]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), *map(pa.array, sums)], names=["k", "n", "i", "d"]
                )

    rows = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    return arrow_map(rows, run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    return digests(read(spark, sf_dir, "documents"))
