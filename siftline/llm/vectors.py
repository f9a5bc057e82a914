"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least c lie within eps = sqrt(2 - 2c) of each other, and so do their projections on any
dimensions. Vectors are sorted by label and by the grid cells, of side eps, of their leading principal components, over
the whole cluster. The sorted sequence is cut into intervals (the partitions of the sort) of blocks, and intervals are
grouped by eights, those groups again, and so on. The join goes down this tree: pairs of intervals whose bounding boxes
lie more than eps apart are skipped with all that is below them. What is left of a pair of intervals is one square, to
which each block that comes near the other side is sent once. There the halving goes on, and runs of at most LEAF
vectors are compared by exact cosines in double precision.

A square gives counts of links per vector and a spanning forest of its links, never the links themselves, so that dense
groups cost memory and shuffle in proportion to their size. Equal vectors of an interval are one weighted node.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
link with nothing; vectors of different lengths don't link; each row of a repeated id is compared as a vector of its own
and gets the sum of the id's links; a null id links with nothing; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import give_back, ship
from .common import arrow_map, cut, read
from .components import components

SIMILAR = 0.98
#: Leading principal dimensions of the grid, vectors of a block, and of a leaf of the recursive join.
DIMS, BLOCK, LEAF = 6, 1024, 128
#: Vectors of an interval at least, and bytes of one at most: a square holds two.
INTERVAL, INTERVAL_BYTES = 16 * BLOCK, 16 << 20
#: Intervals that have a common parent in the tree, as a power of two.
FANOUT_BITS = 3


def _vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors that can link, for each length in turn."""
    starts = np.asarray(column.offsets)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    flat = column.values.to_numpy(zero_copy_only=False)  # a null component is not a number
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        found = flat[starts[at][:, None] + np.arange(dim)] + flat.dtype.type(0)  # no negative zeros
        ok = np.isfinite(found).all(1) & found.any(1)
        if ok.any():
            yield at[ok], found[ok]


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components, one row per dimension pair and partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, found in _vectors(batch.column(0)):
            x = np.hstack((_units(found), np.ones((len(found), 1))))
            dim = found.shape[1]
            sums[dim] = sums.get(dim, 0.0) + x.T @ x
    for dim, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, dim, np.int32)), pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["dim", "at", "sum"])


def principal(rows: DataFrame, dims: int) -> tuple[dict[int, np.ndarray], int]:
    """The leading principal directions by vector length, and the number of vectors. dim**2 sums by length come to the driver."""
    sums = arrow_map(rows.select("vector"), _moments, "dim int, at int, sum double").groupBy("dim", "at").agg(F.sum("sum"))
    by: dict[int, dict[int, float]] = {}
    for dim, at, value in sums.collect():
        by.setdefault(dim, {})[at] = value
    out, count = {}, 0
    for dim, cells in by.items():
        m = np.array([cells[i] for i in range((dim + 1) ** 2)]).reshape(dim + 1, dim + 1)
        cov = m[:dim, :dim] / m[dim, dim] - np.outer(m[:dim, dim], m[:dim, dim]) / m[dim, dim] ** 2
        out[dim] = np.linalg.eigh(cov)[1][:, ::-1][:, : min(dims, dim)]
        count += int(m[dim, dim])
    return out, count


def _project(units: np.ndarray, axes: dict[int, np.ndarray], width: int) -> np.ndarray:
    at = np.zeros((len(units), width))
    own = axes[units.shape[1]]
    at[:, : own.shape[1]] = units @ own
    return at


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while (above := self.up[r]).tobytes() != r.tobytes():
            r = above
        self.up[i] = r
        return r

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def tie(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the trees of i[k] and j[k] for all k; ties within a tree cost no loop."""
        a, b = self.roots(i), self.roots(j)
        apart = np.unique((a * len(self.up) + b)[a != b])
        for x, y in zip((apart // len(self.up)).tolist(), (apart % len(self.up)).tolist()):
            x, y = self.root(x), self.root(y)
            self.up[max(x, y)] = min(x, y)


def _near(px: np.ndarray, py: np.ndarray, same: bool, eps2: float, leaf: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs (a, b) of px and (c, d) of py, of at most leaf rows, whose boxes lie within eps; with same, those with a <= c."""

    def boxes(p: np.ndarray):
        known: dict = {}

        def box(a: int, b: int):
            if (a, b) not in known:
                known[a, b] = p[a:b].min(0), p[a:b].max(0)
            return known[a, b]

        return box

    of_x, of_y = boxes(px), boxes(py)
    todo = [(0, len(px), 0, len(py))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or same and d <= a:
            continue
        (lo, hi), (lo2, hi2) = of_x(a, b), of_y(c, d)
        gap = np.maximum(0.0, np.maximum(lo - hi2, lo2 - hi))
        if gap @ gap > eps2:
            continue
        if b - a <= leaf and d - c <= leaf:
            yield a, b, c, d
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def _gap(lo: list, hi: list, lo2: list, hi2: list):
    """Squared distance of two boxes, as a Column."""
    return sum((F.pow(F.greatest(F.lit(0.0), F.col(a) - F.col(d), F.col(c) - F.col(b)), 2) for a, b, c, d in zip(lo, hi, lo2, hi2)), F.lit(0.0))


def links(rows: DataFrame, least: float, block: int, leaf: int, interval: int) -> tuple[DataFrame, DataFrame] | None:
    """rows: (id, label, vector), none null. Two tables: (node, id, links, other), counts of linked rows of a node and edges
    of spanning forests, and (node, id, first, node_id, n), the rows of nodes that stand for several; None without vectors."""
    eps = float(np.sqrt(2 - 2 * least)) + 1e-9
    axes, count = principal(rows, DIMS)
    if not axes:
        return None
    width = max(a.shape[1] for a in axes.values())
    kind = np.float32 if isinstance(rows.schema["vector"].dataType.elementType, T.FloatType) else np.float64
    bytes_ = max(axes) * np.dtype(kind).itemsize
    fits = max(1, INTERVAL_BYTES // bytes_)
    parts = -(-count // min(fits, max(interval, count // 64)))
    grid = [f"c{k}" for k in range(width)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in _vectors(batch.column(2)):
                cells = np.floor(_project(_units(found), axes, width) / eps).astype(np.int32)
                picked = [batch.column(k).take(pa.array(at)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*picked, pa.array(np.full(len(at), found.shape[1], np.int32)), *[pa.array(cells[:, k]) for k in range(width)], _binary(found)],
                    names=["id", "label", "dim", *grid, "raw"],
                )

    placed = arrow_map(rows, place, "id long, label long, dim int, " + ", ".join(f"{c} int" for c in grid) + ", raw binary")
    placed = placed.withColumn("mark", F.xxhash64("raw"))
    order = ["label", "dim", *grid, "mark", "id"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lows, highs = [f"lo{k}" for k in range(width)], [f"hi{k}" for k in range(width)]
    packed = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), *[(c, pa.float64()) for c in lows + highs],
                        ("heads", pa.binary()), ("ns", pa.binary()), ("raw", pa.binary()), ("ids", pa.binary()), ("of", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of a label in this interval, equal ones together, in rows of up to block vectors."""
        key, part, done = None, 0, 0
        ids: list = []
        raws: list = []

        def flush():
            nonlocal done
            raw, own = np.vstack(raws), np.concatenate(ids)
            new = np.concatenate(([True], (raw[1:] != raw[:-1]).any(1)))
            first, node = np.flatnonzero(new), np.cumsum(new) - 1
            ns = np.diff(np.append(first, len(own)))
            for a in range(0, len(first), block):
                b = min(a + block, len(first))
                some = raw[first[a:b]]
                at = _project(_units(some), axes, width)
                rows_ = slice(first[a], first[b] if b < len(first) else len(own))
                values = [(part << 20) + done, part, *key, *at.min(0).tolist(), *at.max(0).tolist(), own[first[a:b]].tobytes(), ns[a:b].astype(np.int64).tobytes(),
                          some.tobytes(), own[rows_].tobytes(), (node[rows_] - a).astype(np.int32).tobytes()]
                done += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, packed.types)], schema=packed)

        for batch in batches:
            if not len(batch):
                continue
            own, label, dim = (batch.column(k).to_numpy() for k in range(3))
            part = batch.column(4)[0].as_py()
            turns = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)]):
                now = (int(label[a]), int(dim[a]))
                if now != key:
                    if raws:
                        yield from flush()
                    key, ids, raws = now, [], []
                ids.append(own[a:b])
                raws.append(np.frombuffer(b"".join(batch.column(3)[a:b].to_pylist()), kind).reshape(b - a, -1))
        if raws:
            yield from flush()

    boxes = ", ".join(f"{c} double" for c in lows + highs)
    stored = cut(arrow_map(
        ordered.select("id", "label", "dim", "raw", F.spark_partition_id().cast("long").alias("part")), pack,
        f"block long, part long, label long, dim int, {boxes}, heads binary, ns binary, raw binary, ids binary, of binary",
    ))
    about = cut(stored.select("block", "part", "label", "dim", *lows, *highs))

    def level(h: int, tag: str) -> DataFrame:
        """The boxes of the intervals h steps above single ones, with columns named by a tag."""
        at = about.groupBy("label", "dim", F.shiftright("part", FANOUT_BITS * h).alias("key")).agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        return at.withColumn("parent", F.shiftright("key", FANOUT_BITS)).select(*[F.col(c).alias(tag + c) for c in at.columns + ["parent"]])

    tagged = lambda tag, names: [tag + n for n in names]
    top = 0
    while (parts - 1) >> (FANOUT_BITS * top):
        top += 1
    pairs = level(top, "").select("label", "dim", F.col("key").alias("a"), F.col("key").alias("b"))
    for h in range(top - 1, -1, -1):
        x, y = level(h, "x_"), level(h, "y_")
        under = pairs.join(x, (F.col("label") == F.col("x_label")) & (F.col("dim") == F.col("x_dim")) & (F.col("a") == F.col("x_parent")))
        under = under.join(y, (F.col("label") == F.col("y_label")) & (F.col("dim") == F.col("y_dim")) & (F.col("b") == F.col("y_parent")) & (F.col("x_key") <= F.col("y_key")))
        under = under.where(_gap(tagged("x_", lows), tagged("x_", highs), tagged("y_", lows), tagged("y_", highs)) <= eps * eps)
        pairs = under.select("label", "dim", F.col("x_key").alias("a"), F.col("y_key").alias("b"))
    pairs = cut(pairs)
    side = about.select("block", *[F.col(c).alias("s_" + c) for c in ("part", "label", "dim", *lows, *highs)])

    def sent(mine: str, theirs: str) -> DataFrame:
        """The blocks of the interval mine that come near the box of the interval theirs."""
        met = pairs.where("a < b" if mine == "b" else "true").join(level(0, "o_"), (F.col("label") == F.col("o_label")) & (F.col("dim") == F.col("o_dim")) & (F.col(theirs) == F.col("o_key")))
        met = met.join(side, (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")) & (F.col(mine) == F.col("s_part")))
        return met.where(_gap(tagged("s_", lows), tagged("s_", highs), tagged("o_", lows), tagged("o_", highs)) <= eps * eps).select("a", "b", "block")

    wanted = sent("a", "b").unionByName(sent("b", "a"))
    squares = wanted.join(stored.select("block", "part", "label", "dim", "heads", "ns", "raw"), "block")
    given = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("block")
        one, two, dim = (table.column(c)[0].as_py() for c in ("a", "b", "dim"))
        part = table.column("part").to_numpy()

        def load(which: int):
            rows_ = table.filter(pa.array(part == which))
            whole = lambda c, t: np.concatenate([np.frombuffer(v, t) for v in rows_.column(c).to_pylist()] or [np.zeros(0, t)])
            ids, ns, x = whole("heads", np.int64), whole("ns", np.int64), _units(whole("raw", kind).reshape(-1, dim)) if len(rows_) else np.zeros((0, dim))
            sizes = [len(v) // 8 for v in rows_.column("heads").to_pylist()]
            nodes = np.concatenate([(b << 12) + np.arange(k) for b, k in zip(rows_.column("block").to_pylist(), sizes)] or [np.zeros(0, np.int64)])
            return ids, ns, x, nodes, _project(x, axes, width)

        ids, ns, x, nodes, px = load(one)
        same = one == two
        ids2, ns2, y, nodes2, py = (ids[:0], ns, x, nodes[:0], px) if same else load(two)
        shift, counts = 0 if same else len(x), np.zeros(len(x) + len(ids2), np.int64)
        forest = _Forest(len(counts))
        for a, b, c, d in _near(px, py, same, eps * eps, leaf):
            hit = x[a:b] @ y[c:d].T >= least
            if same and a == c:
                np.fill_diagonal(hit, False)
            if hit.any():
                counts[a:b] += hit @ ns2[c:d]
                if not (same and a == c):
                    counts[c + shift : d + shift] += ns[a:b] @ hit
                i, j = np.nonzero(hit)
                forest.tie(i + a, j + c + shift)
        at = np.flatnonzero(counts)
        names, nodes = np.concatenate((ids, ids2)), np.concatenate((nodes, nodes2))
        out = pa.Table.from_arrays([pa.array(nodes[at]), pa.array(names[at]), pa.array(counts[at]), pa.array(names[forest.roots(at)])], schema=given)
        del table, x, y
        give_back()
        return out

    ship(rows.sparkSession)
    found = cut(squares.groupBy("label", "dim", "a", "b").applyInArrow(run, "node long, id long, links long, other long"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *raw in zip(*(c.to_pylist() for c in batch.columns)):
                heads, ns, ids = (np.frombuffer(v, np.int64) for v in raw[:3])
                of = np.frombuffer(raw[3], np.int32)
                first = np.concatenate(([True], of[1:] != of[:-1]))
                at = np.flatnonzero(ns[of] > 1)
                yield pa.RecordBatch.from_arrays([pa.array((number << 12) + of[at].astype(np.int64)), pa.array(ids[at]), pa.array(first[at]), pa.array(heads[of[at]]), pa.array(ns[of[at]])],
                                                 names=["node", "id", "first", "node_id", "n"])

    copies = arrow_map(stored.select("block", "heads", "ns", "ids", "of"), spread, "node long, id long, first boolean, node_id long, n long")
    return found, cut(copies)


def classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = SIMILAR,
            block: int = BLOCK, leaf: int = LEAF, interval: int = INTERVAL) -> DataFrame:
    """(id, n_links, component_id) of every row. block (at most 4096), leaf and interval are numbers of vectors."""
    given = F.col(f"`{vector}`")
    if not isinstance(vectors.schema[vector].dataType.elementType, T.FloatType):
        given = given.cast("array<double>")
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), given.alias("vector"))
    made = links(rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), least, block, leaf, interval)
    if made is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found, copies = made
    by_node = found.groupBy("node").agg(F.sum("links").alias("links"))
    counts = found.select("id", "links").union(copies.select("id", F.col("n") - 1)).union(copies.where("NOT first").join(by_node, "node").select("id", "links"))
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    placed = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")).union(copies.where("id <> node_id").select("id", "node_id")))
    done = rows.select("id").join(counts, "id", "left").join(placed, "id", "left")
    return done.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of the whole embeddings table."""
    found = classes(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
