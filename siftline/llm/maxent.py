"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class, given hashed features of the history (the last word, the word before
it with a skip, and both), times that of its slot in the class, given the hashed pair of class and last word. Each class
has slots for its most frequent words and one for its tail, within which words have their relative training frequency.
The share of tokens that were seen once is left to unseen words, in equal parts for as many as Chao's estimate from the
words seen once and twice says there are, so that the model is a distribution over words and texts compare.

Classes are clusters of word endings that keep similar company. Training is distributed: each task takes gradient steps
over its own texts in numpy batches, from the same weights, and returns what it changed by feature row; Spark averages
the changes by how often a task met the row, and the next round, over other texts, starts from there. Every training
token is learnt from once. Counts (for the base score, classes, slots and tails) are exact and over all training texts.
Feature rows grow with the square root of the counted vocabulary, and so do the training tasks with that of the bytes, so
that what they exchange grows in proportion to the input.

Word counts are joined to texts by blocks: texts are dealt to blocks by a hash of their id, every block asks once for
each of its different words, and gets the counts back as a sorted table. Neither the vocabulary nor the texts ever
meet in one place; what the driver sees is the model: 640 bytes for each of its rows.

Defined results: a null or empty text is the end token alone; texts of equal words score alike; a null id is hashed as
''; repeated ids are scored row by row; without training texts all weights are zero and scores follow the base
counts' smoothing; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import ship
from .common import arrow_map, cut, partitions_for, read
from .words import _FOLDED, blocks, fixed, mix, span_hashes, text_bytes, word_spans

CLASSES, SLOTS, ENDINGS, COMPANY = 32, 64, 1024, 64
#: Templates of the class softmax; feature rows per template for each square root of the vocabulary, the least power of two
#: of rows, and rows that travel together.
TEMPLATES, ROWS_PER_ROOT, LEAST_BITS, TOGETHER = 3, 4, 12, 64
#: Training rounds (each over its own share of the texts), tokens of a step, and its rate.
ROUNDS, STEP, RATE = 2, 8192, 0.3
#: Tokens up to which the errors of a row are added one after another.
FEW = 8
#: Most frequent words that may get slots, and bytes of a block of texts.
HEAD, BLOCK_BYTES = 8192, 16 << 20

_END, _BEGIN, _SIGN = fixed("end of text"), fixed("before the text"), fixed("ending")
_MUL = [fixed(f"feature {i}") | np.uint64(1) for i in range(6)]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of texts (each ends with the end token), their endings, and the tokens before each text and the end."""
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, _FOLDED)
    sign = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        sign = sign * _SIGN + np.where(ends - back >= starts, _FOLDED[data[np.maximum(ends - back, 0)]], np.uint64(7))
    sign = (mix(sign) % np.uint64(ENDINGS - 1)).astype(np.int64) + 1
    return np.insert(words, first[1:], _END), np.insert(sign, first[1:], 0), first + np.arange(len(first))


def history(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word and the one before it, for every token."""
    out = []
    for back in (1, 2):
        h = np.concatenate((np.full(min(back, len(words)), _BEGIN), words[:-back] if len(words) > back else words[:0]))
        for k in range(back):
            at = first[:-1] + k
            at = at[at < first[1:]]
            h[at] = _BEGIN
        out.append(h)
    return out[0], out[1]


def rows_bits(types: int) -> int:
    """Binary logarithm of the feature rows of a template, for a vocabulary."""
    return max(LEAST_BITS, int(np.ceil(np.log2(ROWS_PER_ROOT * max(types, 1) ** 0.5))))


@dataclass
class Model:
    """Counts of the training texts, classes and slots, and the weights."""

    total: int = 0
    types: int = 0
    once: int = 0
    twice: int = 0
    bits: int = LEAST_BITS
    class_of: np.ndarray = field(default_factory=lambda: np.zeros(ENDINGS, np.int64))
    head: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    head_class: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    head_slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tail: np.ndarray = field(default_factory=lambda: np.ones(CLASSES))
    class_bias: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.float32))
    slot_bias: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, SLOTS), np.float32))
    #: Tables of TEMPLATES class templates, and the one of slots.
    tables: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not self.tables:
            self.tables = [np.zeros((1 << self.bits, CLASSES if t < TEMPLATES else SLOTS), np.float32) for t in range(TEMPLATES + 1)]

    def unseen(self) -> tuple[float, float]:
        """The share of tokens that are unseen words, and how many such words there may be."""
        share = min((self.once + 0.5) / (self.total + 1.0), 0.5)
        return share, max(self.once * self.once / (2.0 * max(self.twice, 1)), self.once, 1.0)

    def targets(self, words: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot (0: tail) of tokens."""
        kind, slot = self.class_of[signs], np.zeros(len(words), np.int64)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.head, words), len(self.head) - 1)
            hit = self.head[at] == words
            slot[hit] = self.head_slot[at[hit]]
        return kind, slot

    def rows(self, last: np.ndarray, before: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
        """Rows of the three class templates and of the slots, by history."""
        mixed = (last * _MUL[0], before * _MUL[1], last * _MUL[2] + before * _MUL[3], last * _MUL[4] + kind.astype(np.uint64) * _MUL[5])
        return [(mix(x) >> np.uint64(64 - self.bits)).astype(np.int64) for x in mixed]

    def exps(self, rows: list[np.ndarray], kind: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """exp of the logits of classes and of slots, with their sums. Biases are logarithms of shares and weights are small,
        so that sums seldom leave the range; where they do, the largest logit is taken off."""

        def logits(slots: bool) -> np.ndarray:
            if slots:
                out = np.take(self.tables[TEMPLATES], rows[TEMPLATES], axis=0)
                out += np.take(self.slot_bias, kind, axis=0)
            else:
                out = np.take(self.tables[0], rows[0], axis=0)
                for t in range(1, TEMPLATES):
                    out += np.take(self.tables[t], rows[t], axis=0)
                out += self.class_bias
            return out

        done = []
        for slots in (False, True):
            e = logits(slots)
            with np.errstate(over="ignore"):
                np.exp(e, out=e)
            total = np.einsum("ij->i", e)
            if not (np.isfinite(total).all() and (total > 1e-30).all()):
                e = logits(slots)
                e -= e.max(axis=1, keepdims=True)
                np.exp(e, out=e)
                total = np.einsum("ij->i", e)
            done.append((e, total))
        return done

    def log10(self, words: np.ndarray, signs: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of every token; counts are the tokens' training counts."""
        last, before = history(words, first)
        out = np.empty(len(words))
        share, left = self.unseen()
        for a in range(0, len(words), STEP):
            cut_ = slice(a, a + STEP)
            kind, slot = self.targets(words[cut_], signs[cut_])
            n, c = np.arange(len(kind)), counts[cut_]
            got = np.zeros(len(kind))
            for (e, total), at in zip(self.exps(self.rows(last[cut_], before[cut_], kind), kind), (kind, slot)):
                got += np.log(np.maximum(e[n, at], 1e-35)) - np.log(total)
            got += np.where(slot == 0, np.log(np.maximum(c, 1) / np.maximum(self.tail[kind], 1.0)), 0.0)
            out[cut_] = np.where(c > 0, got + np.log1p(-share), np.log(share / left))
        return out / np.log(10)

    def learn(self, words: np.ndarray, signs: np.ndarray, first: np.ndarray, state: list) -> None:
        """Gradient steps over the tokens of some texts, with step sizes that fall by row; counts the rows met."""
        last, before = history(words, first)
        for a in range(0, len(words), STEP):
            cut_ = slice(a, a + STEP)
            kind, slot = self.targets(words[cut_], signs[cut_])
            n = np.arange(len(kind))
            rows = self.rows(last[cut_], before[cut_], kind)
            (classes, total), (slots, total2) = self.exps(rows, kind)
            classes /= total[:, None]
            classes[n, kind] -= 1
            slots /= total2[:, None]
            slots[n, slot] -= 1
            for t, row in enumerate(rows):
                self._step(self.tables[t], row, classes if t < TEMPLATES else slots, state[t])

    def _step(self, weights: np.ndarray, row: np.ndarray, error: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> None:
        # Errors are summed by row in the order of rows; only the rows met change. (Small numbers sort by radix.)
        order = np.argsort(row.astype(np.uint16) if self.bits <= 16 else row, kind="stable")
        ranked = row[order]
        begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        met, sizes = ranked[begins], np.diff(np.append(begins, len(row)))
        gradient = np.take(error, order[begins], axis=0)
        # Rows of few tokens: the second, third, .. token of all at once. Rows of many: one sum each.
        for k in range(1, FEW):
            more = np.flatnonzero((sizes > k) & (sizes <= FEW))
            if len(more):
                gradient[more] += np.take(error, order[begins[more] + k], axis=0)
        many = np.flatnonzero(sizes > FEW)
        if len(many):
            first = np.cumsum(sizes[many]) - sizes[many]
            mine = order[np.arange(sizes[many].sum()) + np.repeat(begins[many] - first, sizes[many])]
            gradient[many] = np.add.reduceat(np.take(error, mine, axis=0), first, axis=0)
        squares, seen = state
        squares[met] += np.einsum("ij,ij->i", gradient, gradient) / error.shape[1]
        seen[met] += sizes
        gradient *= (np.float32(RATE) / np.sqrt(squares[met]))[:, None]
        weights[met] -= gradient


def _texts(table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of ranges of the texts of a column."""
    data, offsets = text_bytes(table)
    for a, b in blocks(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _count_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(block, word, ending, n) of a block's different words with their training counts, and company counts as block -1."""
    learns = table.column("train").to_numpy()
    words, signs, counts = [], [], []
    company = np.zeros(ENDINGS * COMPANY, np.int64)
    for a, b, data, offsets in _texts(table.column("text")):
        w, s, first = tokens(data, offsets)
        mine = np.repeat(learns[a:b], np.diff(first))
        u, at, which = np.unique(w, return_index=True, return_inverse=True)
        words.append(u)
        signs.append(s[at])
        counts.append(np.bincount(which, weights=mine, minlength=len(u)).astype(np.int64))
        inner = mine.copy()
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        company += np.bincount(s[at] * COMPANY + s[at - 1] % COMPANY, minlength=len(company))
    w, s, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((words, np.uint64), (signs, np.int64), (counts, np.int64)))
    u, at, which = np.unique(w, return_index=True, return_inverse=True)
    n = np.bincount(which, weights=c, minlength=len(u)).astype(np.int64)
    near = np.flatnonzero(company)
    return pa.table({
        "block": pa.array(np.concatenate((np.full(len(u), key[0].as_py()), np.full(len(near), -1))).astype(np.int32)),
        "word": pa.array(np.concatenate((u.view(np.int64), near))),
        "ending": pa.array(np.concatenate((s[at] if len(u) else s, near // COMPANY)).astype(np.int32)),
        "n": pa.array(np.concatenate((n, company[near]))),
    })


def cluster(company: np.ndarray, k: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Classes of endings by weighted k-means of the square roots of their company's shares; heavy endings are the seeds."""
    weight = company.sum(axis=1)
    shares = np.sqrt(company / np.maximum(weight, 1)[:, None])
    centres = shares[np.argsort(-weight, kind="stable")[:k]]
    for _ in range(rounds):
        place = np.argmax(shares @ centres.T, axis=1)
        for c in range(k):
            mine = (place == c) & (weight > 0)
            if mine.any():
                total = (shares[mine] * weight[mine, None]).sum(axis=0)
                centres[c] = total / max(np.linalg.norm(total), 1e-12)
    return place


def counted(totals: DataFrame, local: DataFrame) -> Model:
    """The model's counts, classes and slots. The driver gets ENDINGS * COMPANY sums, HEAD words and a row per class."""
    company = np.zeros(ENDINGS * COMPANY)
    for word, n in local.where("block < 0").groupBy("word").agg(F.sum("n")).collect():
        company[word] = n
    model = Model(class_of=cluster(company.reshape(ENDINGS, COMPANY)))
    seen = totals.where("c > 0")
    by_ending = seen.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).collect()
    mass = np.zeros(CLASSES)
    for ending, c, v, once, twice in by_ending:
        model.total, model.types, model.once, model.twice = model.total + c, model.types + v, model.once + once, model.twice + twice
        mass[model.class_of[ending]] += c
    model = replace(model, bits=rows_bits(model.types), tables=[])
    # Counts that HEAD words reach, in steps of an eighth of a power of two: tasks report few words, and none of the first HEAD is lost.
    step = F.floor(8 * F.log2("c"))
    enough, bound = 0, 0
    for bound, n in seen.groupBy(step.alias("s")).agg(F.count("*")).orderBy(F.desc("s")).collect():
        enough += n
        if enough >= HEAD:
            break
    top = seen.where(step >= bound).orderBy(F.desc("c"), "word").limit(HEAD).collect()
    slots, heads = np.zeros((CLASSES, SLOTS)), []
    used = np.zeros(CLASSES, np.int64)
    for word, ending, c in top:
        k = model.class_of[ending]
        if used[k] < SLOTS - 1:
            used[k] += 1
            slots[k, used[k]] = c
            heads.append((np.int64(word).view(np.uint64), k, used[k]))
    heads.sort(key=lambda h: int(h[0]))
    model.head = np.array([h[0] for h in heads], np.uint64)
    model.head_class, model.head_slot = (np.array([h[i] for h in heads], np.int64) for i in (1, 2))
    model.tail = mass - slots.sum(axis=1)
    slots[:, 0] = model.tail
    model.class_bias = np.log(np.maximum(mass, 0.5) / max(model.total, 1)).astype(np.float32)
    model.slot_bias = np.where(slots > 0, np.log(np.maximum(slots, 1e-9) / np.maximum(mass, 0.5)[:, None]), -60.0).astype(np.float32)
    return model


def _averaged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The sum of the tasks' changes of some rows, over how often the rows were met."""
    width = CLASSES if key[0].as_py() < TEMPLATES else SLOTS
    total = np.zeros((TOGETHER, width + 1))
    for change in table.column("change"):
        total += np.frombuffer(change.as_buffer(), np.float32).reshape(TOGETHER, width + 1)
    mean = (total[:, :width] / np.maximum(total[:, width:], 1)).astype(np.float32)
    return pa.table({"template": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "change": pa.array([mean.tobytes()], pa.binary())})


def train(texts: DataFrame, model: Model, tasks: int, rounds: int = ROUNDS) -> Model:
    """Distributed gradient training over the training texts by so many tasks; each round takes its share of the texts."""
    spark = texts.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start = shared.value
            mine = replace(start, tables=[t.copy() for t in start.tables])
            state = [(np.full(len(t), 1e-2, np.float32), np.zeros(len(t), np.int64)) for t in mine.tables]
            for batch in batches:
                for _, _, data, offsets in _texts(batch.column(0)):
                    mine.learn(*tokens(data, offsets), state)
            for t, (old, now, (_, seen)) in enumerate(zip(start.tables, mine.tables, state)):
                now -= old
                now *= seen[:, None]
                change = np.concatenate((now, seen[:, None].astype(np.float32)), axis=1)
                at = np.flatnonzero(seen.reshape(-1, TOGETHER).any(axis=1))
                payload = [change[i * TOGETHER : (i + 1) * TOGETHER].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(payload, pa.binary())], names=["template", "at", "change"])

        share = texts.where("train").where(F.pmod(F.xxhash64("id", F.lit("round")), F.lit(rounds)) == turn).select("text").coalesce(tasks)
        changes = arrow_map(share, run, "template int, at int, change binary")
        mean = changes.groupBy("template", "at").applyInArrow(_averaged, "template int, at int, change binary")
        model = replace(model, tables=[t.copy() for t in model.tables])
        for t, at, change in mean.collect():
            model.tables[t][at * TOGETHER : (at + 1) * TOGETHER] += np.frombuffer(change, np.float32).reshape(TOGETHER, -1)
        shared.unpersist()
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % 5 == 1
    n = partitions_for(docs, text, BLOCK_BYTES)
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), (~held_out).alias("train"))
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    ship(spark)
    local = cut(dealt.groupBy("block").applyInArrow(_count_block, "block int, word long, ending int, n long"))
    words = local.where("block >= 0")
    totals = cut(words.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("c")))
    tasks = max(spark.sparkContext.defaultParallelism, int(np.ceil(2 * n**0.5)))
    model = train(texts, counted(totals, local), tasks, rounds)
    shared = spark.sparkContext.broadcast(model)
    lexicon = words.select("block", "word").join(totals.select("word", "c"), "word").select(F.col("block").alias("of"), "word", "c")

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        m = shared.value
        entries = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(entries)
        entries, counts = entries[order], known.column("c").to_numpy()[order]
        size, have, base, mine = [], [], [], []
        for _, _, data, offsets in _texts(table.column("text")):
            w, s, first = tokens(data, offsets)
            c = counts[np.searchsorted(entries, w)]
            logs = np.log10((c + 0.5) / (m.total + 0.5 * (m.types + 1)))
            size.append(np.diff(first))
            # Every text has a token, so that no run is empty.
            have.append(np.add.reduceat((c > 0).astype(np.int64), first[:-1]))
            base.append(np.add.reduceat(logs, first[:-1]))
            mine.append(np.add.reduceat(m.log10(w, s, first, c), first[:-1]))
        join = lambda x, t: pa.array(np.concatenate(x).astype(t)) if x else pa.array([], pa.from_numpy_dtype(t))
        return pa.table({
            "id": table.column("id"), "train": table.column("train"), "n_tokens": join(size, np.int64), "n_known": join(have, np.int64),
            "base_score": join(base, np.float64), "score": join(mine, np.float64),
        })

    kind = texts.schema["id"].dataType.simpleString()
    done = dealt.groupBy("block").cogroup(lexicon.groupBy("of")).applyInArrow(run, f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document."""
    return score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
