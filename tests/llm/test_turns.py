"""Conversation repair against an enumeration of all edits, and the rows that it repairs to."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import turns

FILLED = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every edit of a conversation's rows in order, by growing (cost, audit, roles) lists; at most two insertions in a row."""
    seen, ways, count = set(), [(0, "", [])], dict.fromkeys(turns.COUNTS, 0)
    fits = lambda roles: re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in roles))
    cheapest = {}
    for _, role, text in rows:
        filled = FILLED.findall(text)
        fault = "blank" if not filled else "duplicate" if (role, text) in seen else "truncated" if filled[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        more = {}
        for cost, audit, roles in ways:
            for k in range(3):
                for added in itertools.product(["user", "assistant"], repeat=k):
                    head = roles + [(r, "") for r in added]
                    ends = [(4, "D", head)]
                    if fault not in ("blank", "duplicate"):
                        cut = 3 if fault else 0
                        ends += [(cut, "K", head + [(role, text)])] + [(3 + cut, "R", head + [(r, text)]) for r in ("user", "assistant")]
                    for price, edit, now in ends:
                        if fits(now):
                            at = "".join(r[:1] or "-" for r, _ in now)[-1:] + ("s" if len(now) == 1 else "") if now else ""
                            found = (cost + price + 3 * k, audit + "I" * k + edit, now)
                            more.setdefault((at, bool(now)), []).append(found)
        # Of ways that end alike only the best can be a part of the best.
        ways = [min(v, key=lambda w: w[:2]) for v in more.values()]
    for cost, audit, roles in ways:
        for k in range(3):
            for added in itertools.product(["user", "assistant"], repeat=k):
                now = roles + [(r, "") for r in added]
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in now)):
                    cheapest[(cost + 3 * k, audit + "I" * k)] = now
    best = min(cheapest)
    initials = [r[:1] for _, r, _ in rows]
    count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    known = [t for t, _, _ in rows if t is not None]
    count["gaps"] = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return count | {"cost": best[0]}, best[1], cheapest[best]


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: brute(sorted(v, key=order)) for c, v in by.items()}


def conversations():
    rng, rows = random.Random(7), []
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why? ", "é…", "ok.\t", None]
    for conv in range(250):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "useful"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts[:3] if conv % 2 else texts) if rng.random() < 0.5 else f"Text {rng.randrange(99)}."))
    rows += [(None, 0, "user", "A null id."), (None, 1, "assistant", "And b."), (900, None, "user", "Same."), (900, None, "user", "Same.")]
    rows += [(901, t, "assistant" if t % 3 else "user", f"{t}." if t % 7 else "cut") for t in range(40)]
    return rows + [(902, 0, "system", "Alone."), (903, 5, "user", "x" * 300_000 + ".")]


def test_repair_against_all_edits(spark):
    rows, want = conversations(), expected(conversations())
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "at": F.lit("x"), "a.b": F.lit(2), "present": F.lit(False)})
    got = {r.conv_id: r for r in turns.repair(df).collect()}
    assert got.keys() == want.keys()
    for conv, (count, audit, kept) in want.items():
        r = got[conv]
        assert ({c: r[c] for c in turns.COUNTS}, r.audit) == (count, audit), conv
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks_of_pointers_trace_the_same_edits(monkeypatch, block):
    """Rows in small batches and blocks: the passes give the edits of the enumeration, however both are cut."""
    monkeypatch.setattr(turns, "BLOCK", block)
    want, rows = expected(conversations()), []
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())
    seen = set()
    for r in sorted([(c, t, " " if a is None else a, " " if x is None else x) for c, t, a, x in conversations()], key=order):
        rows.append((*r, (r[0], *r[2:]) in seen, True))
        seen.add((r[0], *r[2:]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    batches = [turns._emit(rows[i : i + 5], types[0], types[1:], list("trxap")) for i in range(0, len(rows), 5)]
    spilled = [d for b in turns._forward(iter(batches)) for d in zip(*(c.to_pylist() for c in b.columns))]
    assert max(len(d[2]) for d in spilled) <= 4 * block
    spilled.sort(key=lambda d: (d[0] is not None, d[0] or 0, -d[1]))
    batches = [turns._emit(spilled[i : i + 4], types[0], turns._POINTER_TYPES, turns._POINTERS) for i in range(0, len(spilled), 4)]
    got = {d[0]: d[-2] for b in turns._backward(True)(iter(batches)) for d in zip(*(c.to_pylist() for c in b.columns))}
    assert got == {c: w[1] for c, w in want.items()}


def test_repaired_rows_are_those_that_the_digest_covers(spark):
    want, got = expected(conversations()), {}
    for r in turns.repaired(spark.createDataFrame(conversations(), SCHEMA)).orderBy("number").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: kept for c, (_, _, kept) in want.items() if kept}


def test_damage_and_empty_tables(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"What now {c}? Yes.") for c in range(40) for t in range(4)] + [(77, None, None, None)]
    df, want = spark.createDataFrame(rows, SCHEMA), []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = turns.damaged(df)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.where("present").drop("present").collect()), key=key) == sorted(want, key=key)
    out = {r.conv_id: r for r in turns.repair(got, present=F.col("present")).collect()}
    assert out.keys() == {r[0] for r in rows}
    for conv, (count, audit, _) in expected(want).items():
        assert (out[conv].cost, out[conv].audit) == (count["cost"], audit)
    gone = {r[0] for r in rows} - {r[0] for r in want}
    for conv in gone:
        assert (out[conv].cost, out[conv].gaps, out[conv].audit, out[conv].repaired_sha256) == (0, 0, "", hashlib.sha256().hexdigest())
    nobody = turns.repair(df, present=F.lit(False)).collect()
    assert len(nobody) == 41 and {r.audit for r in nobody} == {""}
    assert turns.repair(df.limit(0)).count() == 0 and turns.repaired(df.limit(0)).count() == 0


def test_memory_of_a_long_conversation_is_its_edits():
    """States that lose drop out, so that steps are few kinds; the digest needs no text of before."""
    turns.step.cache_clear()
    c = turns._Conversation(1)
    for i in range(20_000):
        c.row(i, "system" if i % 5 else "tool", f"{i}.", False)
    assert turns.step.cache_info().currsize < 60 and len(c.seen) <= 4 and len(c.back) == 80_000
