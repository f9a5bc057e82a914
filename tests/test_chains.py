"""Logs in files: hashes that survive the round trip, commits, resumed verification, and what tampering does."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import audit
from siftline.sources import chains, tree


def values(rng, depth=0):
    kinds = [1.0, 1e20, -0.0, 0.1, 1e-7, 123456789012345678901234567890, 5, True, None, "é", "\U0001f600 \"\\\n\x7f\x01", "},\"previous_hash\":\"x\"", ""]
    if depth < 3 and rng.random() < 0.4:
        return {rng.choice(["b", "a", "é", "previous_hash", "z\"", "A"]): values(rng, depth + 1) for _ in range(rng.randrange(4))}
    if depth < 3 and rng.random() < 0.2:
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice(kinds)


def events(n, sessions=4, seed=1):
    rng = random.Random(seed)
    return [(i, f"s{i % sessions}é\"" if i % sessions else "s0", f"2024-01-01T00:00:{i % 60:02}Z", rng.choice(["finding", "redaction", "o\"dd"]), json.dumps({"k": values(rng), "n": i})) for i in range(n)]


SCHEMA = "n long, session_id string, timestamp string, event string, metadata string"


def put(name, text):
    """Overwrite a file of a log; the file system's own checksum goes."""
    folder, base = os.path.split(name)
    if os.path.exists(f"{folder}/.{base}.crc"):
        os.remove(f"{folder}/.{base}.crc")
    with open(name, "w", encoding="utf-8") as f:
        f.write(text)


def same(df, keys):
    return sorted(tuple(r[c] for c in (*keys, "n_events", "ok", "message", "head")) for r in df.collect())


@pytest.mark.parametrize("by_session", [True, False])
def test_written_read_and_verified_chains_agree(spark, tmp_path, by_session):
    log = chains.ChainLog(spark, f"file://{tmp_path}/log", by_session)
    assert log.verify().count() == 0 and log.read().count() == 0
    rows = events(120)
    for a, b in ((0, 50), (50, 51), (51, 120)):
        log.append(spark.createDataFrame(rows[a:b], SCHEMA), "n")
    whole = audit.append(spark.createDataFrame(rows, SCHEMA).withColumn("chain", F.col("session_id") if by_session else F.lit("log")), "chain", "n")
    key = lambda r: (r.chain, r.seq)
    fields = ["chain", "seq", "event_id", "session_id", "timestamp", "event", "metadata", "previous_hash", "hash"]
    assert sorted(map(tuple, log.read().select(fields).collect())) == sorted(map(tuple, whole.select(fields).collect()))
    assert same(log.verify(), ["chain"]) == same(audit.verify(whole, ["chain"]), ["chain"]) and all(r[2] for r in same(log.verify(), ["chain"]))
    # A hash covers the text that json.dumps gives.
    for r in sorted(log.read().collect(), key=key)[:40]:
        assert r.metadata == json.dumps(json.loads(r.metadata), sort_keys=True, separators=(",", ":"))


def test_second_verification_reads_new_files_only_and_finds_old_tampering(spark, tmp_path):
    log, rows = chains.ChainLog(spark, f"file://{tmp_path}/log"), events(60, 2)
    log.append(spark.createDataFrame(rows[:30], SCHEMA), "n")
    assert len(log.due()) >= 1 and all(r.ok for r in log.verify().collect()) and log.due() == []
    log.append(spark.createDataFrame(rows[30:], SCHEMA), "n")
    first, second = (c.segment for c in log._commits())
    assert log.due() and all(os.path.basename(second) in f for f in log.due())
    assert {r.chain: r.n_events for r in log.verify().collect()} == {"s0": 30, 's1é"': 30}
    # A field of an event in an old file.
    folder = first.removeprefix("file://")
    names = [os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("part-") and os.path.getsize(os.path.join(folder, n))]
    with open(names[0], encoding="utf-8") as f:
        text = f.read()
    session = json.loads(text.splitlines()[3])
    put(names[0], "".join(x + "\n" if i != 3 else x.replace('"n":', '"n":1') + "\n" for i, x in enumerate(text.splitlines())))
    bad = [r for r in log.verify().collect() if not r.ok]
    assert [(r.chain, r.message, r.head) for r in bad] == [(session["session_id"], f"Event {session['event_id']} has invalid hash", session["previous_hash"])]
    # A line lost inside, then one that is no JSON, then the file as it was.
    put(names[0], "".join(x + "\n" for i, x in enumerate(text.splitlines()) if i != 3))
    assert [r.message.split(" has ")[1] for r in log.verify().collect() if not r.ok] == ["invalid previous_hash"]
    put(names[0], "no json\n" + text)
    assert not all(r.ok for r in log.verify().collect())
    put(names[0], text)
    assert all(r.ok for r in log.verify().collect())


def test_cut_tails_and_lost_jobs(spark, tmp_path):
    log, rows = chains.ChainLog(spark, f"file://{tmp_path}/log", False), events(20)
    log.append(spark.createDataFrame(rows[:10], SCHEMA), "n")
    # A segment that was never committed is no part of the log.
    spark.createDataFrame([("{}",)], "value string").write.text(f"file://{tmp_path}/log/segments/lost")
    log.append(spark.createDataFrame(rows[10:], SCHEMA), "n")
    assert [tuple(r)[1:3] for r in log.verify().collect()] == [(20, True)]
    folder = log._commits()[1].segment.removeprefix("file://")
    name = next(os.path.join(folder, n) for n in os.listdir(folder) if n.startswith("part-") and os.path.getsize(os.path.join(folder, n)))
    with open(name, encoding="utf-8") as f:
        lines = f.readlines()
    put(name, "".join(lines[:-2]))
    assert [(r.n_events, r.ok, r.message) for r in log.verify().collect()] == [(18, False, "Chain ends before the session's last event")]


def test_plain_log_files_keep_numbers_and_accents(spark, tmp_path):
    whole = audit.append(spark.createDataFrame(events(40), SCHEMA).withColumn("chain", F.lit("x")), "chain", "n")
    tree.write_log(whole, f"{tmp_path}/log")
    assert [r.ok for r in audit.verify(tree.event_log(spark, f"{tmp_path}/log")).collect()] == [True]
    # The same events as another writer lays them out: spaces, other order, plain accents.
    os.mkdir(tmp_path / "other")
    with open(tmp_path / "other" / "a.jsonl", "w", encoding="utf-8") as f:
        for r in sorted(whole.collect(), key=lambda r: r.seq):
            d = {"metadata": json.loads(r.metadata), "hash": r.hash, "event_id": r.event_id, "timestamp": r.timestamp, "event": r.event, "session_id": r.session_id, "previous_hash": r.previous_hash}
            f.write(json.dumps(d, ensure_ascii=False) + "\n")
    assert [(r.n_events, r.ok) for r in audit.verify(tree.event_log(spark, f"{tmp_path}/other")).collect()] == [(40, True)]


def test_streamed_chains_equal_the_batch(spark, tmp_path):
    """Events in no order over several batches: whole, changed, dropped, repeated and cut chains, each as audit.verify sees it."""
    from siftline.streaming import chains as stream

    log = audit.append(spark.createDataFrame(events(90, 6), SCHEMA).withColumn("chain", F.concat(F.lit("c"), F.col("n") % 6)), "chain", "n")
    log = log.withColumn("metadata", F.when((F.col("chain") == "c1") & (F.col("seq") == 4), "{}").otherwise(F.col("metadata")))
    log = log.where(~((F.col("chain") == "c2") & (F.col("seq") == 7)) & ~((F.col("chain") == "c3") & (F.col("seq") == 1)))
    log = log.unionByName(log.where("chain = 'c4' and seq = 5")).cache()
    log.repartition(6, F.xxhash64("hash", F.rand(3))).write.parquet(f"{tmp_path}/in")
    found = stream.verify_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in"))
    rows = []
    query = found.writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend((n, r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    last = {r.chain: r for _, r in sorted(rows, key=lambda x: x[0])}
    want = {r.chain: r for r in audit.verify(log, ["chain"]).collect()}
    assert {c: (r.n_events, r.ok) for c, r in last.items()} == {c: (r.n_events, r.ok) for c, r in want.items()}
    assert {c: (r.message, r.head) for c, r in last.items() if c != "c4"} == {c: (r.message, r.head) for c, r in want.items() if c != "c4"}
    assert last["c4"].message.endswith("invalid previous_hash") and last["c2"].waiting == 8


def test_denied_files_are_never_opened_and_unreadable_ones_dont_count(spark, tmp_path, monkeypatch):
    import builtins

    import pyarrow as pa

    for name in ("a.py", "b.py", "c.py", ".env", "k/x.pem", "big.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("two words" if name != "big.txt" else "x" * 500)
    got = {r.path: (r.classification, r.text) for r in tree.tree_manifest(spark, str(tmp_path), max_files=2, max_bytes=100).collect()}
    assert got == {"a.py": ("scanned", "two words"), "b.py": ("scanned", "two words"), "c.py": ("over_limit", None), ".env": ("denied", None), "k/x.pem": ("denied", None), "big.txt": ("skipped_large", None)}
    one = tree.tree_manifest(spark, str(tmp_path / "a.py")).collect()
    assert [(r.path, r.classification, r.n_tokens) for r in one] == [("a.py", "scanned", 2)]
    # The passes over names, with files that can't be opened.
    opened, plain = [], builtins.open

    def guarded(path, *args, **kw):
        if str(path).startswith(str(tmp_path)):
            opened.append(os.path.basename(path))
            if path.endswith("a.py"):
                raise PermissionError(path)
        return plain(path, *args, **kw)

    monkeypatch.setattr(builtins, "open", guarded)
    rows = [("a.py", 9, "scanned"), ("b.py", 9, "scanned"), (".env", 9, "denied"), ("big.txt", 500, "skipped_large")]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["path", "size", "classification"])
    probed = list(tree._probed(str(tmp_path))([batch]))
    filled = [tuple(r.values()) for b in tree._filled(str(tmp_path), 1)(probed) for r in b.to_pylist()]
    assert [(p, k, c) for p, _, k, c in filled] == [("a.py", "unreadable", None), ("b.py", "scanned", b"two words"), (".env", "denied", None), ("big.txt", "skipped_large", None)]
    assert set(opened) == {"a.py", "b.py"}
    # With a size of null, a file is unreadable and leaves its place to the next.
    monkeypatch.undo()
    files = spark.createDataFrame([("a.py", None, None), ("b.py", 9, b"x"), ("c.py", 9, b"y z"), (".env", None, None)], "path string, size long, content binary")
    assert {r.path: (r.classification, r.n_tokens) for r in tree.manifest(files, max_files=2).collect()} == {"a.py": ("unreadable", 0), "b.py": ("scanned", 1), "c.py": ("scanned", 2), ".env": ("denied", 0)}


def test_one_long_chain_is_appended_in_steps(spark, monkeypatch):
    """Steps give the chains of one task each, null fields and heads included, and no task sorts more than a step of a chain."""
    rows = [(i, "a" if i % 5 else None, None if i % 7 == 0 else f"s{i % 3}", "2026-01-01T00:00:00Z", 'e"\u00e9', f'{{"n": {i}}}' if i % 4 else None) for i in range(230)]
    events = spark.createDataFrame(rows, "n long, chain string, session_id string, timestamp string, event string, metadata string")
    heads = spark.createDataFrame([("a", 41, "f" * 64)], "chain string, seq long, hash string")
    for known in (None, heads):
        plain = sorted(map(tuple, audit.append(events, "chain", "n", heads=known).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(audit, "STEP", 50)
            steps = audit.append(events, "chain", "n", heads=known)
            assert sorted(map(tuple, steps.collect()), key=str) == plain
            assert "Sort" not in steps._jdf.queryExecution().executedPlan().toString()
    for _, seq, event_id, session, at, event, metadata, previous, own in plain:
        assert own == audit.digest(event_id, session, at, event, metadata, previous)


def test_a_log_is_verified_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(audit, "RUN", 7)
    rows = spark.range(40).select((F.col("id") % 2).alias("c"), "id", F.lit('s\u00e9"\\ x').alias("session_id"), F.lit("t\n\x7f").alias("timestamp"), F.lit("finding").alias("event"), F.lit("{}").alias("metadata"))
    log = audit.append(rows, "c", "id").localCheckpoint()
    plan = audit.verify(log, ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
    assert [(r.n_events, r.ok) for r in audit.verify(log, ["c"]).collect()] == [(20, True)] * 2
    for k in (6, 7, 8):
        bad = audit.verify(log.where(f"NOT (c = 0 AND seq = {k})"), ["c"]).where("NOT ok").collect()
        head = log.where(f"c = 0 AND seq = {k - 1}").first().hash
        assert [(r.n_events, r.message, r.head) for r in bad] == [(19, f"Event evt_{k + 1:06d} has invalid previous_hash", head)]
        changed = log.withColumn("event", F.when((F.col("c") == 1) & (F.col("seq") == k), "x").otherwise(F.col("event")))
        assert [r.message for r in audit.verify(changed, ["c"]).where("NOT ok").collect()] == [f"Event evt_{k:06d} has invalid hash"]
