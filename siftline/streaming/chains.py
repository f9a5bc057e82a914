"""Chains verified as their events arrive, in any order."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import audit
from ..workers import ship

#: What is held of an event: whether its hash is right is known before events meet.
FIELDS = ["event_id", "previous_hash", "hash", "fine"]
STATE = "next long, head string, n long, message string, early array<string>"
RESULT = "chain string, n_events long, waiting long, ok boolean, message string, head string"


def _seen(next_: int, head: str, message: str | None, early: dict[int, list[list]]) -> tuple[int, str, str | None]:
    """Go on through the events that are next in turn, until one is missing or fails."""
    while message is None and next_ in early:
        events = early.pop(next_)
        e = events[0]
        if e[1] != head:
            message = f"Event {e[0]} has invalid previous_hash"
        elif not e[3]:
            message = f"Event {e[0]} has invalid hash"
        else:
            next_, head = next_ + 1, e[2]
            if len(events) > 1:  # a number that comes twice doesn't follow itself
                message = f"Event {events[1][0]} has invalid previous_hash"
    return next_, head, message


def verify_stream(events: DataFrame, chain: str = "chain", seq: str = "seq", wait_ms: int | None = None) -> DataFrame:
    """Per chain and batch what audit.verify says of its events so far: (chain, n_events, waiting, ok, message, head).

    A chain's state is its next number, its last hash and the events that came early. While one is missing, the first that waits counts
    as badly linked; when it comes, the chain is whole again. After wait_ms without an event for the chain (None: never), what is missing
    then is missing for good and what waits is dropped. With wait_ms, batches without data run too, so that an availableNow trigger doesn't end. An event whose number was passed already is badly linked, whatever it holds.
    """
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        next_, head, n, message, held = state.get if state.exists else (1, audit.GENESIS, 0, None, [])
        early: dict[int, list[list]] = {}
        for text in held or []:
            at, e = json.loads(text)
            early.setdefault(at, []).append(e)
        late = None
        expired = wait_ms is not None and state.hasTimedOut
        if not expired:
            for frame in frames:
                for at, *e in frame[["_seq", *FIELDS]].itertuples(index=False):
                    n += 1
                    if at < next_:
                        late = late or f"Event {e[0]} has invalid previous_hash"
                    elif message is None:
                        early.setdefault(int(at), []).append(e)
        next_, head, message = _seen(next_, head, message, early)
        message = message or late
        now = message
        if early and message is None:
            now = f"Event {early[min(early)][0][0]} has invalid previous_hash"
            message = now if expired else None
        if message:
            early = {}
        state.update((next_, head, n, message, [json.dumps([at, e]) for at, some in early.items() for e in some]))
        if early and wait_ms is not None:
            state.setTimeoutDuration(wait_ms)
        waiting = sum(map(len, early.values()))
        yield pd.DataFrame([(key[0], n, waiting, now is None, now or f"{n} audit events verified", head)], columns=[c.split()[0] for c in RESULT.split(", ")])

    rows = events.withColumns({"_chain": F.col(chain).cast("string"), "_seq": F.col(seq).cast("long"), "metadata": F.when(F.col("metadata").isNotNull(), audit.canonical("metadata"))})
    rows = rows.withColumn("fine", F.coalesce(F.col("hash") == audit.own_hash(), F.lit(False))).select("_chain", "_seq", *FIELDS)
    return rows.groupBy("_chain").applyInPandasWithState(step, RESULT, STATE, "update", GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
