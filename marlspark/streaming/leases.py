"""Jobs leased to schedulers as a stream: claims, expiry and retake, settled runs, backing off after failures.

Events of a job arrive in any order within the watermark's delay: they are kept as state and taken up in order of time when the watermark has passed them, by timers.  A lease that
runs out before its job is settled is a timer too.  Jobs that are not heard of for ``forget`` lose their state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds of a lease, failures in a row from which a job is backed off, and by how much its interval grows then (fixed values).
LEASE, FAILURES, BACKOFF = 3600, 5, 6

STATE = "next_run long, holder string, until long, failures long, touched long"
EVENT = "at long, seq long, kind string, who string, ok boolean"
OUT = "job long, at long, seq long, what string, who string, until long, next_run long, failures long"


def step(state: tuple, event: tuple, interval: int, lease: int = LEASE) -> tuple[tuple, list[tuple]]:
    """The state after one event, and what is to be said: (at, seq, what, who, until, next_run, failures).  Times are milliseconds.

    A poll takes the job if its time has come and no lease holds it; one that has run out holds nothing.  A job is settled by its holder alone; the next run counts from then.
    """
    next_run, holder, until, failures = state
    at, seq, kind, who, ok = event
    out = []
    if holder is not None and until <= at:
        out.append((until, -1, "expired", holder, until, next_run, failures))
        holder, until = None, 0
    if kind == "poll":
        if holder is None and next_run <= at:
            holder, until = who, at + lease * 1000
            out.append((at, seq, "claimed", who, until, next_run, failures))
    elif holder == who:
        failures = 0 if ok else failures + 1
        next_run = at + interval * 1000 * (BACKOFF if failures >= FAILURES else 1)
        holder, until = None, 0
        out.append((at, seq, "settled" if ok else "failed", who, 0, next_run, failures))
    return (next_run, holder, until, failures), out


def expired(state: tuple, now: int) -> tuple[tuple, list[tuple]]:
    """The state at a time, with a lease that has run out."""
    next_run, holder, until, failures = state
    if holder is None or until > now:
        return state, []
    return (next_run, None, 0, failures), [(until, -1, "expired", holder, until, next_run, failures)]


def said(out: list[tuple], key) -> pd.DataFrame:
    return pd.DataFrame([(int(key[0]), *o) for o in out], columns=[c.split()[0] for c in OUT.split(", ")])


class Leases(StatefulProcessor):
    def __init__(self, interval: int, lease: int, forget: int):
        self.interval, self.lease, self.forget = interval, lease, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for batch in rows:
            # to Python's own numbers, as state takes them
            events = [(int(a), int(s), str(k), str(w), bool(o)) for a, s, k, w, o in zip(batch["at"], batch["seq"], batch["kind"], batch["who"], batch["ok"])]
            # one timer a batch of events, not one an event: the first that fires takes up all that is due and looks again for the next
            self.handle.registerTimer(min(e[0] for e in events))
            self.waiting.appendList(events)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Everything up to the watermark, whichever timer comes first; the others then find nothing to do."""
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(e) for e in self.waiting.get()]
        due = sorted(e for e in held if e[0] <= now)
        *state, touched = self.job.get() or (0, None, 0, 0, 0)
        state, out = tuple(state), []
        for e in due:
            if e[0] - touched >= self.forget * 1000:  # whether its state is still there or not, it is forgotten
                state, more = expired(state, e[0])
                out += more
                state = state if state[1] is not None else (0, None, 0, 0)
            state, more = step(state, e, self.interval, self.lease)
            out += more
            touched = e[0]
        state, more = expired(state, now)
        out += more
        if due:
            if rest := [e for e in held if e[0] > now]:
                self.waiting.put(rest)
                self.handle.registerTimer(min(e[0] for e in rest))
            else:
                self.waiting.clear()
        if due or out:
            self.job.update((*state, touched))
            # when to look again: at the end of the lease, or when the job is to be forgotten
            self.handle.registerTimer(state[2] if state[1] is not None else touched + self.forget * 1000)
        elif not held and state[1] is None and now >= touched + self.forget * 1000:
            self.job.clear()
        if out:
            yield said(out, key)

    def close(self) -> None:
        pass


def leased(events: DataFrame, interval: int, lease: int = LEASE, forget: int = 30 * 86_400) -> DataFrame:
    """OUT: what happens to each job, as a stream.  events: job, ts (with a watermark), seq (orders events of one time), kind (poll or settle), who, ok.

    State with timers is kept by RocksDB, so the session's state store must be that (``with_rocks``).
    """
    from pyspark.sql import functions as F

    plain = events.select("job", "ts", (F.unix_micros("ts") / 1000).cast("long").alias("at"), "seq", "kind", "who", "ok")
    return plain.groupBy("job").transformWithStateInPandas(statefulProcessor=Leases(interval, lease, forget), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


@contextmanager
def with_rocks(spark: SparkSession):
    """The session's state store is RocksDB in the meantime."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)
