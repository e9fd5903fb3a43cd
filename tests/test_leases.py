"""Leased jobs as a stream against a fold over each job's events in order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marlspark.plans import stream_queries as Q
from marlspark.streaming import leases as L
from marlspark.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def fold(events, interval, lease, until):
    """events: (job, at, seq, kind, who, ok); the story up to a time."""
    out = []
    for job in {e[0] for e in events}:
        next_run = held_until = failures = 0
        holder = None
        for _, at, seq, kind, who, ok in sorted(e for e in events if e[0] == job and e[1] <= until):
            if holder and held_until <= at:
                out.append((job, held_until, -1, "expired", holder, held_until, next_run, failures))
                holder = None
            if kind == "poll" and not holder and next_run <= at:
                holder, held_until = who, at + lease * 1000
                out.append((job, at, seq, "claimed", who, held_until, next_run, failures))
            elif kind == "settle" and holder == who:
                failures = 0 if ok else failures + 1
                next_run = at + 1000 * (interval * 6 if failures >= 5 else interval)
                holder = None
                out.append((job, at, seq, "settled" if ok else "failed", who, 0, next_run, failures))
        if holder and held_until <= until:
            out.append((job, held_until, -1, "expired", holder, held_until, next_run, failures))
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    events, at = [], 0
    for i in range(n):
        at += r.randrange(1, 400) * 1000
        events.append((r.randrange(4), at, i, r.choice(["poll", "poll", "settle"]), r.choice("xy"), r.random() < 0.3))
    return events


@pytest.mark.parametrize("files, seed", [(1, 1), (6, 1), (6, 2)])
def test_stream_equals_fold_on_shuffled_batches(spark, tmp_path, files, seed):
    events = made(700, seed)
    r = random.Random(seed)
    # events come up to two hours out of order, in several batches
    late = sorted(events, key=lambda e: e[1] + r.randrange(7_200_000))
    folder = str(tmp_path / "in")
    for i in range(files):
        part = late[i * len(late) // files : (i + 1) * len(late) // files]
        rows = [(job, T0 + dt.timedelta(milliseconds=at), seq, kind, who, ok) for job, at, seq, kind, who, ok in part]
        spark.createDataFrame(rows, "job long, ts timestamp_ntz, seq long, kind string, who string, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3 hours")
    with L.with_rocks(spark):
        got = sorted(tuple(x) for x in S.drained(L.leased(stream, 900, 1200), "append").collect())
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    shifted = [(job, base + at, *rest) for job, at, *rest in events]
    want = fold(shifted, 900, 1200, max(e[1] for e in shifted) - 3 * 3_600_000)
    assert got == want
    assert {w[3] for w in want} == {"claimed", "settled", "failed", "expired"} and max(w[7] for w in want) >= 5


def test_query_equals_fold(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    ms = lambda ts: int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1000 + 1e-6)
    events = [(r["user_id"], ms(r["ts"]), r["event_id"], "settle" if r["event_type"] in ("purchase", "error") else "poll", f"s{r['ts'].hour % 2}", r["event_type"] != "error") for r in rows]
    got = sorted(tuple(x) for x in Q.leases(spark, sf_dir).collect())
    want = fold(events, 600, L.LEASE, max(e[1] for e in events) - 86_400_000)
    assert got and [g[:4] for g in got] == [w[:4] for w in want]


def test_forgotten_jobs(spark, tmp_path):
    """A job that comes back after its state was dropped begins anew."""
    day = 86_400_000
    events = [(1, 0, 0, "poll", "x", True), (1, 1000, 1, "settle", "x", False), (2, 5 * day, 2, "poll", "x", True), (2, 50 * day, 3, "poll", "x", True), (1, 51 * day, 4, "poll", "y", True), (2, 90 * day, 5, "poll", "y", True)]
    folder = str(tmp_path / "in")
    for e in events:
        spark.createDataFrame([(e[0], T0 + dt.timedelta(milliseconds=e[1]), *e[2:])], "job long, ts timestamp_ntz, seq long, kind string, who string, ok boolean").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    with L.with_rocks(spark):
        got = [(x["job"], x["what"], x["failures"]) for x in S.drained(L.leased(stream, 600, forget=86_400 * 10), "append").orderBy("at").collect()]
    assert (1, "failed", 1) in got and [g for g in got if g[0] == 1][-2] == (1, "claimed", 0)


def test_one_timer_a_batch_of_events():
    """Timers grow with the batches of a job, not with its events; what is not due yet gets the next one."""

    class Kept:
        def __init__(self):
            self.rows = []

        def get(self):
            return iter(list(self.rows))

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.rows = []

    class Value:
        row = None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def getListState(self, *_):  # noqa: N802
            return Kept()

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 30_000

    import pandas as pd

    p, handle = L.Leases(600, 1200, 86_400), Handle()
    p.init(handle)
    rows = pd.DataFrame([(1000 * i, i, "poll", "x", True) for i in range(1, 51)], columns=["at", "seq", "kind", "who", "ok"])
    assert list(p.handleInputRows((7,), iter([rows]), Now())) == [] and handle.timers == [1000]
    out = list(p.handleExpiredTimer((7,), Now(), None))
    assert [len(o) for o in out] == [1] and 31_000 in handle.timers and len(p.waiting.rows) == 20
