import random

import pytest

from corbel.operators import ops
from corbel.streaming import keyed

EVENTS = "key string, at long, n long, failed boolean, kind string, token string, lease_ms long, deadline long, timeout_ms long, max_attempts long, code string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def some_events(seed, keys=("a", "b", "c", None), steps=120):
    rng, rows = random.Random(seed), []
    for key in keys:
        at = 1_000_000
        for _ in range(steps):
            at += rng.choice((0, 1, 50, 200, 900, 3_000, 12_000 if rng.random() < 0.2 else 10))
            kind = rng.choice(("enqueue", "claim", "claim", "heartbeat", "complete", "fail", "cancel" if rng.random() < 0.3 else "claim"))
            rows.append((key, at, len(rows), rng.random() < 0.55, kind, rng.choice(("t1", "t1", "t2", None)), rng.choice((300, 2_000)), at + rng.choice((500, 5_000, 60_000)), rng.choice((400, 9_000)), rng.choice((1, 3)), rng.choice((None, "JOB_HANDLER_TIMEOUT", "JOB_DEPENDENCY_UNAVAILABLE"))))
    return rows


def in_stream(spark, rows, machine, folder, batches=3):
    """The rows of a stream that takes its events in several triggers, and the state that is left once time has gone by."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    last = rows[-1][1] + 10_000_000
    parts = [rows[i * len(rows) // batches : (i + 1) * len(rows) // batches] for i in range(batches)] + [[("clock", last + k, 10_000 + k, False, "none", *[None] * 6)] for k in range(2)]
    out = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i, part in enumerate(parts):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = spark.readStream.schema(EVENTS).parquet(str(folder / "in"))
            q = keyed.streamed(stream, machine, "key", "at", "n", "0 seconds").writeStream.foreachBatch(lambda d, _: out.extend(map(tuple, d.collect()))).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return [r for r in out if r[0] != "clock"], left, last


@pytest.mark.parametrize("machine", [keyed.Windows(700, 2), keyed.Breaker(2_500, 3, 4_000), keyed.Leases()], ids=["windows", "breaker", "leases"])
def test_streams_equal_replays_and_their_state_runs_out(spark, tmp_path, machine):
    rows = some_events(3)
    got, left, until = in_stream(spark, rows, machine, tmp_path)
    want = [tuple(r) for r in keyed.replayed(spark.createDataFrame(rows, EVENTS).repartition(4), machine, "key", "at", "n", until).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len([r for r in got if r[1] is not None]) == len(rows)
    open_ = {k for k in ("a", "b", "c", None) if isinstance(machine, keyed.Breaker) and [r for r in sorted((r for r in want if r[0] == k), key=lambda r: (r[2], r[1] is None))][-1][3] == "half_open"}
    assert left is not None and left <= 2 * (1 + len(open_)) + 1  # the clock's own state, and breakers that wait for a call


def brute_breaker(calls, cool, opens, forget):
    """One key's calls by the rules, with the state as words."""
    out, mode, failures, until = [], "closed", 0, None
    for n, at, failed in calls:
        if mode == "open" and at >= until:
            out.append((None, until, "half_open", None))
            mode = "half_open"
        if mode == "closed" and until is not None and at >= until:
            failures, until = 0, None
        out.append((n, at, mode, mode != "open"))
        if mode == "half_open":
            mode, failures, until = ("open", opens, at + cool) if failed else ("closed", 0, None)
        elif mode == "closed":
            failures, until = (failures + 1, at + forget) if failed else (0, None)
            if failures >= opens:
                mode, until = "open", at + cool
    return out


def test_breakers_by_their_rules_and_windows_as_before(spark):
    rows = some_events(5, steps=400)
    df = spark.createDataFrame(rows, EVENTS)
    got = keyed.replayed(df, keyed.Breaker(2_500, 3, 4_000), "key", "at", "n").collect()
    for key in ("a", "b", "c", None):
        own = sorted((r[1:] for r in map(tuple, got) if r[0] == key), key=lambda r: (r[1], r[0] is not None, r[0] or 0))
        assert own == brute_breaker([(r[2], r[1], r[3]) for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))], 2_500, 3, 4_000)
    windows = keyed.replayed(df, keyed.Windows(700, 2), "key", "at", "n").select("key", "n", "window_start", "hit", "allowed")
    assert sorted(map(tuple, windows.collect()), key=str) == sorted(map(tuple, ops.anchored_windows(df, "key", "at", "n", 700, 2).collect()), key=str)


def test_leases_run_out_and_are_tried_again(spark):
    job = lambda at, n, kind, token=None, lease=None, code=None: ("j", at, n, False, kind, token, lease, 100_000, 5_000, 3, code)
    log = [
        job(0, 0, "claim", "t", 100), job(0, 1, "enqueue"), job(10, 2, "claim", "t1", 1_000), job(500, 3, "heartbeat", "t1", 2_000), job(2_400, 4, "complete", "t2"), job(3_000, 5, "claim", "t2", 500),
        job(3_600, 6, "claim", "t2", 9_000), job(4_000, 7, "fail", "t2", code="JOB_HANDLER_TIMEOUT"), job(6_100, 8, "claim", "t3", 90_000), job(20_000, 9, "enqueue"), job(20_001, 10, "cancel"),
    ]
    got = sorted(map(tuple, keyed.replayed(spark.createDataFrame(log, EVENTS), keyed.Leases(), "key", "at", "n", 200_000).collect()), key=lambda r: (r[2], r[1] is not None, r[1] or 0))
    assert [r[1:] for r in got] == [
        (0, 0, "rejected", None, None), (1, 0, "available", 0, None), (2, 10, "leased", 1, None), (3, 500, "leased", 1, None), (4, 2_400, "rejected", 1, None), (None, 2_500, "retry_wait", 1, "JOB_LEASE_EXPIRED"), (5, 3_000, "rejected", 1, None),
        (6, 3_600, "leased", 2, None), (7, 4_000, "retry_wait", 2, "JOB_HANDLER_TIMEOUT"), (8, 6_100, "leased", 3, None), (None, 11_100, "dead_lettered", 3, "JOB_HANDLER_TIMEOUT"), (9, 20_000, "available", 0, None), (10, 20_001, "cancelled", 0, "JOB_CANCELLED"),
    ]
