"""Keyed machines with clocks of their own: windows that forget, breakers that cool down, leases that run out.

A machine is a state a key, what time alone does to it (``advance``), what an event does (``apply``), and when time will do something next (``timer``). ``streamed`` runs one over a
stream, with a timer in event time for each key and no state where nothing is held; ``replayed`` runs it over a table. As an event first brings its key's clock up to date, both say the same of each event,
however events are dealt to batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType, _parse_datatype_string

from ..operators.workqueue import RETRYABLE

Row = dict
State = tuple | None
AHEAD = 1 << 42  # by how many milliseconds clocks run ahead: a stream's watermark begins at 1970, and what isn't after it counts as late


@dataclass(frozen=True)
class Windows:
    """Fixed windows that begin with a key's first event, and again with the first at or after their end; over ``most`` events of one are denied. Forgotten at their end."""

    window_ms: int
    most: int
    state = "start long, n long"
    columns = ()
    out = "window_start long, hit long, allowed boolean"

    def timer(self, s: State) -> int | None:
        return s[0] + self.window_ms

    def advance(self, s: State, at: int) -> tuple[State, list]:
        return (None if s[0] + self.window_ms <= at else s), []

    def apply(self, s: State, e: Row) -> tuple[State, tuple]:
        start, n = s or (e["at"], 0)
        return (start, n + 1), (start, n + 1, n < self.most)


@dataclass(frozen=True)
class Breaker:
    """``opens`` failures in a row open it; for ``cool_ms`` calls are refused and count for nothing; then it is half open, and the first call decides.

    Failures short of that are forgotten ``forget_ms`` after the last one, if that is given. When the time is up a row without an order says that it is half open.
    """

    cool_ms: int
    opens: int = 3
    forget_ms: int | None = None
    state = "failures long, until long, half boolean"
    columns = ("failed",)
    out = "state string, allowed boolean"

    def timer(self, s: State) -> int | None:
        return None if s[2] else s[1]

    def advance(self, s: State, at: int) -> tuple[State, list]:
        failures, until, half = s
        if half or until is None or at < until:
            return s, []
        return ((failures, until, True), [(until, "half_open", None)]) if failures >= self.opens else (None, [])

    def apply(self, s: State, e: Row) -> tuple[State, tuple]:
        failures, until, half = s or (0, None, False)
        opened = (self.opens, e["at"] + self.cool_ms, False)
        if half:
            return (opened if e["failed"] else None), ("half_open", True)
        if failures >= self.opens:
            return s, ("open", False)
        if not e["failed"]:
            return None, ("closed", True)
        return (opened if failures + 1 >= self.opens else (failures + 1, e["at"] + self.forget_ms if self.forget_ms else None, False)), ("closed", True)


@dataclass(frozen=True)
class Leases:
    """Jobs from their enqueueing to their end. Events: ``enqueue`` (``deadline``, ``timeout_ms``, ``max_attempts``), ``claim`` and ``heartbeat`` (``token``, ``lease_ms``), ``complete`` and ``fail`` (``token``, ``code``), ``cancel``.

    A lease ends at its own time, with the execution's timeout or at the deadline; the job is then tried again after a delay that doubles, or is dead-lettered, as it is after a failure. What a job can't do is rejected, and a key may be
    used again once its job has ended. Rows without an order say what time did.
    """

    base_ms: int = 1_000
    most_ms: int = 900_000
    state = "phase string, attempt long, max_attempts long, timeout_ms long, deadline long, available long, token string, lease long, execution long, cancelled boolean"
    columns = ("kind", "token", "lease_ms", "deadline", "timeout_ms", "max_attempts", "code")
    out = "outcome string, attempt long, last_error string"

    def timer(self, s: State) -> int | None:
        return min(s[7], s[8], s[4]) if s[0] == "leased" else s[4]

    def _settled(self, s: State, at: int, code: str) -> tuple[State, tuple]:
        phase, attempt, most, timeout, deadline, *_, cancelled = s
        again = at + min(self.most_ms, self.base_ms * 2 ** min(attempt - 1, 30))
        if not cancelled and RETRYABLE.get(code, False) and attempt < most and again < deadline:
            return ("waiting", attempt, most, timeout, deadline, again, None, None, None, False), ("retry_wait", attempt, code)
        return None, ("cancelled", attempt, "JOB_CANCELLED") if cancelled else ("dead_lettered", attempt, code)

    def advance(self, s: State, at: int) -> tuple[State, list]:
        out = []
        while s is not None and (end := self.timer(s)) <= at:
            if s[0] == "leased" and end < s[4]:
                s, row = self._settled(s, end, "JOB_HANDLER_TIMEOUT" if s[8] <= end else "JOB_LEASE_EXPIRED")
            else:
                s, row = None, ("dead_lettered", s[1], "JOB_DEADLINE_EXCEEDED")
            out.append((end, *row))
        return s, out

    def apply(self, s: State, e: Row) -> tuple[State, tuple]:
        at, kind = e["at"], e["kind"]
        refused = s, ("rejected", s[1] if s else None, None)
        if s is None:
            if kind != "enqueue" or None in (e["deadline"], e["timeout_ms"], e["max_attempts"]) or e["deadline"] <= at:
                return refused
            return ("waiting", 0, e["max_attempts"], e["timeout_ms"], e["deadline"], at, None, None, None, False), ("available", 0, None)
        phase, attempt, most, timeout, deadline, available, token, lease, execution, cancelled = s
        if kind == "cancel":
            return (None, ("cancelled", attempt, "JOB_CANCELLED")) if phase == "waiting" else ((*s[:-1], True), ("cancel_requested", attempt, None))
        if kind == "claim" and phase == "waiting" and available <= at and attempt < most and e["lease_ms"]:
            end = min(at + timeout, deadline)
            return ("leased", attempt + 1, most, timeout, deadline, available, e["token"], min(at + e["lease_ms"], end), end, False), ("leased", attempt + 1, None)
        if phase != "leased" or e["token"] is None or e["token"] != token:
            return refused
        if kind == "heartbeat" and e["lease_ms"] and not cancelled:
            return (*s[:7], min(at + e["lease_ms"], execution), *s[8:]), ("leased", attempt, None)
        if kind == "complete":
            return None, ("cancelled", attempt, "JOB_CANCELLED") if cancelled else ("succeeded", attempt, None)
        return self._settled(s, at, e["code"] or "JOB_HANDLER_FAILED") if kind == "fail" else refused


def _plain(x):
    """A value as Python has it; pandas' missing ones are none."""
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x


class _Processor(StatefulProcessor):
    def __init__(self, machine, key: str, order: str, names: list[str]):
        self.machine, self.key, self.order, self.names, self.kind = machine, key, order, names, _parse_datatype_string(machine.state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.kind)

    def _kept(self, before: State, after: State) -> None:
        old, new = (None if s is None or (t := self.machine.timer(s)) is None else t + AHEAD for s in (before, after))
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if after is None:
            if before is not None:
                self.held.clear()
        elif after != before:
            self.held.update(after)

    def _state(self) -> State:
        return tuple(map(_plain, self.held.get())) if self.held.exists() else None

    def _rows(self, key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key, *r) for r in rows], columns=[self.key, *self.names], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = s = self._state()
        every, out = pd.concat(list(rows)).sort_values(["at", self.order], kind="stable"), []
        names = [self.order, "at", *self.machine.columns]
        for values in zip(*(every[c].tolist() for c in names)):
            e = dict(zip(names, map(_plain, values)))
            if s is not None:
                s, passed = self.machine.advance(s, e["at"])
                out += [(None, *p) for p in passed]
            s, said = self.machine.apply(s, e)
            out.append((e[self.order], e["at"], *said))
        self._kept(before, s)
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, at = self._state(), expiredTimerInfo.getExpiryTimeInMs() - AHEAD
        if before is None:
            return
        s, passed = self.machine.advance(before, at)
        if s is None or self.machine.timer(s) != at:  # the timer that has fired is gone already
            self._kept(None if self.machine.timer(before) == at else before, s)
            if s is None:
                self.held.clear()
        yield self._rows(key[0], [(None, *p) for p in passed])

    def close(self) -> None:
        pass


def _out(machine, df: DataFrame, key: str, order: str) -> StructType:
    return _parse_datatype_string(f"`{key}` {df.schema[key].dataType.simpleString()}, `{order}` long, at long, {machine.out}")


def streamed(stream: DataFrame, machine, key: str, at_ms: str, order: str, late: str) -> DataFrame:
    """``(key, order, at, ...)`` of each event of a stream, and of each timer that fires; rows later than ``late`` behind the newest are dropped.

    Needs the RocksDB state store. A trigger's events of one key are put in order together, so triggers are to be small (``maxFilesPerTrigger``); null keys are one key, and events without a time are left out.
    """
    out = _out(machine, stream, key, order)
    rows = stream.where(F.col(at_ms).isNotNull()).select(key, F.col(at_ms).cast("long").alias("at"), F.timestamp_millis(F.col(at_ms).cast("long") + AHEAD).alias("event_time"), F.col(order).cast("long").alias(order), *machine.columns)
    return rows.withWatermark("event_time", late).groupBy(key).transformWithStateInPandas(_Processor(machine, key, order, out.names[1:]), out, "Append", "EventTime")


def replayed(df: DataFrame, machine, key: str, at_ms: str, order: str, until: int | None = None) -> DataFrame:
    """The same rows from a table: every event in order, and what time did up to ``until``, or for a key's last state up to its last event.

    What comes next depends on all before, so a key's events pass through one task, in order; it holds a batch of them and one state.
    """
    out = _out(machine, df, key, order)
    names = [order, "at", *machine.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = [], None
        pack = lambda rows: pa.RecordBatch.from_pylist([dict(zip(out.names, r)) for r in rows], schema)
        ended = lambda: [(last[0], None, *p) for p in machine.advance(s, until)[1]] if last and s is not None and until is not None else []
        for batch in batches:
            rows = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *names))):
                e = dict(zip(names, values))
                if not last or k != last[0]:
                    rows += ended()
                    last[:], s = [k], None
                if s is not None:
                    s, passed = machine.advance(s, e["at"])
                    rows += [(k, None, *p) for p in passed]
                s, said = machine.apply(s, e)
                rows.append((k, e[order], e["at"], *said))
            yield pack(rows)
        yield pack(ended())

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)
    rows = df.where(F.col(at_ms).isNotNull()).select(key, F.col(at_ms).cast("long").alias("at"), F.col(order).cast("long").alias(order), *machine.columns)
    return rows.repartition(F.col(key)).sortWithinPartitions(key, "at", order).mapInArrow(run, out)
