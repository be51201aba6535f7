"""Operations: counters, histograms, series caps, rate limits, circuit states, alerts, capacity, retention, recovery, paging."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Retention rules: asset, default days, most days, whether a legal hold applies, classification. Fixed values.
RETENTION = (
    ("account_identity", 30, 90, True, "restricted"), ("api_key_verifiers", 30, 90, False, "secret"), ("audit_events", 365, 2555, True, "confidential"), ("context_capsules_verdicts", 365, 2555, True, "confidential"),
    ("derived_claims_findings", 30, 365, True, "confidential"), ("normalized_content", 7, 30, True, "confidential"), ("operational_telemetry", 30, 90, False, "internal"), ("portfolio_data", 1, 7, True, "restricted"),
    ("public_source_metadata", 365, 2555, True, "public"), ("quarantined_content", 30, 90, True, "restricted"), ("raw_untrusted_content", 7, 30, True, "confidential"), ("recoverable_credentials", 0, 0, False, "secret"),
)
BACKUP_DAYS = 35
CLASS_RANK = {"public": 0, "internal": 1, "confidential": 2, "restricted": 3, "secret": 4}


def keyset_page(df: DataFrame, key: str, after: object, size: int) -> DataFrame:
    """A page of ``size`` rows after a cursor, with ``next_cursor`` on its rows if there are more: one top-n plan of ``size + 1`` rows."""
    if not 1 <= size <= 100:
        raise ValueError("page size must be 1 to 100")
    rows = (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size + 1)
    numbered = rows.withColumn("n", F.row_number().over(Window.orderBy(key)))
    cursor = F.max(F.when(F.col("n") == size, F.col(key))).over(Window.partitionBy())
    more = F.count("*").over(Window.partitionBy()) > size
    return numbered.withColumn("next_cursor", F.when(more, cursor)).where(F.col("n") <= size).drop("n")


def counter(df: DataFrame, labels: list[str], value: Column) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("value"))


def histogram(df: DataFrame, labels: list[str], value: Column, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative buckets ``le``, and their count and sum, by label: one pass, then a row a bound."""
    sums = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = df.groupBy(*labels).agg(*sums, F.count(value).alias("observations"), F.sum(value).alias("total"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("bucket")))
    return agg.select(*labels, F.inline(cells), "observations", "total")


def cap_series(df: DataFrame, metric: str, series: str, order: str, most: int = 200) -> DataFrame:
    """Rows of the first ``most`` series of each metric by first appearance. Series are summed up before the window, so it sees one row a series."""
    first = df.groupBy(metric, series).agg(F.min(order).alias("first"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy(metric).orderBy("first", series))).where(F.col("k") <= most).select(metric, series)
    return df.join(kept, [metric, series], "left_semi")


def _runs(values: list, last: list) -> Iterator[tuple[slice, bool]]:
    """Stretches of equal neighbours, and whether each begins a key; ``last`` holds the key that the batch before ended with."""
    same = lambda a, b: a == b or a != a and b != b
    at = 0
    while at < len(values):
        end = at + 1
        while end < len(values) and same(values[end], values[at]):
            end += 1
        yield slice(at, end), not last or not same(last[0], values[at])
        last[:] = [values[at]]
        at = end


def anchored_windows(df: DataFrame, key: str, at_ms: str, order: str, window_ms: int, most: int) -> DataFrame:
    """Fixed windows that begin with a key's first event and again with the first event at or after their end; all hits count, over ``most`` are denied.

    ``(key, order, window_start, hit, allowed)``. The next window depends on the last, so a key's events pass through one task, in order; it
    holds a batch of them and the current window, however many there are.
    """
    rows = df.select(key, F.col(at_ms).cast("long").alias("at"), F.col(order).cast("long").alias(order))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = [], None, 0
        for batch in batches:
            column = batch.column("at")
            times, empty = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
            starts, hits = np.zeros(len(times), np.int64), np.ones(len(times), np.int64)
            for run, fresh in _runs(batch.column(key).to_pylist(), last):
                if fresh:
                    start, n = None, 0
                at = run.start + int(empty[run].sum())  # rows without a time come first, each for itself
                while at < run.stop:
                    if start is None or start + window_ms <= times[at]:
                        start, n = int(times[at]), 0
                    end = at + int(np.searchsorted(times[at : run.stop], start + window_ms))
                    starts[at:end], hits[at:end] = start, np.arange(n + 1, n + 1 + end - at)
                    at, n = end, n + end - at
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(order), pa.array(starts, pa.int64(), mask=empty), pa.array(hits, pa.int64())], [key, order, "window_start", "hit"])

    kinds = f"`{key}` {df.schema[key].dataType.simpleString()}, `{order}` long, window_start long, hit long"
    return rows.repartition(key).sortWithinPartitions(key, "at", order).mapInArrow(fold, kinds).withColumn("allowed", F.col("hit") <= most)


def two_level_windows(df: DataFrame, group: str, key: str, at_ms: str, order: str, window_ms: int, most_group: int, most_key: int, suspended: str | None = None) -> DataFrame:
    """``(group, key, order, allowed, reason, retry_after_s)``: a request must fit both its group's and its key's window; denied ones count in both.

    Requests of suspended groups (a boolean column) are denied and count nowhere. The delay is the longer of those of the windows that are full, a second at least.
    """
    held = F.coalesce(F.col(suspended), F.lit(False)) if suspended else F.lit(False)
    rows = df.select(group, key, F.col(at_ms).cast("long").alias("at"), F.col(order).cast("long").alias(order), held.alias("held"))
    open_ = rows.where(~F.col("held")).withColumn("both", F.to_json(F.struct(group, key)))
    ends = lambda c, name: anchored_windows(open_, c, "at", order, window_ms, most_group if c == group else most_key).select(order, F.when(~F.col("allowed"), F.col("window_start") + window_ms).alias(name))
    met = rows.join(ends(group, "g"), order, "left").join(ends("both", "k"), order, "left")
    full = F.greatest("g", "k")  # null where both have room
    wait = F.greatest(F.lit(1), F.ceil((full - F.col("at")) / 1000)).cast("long")
    reason = F.when(F.col("held"), "suspended").when(full.isNotNull(), "quota")
    return met.select(group, key, order, reason.isNull().alias("allowed"), reason.alias("reason"), F.when(~F.col("held") & full.isNotNull(), wait).alias("retry_after_s"))


def circuit(rows: DataFrame, key: str, order: str, failed: str, opens: int = 3, cool: int = 5) -> DataFrame:
    """Each key's breaker state after all its calls in order: ``opens`` failures in a row open it, ``cool`` calls later one probe decides.

    Calls are dealt by ranges of (key, order), so a busy key goes to many tasks. A task says for each of its keys where each state leads and how
    often it opens on the way; a key's few such rows are then taken in order.
    """
    names = ["closed"] * max(opens, 1) + ["open"] * max(cool, 1) + ["half_open"]  # failures in a row; calls waited; the probe
    first_open, half = max(opens, 1), len(names) - 1

    def after(state: int, bad: bool) -> int:
        if state == half:
            return first_open if bad else 0
        if state >= first_open:
            return state + 1  # the last one leads to the probe
        return 0 if not bad and opens > 0 else first_open if state + 1 >= opens else state + 1

    table = np.array([[after(s, bad) for s in range(half + 1)] for bad in (False, True)], np.int16)
    opened = ((table >= first_open) & (table < half) & ~((np.arange(half + 1) >= first_open) & (np.arange(half + 1) < half))).astype(np.int64)

    def lead(bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state leads and how often it opens, by pairs of neighbours until one row is left."""
        to, n = table[bad], opened[bad]
        while len(to) > 1:
            odd = len(to) % 2
            a, b, m, k = to[0 : len(to) - odd : 2], to[1::2], n[0 : len(n) - odd : 2], n[1::2]
            to, n = np.concatenate([np.take_along_axis(b, a, 1), to[len(to) - odd :]]), np.concatenate([m + np.take_along_axis(k, a, 1), n[len(n) - odd :]])
        return to[0], n[0]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = [], None

        def rows_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x[0] for x in done]), pa.array([x[1].tolist() for x in done], pa.list_(pa.int32())), pa.array([x[2].tolist() for x in done], pa.list_(pa.int64()))], [key, "to", "n"])

        for batch in batches:
            bad, done = batch.column("bad").fill_null(False).to_numpy(zero_copy_only=False).astype(np.int8), []
            for run, fresh in _runs(batch.column(key).to_pylist(), last):
                to, n = lead(bad[run])
                if fresh:
                    done += [held] if held else []
                    held = batch.column(key).slice(run.start, 1), to, n
                else:
                    held = held[0], to[held[1]], held[2] + n[held[1]]
            if done:
                yield rows_of(done)
        if held:
            yield rows_of([held])

    calls = rows.select(key, F.col(order).alias("at"), F.col(failed).alias("bad"))
    parts = calls.repartitionByRange(key, "at", "bad").sortWithinPartitions(key, "at", "bad").mapInArrow(summary, f"`{key}` {rows.schema[key].dataType.simpleString()}, to array<int>, n array<long>")
    lists = parts.withColumn("task", F.spark_partition_id()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("task", "to", "n"))).alias("parts"))

    def step(a: Column, p: Column) -> Column:
        return F.struct(F.element_at(p["to"], a["state"] + 1).alias("state"), (a["opened"] + F.element_at(p["n"], a["state"] + 1)).alias("opened"))

    folded = lists.select(key, F.aggregate("parts", F.expr("named_struct('state', 0, 'opened', 0L)"), step).alias("s"))
    return folded.select(key, F.element_at(F.array(*map(F.lit, names)), F.col("s.state") + 1).alias("state"), F.col("s.opened").cast("int").alias("times_opened"))


def ordered_digest(df: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    """``(key, n, digest)``: SHA-256 of a JSON array of each key's items in order. A key's items pass through one task, which holds a batch of them."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, n, hashed = [], None, 0, None
        done = lambda: pa.RecordBatch.from_arrays([held, pa.array([n], pa.int64()), pa.array(["sha256:" + (hashed.update(b"]"), hashed.hexdigest())[1]])], [key, "n", "digest"])
        for batch in batches:
            items = batch.column("item").cast(pa.binary()).to_pylist()
            for run, fresh in _runs(batch.column(key).to_pylist(), last):
                if fresh:
                    if hashed:
                        yield done()
                    held, n, hashed = batch.column(key).slice(run.start, 1), 0, hashlib.sha256(b"[")
                hashed.update((b"," if n else b"") + b",".join(items[run]))
                n += run.stop - run.start
        if hashed:
            yield done()

    rows = df.repartition(key).sortWithinPartitions(key, *order).select(key, item.alias("item"))
    return rows.mapInArrow(fold, f"`{key}` {df.schema[key].dataType.simpleString()}, n long, digest string")


# Thresholds of alerts, budgets of capacity and times of recovery below: fixed values.
def next_circuit(state: Column, failures: Column, cooled: Column, probe_ok: Column) -> Column:
    return F.when(state == "closed", F.when(failures >= 3, "open").otherwise("closed")).when(state == "open", F.when(cooled, "half_open").otherwise("open")).otherwise(F.when(probe_ok, "closed").otherwise("open"))


def alerts(s: dict[str, Column]) -> Column:
    """Sorted ids of the alerts that a snapshot raises; maintenance silences the two about availability."""
    calm = ~s["maintenance"]
    return F.array_compact(
        F.array(
            F.when(~s["audit_healthy"], "audit_commit_failed"),
            F.when(calm & ((s["burn_1h"] > 14) | (s["burn_6h"] > 6)), "availability_burn"),
            F.when(s["dead_letters_per_hour"] >= 10, "dead_letter_growth"),
            F.when(calm & (s["burn_3d"] > 1), "error_budget_burn"),
            F.when(s["oldest_ready_s"] > 300, "queue_backlog"),
            F.when(s["telemetry_age_s"] > 300, "telemetry_stale"),
        )
    )


def capacity(scan_cost: Column, tenant_cost: Column, active: Column, queued: Column, most_cost: int = 20, most_tenant: int = 500, most_active: int = 8, most_queued: int = 100) -> Column:
    """Admission; cost is checked before load."""
    return F.when((scan_cost > most_cost) | (tenant_cost + scan_cost > most_tenant), "cost_limited").when((active >= most_active) | (queued >= most_queued), "overloaded").otherwise("accepted")


def retention_plan(df: DataFrame, asset: str, created: str, held: str, now: Column) -> DataFrame:
    """``due`` and backup expiry dates, and why a row may not be deleted yet: a hold comes before the date."""
    days, holds = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for name, default, _, hold, _ in RETENTION:
        days, holds = F.when(F.col(asset) == name, F.lit(default)).otherwise(days), F.when(F.col(asset) == name, F.lit(hold)).otherwise(holds)
    rows = df.withColumn("due", F.date_add(F.to_date(created), days)).withColumn("hold_applies", holds & F.col(held))
    reason = F.when(F.col("due").isNull(), "unknown_asset").when(F.col("hold_applies"), "legal_hold").when(F.to_date(now) < F.col("due"), "retention_not_due")
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).withColumn("backup_due", F.date_add("due", BACKUP_DAYS)).drop("hold_applies")


def may_forward(classification: Column, consent: Column) -> Column:
    """Secrets never go to a model; what is confidential or restricted needs consent."""
    return F.when(classification == "secret", False).when(classification.isin("confidential", "restricted"), consent).otherwise(F.lit(True))


def restore_verdict(artifact: Column, intact: Column, minutes: Column, lost_minutes: Column, rto: int = 20, rpo: int = 30) -> Column:
    return F.when(~artifact, "artifact_missing").when(~intact, "integrity_failed").when(minutes > rto, "rto_exceeded").when(lost_minutes > rpo, "rpo_exceeded").otherwise("passed")


def bps(n: Column, d: Column) -> Column:
    """Basis points, half up; nothing of nothing is all."""
    return F.when(d == 0, 10_000).otherwise(F.floor(n / d * 10_000 + 0.5)).cast("long")


def openmetrics(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the OpenMetrics text format."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(f"{metric}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
