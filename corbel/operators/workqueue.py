"""Leased work queues and ordered deliveries as snapshot transitions: a table in, the table after the step out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Allowed moves of a job, and whether a failure may be retried: fixed values.
MOVES = {
    "available": ("leased", "cancelled", "dead_lettered"),
    "leased": ("leased", "retry_wait", "succeeded", "dead_lettered", "cancelled"),
    "retry_wait": ("leased", "cancelled", "dead_lettered"),
    "succeeded": (),
    "dead_lettered": (),
    "cancelled": (),
}
RETRYABLE = {
    "JOB_CANCELLED": False,
    "JOB_DEADLINE_EXCEEDED": False,
    "JOB_DEPENDENCY_UNAVAILABLE": True,
    "JOB_HANDLER_FAILED": False,
    "JOB_HANDLER_TIMEOUT": True,
    "JOB_LEASE_EXPIRED": True,
    "JOB_PAYLOAD_UNAVAILABLE": True,
    "JOB_UNSUPPORTED_ENVELOPE": False,
}


def may_move(state: Column, target: Column) -> Column:
    out = F.lit(False)
    for a, bs in MOVES.items():
        if bs:
            out = out | ((state == a) & target.isin(*bs))
    return out


def retry_delay_ms(attempt: Column, base: int = 1_000, most: int = 900_000) -> Column:
    """Doubles with each attempt up to a limit."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30)))).cast("long")


def later(at: Column, ms: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(at) + ms)


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    ready = F.col("state").isin("available", "retry_wait") & (F.col("available_at") <= now) & (F.col("deadline_at") > now) & (F.col("attempt") < F.col("max_attempts"))
    return jobs.where(ready)


def claim_next(jobs: DataFrame, now: Column, lease_ms: int) -> DataFrame:
    """The next job of every queue by ``available_at, created_at, job_id``, leased: execution ends at its timeout or deadline, the lease with it at the latest.

    The minimum of a struct finds it by partial aggregation, whatever the queue's length.
    """
    first = claimable(jobs, now).groupBy("queue").agg(F.min(F.struct("available_at", "created_at", "job_id", "attempt", "timeout_ms", "deadline_at")).alias("j"))
    ends = F.least(later(now, F.col("j.timeout_ms")), F.col("j.deadline_at"))
    return first.select("queue", F.col("j.job_id").alias("job_id"), (F.col("j.attempt") + 1).alias("attempt"), F.lit("leased").alias("state"), ends.alias("execution_expires_at"), F.least(later(now, F.lit(lease_ms)), ends).alias("lease_expires_at"))


def _settled(jobs: DataFrame, state: Column, code: Column, now: Column) -> DataFrame:
    retry = F.coalesce(*(F.when(F.col("code") == c, F.lit(v)) for c, v in RETRYABLE.items()), F.lit(False))
    rows = jobs.withColumn("next_state", state).withColumn("code", code)
    return rows.select(
        "job_id", F.col("next_state").alias("state"), F.col("code").alias("last_error_code"), retry.alias("last_error_retryable"),
        F.when(F.col("next_state") == "retry_wait", later(now, retry_delay_ms(F.col("attempt")))).otherwise(F.col("available_at")).alias("available_at"),
        F.when(F.col("next_state") != "retry_wait", now).alias("completed_at"),
    )


def reap(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """What a reaper settles of one queue: jobs that wait past their deadline, in order of it, then leased ones past lease, timeout or deadline in order
    of the lease, together at most ``limit``: a limit is what this operator is for, so two top-n plans make it."""
    waiting = jobs.where(F.col("state").isin("available", "retry_wait") & (F.col("deadline_at") <= now)).orderBy("deadline_at", "job_id").limit(limit)
    first = _settled(waiting.withColumn("order", F.lit(0)), F.lit("dead_lettered"), F.lit("JOB_DEADLINE_EXCEEDED"), now).withColumn("turn", F.lit(0))
    used = waiting.agg(F.count("*").alias("used"))
    over = (F.col("lease_expires_at") <= now) | (F.col("execution_expires_at") <= now) | (F.col("deadline_at") <= now)
    leased = jobs.where((F.col("state") == "leased") & over).orderBy("lease_expires_at", "job_id").limit(limit)
    rank = Window.orderBy("lease_expires_at", "job_id")
    leased = leased.withColumn("n", F.row_number().over(rank)).join(F.broadcast(used), F.lit(True)).where(F.col("n") <= limit - F.col("used"))
    late, slow, cancelled = F.col("deadline_at") <= now, F.coalesce(F.col("execution_expires_at") <= now, F.lit(False)), F.col("cancel_requested_at").isNotNull()
    code = F.when(late, "JOB_DEADLINE_EXCEEDED").when(slow, "JOB_HANDLER_TIMEOUT").otherwise("JOB_LEASE_EXPIRED")
    retry = ~late & (F.col("attempt") < F.col("max_attempts")) & (later(now, retry_delay_ms(F.col("attempt"))) < F.col("deadline_at")) & ~cancelled
    state = F.when(retry, "retry_wait").when(cancelled, "cancelled").otherwise("dead_lettered")
    second = _settled(leased, state, F.when(cancelled & ~retry, "JOB_CANCELLED").otherwise(code), now).withColumn("turn", F.lit(1))
    return first.unionByName(second)


def fail(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs with an ``error_code`` and ``retryable`` after the failure: cancelled, waiting to retry, or dead-lettered."""
    cancelled = F.col("cancel_requested_at").isNotNull() | (F.col("error_code") == "JOB_CANCELLED")
    at = later(now, retry_delay_ms(F.col("attempt")))
    retry = F.col("retryable") & (F.col("attempt") < F.col("max_attempts")) & (at < F.col("deadline_at"))
    state = F.when(cancelled, "cancelled").when(retry, "retry_wait").otherwise("dead_lettered")
    code = F.when(cancelled, "JOB_CANCELLED").when(retry, F.col("error_code")).when(at >= F.col("deadline_at"), "JOB_DEADLINE_EXCEEDED").otherwise(F.col("error_code"))
    return _settled(jobs.where("state = 'leased'"), state, code, now)


def claimable_deliveries(rows: DataFrame, now: Column) -> DataFrame:
    """Deliveries that may go out: due or with a lapsed lease, and none of a smaller sequence under the same ordering key still unfinished.

    The blocking sequence is each key's minimum, found by partial aggregation, so a hot key needs no self-join of its rows.
    """
    due = (F.col("state").isin("pending", "retry") & (F.col("next_attempt_at") <= now)) | ((F.col("state") == "delivering") & (F.col("lease_until") <= now))
    busy = F.col("state").isin("pending", "retry") | ((F.col("state") == "delivering") & (F.col("lease_until") > now))
    head = rows.where(busy & F.col("ordering_key").isNotNull() & F.col("sequence").isNotNull()).groupBy("ordering_key").agg(F.min("sequence").alias("head"))
    return rows.where(due).join(head, "ordering_key", "left").where("head is null or sequence is null or sequence <= head").drop("head")


def claim_delivery(rows: DataFrame, now: Column, lease_ms: int | None = None) -> DataFrame:
    """The next delivery by sequence (null last), time and id. With ``lease_ms`` as it is after the claim: ``delivering``, one attempt more, leased until then."""
    one = claimable_deliveries(rows, now).orderBy(F.col("sequence").asc_nulls_last(), "created_at", "delivery_id").limit(1)
    return one if lease_ms is None else one.withColumns({"state": F.lit("delivering"), "attempt": F.col("attempt") + 1, "lease_until": later(now, F.lit(lease_ms))})


def claim_deliveries(rows: DataFrame, now: Column, lease_ms: int, workspace: str = "workspace_id") -> DataFrame:
    """The next delivery of each workspace, claimed: ``(workspace, delivery_id, attempt, state, lease_until)``. Its key is the minimum of a struct, found by partial aggregation."""
    first = F.min(F.struct(F.col("sequence").isNull().alias("last"), "sequence", "created_at", "delivery_id", "attempt"))
    keyed = rows.withColumn("ordering_key", F.when(F.col("ordering_key").isNotNull(), F.to_json(F.struct(workspace, "ordering_key"))))  # an order holds within a workspace
    return claimable_deliveries(keyed, now).groupBy(workspace).agg(first.alias("d")).select(workspace, "d.delivery_id", (F.col("d.attempt") + 1).alias("attempt"), F.lit("delivering").alias("state"), later(now, F.lit(lease_ms)).alias("lease_until"))


def insert_if_absent(new: DataFrame, old: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, the first by ``order`` of each key."""
    fields = [c for c in new.columns if c not in key and c not in order]
    first = new.groupBy(*key).agg(F.min(F.struct(*order, *fields)).alias("r")).select(*key, "r.*")
    return first.join(old.select(*key), key, "left_anti").select(new.columns)


def replay_check(new: DataFrame, old: DataFrame, key: str, digest: str) -> DataFrame:
    """``outcome`` of an idempotent request: accepted, a replay of the same content, or in conflict with other content."""
    known = old.select(key, F.col(digest).alias("known"), F.lit(True).alias("seen"))
    return new.join(known, key, "left").withColumn("outcome", F.when(F.col("seen").isNull(), "accepted").when(F.col(digest).eqNullSafe(F.col("known")), "replay").otherwise("conflict")).drop("known", "seen")


def compare_and_set(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """``requests(key, expected_version, from_state, to_state)`` on ``rows(key, state, version)``: the new state and version, and ``outcome``."""
    met = requests.join(rows, key, "left")
    ok = (F.col("state") == F.col("from_state")) & (F.col("version") == F.col("expected_version"))
    outcome = F.when(F.col("state").isNull(), "not_found").when(ok, "applied").otherwise("conflict")
    return met.select(key, F.when(ok, F.col("to_state")).otherwise(F.col("state")).alias("state"), (F.col("version") + F.when(ok, 1).otherwise(0)).alias("version"), outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """``old`` with the rows of ``new`` that are newer or not there yet: a full outer join, as files have no merge."""
    a, b = old.alias("a"), new.alias("b")
    use = F.col(f"a.{key}").isNull() | (F.col(f"b.{version}") > F.col(f"a.{version}"))
    cols = [F.when(F.col(f"b.{key}").isNotNull() & use, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *cols)


def lease_valid(token: Column, now: Column) -> Column:
    """Whether a worker with ``token`` still holds the job: leased to it, and neither lease, execution nor deadline is over."""
    after = lambda c: F.col(c) > now
    return F.coalesce((F.col("state") == "leased") & (F.col("lease_token") == token) & after("lease_expires_at") & after("execution_expires_at") & after("deadline_at"), F.lit(False))


def enqueue(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """``outcome`` of new jobs ``(job_id, idempotency_key, payload_ref, max_attempts, timeout_ms, deadline_at)``: INVALID envelope, created, replay of the
    same payload, or CONFLICT. Of a batch's jobs with one key the smallest ``job_id`` is first."""
    valid = F.col("payload_ref").rlike("^object://sha256/[0-9a-f]{64}$") & F.col("max_attempts").between(1, 20) & F.col("timeout_ms").between(1_000, 86_400_000) & (F.col("deadline_at") > now) & F.col("idempotency_key").isNotNull()
    rows = new.withColumn("valid", F.coalesce(valid, F.lit(False)))
    first = rows.where("valid").groupBy("idempotency_key").agg(F.min(F.struct("job_id", "payload_ref")).alias("first"))
    known = old.select("idempotency_key", F.col("payload_ref").alias("known"))
    met = rows.join(first, "idempotency_key", "left").join(known, "idempotency_key", "left")
    same = F.col("payload_ref") == F.coalesce("known", "first.payload_ref")
    outcome = F.when(~F.col("valid"), "INVALID").when(~same, "CONFLICT").when(F.col("known").isNull() & (F.col("job_id") == F.col("first.job_id")), "created").otherwise("replay")
    return met.select("job_id", "idempotency_key", outcome.alias("outcome"), F.when(outcome == "created", "available").alias("state"))


def heartbeat(jobs: DataFrame, asked: DataFrame, now: Column, lease_ms: int) -> DataFrame:
    """``asked(job_id, token)`` after a heartbeat: the lease goes on for ``lease_ms``, at most to the end of the execution; LOST where it is not held."""
    met = asked.join(jobs, "job_id", "left")
    held = lease_valid(F.col("token"), now)
    outcome = F.when(F.col("state").isNull(), "NOT_FOUND").when(held, "extended").otherwise("LOST_LEASE")
    return met.select("job_id", outcome.alias("outcome"), F.when(held, F.least(later(now, F.lit(lease_ms)), F.col("execution_expires_at"))).alias("lease_expires_at"), F.when(held, F.col("cancel_requested_at").isNotNull()).alias("cancel_requested"))


def complete(jobs: DataFrame, results: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """``asked(job_id, token, result_digest)`` after completion, ``results(effect_key, result_digest)`` being the ledger: an effect has one result.

    A job that ended with the same result is a replay; with another it is a CONFLICT, as is an effect that has another result. Of a batch's
    valid requests for one effect the smallest ``job_id`` commits, and those with its result agree with it.
    """
    met = asked.join(jobs.select("job_id", "state", "effect_key", "lease_token", "lease_expires_at", "execution_expires_at", "deadline_at", F.col("result_digest").alias("own_digest")), "job_id", "left")
    met = met.withColumn("held", lease_valid(F.col("token"), now))
    first = met.where("held").groupBy("effect_key").agg(F.min(F.struct("job_id", "result_digest")).alias("first"))
    met = met.join(first, "effect_key", "left").join(results.select("effect_key", F.col("result_digest").alias("known")), "effect_key", "left")
    same = F.col("result_digest") == F.coalesce("known", "first.result_digest")
    outcome = (
        F.when(F.col("state").isNull(), "NOT_FOUND")
        .when(F.col("state") == "succeeded", F.when(F.col("own_digest").eqNullSafe(F.col("result_digest")), "replay").otherwise("CONFLICT"))
        .when(~F.col("held"), "LOST_LEASE").when(~same, "CONFLICT").otherwise("succeeded")
    )
    return met.select("job_id", outcome.alias("outcome"), F.when(outcome.isin("succeeded", "replay"), "succeeded").otherwise(F.col("state")).alias("state"))


def cancel(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """``asked(job_id)`` after the request: waiting jobs are cancelled, leased ones asked to stop, ended ones stay."""
    met = asked.join(jobs, "job_id", "left")
    waits, runs = F.col("state").isin("available", "retry_wait"), F.col("state") == "leased"
    outcome = F.when(F.col("state").isNull(), "NOT_FOUND").when(waits, "cancelled").when(runs, "requested").otherwise("terminal")
    return met.select("job_id", outcome.alias("outcome"), F.when(waits, "cancelled").otherwise(F.col("state")).alias("state"), F.when(waits | runs, now).otherwise(F.col("cancel_requested_at")).alias("cancel_requested_at"), F.when(waits, now).alias("completed_at"))


def insert_unless_any(new: DataFrame, old: DataFrame, group: str, order: str) -> DataFrame:
    """The first row by ``order`` of each group that has no row in ``old`` at all: an insert guarded by NOT EXISTS."""
    fields = [c for c in new.columns if c not in (group, order)]
    first = new.groupBy(group).agg(F.min(F.struct(order, *fields)).alias("r")).select(group, "r.*")
    return first.join(old.select(group).distinct(), group, "left_anti").select(new.columns)


def update_from(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` replaced by those of the row of ``source`` with the same key, where there is one and it is not null."""
    other = source.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    met = rows.join(other, key, "left")
    return met.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key with ``found``: one, none or several; several or none give a row of nulls, so that a broken uniqueness is seen."""
    met = rows.where(F.col(key) == F.lit(value))
    first = met.agg(F.count("*").alias("n"), F.min(F.struct(*rows.columns)).alias("r"))
    return first.select(F.when(F.col("n") == 1, "one").when(F.col("n") == 0, "none").otherwise("several").alias("found"), *(F.when(F.col("n") == 1, F.col(f"r.{c}")).alias(c) for c in rows.columns))
