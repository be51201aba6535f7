"""Deliveries after their attempts, their replay, the endpoints they may go to, and what a payload may not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .workqueue import later

MOST_BACKOFF_S = 3_600


def endpoint_allowed(url: Column, hosts: tuple[str, ...] | None = None) -> Column:
    """Whether a webhook may go to a URL: https, no user info, no fragment, not this machine, not the private addresses of a narrower list than
    that for fetching, and, with ``hosts``, one of these."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = T.host(url)
    four, six = _quad(name), F.regexp_extract(name, "^\\[(.*)\\]$", 1)
    private = F.coalesce(four, F.lit(False)) | (six == "::1") | six.rlike("^(?:fc|fd|fe80:)")
    good = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).eqNullSafe("https") & ~authority.contains("@") & ~url.contains("#") & (name != "") & (name != "localhost") & ~name.endswith(".localhost") & ~private
    return F.coalesce(good & (F.lit(True) if hosts is None else name.isin(*hosts)), F.lit(False))


def _quad(name: Column) -> Column:
    part = lambda k: F.regexp_extract(name, "^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})$", k).try_cast("int")
    a, b = part(1), part(2)
    return a.isin(10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))  # fixed values


def enqueue(new: DataFrame, old: DataFrame) -> DataFrame:
    """``status`` of new deliveries ``(delivery_id, idempotency_key, ...)``: queued, or duplicate of a key that is there or came earlier (smaller ``delivery_id``)."""
    first = new.groupBy("idempotency_key").agg(F.min("delivery_id").alias("first"))
    seen = old.select("idempotency_key").distinct().withColumn("seen", F.lit(True))
    rows = new.join(first, "idempotency_key", "left").join(seen, "idempotency_key", "left")
    return rows.withColumn("status", F.when(F.col("seen").isNull() & (F.col("delivery_id") == F.col("first")), "queued").otherwise("duplicate")).drop("first", "seen")


def settle(rows: DataFrame, now: Column, jitter: Column) -> DataFrame:
    """Deliveries under way after an answer: ``(delivery_id, state, next_attempt_at, last_status, error_code)``.

    ``rows(delivery_id, state, attempt, max_attempts, next_attempt_at, status, retry_after_s)``; a null ``status`` is a failed transport. 2xx is delivered; 408, 425,
    429 and 5xx are tried again after the answer's own delay or a doubling one times ``jitter`` (0.8 to 1.2), at most an hour, until the attempts are used up;
    all else is a dead letter. Rows in other states stay out: nobody holds their lease.
    """
    code, held = F.col("status"), rows.where("state = 'delivering'")
    good = F.coalesce(code.between(200, 299), F.lit(False))
    again = (code.isNull() | code.isin(408, 425, 429) | (code >= 500)) & (F.col("attempt") < F.col("max_attempts"))
    wait = F.least(F.lit(MOST_BACKOFF_S), F.coalesce(F.col("retry_after_s"), F.ceil(F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempt") - 1)) * jitter))).cast("long")
    state = F.when(good, "delivered").when(again, "retry").otherwise("dead_letter")
    error = F.when(~good, F.when(code.isNull(), "TRANSPORT_FAILED").otherwise(F.concat(F.lit("HTTP_"), code.cast("string"))))
    return held.select("delivery_id", state.alias("state"), F.when(state == "retry", later(now, wait * 1000)).otherwise(F.col("next_attempt_at")).alias("next_attempt_at"), code.alias("last_status"), error.alias("error_code"))


def replay(rows: DataFrame, asked: DataFrame, endpoint: object) -> DataFrame:
    """New deliveries for ``asked(delivery_id, reason)``: only ended ones of the endpoint, with a reason of 8 to 256 characters, keep event and order; others say why not."""
    met = asked.join(rows, "delivery_id", "left")
    reason = F.trim("reason")
    why = F.when(~F.coalesce((F.char_length(reason) >= 8) & (F.char_length("reason") <= 256), F.lit(False)), "REASON_INVALID").when(~F.coalesce((F.col("endpoint_id") == F.lit(endpoint)) & F.col("state").isin("dead_letter", "delivered"), F.lit(False)), "NOT_REPLAYABLE").otherwise("queued")
    new = F.concat(F.lit("replay-"), F.col("delivery_id").cast("string"))
    ok = why == "queued"
    return met.select("delivery_id", why.alias("status"), F.when(ok, new).alias("new_id"), F.when(ok, F.col("event_id")).alias("event_id"), F.when(ok, F.col("ordering_key")).alias("ordering_key"), F.when(ok, F.concat_ws(":", F.col("delivery_id").cast("string"), F.lit("replay"), new)).alias("idempotency_key"))


def traceparent(value: Column) -> Column:
    """``struct(trace_id, parent_id, flags)`` of a trace header, null unless it is one of version 00 with ids that are not all zeros."""
    part = lambda k: F.regexp_extract(F.trim(value), "^00-([0-9a-f]{32})-([0-9a-f]{16})-(00|01)$", k)
    good = (part(1) != "") & ~part(1).rlike("^0+$") & ~part(2).rlike("^0+$")
    return F.when(good, F.struct(part(1).alias("trace_id"), part(2).alias("parent_id"), part(3).alias("flags")))
