"""Evidence over time: validity, corrections, freshness, contradictions; quorums of claims; source checks; revenue claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ISO = "^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d{1,3})?Z$"


def published(text: Column) -> Column:
    """Timestamp of an ISO text in UTC with Z; null for any other."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def maximum_age(claim_type: Column, source_type: Column, default_ms: int, by_claim: dict[str, int], by_source: dict[str, int]) -> Column:
    """The first limit that is defined: of the claim type, the source type, the default; not the least of them."""
    pick = lambda key, limits: F.coalesce(*(F.when(key == k, F.lit(v)) for k, v in limits.items()), F.lit(None).cast("long"))
    return F.coalesce(pick(claim_type, by_claim), pick(source_type, by_source), F.lit(default_ms)).cast("long")


def timeline(evidence: DataFrame, as_of: str, default_ms: int, by_claim: dict[str, int] | None = None, by_source: dict[str, int] | None = None) -> DataFrame:
    """``evidence(id, source_type, claim_type, published_at timestamp, corrects)`` with ``state`` and ``reason``.

    invalid (no time, or a negative limit), future (after ``as_of``), superseded (a correction that is published and not itself
    invalid or future names it, however old), stale (older than its limit), current; one level of correction only.
    """
    now = F.lit(as_of).cast("timestamp")
    if default_ms < 0:
        return evidence.select("*", F.lit("invalid").alias("state"), F.lit("TEMPORAL_POLICY_INVALID").alias("reason"))
    limit = maximum_age(F.col("claim_type"), F.col("source_type"), default_ms, by_claim or {}, by_source or {})
    rows = evidence.withColumn("limit_ms", limit).withColumn("basis", F.when(F.col("published_at").isNull() | (F.col("limit_ms") < 0), "invalid").when(F.col("published_at") > now, "future").otherwise("current"))
    corrected = rows.where("basis = 'current' and corrects is not null").select(F.col("corrects").alias("id")).distinct().withColumn("corrected", F.lit(True))
    age = F.unix_millis(now) - F.unix_millis("published_at")
    state = F.when(F.col("basis") != "current", F.col("basis")).when(F.col("corrected"), "superseded").when(age > F.col("limit_ms"), "stale").otherwise("current")
    reason = (
        F.when(F.col("state") == "invalid", "PUBLISHED_AT_INVALID").when(F.col("state") == "future", "PUBLISHED_AFTER_AS_OF").when(F.col("state") == "superseded", "CORRECTED_BY_NEWER_EVIDENCE").when(F.col("state") == "stale", "FRESHNESS_WINDOW_EXCEEDED")
    )
    return rows.join(corrected, "id", "left").withColumn("state", state).withColumn("reason", F.coalesce(reason, F.lit(""))).drop("limit_ms", "basis", "corrected")


def contradictions(current: DataFrame) -> DataFrame:
    """Pairs ``(first_id, second_id)`` of ``current(id, pos, entity, claim_type, period, currency, value)`` that agree on all keys, null being equal to
    null, and differ in value; the one that stands first comes first. Keys hold few rows each, so the pairs are the result itself."""
    rows = current.where("value is not null")
    a, b = rows.alias("a"), rows.alias("b")
    same = F.lit(True)
    for k in ("entity", "claim_type", "period", "currency"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    pairs = a.join(b, same & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.value") != F.col("b.value")))
    return pairs.select(F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"))


def quorum(claims: DataFrame, evidence: DataFrame, minimum: int, require_primary: bool) -> DataFrame:
    """``claims(claim_id, entity, value, currency, ambiguous, type_matches)`` with counts of supporting and contradicting ``evidence(id, entity,
    value, currency, primary)`` and ``state``. Support needs the value and the currency (USD where absent); any other value contradicts, whatever its
    currency, and an equal value in another currency is neither. Evidence is added up by entity, value and currency before it meets the claims, so no claim is paired with each piece; a claim that is repeated keeps its rows."""
    by = evidence.where("value is not null").groupBy("entity", F.col("value").alias("value"), F.coalesce("currency", F.lit("USD")).alias("money")).agg(F.count("*").alias("supporting"), F.bool_or("primary").alias("has_primary"))
    equal = by.groupBy("entity", "value").agg(F.sum("supporting").alias("equal"))
    all_ = by.groupBy("entity").agg(F.sum("supporting").alias("all"))
    asked = claims.withColumn("money", F.coalesce("currency", F.lit("USD"))).join(by, ["entity", "value", "money"], "left").join(equal, ["entity", "value"], "left").join(all_, "entity", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = asked.select("claim_id", "value", "ambiguous", "type_matches", n("supporting").alias("supporting"), (n("all") - n("equal")).alias("contradicting"), F.coalesce("has_primary", F.lit(False)).alias("has_primary"))
    open_ = F.col("value").isNull() | ~F.col("type_matches")
    state = (
        F.when(F.col("ambiguous"), "ambiguous").when(open_, "pending").when(F.col("contradicting") > 0, "contradicted").when((F.col("supporting") >= minimum) & (F.lit(not require_primary) | F.col("has_primary")), "verified").otherwise("unsupported")
    )
    silent = F.col("ambiguous") | open_
    blank = lambda c: F.when(silent, F.lit(0)).otherwise(F.col(c)).alias(c)
    return counted.select("claim_id", blank("supporting"), blank("contradicting"), state.alias("state"))


def verify_sources(observations: DataFrame, records: DataFrame) -> DataFrame:
    """``observations(source_id, final_url, redirect_urls, tls_verified, publisher_metadata)`` against ``records(source_id, publisher, domains, aliases,
    review_state)``: disposition and sorted reasons."""
    o = observations.join(records, "source_id", "left").withColumn("known", F.col("review_state").isNotNull())
    outside = lambda u: ~F.array_contains("domains", T.host(u))
    meta = F.col("publisher_metadata")
    reasons = F.array_compact(
        F.array(
            F.when(outside(F.col("final_url")), "FINAL_DOMAIN_MISMATCH"),
            F.when((F.coalesce(meta, F.lit("")) != "") & (meta != F.col("publisher")) & ~F.array_contains("aliases", meta), "PUBLISHER_METADATA_MISMATCH"),
            F.when(F.exists("redirect_urls", outside), "REDIRECT_DOMAIN_MISMATCH"),
            F.when(F.col("review_state") != "approved", "SOURCE_REVOKED"),
            F.when(~F.col("tls_verified"), "TLS_UNVERIFIED"),
        )
    )
    reasons = F.when(F.col("known"), reasons).otherwise(F.array(F.lit("SOURCE_NOT_REGISTERED")))
    state = F.when(~F.col("known"), "unknown").when(F.size(reasons) > 0, "mismatch").otherwise("verified")
    return o.select(*observations.columns, state.alias("disposition"), F.array_join(reasons, ",").alias("reasons"))


REVENUE = "(?i)revenue\\s+(?:was|of)\\s+\\$?(\\d+(?:\\.\\d+)?)\\s*(million|billion)?"


def revenue_claims(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first revenue statement of each text: value, zero-based start and end, text. The multiplier's word counts in lower case only, as the
    statement's pattern ignores case but its words are compared as written; ``multiplier_ignored`` marks the others."""
    t = F.col(text_col)
    whole, number, unit = (F.regexp_extract(t, REVENUE, k) for k in (0, 1, 2))
    rows = docs.where(t.rlike(REVENUE)).select(id_col, whole.alias("claim"), number.cast("double").alias("number"), unit.alias("unit"), (F.regexp_instr(t, F.lit(REVENUE)) - 1).alias("start"))
    times = F.when(F.col("unit") == "billion", 1e9).when(F.col("unit") == "million", 1e6).otherwise(1.0)
    return rows.select(id_col, (F.col("number") * times).alias("value"), "start", (F.col("start") + F.char_length("claim")).alias("end"), "claim", ((F.col("unit") != "") & ~F.col("unit").isin("million", "billion")).alias("multiplier_ignored"))
