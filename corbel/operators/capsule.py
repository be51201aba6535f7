"""What leaves the boundary: capsules without raw content, explanations of verdicts, deliveries to agents, and records without forbidden fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import jsonc
from ..functions import text as T
from . import contracts

# Fields with raw content, keys that a payload may not hold, how reasons become categories, places of findings: fixed values.
RAW_FIELDS = ("content", "raw_content", "rawContent", "parsed_text", "excerpt")
RAW_KEYS = frozenset(("content", "raw_content", "parsed_text", "excerpt", "text"))
FORBIDDEN_KEYS = frozenset(("authorization", "content", "cookie", "password", "private_key", "raw_content", "rawcontent", "secret", "source_bytes", "token"))
CATEGORY = {"DIRECT_INSTRUCTION_OVERRIDE": "direct_prompt_injection", "INDIRECT_INSTRUCTION_OVERRIDE": "indirect_prompt_injection", "SOURCE_IMPERSONATION": "source_mismatch"}
PLACES = ("raw", "canonical", "decoded", "metadata", "ocr")


def safe_record(df: DataFrame) -> DataFrame:
    """Without columns of raw content; names are compared as they are, so ``Content`` stays."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in RAW_FIELDS))


def _walk(value, depth: int):
    """A JSON value without raw keys, no deeper than 12 and no wider than 1,000."""
    if depth > 12:
        return "[depth-limited]"
    if isinstance(value, list):
        return [_walk(x, depth + 1) for x in value[:1000]]
    if isinstance(value, dict):
        return {k: _walk(x, depth + 1) for k, x in [kv for kv in value.items() if kv[0].lower() not in RAW_KEYS][:1000]}
    return value


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def sanitized(texts: pd.Series) -> pd.Series:
    """JSON without raw keys at any depth; null for what is no JSON."""
    return texts.map(lambda t: None if (v := _parsed(t)) is None else json.dumps(_walk(v, 0), ensure_ascii=False, separators=(",", ":")))


def _forbidden(value, depth: int = 0) -> str | None:
    if depth > 32:
        return "depth"
    for k, x in value.items() if isinstance(value, dict) else (("", x) for x in value) if isinstance(value, list) else ():
        if k.lower() in FORBIDDEN_KEYS:
            return k
        if (found := _forbidden(x, depth + 1)) is not None:
            return found
    return None


@F.pandas_udf(StringType())
def forbidden_key(texts: pd.Series) -> pd.Series:
    """The first forbidden key of a JSON in document order, ``depth`` beyond 32 levels, ``json`` for what is none; null if it may go out."""

    def one(t: str | None) -> str | None:
        v = _parsed(t)
        return "json" if v is None and (t is None or t.strip() != "null") else _forbidden(v)

    return texts.map(one)


def category(kind: Column, reason: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CATEGORY.items() for x in kv))
    return F.coalesce(F.try_element_at(table, reason), F.when(kind == "processing", "policy_failure").otherwise("other"))


def compose(scans: DataFrame, findings: DataFrame, policy_id: str, component: str) -> DataFrame:
    """``(scan_id, capsule, digest)`` of ended scans: canonical JSON (sorted keys, absent fields left out) of the scan and its findings in order, and its SHA-256.

    ``scans(scan_id, workspace_id, input_digest, created_at, state)``; ``findings`` as ``intake.process`` gives them, which hold no raw content. A
    scan's findings meet in one row: they are as many as its text has matches.
    """
    known = F.coalesce(F.col("representation").isin(*PLACES), F.lit(False))
    place = F.struct(F.when(known, F.col("representation")).otherwise("metadata").alias("representation"), F.when(known, F.col("text_end")).alias("text_end"), F.when(known, F.col("text_start")).alias("text_start"))
    one = F.struct(category(F.col("category"), F.col("reason_code")).alias("category"), "confidence_bps", "detector_id", place.alias("location"), "reason_code", "severity")
    listed = findings.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("text_start", F.lit(-1)).alias("at"), F.col("detector_id").alias("by"), one.alias("f")))).alias("found"))
    rows = scans.where(F.col("state").isin("allowed", "blocked", "review")).join(listed, "scan_id", "left")
    body = F.struct(
        F.col("created_at").alias("as_of"), F.array().cast("array<string>").alias("claims"), F.array(F.lit(component)).alias("components"), F.array().cast("array<string>").alias("conflicts"), F.col("created_at").alias("created_at"),
        F.when(F.col("state") == "allowed", "allow").when(F.col("state") == "blocked", "block").otherwise("review").alias("disposition"), F.array().cast("array<string>").alias("evidence"),
        F.coalesce(F.transform("found", lambda x: x["f"]), F.array().cast(_found_type(findings))).alias("findings"), "input_digest", F.lit(policy_id).alias("policy"), "scan_id", F.lit("1.0").alias("schema_version"), "workspace_id",
    )
    return rows.select("scan_id", F.to_json(body).alias("capsule")).withColumn("digest", T.digest(F.col("capsule").cast("binary")))


def compose_contract(scans: DataFrame, findings: DataFrame, policy: dict[str, str], component: dict[str, str]) -> DataFrame:
    """``(scan_id, capsule, digest, violations)``: unsigned capsules of ended scans with all that their contract asks for, as canonical JSON, and what of the contract they break.

    As ``compose``, with ids of capsules and findings made from the scan's (and the finding's place in the order of starts and detectors), ``policy(policy_id, version, digest)`` and ``component(component, version, digest)``, an unknown
    subject and empty extensions. Names of keys are fixed, and stand alike in either order of canonical JSON.
    """
    known = F.coalesce(F.col("representation").isin(*PLACES), F.lit(False))
    place = F.struct(F.when(known, F.col("representation")).otherwise("metadata").alias("representation"), F.when(known, F.col("text_end")).alias("text_end"), F.when(known, F.col("text_start")).alias("text_start"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    one = F.struct(category(F.col("category"), F.col("reason_code")).alias("category"), "confidence_bps", "detector_id", place.alias("location"), "reason_code", "severity")
    listed = findings.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("text_start", F.lit(-1)).alias("at"), F.col("detector_id").alias("by"), one.alias("f")))).alias("found"))
    rows = scans.where(F.col("state").isin("allowed", "blocked", "review")).join(listed, "scan_id", "left")
    made = lambda prefix, text: F.concat(F.lit(f"{prefix}_"), F.upper(F.left(F.sha2(text.cast("binary"), 256), F.lit(26))))
    named = F.transform(F.coalesce("found", F.array().cast(rows.schema["found"].dataType)), lambda x, k: F.struct(*(x["f"][c].alias(c) for c in ("category", "confidence_bps", "detector_id", "location", "reason_code", "severity")), made("finding", F.concat(F.col("scan_id"), F.lit(":"), k.cast("string"))).alias("finding_id"), none.alias("extensions")))
    empty, fixed = F.array().cast("array<string>"), lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    body = F.struct(
        F.lit("1.0").alias("schema_version"), made("capsule", F.col("scan_id")).alias("capsule_id"), "workspace_id", "scan_id", "input_digest", "created_at", F.col("created_at").alias("as_of"), F.struct(F.lit("unknown").alias("kind"), empty.alias("symbols")).alias("subject"),
        empty.alias("claims"), named.alias("findings"), empty.alias("evidence"), empty.alias("conflicts"), F.when(F.col("state") == "allowed", "allow").when(F.col("state") == "blocked", "block").otherwise("review").alias("disposition"),
        fixed(policy).alias("policy"), F.array(fixed(component)).alias("components"), none.alias("extensions"),
    )
    written = rows.select("scan_id", F.to_json(body).alias("written"))  # a column, as the canonical text refers to it several times
    capsules = written.select("scan_id", jsonc.canonical(F.col("written")).alias("capsule"))
    return capsules.withColumn("digest", jsonc.digest(F.col("capsule"))).withColumn("violations", contracts.contract("unsignedCapsule").violations(F.col("capsule")))


def _found_type(findings: DataFrame) -> str:
    kind = lambda c: findings.schema[c].dataType.simpleString()
    return f"array<struct<category:string,confidence_bps:{kind('confidence_bps')},detector_id:string,location:struct<representation:string,text_end:{kind('text_end')},text_start:{kind('text_start')}>,reason_code:string,severity:string>>"


def key_of(capsules: DataFrame, keys: DataFrame) -> DataFrame:
    """Capsules with the signing key of their id and algorithm: ``key_state`` is found, unknown, or revoked; several such keys make it ambiguous."""
    by = keys.groupBy("key_id", "algorithm").agg(F.count("*").alias("n"), F.min("status").alias("status"))
    met = capsules.join(by, ["key_id", "algorithm"], "left")
    return met.withColumn("key_state", F.when(F.col("n").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(F.col("status") != "active", "revoked").otherwise("found")).drop("n", "status")


def preview(text: Column, most: int = 280) -> Column:
    """The first characters without angle brackets."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]", ""), 1, most)


def explanation(disposition: Column, reasons: Column, excerpt: Column) -> Column:
    """``struct(primary_reason, next_action, preview)`` of a verdict."""
    primary = F.coalesce(F.try_element_at(reasons, F.lit(1)), F.when(disposition == "allow", "POLICY_PASSED").otherwise("POLICY_EVALUATION_FAILED"))
    step = F.when(disposition == "allow", "release").when(disposition == "review", "request_review").otherwise("blocked")
    return F.struct(primary.alias("primary_reason"), step.alias("next_action"), preview(excerpt).alias("preview"))


def agent_delivery(disposition: Column, text: Column) -> Column:
    """``struct(state, passes, context)``: what reaches a protected agent (only what is allowed), where an unprotected one gets every text."""
    state = F.when(disposition.isNull(), "pending").when(disposition == "allow", "delivered").when(disposition == "review", "review").otherwise("withheld")
    passes = F.coalesce(disposition == "allow", F.lit(False))
    return F.struct(state.alias("state"), passes.alias("passes"), F.when(passes, text).otherwise("[withheld]").alias("context"))


def visual_disagreement(canonical: Column, visual: Column, hidden_css: Column, metadata: Column) -> Column:
    """Findings besides a text's own: one for each region hidden by style and each metadata value that isn't blank, and one if what is seen differs."""
    spans = F.transform(hidden_css, lambda _: F.lit("css_hidden"))
    payload = F.transform(F.filter(F.map_values(metadata), lambda x: F.trim(x) != ""), lambda _: F.lit("metadata_payload"))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(spans, none), F.coalesce(payload, none), F.when(visual.isNotNull() & (visual != canonical), F.array(F.lit("visual_text_disagreement"))).otherwise(none))
