"""From requests to decided scans: contract checks, acceptance once a key, the scan's states, and its processing by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonc
from ..session import dealt
from . import contracts, detect
from .detect import Rule
from .schema import Schema

# Allowed moves of a scan, limits of a request, and what a classifier may say: fixed values.
MOVES = {
    "accepted": ("queued", "cancelled"),
    "queued": ("processing", "cancelled"),
    "processing": ("review", "allowed", "blocked", "failed", "cancelled"),
    "review": ("allowed", "blocked", "cancelled"),
    "allowed": (),
    "blocked": (),
    "failed": (),
    "cancelled": (),
}
MOST_REQUEST_BYTES, MOST_TEXT_BYTES, MOST_UPLOAD_BYTES = 1_100_000, 1_000_000, 100_000_000
CLASSIFIER_KEYS = ("disposition", "confidence", "categories")


def may_move(state: Column, target: Column) -> Column:
    """Whether a scan in ``state`` may go to ``target``; an unknown or null state goes nowhere."""
    table = F.create_map(*(x for a, bs in MOVES.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    return F.coalesce(F.array_contains(F.try_element_at(table, state), target), F.lit(False))


def schema_violations(value: Column, schema: dict) -> Column:
    """What of a JSON text breaks a JSON schema; see ``schema.Schema``."""
    return Schema(schema).violations(value)


def accept(requests: DataFrame, scans: DataFrame, workspace: object) -> DataFrame:
    """Requests after acceptance: ``outcome`` and, for the accepted ones, the scan that answers them.

    ``requests(position, body)`` are JSON bodies, ``scans(idempotency_key, request_digest, scan_id)`` what the workspace has. Outcomes: TOO_LARGE (body, text or
    upload), INVALID (the contract is broken), DENIED (another workspace), created, replay (the key's request has the same digest), CONFLICT. Digests are those
    of canonical JSON, so the order of keys and the form of numbers make no other request; an input's digest is its own where it names one (uploads, feed events). Of a batch's requests with one key the smallest
    ``position`` is first. Keys are settled by partial aggregation, so a key that repeats often costs no more.
    """
    v = F.col("v")
    text = lambda p: F.try_variant_get(v, p, "string")
    parsed = requests.select("position", "body", F.try_parse_json("body").alias("v"))
    rows = parsed.select("position", "v", jsonc.canonical(F.col("body"), parsed=v).alias("canonical"), text("$.input.kind").alias("kind"), contracts.contract("ingestionRequest").holds(v).alias("holds"))
    canonical, kind = F.col("canonical"), F.col("kind")
    over = lambda c, most: F.coalesce(c > most, F.lit(False))
    early = (
        F.when(over(F.octet_length(canonical), MOST_REQUEST_BYTES), "TOO_LARGE").when(~F.coalesce("holds", F.lit(False)), "INVALID").when(~text("$.workspace_id").eqNullSafe(F.lit(workspace)), "DENIED")
        .when((kind == "text") & over(F.octet_length(text("$.input.text")), MOST_TEXT_BYTES) | (kind == "upload") & over(F.try_variant_get(v, "$.input.size_bytes", "double"), MOST_UPLOAD_BYTES), "TOO_LARGE")
    )
    # digests are bytes until the end; those that are given have the contract's form, or the row is refused
    given = F.unhex(F.substring(F.coalesce(text("$.input.digest"), text("$.input.payload_digest")), 8, 64))
    own = F.when(kind.isin("upload", "feed_event"), given).otherwise(F.unhex(F.sha2(jsonc.canonical_variant(F.try_variant_get(v, "$.input", "variant")).cast("binary"), 256)))
    rows = rows.select("position", "v", "canonical", "kind", early.alias("early"))
    good = F.col("early").isNull()
    # the key counts only where the contract holds: rows that are refused early settle nothing, and have keys of no request
    key = F.when(good, text("$.idempotency_key")).otherwise(F.concat_ws("", F.lit("\u0000"), F.col("position") % 1000))
    rows = rows.select("position", "early", F.coalesce(key, F.lit("\u0000")).alias("key"), F.when(good, F.unhex(F.sha2(canonical.cast("binary"), 256))).alias("request"), F.when(good, own).alias("input"))
    # dealt here, with all its columns on both ways, so that what was worked out is read twice and not made twice
    rows = dealt(rows, "position")
    first = rows.groupBy("key").agg(F.min(F.struct("position", "request", "input", "early")).alias("first"))
    known = scans.select(F.col("idempotency_key").alias("key"), F.col("request_digest").alias("known_digest"), F.col("scan_id").alias("known_scan"))
    rows = rows.join(first, "key", "left").join(known, "key", "left")
    named = lambda c: F.concat(F.lit("sha256:"), F.lower(F.hex(c)))
    changed = F.when(F.col("known_digest").isNotNull(), named(F.col("request")) != F.col("known_digest")).otherwise(F.col("request") != F.col("first.request"))
    outcome = F.coalesce("early", F.when(changed, "CONFLICT").when(F.col("known_scan").isNull() & (F.col("position") == F.col("first.position")), "created").otherwise("replay"))
    scan = F.coalesce("known_scan", F.concat(F.lit("scan_"), F.left(F.sha2(F.concat_ws("\u0000", F.lit(workspace).cast("string"), "key").cast("binary"), 256), F.lit(26))))
    out = rows.withColumn("outcome", outcome).withColumn("scan_id", F.when(F.col("outcome").isin("created", "replay"), scan))
    made = F.col("outcome") == "created"
    return out.select("position", F.when(good, F.col("key")).alias("idempotency_key"), "outcome", "scan_id", F.when(good, named(F.col("request"))).alias("request_digest"), F.when(good, named(F.col("input"))).alias("input_digest"), F.when(made, "queued").alias("state"), F.when(made, F.concat(F.lit("object://sha256/"), F.lower(F.hex("input")))).alias("payload_ref"))


def text_at(value: Column, path: str) -> Column:
    """The string at a path of a variant; null for whatever is no string there, numbers and objects too."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def envelope_text(envelope: Column) -> Column:
    """The text that an envelope brings, if it is a string."""
    return text_at(F.try_parse_json(envelope), "$.input.text")


def process(scans: DataFrame, rules: tuple[Rule, ...], tenant: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(decided, findings)`` of ``scans(scan_id, state, envelope)``, the envelope being JSON with ``input.text``, ``input.kind`` and ``input.source_id``.

    Scans already ended keep their state; others than queued ones are ``CONFLICT``. Without a text in reach (absent, or anything but a string) a scan goes to review with
    one finding; else its state follows the most restrictive rule that matches. The decision is made inside the row, without a join.
    """
    v = F.col("v")
    source = F.when(text_at(v, "$.input.kind") == "feed_event", text_at(v, "$.input.source_id"))
    once = lambda *cells: F.inline(F.array(F.struct(*cells)))  # noqa: E731  # filters on these stay above, where a plain column would be worked out in the filter and again
    rows = scans.select("scan_id", "state", F.try_parse_json("envelope").alias("v")).select("scan_id", "state", once(text_at(v, "$.input.text").alias("text"), source.alias("source"))).withColumn("tenant", F.lit(tenant).cast("string"))
    worst = F.array_max(F.transform(detect.matching(rules, F.col("text"), F.col("tenant"), F.col("source")), lambda r: detect.rank(r["disposition"])))
    ended = F.col("state").isin(*(s for s, to in MOVES.items() if not to), "review")
    after = F.when(F.col("text").isNull(), "review").otherwise(F.element_at(F.array(*map(F.lit, ("allowed", "review", "blocked"))), (F.coalesce(worst, F.lit(0)) + 1).cast("int")))
    decided = rows.select("scan_id", once(F.when(ended, F.col("state")).when(F.col("state") == "queued", after).otherwise(F.col("state")).alias("after")), "state").select("scan_id", F.col("after").alias("state"), F.when(ended, "kept").when(F.col("state") == "queued", "processed").otherwise("CONFLICT").alias("outcome"))
    queued = rows.where("state = 'queued'")
    found = detect.findings(queued.where("text is not null"), rules, "scan_id", "text", "tenant", "source")
    named = found.select("scan_id", F.lit("prompt_injection").alias("category"), "severity", F.col("rule_id").alias("detector_id"), "reason_code", F.lit(10_000).alias("confidence_bps"), F.lit("canonical").alias("representation"), F.col("start").alias("text_start"), F.col("end").alias("text_end"))
    missing = queued.where("text is null").select("scan_id", F.lit("processing").alias("category"), F.lit("medium").alias("severity"), F.lit("processing.v1").alias("detector_id"), F.lit("INPUT_REQUIRES_REVIEW").alias("reason_code"), F.lit(None).cast("int").alias("confidence_bps"), F.lit("metadata").alias("representation"), F.lit(None).cast("int").alias("text_start"), F.lit(None).cast("int").alias("text_end"))
    return decided, named.unionByName(missing)


def classifier_output_valid(value: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a classifier's JSON says review or block, a confidence of 0 to 1 and distinct allowed categories, and nothing else."""
    v = F.try_parse_json(value)
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit(""))
    items, score = F.try_variant_get(v, "$.categories", "array<variant>"), F.try_variant_get(v, "$.confidence", "double")
    names = F.try_variant_get(v, "$.categories", "array<string>")
    strings = F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
    good = (
        kind("$").startswith("OBJECT") & (F.size(F.array_except(F.json_object_keys(value), F.array(*map(F.lit, CLASSIFIER_KEYS)))) == 0)
        & (kind("$.disposition") == "STRING") & F.try_variant_get(v, "$.disposition", "string").isin("review", "block")
        & kind("$.confidence").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & score.between(0, 1)
        & kind("$.categories").startswith("ARRAY") & strings & (F.size(items) <= len(allowed))
        & (F.size(F.array_except(names, F.array(*map(F.lit, allowed)))) == 0) & (F.size(F.array_distinct(names)) == F.size(names))
    )
    return F.coalesce(good, F.lit(False))
