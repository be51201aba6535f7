"""Queries of contracts, canonical JSON, and envelopes as they arrive: what is a text, what is refused, and exact quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonc
from ..operators import capsule, contracts, intake, listing
from ..session import spread, table
from .lifecycle import _PROCESSED, RULES, _scans


def _text(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _join(*parts) -> Column:
    """Texts and columns one after the other; texts stand for themselves."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _pick(xs: tuple, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in xs)), (k % len(xs) + 1).cast("int"))


def _identifier(prefix: str, k: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.lpad(k.cast("string"), 26, "0"))


ZERO = "sha256:" + "0" * 64


def contract_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of events against the contract of requests: references, constants, names, patterns and one of four inputs."""
    k = F.col("event_id")
    inputs = (
        _join('{"kind":"text","text":"t', k, '","media_type":"text/plain"}'), F.lit('{"kind":"url","url":"http://plain.example"}'), _join('{"kind":"upload","upload_id":"', _identifier("up", k), f'","media_type":"x/y","size_bytes":5.0,"digest":"{ZERO}"}}'),
        _join('{"kind":"feed_event","source_id":"', _identifier("src", k), f'","event_id":"e","payload_digest":"{ZERO}"}}'), F.lit('{"kind":"text","text":5,"media_type":"text/plain"}'),
    )
    body = _join(
        '{"request_id":"', _identifier("req", k), '","workspace_id":"', _identifier("ws", k % 9), '","schema_version":', F.when(k % 7 == 0, "1.0").otherwise('"1.0"'), ',"submitted_at":"2024-01-0', k % 9 + 1, "T00:00:00", F.when(k % 13 == 0, "Z\\n").otherwise("Z"),
        '","provenance":{"source_class":"', F.when(F.col("event_type") == "purchase", "hearsay").otherwise("primary"), '","submitted_by":"', F.when(k % 23 == 0, "").otherwise("me"), '"},"input":', _pick(inputs, k), ',"extensions":{', F.when(k % 19 == 0, '"x":1').otherwise('"a.b":{"c":[]}'), "}",
        F.when(k % 11 == 0, "").otherwise(',"idempotency_key":"key-0001"'), F.when(k % 17 == 0, ',"more":null').otherwise(""), "}",
    )
    found = contracts.contract("ingestionRequest").violations(F.when(k % 29 == 0, F.lit('{"request_id":')).otherwise(body))
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type")).select("event_id", F.array_join(found, ",").alias("violations"))


# What speaks against each of the four inputs, by the rules of oneOf: the kinds that aren't meant, their missing keys, the key too many
_ALL_MISSING = ["digest", "event_id", "media_type", "payload_digest", "size_bytes", "source_id", "text", "upload_id", "url"]


def _against(own: list[str], has: set[str], fault: list[str]) -> str:
    return ",".join(sorted(["$.input.kind:const", "$.input:additionalProperties", "$.input:oneOf", *fault, *(f"$.input:required:{m}" for m in _ALL_MISSING if m not in has)]))


CONTRACT_REQUESTS = f"""WITH v AS (SELECT event_id, event_id AS k, event_type FROM events)
SELECT event_id, CASE WHEN k % 29 = 0 THEN '$:json' ELSE concat_ws(',', CASE WHEN k % 19 = 0 THEN '$.extensions:propertyNames' END,
  CASE k % 5 WHEN 1 THEN '{_against([], {"url"}, ["$.input.url:pattern"])}' WHEN 4 THEN '{_against([], {"text", "media_type"}, ["$.input.text:type"])}' END,
  CASE WHEN event_type = 'purchase' THEN '$.provenance.source_class:enum' END, CASE WHEN k % 23 = 0 THEN '$.provenance.submitted_by:minLength' END,
  CASE WHEN k % 7 = 0 THEN '$.schema_version:const' END, CASE WHEN k % 13 = 0 THEN '$.submitted_at:pattern' END, CASE WHEN k % 17 = 0 THEN '$:additionalProperties' END, CASE WHEN k % 11 = 0 THEN '$:required:idempotency_key' END) END AS violations FROM v"""


def contract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made of parts: lists of citations with places of their own, values of three forms, limits of numbers and texts."""
    k = F.col("p_partkey")
    citation = lambda place: _join('{"source_id":"', _identifier("src", k), f'","snapshot_digest":"{ZERO}","locator":', place, "}")
    cited = (F.lit("[]"), _join("[", citation('{"page":2,"section":"s"}'), "]"), _join("[", citation('{"page":0}'), ",", citation("{}"), "]"), _join("[", citation('{"json_pointer":"/a~2","text_start":1e2}'), "]"))
    values = ('"9"', "true", '{"decimal":"01"}', '{"decimal":"-1.50","unit":"kg"}', "7", '{"decimal":"1","unit":""}')
    body = _join(
        '{"claim_id":"', _identifier("claim", k), '","kind":"other","statement":"', F.when(k % 31 == 0, F.repeat(F.lit("é"), 4097)).otherwise(F.col("p_name")), '","value":', _pick(values, k), ',"verification":"', _pick(("verified", "maybe", "pending"), k),
        '","confidence_bps":', _pick(("10000", "10001", "-1", "12.5", "1e3", '"5"', "null"), k), ',"citations":', _pick(cited, k), "}",
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(contracts.contract("claim").violations(body), ",").alias("violations"))


_VALUE_ERRORS = {2: "$.value.decimal:pattern,$.value:oneOf,$.value:type", 4: "$.value:oneOf,$.value:type", 5: "$.value.unit:minLength,$.value:oneOf,$.value:type"}
CONTRACT_CLAIMS = f"""WITH v AS (SELECT p_partkey AS k FROM part)
SELECT k AS p_partkey, concat_ws(',', CASE k % 4 WHEN 0 THEN '$.citations:minItems' WHEN 2 THEN '$.citations[0].locator.page:minimum,$.citations[1].locator:minProperties' WHEN 3 THEN '$.citations[0].locator.json_pointer:pattern' END,
  CASE k % 7 WHEN 1 THEN '$.confidence_bps:maximum' WHEN 2 THEN '$.confidence_bps:minimum' WHEN 3 THEN '$.confidence_bps:type' WHEN 5 THEN '$.confidence_bps:type' WHEN 6 THEN '$.confidence_bps:type' END,
  CASE WHEN k % 31 = 0 THEN '$.statement:maxLength' END, CASE k % 6 {" ".join(f"WHEN {n} THEN '{e}'" for n, e in _VALUE_ERRORS.items())} END, CASE WHEN k % 3 = 1 THEN '$.verification:enum' END) AS violations FROM v"""


def contract_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects made of customers: symbols that repeat, too many, of another type or form, and parts of a contract that a path may name."""
    k = F.col("c_custkey")
    many = "[" + ",".join(f'"S{n}"' for n in range(101)) + "]"
    symbols = ('["A","B"]', '["A","A"]', many, '["a"]', '["A",1]', '{"0":"A"}', "[]")
    body = _join('{"kind":"', F.when(k % 10 == 0, "bond").otherwise("equity"), '","symbols":', _pick(symbols, k), F.when(k % 4 == 0, ',"entity_ids":["x",""]').when(k % 4 == 1, ',"entity.ids":["x"]').otherwise(""), "}")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(contracts.contract("subject").violations(body), ",").alias("violations"))


CONTRACT_SUBJECTS = """WITH v AS (SELECT c_custkey AS k FROM customer)
SELECT k AS c_custkey, concat_ws(',', CASE WHEN k % 4 = 0 THEN '$.entity_ids[1]:minLength' END, CASE WHEN k % 10 = 0 THEN '$.kind:enum' END,
  CASE k % 7 WHEN 1 THEN '$.symbols:uniqueItems' WHEN 2 THEN '$.symbols:maxItems' WHEN 3 THEN '$.symbols[0]:pattern' WHEN 4 THEN '$.symbols[1]:type' WHEN 5 THEN '$.symbols:type' END, CASE WHEN k % 4 = 1 THEN '$:additionalProperties' END) AS violations FROM v"""


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON with odd keys and numbers, in each form of canonical JSON, and whether two writings of it agree."""
    k, d = F.col("event_id"), F.col("event_id") % 9 + 1
    one = _join('{ "z":[', k, ".0,", k, "e2, -0.0,", d, "e21,0.", d, "00,", d, 'e-7, true,null], "B":"', F.col("event_type"), '\\u000b\\/ \\"1.0\\"", "b":', F.col("value"), ',"A1":{}, "a_b":{"\\ud83d\\ude00":1,"\\uff5e":2.50},"\\u00e9":123456789012345680000}')
    two = _join('{"A1":{},"a_b":{"～":25e-1,"😀":1.0},"b":', F.col("value"), ',"z":[', k * 1, ",", k * 100, ",0,", d, "000000000000000000000,0.", d, ",0.0000001e0,true,null", '],"B":"', F.col("event_type"), '\\u000B/ \\"1.0\\"","é":1.2345678901234568e20}')
    rows = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "value")).select("event_id", one.alias("one"), two.alias("two"))
    rows = rows.withColumns({"v": F.try_parse_json("one"), "w": F.try_parse_json("two")})
    rows = rows.select("event_id", jsonc.canonical(F.col("one"), parsed=F.col("v")).alias("utf16"), jsonc.canonical(F.col("one"), "locale", 3, F.col("v")).alias("locale"), jsonc.canonical(F.col("two"), parsed=F.col("w")).alias("other"))
    rows = rows.select("event_id", *(F.struct(F.col(order).alias("text"), jsonc.digest(F.col(order)).alias("digest")).alias(order) for order in ("utf16", "locale")), F.col("utf16").eqNullSafe(F.col("other")).alias("agrees"))
    each = F.array(*(F.struct(F.lit(name).alias("form"), F.col(f"{order}.text").alias("text"), F.col(f"{order}.digest").alias("digest")) for name, order in jsonc.FORMS.items()))
    return rows.select("event_id", F.inline_outer(each), "agrees")


_FORM = {
    "locale": """'{"a_b":{"～":2.5,"😀":1},"A1":{},"b":' || v || ',"B":' || s || ',"é":123456789012345680000,"z":' || z || '}'""",
    "utf16": """'{"A1":{},"B":' || s || ',"a_b":{"😀":1,"～":2.5},"b":' || v || ',"z":' || z || ',"é":123456789012345680000}'""",
}
CANONICAL_FORMS = f"""WITH e AS (SELECT event_id, event_id % 9 + 1 AS d, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END AS v, '"' || event_type || '\\u000b/ \\"1.0\\""' AS s FROM events),
x AS (SELECT *, '[' || event_id || ',' || CASE WHEN event_id = 0 THEN '0' ELSE event_id || '00' END || ',0,' || d || 'e+21,0.' || d || ',' || d || 'e-7,true,null]' AS z FROM e),
f AS ({" UNION ALL ".join(f"SELECT event_id, '{name}' AS form, {_FORM[order]} AS text FROM x" for name, order in jsonc.FORMS.items())})
SELECT event_id, form, text, 'sha256:' || sha256(text) AS digest, event_id % 9 = 0 AS agrees FROM f"""


def scan_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans whose envelopes bring their text as a string, a number, an object, a list, null, under other shapes, or not at all: only strings are decided by rules."""
    k = F.col("doc_id")
    said = F.to_json(F.struct(F.col("text").alias("t")))
    quoted = F.regexp_extract(said, r'(?s)^\{"t":(.*)\}$', 1)
    forms = (_join('{"input":{"text":', quoted, "}}"), F.lit('{"input":{"text":5}}'), _join('{"input":{"text":{"t":', quoted, "}}}"), F.lit('{"input":{"text":["a"]}}'), F.lit('{"input":{"text":null}}'), F.lit('{"input":[{"text":"a"}]}'), F.lit('{"input":"text"}'), F.lit("{}"), F.lit("nope"), F.lit('{"input":{"text":""}}'), F.lit('{"input":{"text":true}}'))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(k.alias("scan_id"), F.lit("queued").alias("state"), _pick(forms, k).alias("envelope"))
    decided, found = intake.process(rows, RULES)
    review = found.where("reason_code = 'INPUT_REQUIRES_REVIEW'").select("scan_id", F.lit(True).alias("unread"))
    return decided.join(review, "scan_id", "left").select("scan_id", F.coalesce("unread", F.lit(False)).alias("unread"), F.when(F.col("unread"), F.col("state")).alias("state"), "outcome")


SCAN_INPUTS = "SELECT doc_id AS scan_id, doc_id % 11 NOT IN (0, 9) AS unread, CASE WHEN doc_id % 11 NOT IN (0, 9) THEN 'review' END AS state, 'processed' AS outcome FROM documents WHERE text IS NOT NULL"

CODES = ('"00000"', '"40009"', '"40753"', '"429"', "429", '"45001"', '"1"', "null", "0")
TIMES = ("1700000000000", '"1700000000000"', "0", "-5", "1.5", '"x"', "null", "8640000000000001", "17e11")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    quantity = F.floor(F.col("o_totalprice")).cast("long").cast("string")
    asset = lambda name, rest: _join(f'{{"coin":"{name}",', rest, "}")
    some = _join(asset(" btc ", _join('"balance":"', quantity, '.500"')), ",", asset("eth", _join('"available":"', quantity, '","frozen":"0.1234567890123456789","locked":7')))
    tiny = asset("sol", F.lit('"available":"0.0000000000000000004"'))
    data = (
        _join("[", some, "]"), _join('[{"assets":[', some, ",5]},{\"assets\":[", tiny, "]},{}]"), _join('{"assets":[', tiny, "]}"), _join("[", asset("btc", F.lit('"balance":"-0.0"')), "]"), _join("[", some, ",", asset("BTC", F.lit('"balance":"1"')), "]"),
        F.lit('[{"coin":5,"balance":"1"}]'), F.lit('[{"coin":"x","balance":1}]'), F.lit('"none"'), _join("[", asset("neg", F.lit('"balance":"-1"')), ",", tiny, "]"),
    )
    pick = lambda xs, by: _pick(xs, F.floor(k / by).cast("long"))
    good = k % 4 != 0
    body = _join('{"code":', F.when(good, '"00000"').otherwise(pick(CODES, 4)), ',"requestTime":', F.when(good, F.lit(TIMES[0])).otherwise(pick(TIMES, 8)), ',"data":', pick(data, 4), "}")
    status = F.when(k % 40 == 0, _pick((F.lit(401), F.lit(403), F.lit(429), F.lit(503), F.lit(302)), F.floor(k / 40).cast("long"))).otherwise(200)
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).select(k.alias("account_id"), status.alias("status"), F.when(k % 44 == 0, "[]").otherwise(body).alias("body"))


def account_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider's responses: what each status and code means, and which times hold."""
    return listing.responses(_responses(spark, sf_dir)).select("account_id", "code", "error", "request_time")


_TIME_OK = "(8, 0, 1)"  # of TIMES: a number, a string, an exponent
_RESPONSE = """r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 40 = 0 THEN [401, 403, 429, 503, 302][o_orderkey // 40 % 5 + 1] ELSE 200 END AS status, o_orderkey % 44 = 0 AS odd, o_orderkey % 4 <> 0 AS good, o_orderkey // 4 % 9 AS c, o_orderkey // 8 % 9 AS t, floor(o_totalprice)::BIGINT AS q FROM orders),
a AS (SELECT *, CASE WHEN odd THEN NULL WHEN good THEN '00000' ELSE ['00000', '40009', '40753', '429', '429', '45001', '1', NULL, '0'][c + 1] END AS code FROM r),
b AS (SELECT *, CASE WHEN status = 401 OR code = '40009' THEN 'CREDENTIAL_REVOKED' WHEN status = 403 OR code = '40753' THEN 'PERMISSION_DENIED' WHEN status = 429 OR code = '429' THEN 'RATE_LIMITED' WHEN status >= 500 OR code = '45001' THEN 'UNAVAILABLE'
  WHEN status <> 200 OR odd OR code IS NULL OR code <> '00000' THEN 'RESPONSE_INVALID' WHEN NOT good AND t NOT IN (0, 1, 8) THEN 'TIME_INVALID' END AS error FROM a)"""
ACCOUNT_RESPONSES = f"""WITH {_RESPONSE} SELECT k AS account_id, code, error, CASE WHEN error IS NULL THEN CASE WHEN NOT good AND t = 8 THEN '2023-11-14T22:13:20.000Z' ELSE '2023-11-14T22:13:20.000Z' END END AS request_time FROM b"""


def response_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdings in the responses that are good: flat and nested assets, quantities to the last digit."""
    good = listing.responses(_responses(spark, sf_dir)).where("error is null")
    return listing.holdings(listing.account_assets(good))


RESPONSE_HOLDINGS = f"""WITH {_RESPONSE}, g AS (SELECT k, c, q FROM b WHERE error IS NULL)
SELECT k AS account_id, 'BTC' AS asset, q || '.500' AS quantity, NULL AS error FROM g WHERE c IN (0, 1)
UNION ALL SELECT k, 'ETH', q || '.1234567890123456789', NULL FROM g WHERE c IN (0, 1)
UNION ALL SELECT k, 'SOL', '0.0000000000000000004', NULL FROM g WHERE c IN (1, 2, 8)
UNION ALL SELECT k, NULL, NULL, CASE c WHEN 4 THEN 'DUPLICATE_ASSET' WHEN 5 THEN 'INVALID_IDENTIFIER' WHEN 6 THEN 'INVALID_BALANCE' END FROM g WHERE c IN (4, 5, 6)"""


POLICY = {"policy_id": "policy_" + "P" * 26, "version": "1.2.3", "digest": ZERO}
COMPONENT = {"component": "engine", "version": "1", "digest": ZERO}


def capsule_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned capsules of the processed scans by their contract: the canonical text, its digest, and what it breaks, which is nothing."""
    named = _scans(spark, sf_dir).withColumn("scan_id", _identifier("scan", F.col("scan_id")))
    decided, found = intake.process(named, RULES)
    scans = decided.where("outcome = 'processed'").select("scan_id", _identifier("ws", F.lit(1)).alias("workspace_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("scan_id").cast("binary"), 256)).alias("input_digest"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"), "state")
    return capsule.compose_contract(scans, found, POLICY, COMPONENT).withColumn("violations", F.array_join("violations", ","))


_FINDING = """'{"category":"' || CASE reason_code WHEN 'DIRECT_INSTRUCTION_OVERRIDE' THEN 'direct_prompt_injection' WHEN 'INDIRECT_INSTRUCTION_OVERRIDE' THEN 'indirect_prompt_injection' WHEN 'SOURCE_IMPERSONATION' THEN 'source_mismatch' ELSE 'other' END
  || '","confidence_bps":10000,"detector_id":"' || rule_id || '","extensions":{},"finding_id":"finding_' || upper(left(sha256('scan_' || lpad(id::VARCHAR, 26, '0') || ':' || (n - 1)), 26)) || '","location":{"representation":"canonical","text_end":' || "end" || ',"text_start":' || "start" || '},"reason_code":"' || reason_code || '","severity":"' || severity || '"}'"""
_UNREAD = """'{"category":"policy_failure","detector_id":"processing.v1","extensions":{},"finding_id":"finding_' || upper(left(sha256('scan_' || lpad(doc_id::VARCHAR, 26, '0') || ':0'), 26)) || '","location":{"representation":"metadata"},"reason_code":"INPUT_REQUIRES_REVIEW","severity":"medium"}'"""
CAPSULE_CONTRACT = f"""WITH {_PROCESSED}, q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "start", rule_id) AS n FROM found), l AS (SELECT id, string_agg({_FINDING}, ',' ORDER BY n) AS items FROM q GROUP BY 1),
g AS (SELECT doc_id, 'scan_' || lpad(doc_id::VARCHAR, 26, '0') AS scan, CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN 1 ELSE coalesce(worst, 0) END AS worst, CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN {_UNREAD} ELSE coalesce(items, '') END AS items
  FROM documents LEFT JOIN w ON w.id = doc_id LEFT JOIN l ON l.id = doc_id WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0),
o AS (SELECT scan AS scan_id, '{{"as_of":"2024-01-01T00:00:00.000Z","capsule_id":"capsule_' || upper(left(sha256(scan), 26)) || '","claims":[],"components":[{{"component":"engine","digest":"{ZERO}","version":"1"}}],"conflicts":[],"created_at":"2024-01-01T00:00:00.000Z","disposition":"' || ['allow', 'review', 'block'][worst + 1]
  || '","evidence":[],"extensions":{{}},"findings":[' || items || '],"input_digest":"sha256:' || sha256(scan) || '","policy":{{"digest":"{ZERO}","policy_id":"{POLICY["policy_id"]}","version":"1.2.3"}},"scan_id":"' || scan || '","schema_version":"1.0","subject":{{"kind":"unknown","symbols":[]}},"workspace_id":"ws_' || lpad('1', 26, '0') || '"}}' AS capsule FROM g)
SELECT *, 'sha256:' || sha256(capsule) AS digest, CASE WHEN contains(capsule, '"detector_id":""') THEN 'x' ELSE '' END AS violations FROM o"""


QUERIES = (contract_requests, contract_claims, contract_subjects, canonical_forms, scan_inputs, account_responses, response_holdings, capsule_contract)
