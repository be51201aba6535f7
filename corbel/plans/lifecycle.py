"""Queries of intake, job and delivery steps, capsules, listings and benchmarks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, benchmark, capsule, delivery, intake, listing, ops, workqueue
from ..session import spread, table
from .screening import _findings_sql
from .screening import RULES as ALL_RULES

RULES = tuple(r for r in ALL_RULES if r.tenants is None)
NOW = "2024-01-20 00:00:00"


def _pick(xs: tuple[str, ...], k) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _now():
    return F.lit(NOW).cast("timestamp")


def scan_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested moves of scans, counted by whether the state machine allows them."""
    names, k = tuple(intake.MOVES), F.col("event_id")
    rows = table(spark, sf_dir, "events").select(_pick(names, k).alias("state"), _pick(names, F.floor(k / len(names)).cast("long")).alias("target"))
    return rows.groupBy("state", "target", intake.may_move(F.col("state"), F.col("target")).alias("allowed")).agg(F.count("*").alias("n"))


SCAN_TRANSITIONS = f"""WITH m(state, target) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in intake.MOVES.items() for b in bs)}), s AS (SELECT {_list(intake.MOVES)} AS names),
r AS (SELECT names[event_id % 8 + 1] AS state, names[event_id // 8 % 8 + 1] AS target FROM events, s)
SELECT r.state, r.target, m.state IS NOT NULL AS allowed, count(*) AS n FROM r LEFT JOIN m ON r.state = m.state AND r.target = m.target GROUP BY ALL"""


def ingestion_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of events: keys repeat with equal contents in other writings and with other contents, some belong to another workspace, some are too large or break the contract, some keys are known."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    r, n = k % 700, k % 1400
    digits = lambda c: F.lpad(c.cast("string"), 26, "0")
    join = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    kind = _pick(("text", "upload", "feed_event", "url"), r)
    digest = F.concat(F.lit("sha256:"), F.sha2(r.cast("string").cast("binary"), 256))
    size = (n % 11) * 10_000_001
    inner = (
        F.when(kind == "text", join('{"text":"text ', n, '","media_type":"text/plain","kind":"text"}'))
        .when(kind == "upload", join('{"upload_id":"up_', digits(r), '","media_type":"x/y","kind":"upload","size_bytes":', size + 1, F.when(k % 2 == 0, ".0").otherwise(""), ',"digest":"', digest, '"}'))
        .when(kind == "url", join('{"url":"https://', n, '.example","kind":"url"}'))
        .otherwise(join('{"kind":"feed_event","source_id":"src_', digits(r), '","event_id":"e', n, '","payload_digest":"', digest, '"}'))
    )
    owner = F.when(r % 23 == 0, "1").otherwise("2")
    one = join('{"schema_version":"1.0","request_id":"req_', digits(n), '","workspace_id":"ws_', digits(owner), '","submitted_at":"2024-01-01T00:00:00Z","idempotency_key":', F.when(r % 41 == 0, "null").otherwise(join('"key-', r, '-0000"')), ',"provenance":{"submitted_by":"me","source_class":"primary"},"input":', inner, ',"extensions":{}}')
    two = join('{ "input":', inner, ', "extensions" : {},"provenance":{"source_class":"primary","submitted_by":"me"},"idempotency_key":', F.when(r % 41 == 0, "null").otherwise(join('"key-', r, '-0000"')), ',"submitted_at":"2024-01-01T00:00:00Z","workspace_id":"ws_', digits(owner), '","request_id":"req_', digits(n), '","schema_version":"1.0"}')
    rows = spread(e.select("event_id")).select(k.alias("position"), F.when(F.floor(k / 1400) % 2 == 0, one).otherwise(two).alias("body"))
    known = e.where("event_id % 10 = 3").select((k % 700).alias("r")).distinct().where("r % 7 = 3").select(F.concat(F.lit("key-"), F.col("r").cast("string"), F.lit("-0000")).alias("idempotency_key"), F.lit("sha256:other").alias("request_digest"), F.concat(F.lit("scan_old"), F.col("r").cast("string")).alias("scan_id"))
    return intake.accept(rows, known, "ws_" + "2".rjust(26, "0"))


INGESTION_ACCEPT = """WITH k AS (SELECT event_id AS id, event_id % 700 AS r, event_id % 1400 AS n FROM events),
i AS (SELECT *, ['text', 'upload', 'feed_event', 'url'][r % 4 + 1] AS kind, (n % 11) * 10000001 + 1 AS size, 'sha256:' || sha256(r::VARCHAR) AS given, 'ws_' || lpad(CASE WHEN r % 23 = 0 THEN '1' ELSE '2' END, 26, '0') AS ws, CASE WHEN r % 41 <> 0 THEN 'key-' || r || '-0000' END AS key FROM k),
j AS (SELECT *, CASE kind WHEN 'text' THEN '{"kind":"text","media_type":"text/plain","text":"text ' || n || '"}' WHEN 'upload' THEN '{"digest":"' || given || '","kind":"upload","media_type":"x/y","size_bytes":' || size || ',"upload_id":"up_' || lpad(r::VARCHAR, 26, '0') || '"}'
  WHEN 'url' THEN '{"kind":"url","url":"https://' || n || '.example"}' ELSE '{"event_id":"e' || n || '","kind":"feed_event","payload_digest":"' || given || '","source_id":"src_' || lpad(r::VARCHAR, 26, '0') || '"}' END AS input FROM i),
c AS (SELECT *, CASE WHEN key IS NULL THEN 'INVALID' WHEN ws LIKE '%1' THEN 'DENIED' WHEN kind = 'upload' AND size > 100000000 THEN 'TOO_LARGE' END AS early,
  'sha256:' || sha256('{"extensions":{},"idempotency_key":"' || key || '","input":' || input || ',"provenance":{"source_class":"primary","submitted_by":"me"},"request_id":"req_' || lpad(n::VARCHAR, 26, '0') || '","schema_version":"1.0","submitted_at":"2024-01-01T00:00:00Z","workspace_id":"' || ws || '"}') AS rd,
  CASE WHEN kind IN ('upload', 'feed_event') THEN given ELSE 'sha256:' || sha256(input) END AS inp FROM j),
o AS (SELECT DISTINCT 'key-' || event_id % 700 || '-0000' AS key, 'sha256:other' AS kd, 'scan_old' || event_id % 700 AS ks FROM events WHERE event_id % 10 = 3 AND event_id % 700 % 7 = 3),
f AS (SELECT key, min(id) AS fid, arg_min(rd, id) AS fd FROM c WHERE early IS NULL GROUP BY 1),
x AS (SELECT c.*, ks, coalesce(early, CASE WHEN rd <> coalesce(kd, fd) THEN 'CONFLICT' WHEN ks IS NULL AND id = fid THEN 'created' ELSE 'replay' END) AS outcome FROM c LEFT JOIN f ON c.key = f.key LEFT JOIN o ON c.key = o.key)
SELECT id AS position, CASE WHEN early IS NULL THEN key END AS idempotency_key, outcome, CASE WHEN outcome IN ('created', 'replay') THEN coalesce(ks, 'scan_' || left(sha256(ws || chr(0) || key), 26)) END AS scan_id, CASE WHEN early IS NULL THEN rd END AS request_digest, CASE WHEN early IS NULL THEN inp END AS input_digest,
  CASE WHEN outcome = 'created' THEN 'queued' END AS state, CASE WHEN outcome = 'created' THEN 'object://sha256/' || inp[8:] END AS payload_ref FROM x"""


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    source = F.struct(F.when(k % 9 != 0, F.col("text")).alias("text"), F.when(k % 9 == 0, "url").when(k % 2 == 0, "feed_event").otherwise("text").alias("kind"), F.col("source").alias("source_id"))
    return table(spark, sf_dir, "documents").select(k.alias("scan_id"), F.when(k % 13 == 0, "accepted").when(k % 17 == 0, "blocked").otherwise("queued").alias("state"), F.to_json(F.struct(source.alias("input"))).alias("envelope"))


def scan_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans made of documents after their processing."""
    return intake.process(_scans(spark, sf_dir), RULES)[0]


_PROCESSED = f"""{_findings_sql(RULES, "SELECT doc_id AS id, text, lang AS tenant, source FROM documents WHERE doc_id % 9 <> 0 AND text IS NOT NULL AND doc_id % 13 <> 0 AND doc_id % 17 <> 0")},
w AS (SELECT id, max(CASE disposition WHEN 'block' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS worst FROM found GROUP BY 1)"""
SCAN_PROCESS = f"""WITH {_PROCESSED}
SELECT doc_id AS scan_id, CASE WHEN doc_id % 13 = 0 THEN 'accepted' WHEN doc_id % 17 = 0 THEN 'blocked' WHEN doc_id % 9 = 0 OR text IS NULL THEN 'review' ELSE ['allowed', 'review', 'blocked'][coalesce(worst, 0) + 1] END AS state,
  CASE WHEN doc_id % 13 = 0 THEN 'CONFLICT' WHEN doc_id % 17 = 0 THEN 'kept' ELSE 'processed' END AS outcome FROM documents LEFT JOIN w ON id = doc_id"""


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of that processing; a scan without a text in reach has one that asks for review."""
    return intake.process(_scans(spark, sf_dir), RULES)[1]


SCAN_FINDINGS = f"""WITH {_PROCESSED}
SELECT id AS scan_id, 'prompt_injection' AS category, severity, rule_id AS detector_id, reason_code, 10000 AS confidence_bps, 'canonical' AS representation, "start" AS text_start, "end" AS text_end FROM found
UNION ALL SELECT doc_id, 'processing', 'medium', 'processing.v1', 'INPUT_REQUIRES_REVIEW', NULL, 'metadata', NULL, NULL FROM documents WHERE (doc_id % 9 = 0 OR text IS NULL) AND doc_id % 13 <> 0 AND doc_id % 17 <> 0"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    state = _pick(tuple(workqueue.MOVES), k)
    day = lambda n: F.col("ts") + F.make_dt_interval(n.cast("int"))
    leased = state == "leased"
    return e.select(k.alias("job_id"), state.alias("state"), F.when(leased, F.concat(F.lit("t"), (k % 3).cast("string"))).alias("lease_token"), F.when(leased, day(k % 25)).alias("lease_expires_at"), F.when(leased, day(k % 29)).alias("execution_expires_at"), day(k % 37).alias("deadline_at"), F.when(k % 5 == 0, F.col("ts")).alias("cancel_requested_at"), F.concat(F.lit("e"), (k % 900).cast("string")).alias("effect_key"), F.when(state == "succeeded", F.concat(F.lit("d"), (k % 4).cast("string"))).alias("result_digest"))


_JOBS = f"""j AS (SELECT event_id AS id, {_list(workqueue.MOVES)}[event_id % 6 + 1] AS state, event_id % 3 AS token, ts + to_days((event_id % 25)::INTEGER) AS lease, ts + to_days((event_id % 29)::INTEGER) AS exec, ts + to_days((event_id % 37)::INTEGER) AS dead,
  event_id % 5 = 0 AS cancel, ts, TIMESTAMP '{NOW}' AS now, 'e' || event_id % 900 AS effect, event_id % 4 AS own FROM events),
h AS (SELECT *, state = 'leased' AND token = 1 AND lease > now AND exec > now AND dead > now AS held FROM j)"""


def lease_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose lease a worker still holds, counted by state."""
    held = workqueue.lease_valid(F.lit("t1"), _now())
    return _jobs(spark, sf_dir).groupBy("state", held.alias("valid")).agg(F.count("*").alias("n"))


LEASE_CHECK = f"WITH {_JOBS} SELECT state, held AS valid, count(*) AS n FROM h GROUP BY ALL"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").where(k % 2 == 1).select(F.when(k % 31 == 0, -k).otherwise(k).alias("job_id"), F.lit("t1").alias("token"), F.concat(F.lit("d"), (k % 5 % 4).cast("string")).alias("result_digest"))


_ASKED = "a AS (SELECT CASE WHEN event_id % 31 = 0 THEN -event_id ELSE event_id END AS id, event_id % 5 % 4 AS dig FROM events WHERE event_id % 2 = 1)"


def job_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats of workers, some of which have lost their job."""
    return workqueue.heartbeat(_jobs(spark, sf_dir), _asked(spark, sf_dir), _now(), 60_000)


JOB_HEARTBEAT = f"""WITH {_JOBS}, {_ASKED} SELECT a.id AS job_id, CASE WHEN h.id IS NULL THEN 'NOT_FOUND' WHEN held THEN 'extended' ELSE 'LOST_LEASE' END AS outcome,
  CASE WHEN held THEN least(now + INTERVAL 60 SECOND, exec) END AS lease_expires_at, CASE WHEN held THEN cancel END AS cancel_requested FROM a LEFT JOIN h ON a.id = h.id"""


def job_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions against the ledger of effects, which holds some results already."""
    ledger = table(spark, sf_dir, "events").where("event_id % 900 < 100").select(F.concat(F.lit("e"), (F.col("event_id") % 900).cast("string")).alias("effect_key"), F.concat(F.lit("d"), (F.col("event_id") % 900 % 4).cast("string")).alias("result_digest")).distinct()
    return workqueue.complete(_jobs(spark, sf_dir), ledger, _asked(spark, sf_dir), _now())


JOB_COMPLETE = f"""WITH {_JOBS}, {_ASKED}, l AS (SELECT DISTINCT 'e' || event_id % 900 AS effect, event_id % 900 % 4 AS known FROM events WHERE event_id % 900 < 100),
m AS (SELECT a.id, a.dig, h.* EXCLUDE (id), h.id IS NULL AS missing FROM a LEFT JOIN h ON a.id = h.id), f AS (SELECT effect, arg_min(dig, id) AS fd FROM m WHERE held GROUP BY 1),
o AS (SELECT m.id, m.state, CASE WHEN missing THEN 'NOT_FOUND' WHEN m.state = 'succeeded' THEN CASE WHEN own = dig THEN 'replay' ELSE 'CONFLICT' END WHEN NOT held THEN 'LOST_LEASE' WHEN dig <> coalesce(known, fd) THEN 'CONFLICT' ELSE 'succeeded' END AS outcome
  FROM m LEFT JOIN f ON m.effect = f.effect LEFT JOIN l ON m.effect = l.effect)
SELECT id AS job_id, outcome, CASE WHEN outcome IN ('succeeded', 'replay') THEN 'succeeded' ELSE state END AS state FROM o"""


def job_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to cancel jobs."""
    return workqueue.cancel(_jobs(spark, sf_dir), _asked(spark, sf_dir).select("job_id"), _now())


JOB_CANCEL = f"""WITH {_JOBS}, {_ASKED}, m AS (SELECT a.id AS aid, h.*, state IN ('available', 'retry_wait') AS waits FROM a LEFT JOIN h ON a.id = h.id)
SELECT aid AS job_id, CASE WHEN id IS NULL THEN 'NOT_FOUND' WHEN waits THEN 'cancelled' WHEN state = 'leased' THEN 'requested' ELSE 'terminal' END AS outcome, CASE WHEN waits THEN 'cancelled' ELSE state END AS state,
  CASE WHEN waits OR state = 'leased' THEN now WHEN cancel THEN ts END AS cancel_requested_at, CASE WHEN waits THEN now END AS completed_at FROM m"""


def job_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs, some with an invalid envelope, some with a key that is known or repeats."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    ref = lambda n: F.concat(F.lit("object://sha256/"), F.sha2(n.cast("string").cast("binary"), 256))
    rows = e.select(k.alias("job_id"), F.concat(F.lit("k"), (k % 800).cast("string")).alias("idempotency_key"), F.when(k % 19 == 0, "object://md5/0").otherwise(ref(k % 1600)).alias("payload_ref"), (k % 22).alias("max_attempts"), F.lit(60_000).alias("timeout_ms"), (F.col("ts") + F.make_dt_interval(F.lit(15))).alias("deadline_at"))
    old = e.where("event_id % 800 < 50").select((k % 800).alias("r")).distinct().select(F.concat(F.lit("k"), F.col("r").cast("string")).alias("idempotency_key"), ref(F.col("r")).alias("payload_ref"))
    return workqueue.enqueue(rows, old, _now())


JOB_ENQUEUE = f"""WITH r AS (SELECT event_id AS id, 'k' || event_id % 800 AS key, sha256((event_id % 1600)::VARCHAR) AS ref, event_id % 19 <> 0 AND event_id % 22 BETWEEN 1 AND 20 AND ts + INTERVAL 15 DAY > TIMESTAMP '{NOW}' AS valid FROM events),
o AS (SELECT DISTINCT 'k' || event_id % 800 AS key, sha256((event_id % 800)::VARCHAR) AS known FROM events WHERE event_id % 800 < 50), f AS (SELECT key, min(id) AS fid, arg_min(ref, id) AS fr FROM r WHERE valid GROUP BY 1),
x AS (SELECT r.id, r.key, CASE WHEN NOT valid THEN 'INVALID' WHEN ref <> coalesce(known, fr) THEN 'CONFLICT' WHEN known IS NULL AND id = fid THEN 'created' ELSE 'replay' END AS outcome FROM r LEFT JOIN f ON r.key = f.key LEFT JOIN o ON r.key = o.key)
SELECT id AS job_id, key AS idempotency_key, outcome, CASE WHEN outcome = 'created' THEN 'available' END AS state FROM x"""


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("delivery_id"), _pick(("delivering", "delivered", "dead_letter", "retry"), k).alias("state"), (k % 7 + 1).cast("int").alias("attempt"), F.lit(6).alias("max_attempts"), F.col("ts").alias("next_attempt_at"), F.when(k % 6 != 5, F.element_at(F.array(*map(F.lit, (200, 404, 429, 503, 408))), (F.floor(k / 4) % 5 + 1).cast("int"))).alias("status"), F.when(k % 24 == 0, F.lit(7_200)).alias("retry_after_s"), (k % 2).alias("endpoint_id"), F.col("user_id").alias("event_id"), F.col("event_type").alias("ordering_key"))


def delivery_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries under way after their answers."""
    return delivery.settle(_deliveries(spark, sf_dir), _now(), F.lit(1.0))


DELIVERY_SETTLE = f"""WITH d AS (SELECT event_id AS id, event_id % 7 + 1 AS attempt, ts, CASE WHEN event_id % 6 <> 5 THEN [200, 404, 429, 503, 408][event_id // 4 % 5 + 1] END AS code, CASE WHEN event_id % 24 = 0 THEN 7200 END AS ra FROM events WHERE event_id % 4 = 0),
x AS (SELECT *, CASE WHEN code = 200 THEN 'delivered' WHEN (code IS NULL OR code IN (429, 503, 408)) AND attempt < 6 THEN 'retry' ELSE 'dead_letter' END AS state FROM d)
SELECT id AS delivery_id, state, CASE WHEN state = 'retry' THEN TIMESTAMP '{NOW}' + to_seconds(least(3600, coalesce(ra, pow(2, attempt - 1)))::BIGINT) ELSE ts END AS next_attempt_at, code AS last_status,
  CASE WHEN code IS NULL THEN 'TRANSPORT_FAILED' WHEN code <> 200 THEN 'HTTP_' || code END AS error_code FROM x"""


def delivery_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to replay deliveries."""
    k = F.col("event_id")
    asked = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(k.alias("delivery_id"), F.when(k % 9 == 0, "  short ").otherwise("lost by the receiver").alias("reason"))
    return delivery.replay(_deliveries(spark, sf_dir), asked, 1)


DELIVERY_REPLAY = """WITH x AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'REASON_INVALID' WHEN event_id % 2 <> 1 OR event_id % 4 NOT IN (1, 2) THEN 'NOT_REPLAYABLE' ELSE 'queued' END AS status FROM events WHERE event_id % 3 = 0)
SELECT event_id AS delivery_id, status, CASE WHEN status = 'queued' THEN 'replay-' || event_id END AS new_id, CASE WHEN status = 'queued' THEN user_id END AS event_id, CASE WHEN status = 'queued' THEN event_type END AS ordering_key,
  CASE WHEN status = 'queued' THEN event_id || ':replay:replay-' || event_id END AS idempotency_key FROM x"""


def delivery_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New deliveries, duplicates marked."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("delivery_id"), (k % 3_000).alias("idempotency_key"))
    return delivery.enqueue(rows, rows.where("delivery_id % 100 = 1").select("idempotency_key"))


DELIVERY_ENQUEUE = """SELECT event_id AS delivery_id, event_id % 3000 AS idempotency_key, CASE WHEN event_id % 3000 IN (SELECT event_id % 3000 FROM events WHERE event_id % 100 = 1) OR event_id <> min(event_id) OVER (PARTITION BY event_id % 3000) THEN 'duplicate' ELSE 'queued' END AS status FROM events"""
ENDPOINTS = ("https://hooks.example.com/a", "http://hooks.example.com/a", "https://u:p@hooks.example.com/", "https://hooks.example.com/#x", "https://localhost/", "https://a.localhost/x", "https://10.1.2.3/", "https://172.20.0.1/", "https://172.40.0.1/", "https://[::1]/", "https://[fd00::1]/x", "https://100.64.0.1/", "https://other.example.org:8443/")
_ALLOWED = (True, False, False, False, False, False, False, False, True, False, False, True, True)


def webhook_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which endpoints deliveries may go to."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(ENDPOINTS, F.col("c_custkey")).alias("url"))
    return rows.select("c_custkey", "url", delivery.endpoint_allowed(F.col("url")).alias("allowed"), delivery.endpoint_allowed(F.col("url"), ("hooks.example.com",)).alias("listed"))


WEBHOOK_ENDPOINTS = f"""SELECT c_custkey, {_list(ENDPOINTS)}[c_custkey % {len(ENDPOINTS)} + 1] AS url, [{", ".join(str(x).lower() for x in _ALLOWED)}][c_custkey % {len(ENDPOINTS)} + 1] AS allowed, c_custkey % {len(ENDPOINTS)} = 0 AS listed FROM customer"""
URLS = ("https://a.example/x", "http://a.example/", "not a url", "https://me:pw@a.example/", "https://a.example:8080/", "https://127.0.0.1/", "https://192.168.4.4/", "https://[fe80::1]/", "https://[::ffff:10.0.0.1]/", "https://2130706433/", "https://A.Example:443/x?y#z", "https://8.8.8.8/")
_BLOCKED = ("", "SCHEME_BLOCKED", "INVALID_URL", "CREDENTIAL_URL_BLOCKED", "AUTHORITY_BLOCKED", *("PRIVATE_ADDRESS_BLOCKED",) * 5, "", "")


def url_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reason why a URL may not be fetched, each met."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", _pick(URLS, F.col("c_custkey")).alias("url"))
    return rows.groupBy("url", F.coalesce(T.url_block_reason(F.col("url")), F.lit("")).alias("blocked")).agg(F.count("*").alias("n"))


URL_OUTCOMES = f"SELECT {_list(URLS)}[c_custkey % {len(URLS)} + 1] AS url, {_list(_BLOCKED)}[c_custkey % {len(URLS)} + 1] AS blocked, count(*) AS n FROM customer GROUP BY ALL"
_SECRETS = ("nothing here", "api_key = abcdefgh1", "password: short", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_abcdefghijkl", "Access Token=\"0123456789", "pk_test_abcdefghijkl", "-----BEGIN PUBLIC KEY-----", "client-secret:12345678")
_HAS = (False, True, False, True, True, True, False, False, True)


def secret_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three kinds of likely secrets and what only looks like them, inside order comments."""
    text = F.concat(F.lit("see "), _pick(_SECRETS, F.col("o_orderkey")), F.lit(" ok"))
    return table(spark, sf_dir, "orders").groupBy(text.alias("text"), T.has_secret(text).alias("secret")).agg(F.count("*").alias("n"))


SECRET_FORMS = f"SELECT 'see ' || {_list(_SECRETS)}[o_orderkey % {len(_SECRETS)} + 1] || ' ok' AS text, [{', '.join(str(x).lower() for x in _HAS)}][o_orderkey % {len(_SECRETS)} + 1] AS secret, count(*) AS n FROM orders GROUP BY ALL"


def safe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their content."""
    return capsule.safe_record(table(spark, sf_dir, "documents").withColumnRenamed("text", "content"))


SAFE_RECORDS = "SELECT * EXCLUDE (text) FROM documents"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    key = _pick(("name", "Token", "items", "content", "secretary"), F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"id":'), k, F.lit(',"text":"raw","a":[{"Excerpt":"x","'), key, F.lit('":{"v":'), k, F.lit("}}]}")).alias("body"))


def sanitized_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON without raw keys at any depth."""
    return _nested(spark, sf_dir).select("event_id", capsule.sanitized(F.col("body")).alias("body"))


SANITIZED_JSON = """WITH k AS (SELECT event_id, ['name','Token','items','content','secretary'][event_id % 5 + 1] AS key FROM events)
SELECT event_id, '{"id":' || event_id || ',"a":[{' || CASE WHEN key <> 'content' THEN '"' || key || '":{"v":' || event_id || '}' ELSE '' END || '}]}' AS body FROM k"""


def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that may not go out, with the key that keeps them."""
    return _nested(spark, sf_dir).select("event_id", capsule.forbidden_key(F.col("body")).alias("key")).where("key is not null")


FORBIDDEN_KEYS = "SELECT event_id, ['name','Token','items','content','secretary'][event_id % 5 + 1] AS key FROM events WHERE event_id % 5 IN (1, 3)"
OUTPUTS = ('{"disposition":"review","confidence":0.5,"categories":["a"]}', '{"disposition":"block","confidence":1,"categories":[]}', '{"disposition":"allow","confidence":1,"categories":[]}', '{"disposition":"block","confidence":2,"categories":[]}', '{"disposition":"block","confidence":"1","categories":[]}', '{"disposition":"block","confidence":1,"categories":["a","a"]}', '{"disposition":"block","confidence":1,"categories":["z"]}', '{"disposition":"block","confidence":1,"categories":[],"why":1}', "[]", "no json", '{"confidence":1,"categories":[]}', '{"disposition":"block","confidence":0.25,"categories":["b","a"]}')


def classifier_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a classifier that may be believed."""
    text = _pick(OUTPUTS, F.col("c_custkey"))
    return table(spark, sf_dir, "customer").groupBy(text.alias("output"), intake.classifier_output_valid(text, ("a", "b")).alias("valid")).agg(F.count("*").alias("n"))


CLASSIFIER_OUTPUTS = f"SELECT {_list(OUTPUTS)}[c_custkey % {len(OUTPUTS)} + 1] AS output, c_custkey % {len(OUTPUTS)} IN (0, 1, 11) AS valid, count(*) AS n FROM customer GROUP BY ALL"
CONTRACT = {"type": "object", "required": ["id", "kind"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 100}, "kind": {"type": "string", "enum": ["click", "view"]}, "tags": {"type": "array", "maxItems": 2, "uniqueItems": True}, "name": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 3}, "in": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number", "maximum": 50}}}}}


def contract_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON against a schema: constraint columns made from it find what each row breaks."""
    k = F.col("event_id")
    tags = _pick(('["a","b"]', '["a","a"]', '["a","b","c"]', '"a"'), k)
    body = F.concat(F.lit('{"id":'), F.when(k % 6 == 0, F.lit('"x"')).otherwise(k.cast("string")), F.when(k % 4 != 0, F.concat(F.lit(',"kind":"'), F.col("event_type"), F.lit('"'))).otherwise(""), F.lit(',"tags":'), tags, F.lit(',"name":"u'), F.col("user_id").cast("string"), F.lit('","in":'), F.col("props"), F.when(k % 9 == 0, F.lit(',"more":1')).otherwise(""), F.lit("}"))
    text = F.when(k % 50 == 0, F.lit("{")).otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(intake.schema_violations(text, CONTRACT), ",").alias("violations")).where("violations <> ''")


CONTRACT_SCHEMA = """WITH e AS (SELECT *, event_id % 4 AS t, (props->>'$.k')::DOUBLE AS k FROM events),
v AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '$:json' ELSE concat_ws(',',
  CASE WHEN event_id % 6 <> 0 AND event_id < 100 THEN '$.id:minimum' END, CASE WHEN event_id % 6 = 0 THEN '$.id:type' END,
  CASE WHEN k > 50 THEN '$.in.k:maximum' END, CASE WHEN k IS NULL THEN '$.in:required:k' END,
  CASE WHEN event_id % 4 <> 0 AND event_type NOT IN ('click', 'view') THEN '$.kind:enum' END,
  CASE WHEN length('u' || user_id) > 3 THEN '$.name:maxLength' END,
  CASE WHEN t = 2 THEN '$.tags:maxItems' END, CASE WHEN t = 3 THEN '$.tags:type' END, CASE WHEN t = 1 THEN '$.tags:uniqueItems' END,
  CASE WHEN event_id % 9 = 0 THEN '$:additionalProperties' END, CASE WHEN event_id % 4 = 0 THEN '$:required:kind' END) END AS violations FROM e)
SELECT * FROM v WHERE violations <> ''"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a corpus: toxic ones are to be blocked, poor ones reviewed; an attack has one or two spans."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    disposition = F.when(F.col("toxic") == 1, "block").when(F.col("quality") == 0, "review").otherwise("allow")
    span = lambda c: F.struct(c.alias("category"), F.substring("text", 1, 5).alias("text"))
    spans = F.when(disposition == "allow", F.array().cast("array<struct<category:string,text:string>>")).when(k % 3 == 0, F.array(span(F.concat(F.lit("cat_"), disposition)), span(F.lit("cat_any")))).otherwise(F.array(span(F.concat(F.lit("cat_"), disposition))))
    return rows.select(k.cast("string").alias("id"), _pick(benchmark.PARTITIONS, k).alias("partition"), F.col("text").alias("content"), disposition.alias("expected_disposition"), spans.alias("spans"))


_SAMPLES = """s AS (SELECT doc_id::VARCHAR AS id, ['train','calibration','frozen_test'][doc_id % 3 + 1] AS part, text AS content, CASE WHEN toxic = 1 THEN 'block' WHEN quality = 0 THEN 'review' ELSE 'allow' END AS d, doc_id FROM documents JOIN labels USING (doc_id)),
sp AS (SELECT id, part, content, d, 'cat_' || d AS category, left(content, 5) AS text FROM s WHERE d <> 'allow' UNION ALL SELECT id, part, content, d, 'cat_any', left(content, 5) FROM s WHERE d <> 'allow' AND doc_id % 3 = 0)"""
_WORDS = ("idiot", "pathetic", "worthless", "stupid", "THE ")


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition's rates by category, with the gates of a release."""
    return benchmark.report(_samples(spark, sf_dir), benchmark.detected(F.col("content"), _WORDS), "train")


_HIT = " OR ".join(f"contains(lower(content), '{w.lower()}')" for w in _WORDS)
BENCHMARK_REPORT = f"""WITH {_SAMPLES}, r AS (SELECT 'attack_block_rate' AS measure, '' AS category, count(*) AS samples, count(*) FILTER ({_HIT}) AS detected FROM s WHERE part = 'train' AND d <> 'allow'
UNION ALL SELECT 'benign_false_positive', '', count(*), count(*) FILTER ({_HIT}) FROM s WHERE part = 'train' AND d = 'allow'
UNION ALL SELECT 'recall', category, count(*), count(*) FILTER ({_HIT}) FROM sp WHERE part = 'train' GROUP BY 2),
g AS (SELECT *, CASE WHEN samples = 0 THEN 10000 ELSE floor(detected / samples * 10000 + 0.5)::BIGINT END AS rate_bps FROM r),
p AS (SELECT *, CASE measure WHEN 'attack_block_rate' THEN rate_bps >= 8000 WHEN 'recall' THEN rate_bps >= 7000 ELSE samples = 0 OR rate_bps <= 1000 END AS pass FROM g)
SELECT * FROM p UNION ALL SELECT 'gates', '', count(*), count(*) FILTER (pass), floor(count(*) FILTER (pass) / count(*) * 10000 + 0.5)::BIGINT, bool_and(pass) FROM p"""


def benchmark_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with that corpus under a taxonomy that knows two of its categories."""
    taxonomy = spark.createDataFrame([("cat_block", "block", ["T1"]), ("cat_any", "review", ["T2", "T3"])], "category string, default_disposition string, threats array<string>")
    return benchmark.violations(_samples(spark, sf_dir), taxonomy, ("cat_block", "benign_control", "cat_none"), ("T1", "T4"))


BENCHMARK_CORPUS = f"""WITH {_SAMPLES}, t(category, dd) AS (VALUES ('cat_block', 'block'), ('cat_any', 'review')), j AS (SELECT sp.*, dd FROM sp LEFT JOIN t ON sp.category = t.category)
SELECT 'duplicate_content' AS "check", max(id) AS subject FROM s GROUP BY content HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'invalid_span', id FROM j WHERE dd IS NULL OR NOT contains(content, text)
UNION ALL SELECT DISTINCT 'unexpected_disposition', id FROM j WHERE d <> dd
UNION ALL SELECT 'missing_category', c FROM (VALUES ('cat_block'), ('benign_control'), ('cat_none')) AS v(c) WHERE c NOT IN (SELECT category FROM sp UNION ALL SELECT 'benign_control' FROM s WHERE d = 'allow')
UNION ALL SELECT 'missing_threat', c FROM (VALUES ('T1'), ('T4')) AS v(c) WHERE c NOT IN (SELECT unnest(CASE category WHEN 'cat_block' THEN ['T1'] WHEN 'cat_any' THEN ['T2', 'T3'] END) FROM sp)
UNION ALL SELECT 'empty_partition', c FROM (VALUES ('train'), ('calibration'), ('frozen_test')) AS v(c) WHERE c NOT IN (SELECT part FROM s)"""


def lab_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of protected and unprotected agents compared; days of events stand for runs."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("run_id")).agg(F.count_if(F.col("event_type") != "view").alias("protected_blocked"), F.count_if(F.col("event_type") == "click").alias("baseline_blocked"), F.count_if(F.dayofmonth("ts") % 6 != 0).alias("total"))
    return benchmark.comparison(e)


LAB_SUMMARY = """WITH r AS (SELECT ts::DATE::VARCHAR AS run_id, count(*) FILTER (event_type <> 'view') AS p, count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (day(ts) % 6 <> 0) AS n FROM events GROUP BY 1)
SELECT run_id, CASE WHEN n > 0 THEN p / n END AS protected_rate, CASE WHEN n > 0 THEN b / n END AS baseline_rate, CASE WHEN n > 0 THEN round(p / n - b / n, 6) END AS delta, CASE WHEN n = 0 THEN 'BENCHMARK_EMPTY' END AS error FROM r"""


def capsule_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capsules of the processed scans: canonical JSON and its digest."""
    decided, found = intake.process(_scans(spark, sf_dir), RULES)
    scans = decided.where("outcome = 'processed'").select("scan_id", F.lit("ws_own").alias("workspace_id"), F.concat(F.lit("sha256:in"), F.col("scan_id").cast("string")).alias("input_digest"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), "state")
    return capsule.compose(scans, found, "policy-1", "engine-1")


_FOUND_JSON = """'{"category":"' || CASE reason_code WHEN 'DIRECT_INSTRUCTION_OVERRIDE' THEN 'direct_prompt_injection' WHEN 'INDIRECT_INSTRUCTION_OVERRIDE' THEN 'indirect_prompt_injection' WHEN 'SOURCE_IMPERSONATION' THEN 'source_mismatch' ELSE 'other' END
  || '","confidence_bps":10000,"detector_id":"' || rule_id || '","location":{"representation":"canonical","text_end":' || "end" || ',"text_start":' || "start" || '},"reason_code":"' || reason_code || '","severity":"' || severity || '"}'"""
CAPSULE_COMPOSE = f"""WITH {_PROCESSED}, l AS (SELECT id, string_agg({_FOUND_JSON}, ',' ORDER BY "start", rule_id) AS items FROM found GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN 1 ELSE coalesce(worst, 0) END AS worst, CASE WHEN doc_id % 9 = 0 OR text IS NULL THEN '{{"category":"policy_failure","detector_id":"processing.v1","location":{{"representation":"metadata"}},"reason_code":"INPUT_REQUIRES_REVIEW","severity":"medium"}}' ELSE coalesce(items, '') END AS items
  FROM documents LEFT JOIN w ON w.id = doc_id LEFT JOIN l ON l.id = doc_id WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0),
c AS (SELECT doc_id AS scan_id, '{{"as_of":"2024-01-01T00:00:00Z","claims":[],"components":["engine-1"],"conflicts":[],"created_at":"2024-01-01T00:00:00Z","disposition":"' || ['allow', 'review', 'block'][worst + 1] || '","evidence":[],"findings":[' || items
  || '],"input_digest":"sha256:in' || doc_id || '","policy":"policy-1","scan_id":' || doc_id || ',"schema_version":"1.0","workspace_id":"ws_own"}}' AS capsule FROM d)
SELECT *, 'sha256:' || sha256(capsule) AS digest FROM c"""


def verdict_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with their first reason, the next step, and a preview without angle brackets."""
    k = F.col("page_id")
    disposition = _pick(("allow", "review", "block"), k)
    reasons = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("FIRST"), F.lit("SECOND")))
    x = capsule.explanation(disposition, reasons, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", x.alias("x")).select("page_id", "x.*")


VERDICT_EXPLAINED = """SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 'FIRST' WHEN page_id % 3 = 0 THEN 'POLICY_PASSED' ELSE 'POLICY_EVALUATION_FAILED' END AS primary_reason, ['release', 'request_review', 'blocked'][page_id % 3 + 1] AS next_action, left(regexp_replace(coalesce(html, ''), '[<>]', '', 'g'), 280) AS preview FROM pages"""


def agent_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a protected and an unprotected agent receive of the same texts."""
    k = F.col("turn") % 4
    x = capsule.agent_delivery(F.when(k < 3, _pick(("allow", "review", "block"), k)), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select(x.alias("x"), "text")
    return rows.groupBy(F.col("x.state").alias("state"), F.col("x.passes").alias("passes")).agg(F.count("*").alias("n"), F.sum(F.char_length("x.context")).alias("protected_chars"), F.sum(F.char_length("text")).alias("unprotected_chars"))


AGENT_DELIVERIES = """SELECT ['delivered', 'review', 'withheld', 'pending'][turn % 4 + 1] AS state, turn % 4 = 0 AS passes, count(*) AS n, sum(CASE WHEN turn % 4 = 0 THEN length(text) ELSE 10 END)::BIGINT AS protected_chars, sum(length(text))::BIGINT AS unprotected_chars FROM conversations GROUP BY ALL"""


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signing keys of capsules by id and algorithm."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).alias("key_id"), F.when(F.col("o_orderkey") % 7 == 0, "rsa").otherwise("ed25519").alias("algorithm"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key_id"), F.lit("ed25519").alias("algorithm"), F.when(F.col("n_nationkey") % 5 == 0, "revoked").otherwise("active").alias("status"))
    return capsule.key_of(o, n.unionByName(n.where("key_id % 9 = 1")))


KEY_LOOKUP = """SELECT o_orderkey, o_orderkey % 40 AS key_id, CASE WHEN o_orderkey % 7 = 0 THEN 'rsa' ELSE 'ed25519' END AS algorithm,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 40 NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown' WHEN o_orderkey % 40 % 9 = 1 THEN 'ambiguous' WHEN o_orderkey % 40 % 5 = 0 THEN 'revoked' ELSE 'found' END AS key_state FROM orders"""


def account_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts' assets made of order lines: some with a balance, some with parts, some invalid."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("account_id"), F.when((k % 29 == 0) & (n == 1), "bad name!").otherwise(F.concat(F.lit(" coin"), F.when(k % 31 == 0, F.lit(1)).otherwise(n).cast("string"))).alias("coin"), F.when(k % 3 == 0, F.concat((q - 10).cast("string"), F.lit(".500"))).alias("balance"), F.when((k % 3 == 1) | (k % 37 != 0), q.cast("string")).alias("available"), F.when(n % 2 == 0, F.lit("0.25")).alias("frozen"), F.lit("x").alias("locked"))
    return listing.holdings(rows)


ACCOUNT_HOLDINGS = """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity::BIGINT AS q FROM lineitem),
p AS (SELECT k, CASE WHEN NOT (k % 29 = 0 AND n = 1) THEN 'COIN' || CASE WHEN k % 31 = 0 THEN 1 ELSE n END END AS asset, CASE WHEN k % 3 = 0 THEN (q - 10) || '.500' END AS bal,
  CASE WHEN k % 3 = 1 OR k % 37 <> 0 THEN q END AS av, CASE WHEN n % 2 = 0 THEN '.25' END AS fr FROM r),
g AS (SELECT k, asset, count(*) AS n, min(coalesce(bal, CASE WHEN av IS NOT NULL THEN av || coalesce(fr, '') WHEN fr IS NOT NULL THEN '0.25' END)) AS q, count(*) FILTER (bal IS NULL AND av IS NULL AND fr IS NULL) AS bad FROM p GROUP BY 1, 2),
e AS (SELECT k, CASE WHEN bool_or(asset IS NULL) THEN 'INVALID_IDENTIFIER' WHEN max(n) > 1 THEN 'DUPLICATE_ASSET' WHEN sum(bad) > 0 THEN 'INVALID_BALANCE' END AS error FROM g GROUP BY 1)
SELECT g.k AS account_id, asset, q AS quantity, NULL::VARCHAR AS error FROM g JOIN e ON g.k = e.k WHERE error IS NULL AND q::DECIMAL(18, 3) > 0
UNION ALL SELECT k, NULL, NULL, error FROM e WHERE error IS NOT NULL"""


def instrument_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments made of parts: kind, underlying symbol, status, and symbols that occur again."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (k % 1_900).cast("string"), F.when(k % 43 == 0, "?").otherwise("")).alias("symbol"), F.concat(F.when(k % 4 == 0, "rAb").otherwise("c"), (k % 5).cast("string")).alias("base_coin"), F.lit(" usdt ").alias("quote_coin"), F.when(k % 11 == 0, "YES").alias("is_reality"), F.when(k % 3 != 2, _pick(("stock", "crypto"), k)).otherwise(F.when(k % 2 == 0, "fund")).alias("symbol_type"), _pick(("Online", "offline", "halted"), k).alias("status"))
    return listing.instruments(rows)


INSTRUMENT_CATALOGUE = """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 43 <> 0 THEN 'S' || p_partkey % 1900 END AS symbol, CASE WHEN p_partkey % 4 = 0 THEN 'RAB' ELSE 'C' END || p_partkey % 5 AS base, CASE WHEN p_partkey % 3 <> 2 THEN ['stock', 'crypto'][p_partkey % 2 + 1] WHEN p_partkey % 2 = 0 THEN 'fund' ELSE '' END AS t FROM part),
x AS (SELECT *, CASE WHEN k % 11 = 0 OR (t = 'stock' AND base LIKE 'R%') THEN 'rtoken' WHEN t IN ('crypto', '') THEN 'crypto' ELSE 'other' END AS kind FROM r)
SELECT symbol, base, 'USDT' AS quote, kind, ['online', 'offline', 'unknown'][k % 3 + 1] AS status, CASE WHEN kind = 'rtoken' AND base LIKE 'R%' THEN base[2:] END AS underlying, symbol IS NOT NULL AND count(*) OVER (PARTITION BY symbol) > 1 AS duplicate FROM x"""


def watchlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' distinct instruments in order; one has too many entries, some a bad name."""
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(k).alias("owner"), F.when((k % 17 == 0) & (F.col("o_orderkey") % 3 != 0), "no name").otherwise(F.concat(F.lit(" i"), (F.col("o_orderkey") % 9).cast("string"))).alias("instrument"))
    return listing.watchlist(rows, "owner")


WATCHLISTS = """WITH r AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS owner, CASE WHEN NOT (o_custkey % 17 = 0 AND o_orderkey % 3 <> 0) THEN 'I' || o_orderkey % 9 END AS instrument FROM orders),
e AS (SELECT owner, CASE WHEN count(*) > 500 THEN 'TOO_MANY' WHEN bool_or(instrument IS NULL) THEN 'INVALID_IDENTIFIER' END AS error FROM r GROUP BY 1)
SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY instrument)::INTEGER AS place, instrument, NULL::VARCHAR AS error FROM (SELECT DISTINCT r.owner, instrument FROM r JOIN e ON r.owner = e.owner WHERE error IS NULL)
UNION ALL SELECT owner, NULL, NULL, error FROM e WHERE error IS NOT NULL"""
TRACES = ("00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01", " 00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-00 ", "00-00000000000000000000000000000000-b7ad6b7169203331-01", "01-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01", "00-0af7651916cd43dd8448eb211c80319c-0000000000000000-01", "junk")


def traceparents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace headers of events."""
    text = _pick(TRACES, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", delivery.traceparent(text).alias("t")).where("t is not null").groupBy("t.trace_id", "t.parent_id", "t.flags").agg(F.count("*").alias("n"))


TRACEPARENTS = """SELECT '0af7651916cd43dd8448eb211c80319c' AS trace_id, 'b7ad6b7169203331' AS parent_id, CASE event_id % 6 WHEN 0 THEN '01' ELSE '00' END AS flags, count(*) AS n FROM events WHERE event_id % 6 IN (0, 1) GROUP BY 3"""


def two_level_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests under the windows of a workspace and of a key in it; a suspended workspace gets none."""
    k = F.col("user_id")
    e = table(spark, sf_dir, "events").select((k % 20).alias("workspace"), k.alias("key"), "event_id", F.unix_millis("ts").alias("at"), (k % 20 == 3).alias("suspended"))
    return ops.two_level_windows(e, "workspace", "key", "at", "event_id", 43_200_000, 12, 2, "suspended")


def _window_sql(name: str, by: str) -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ms, event_id) AS n FROM open),
{name} AS (SELECT {by} AS g, event_id, n, ms AS start, 1::BIGINT AS hit FROM {name}0 WHERE n = 1 UNION ALL
  SELECT x.{by}, x.event_id, x.n, CASE WHEN {name}.start + 43200000 <= x.ms THEN x.ms ELSE {name}.start END, CASE WHEN {name}.start + 43200000 <= x.ms THEN 1 ELSE {name}.hit + 1 END FROM {name} JOIN {name}0 x ON x.{by} = {name}.g AND x.n = {name}.n + 1)"""


TWO_LEVEL_LIMIT = f"""WITH RECURSIVE e AS (SELECT user_id % 20 AS workspace, user_id AS key, event_id, epoch_us(ts) // 1000 AS ms FROM events), open AS (SELECT * FROM e WHERE workspace <> 3), {_window_sql("a", "workspace")}, {_window_sql("b", "key")},
f AS (SELECT e.*, greatest(CASE WHEN a.hit > 12 THEN a.start + 43200000 END, CASE WHEN b.hit > 2 THEN b.start + 43200000 END) AS full_ FROM e LEFT JOIN a ON a.event_id = e.event_id LEFT JOIN b ON b.event_id = e.event_id)
SELECT workspace, key, event_id, workspace <> 3 AND full_ IS NULL AS allowed, CASE WHEN workspace = 3 THEN 'suspended' WHEN full_ IS NOT NULL THEN 'quota' END AS reason, CASE WHEN workspace <> 3 AND full_ IS NOT NULL THEN greatest(1, ceil((full_ - ms) / 1000.0))::BIGINT END AS retry_after_s FROM f"""


def key_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose scopes are 1 to 32 known ones."""
    k = F.col("c_custkey").cast("int")
    scopes = F.slice(F.array(*map(F.lit, access.ACTIONS), F.lit("scan.everything")), k % 24 + 1, k % 3)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(scopes, ",").alias("scopes"), access.scopes_valid(scopes).alias("valid"))


KEY_SCOPES = f"""WITH s AS (SELECT c_custkey, ({_list((*access.ACTIONS, "scan.everything"))})[c_custkey % 24 + 1:c_custkey % 24 + c_custkey % 3] AS x FROM customer)
SELECT c_custkey, array_to_string(x, ',') AS scopes, len(x) BETWEEN 1 AND 32 AND NOT list_contains(x, 'scan.everything') AS valid FROM s"""


def first_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers asking for workspaces: the first of each that has no member yet becomes its owner."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("workspace"), F.col("s_suppkey").alias("member"))
    return workqueue.insert_unless_any(s, s.where("member % 7 = 0"), "workspace", "member")


FIRST_OWNERS = "SELECT s_nationkey AS workspace, min(s_suppkey) AS member FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 7 = 0) GROUP BY 1"


def results_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with columns taken over from their customers, where these have them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("label"))
    return workqueue.update_from(o, c, "k", ["label"])


RESULTS_BACKFILLED = "SELECT o_orderkey, o_custkey AS k, coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, o_orderstatus) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0"


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's row, and that there is one only: once found, once missing, once broken."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return workqueue.lookup(n, "n_nationkey", 7).unionByName(workqueue.lookup(n, "n_nationkey", 99)).unionByName(workqueue.lookup(n, "n_regionkey", 1))


POINT_LOOKUP = "SELECT 'one' AS found, n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'none', NULL, NULL UNION ALL SELECT 'several', NULL, NULL"


def service_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of service accounts: an inner join by account and workspace."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return p.select("p_partkey", (F.col("p_partkey") % 120).alias("account"), (F.col("p_partkey") % 25).alias("workspace")).join(s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("account"), F.col("s_nationkey").alias("workspace")), ["account", "workspace"])


SERVICE_SESSIONS = "SELECT p_partkey, p_partkey % 120 AS account, p_partkey % 25 AS workspace FROM part JOIN supplier ON s_suppkey = p_partkey % 120 AND s_nationkey = p_partkey % 25 WHERE s_acctbal > 0"


def identity_workspaces(spark: SparkSession, sf_dir: str, provider: str = "BUILDING", digest: str = "d7") -> DataFrame:
    """The table function of an identity, known by provider and digest together: its active workspaces in order."""
    c = table(spark, sf_dir, "customer").withColumn("digest", F.concat(F.lit("d"), (F.col("c_custkey") % 20).cast("string")))
    own = c.where((F.col("c_mktsegment") == provider) & (F.col("digest") == digest) & (F.col("c_acctbal") > 0))
    return own.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("workspace")).agg(F.min("c_custkey").alias("identity"))


IDENTITY_WORKSPACES = "SELECT n_name AS workspace, min(c_custkey) AS identity FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_custkey % 20 = 7 AND c_acctbal > 0 GROUP BY 1"


def charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in three charsets decoded; bytes that are none of theirs are refused."""
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("t"), _pick(("utf-8", "utf-16le", "utf-16be"), F.col("page_id")).alias("charset"))
    raw = F.when(F.col("charset") == "utf-8", F.encode("t", "UTF-8")).when(F.col("charset") == "utf-16le", F.encode("t", "UTF-16LE")).otherwise(F.encode("t", "UTF-16BE"))
    raw = F.when(F.col("page_id") % 10 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    return p.select("page_id", "charset", T.decoded(raw, F.col("charset")).alias("d")).select("page_id", "charset", F.col("d").isNotNull().alias("decoded"), T.digest(F.col("d").cast("binary")).alias("digest"))


CHARSET_DECODE = "SELECT page_id, ['utf-8', 'utf-16le', 'utf-16be'][page_id % 3 + 1] AS charset, page_id % 10 <> 0 AS decoded, CASE WHEN page_id % 10 <> 0 THEN 'sha256:' || sha256(coalesce(html, '')) END AS digest FROM pages"


def visual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings besides a text's own, made of pages' ids."""
    k = F.col("page_id").cast("int")
    meta = F.create_map(F.lit("a"), F.when(k % 3 == 0, " ").otherwise("x"), F.lit("b"), F.when(k % 2 == 0, "y").otherwise(""))
    found = capsule.visual_disagreement(F.col("html"), F.when(k % 5 == 0, F.concat("html", F.lit("!"))).when(k % 5 == 1, F.col("html")), F.sequence(F.lit(1), k % 3 + 1), meta)
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


VISUAL_FINDINGS = """SELECT 'css_hidden' AS kind, sum(page_id % 3 + 1)::BIGINT AS n FROM pages UNION ALL SELECT 'metadata_payload', (count(*) FILTER (page_id % 3 <> 0) + count(*) FILTER (page_id % 2 = 0)) FROM pages
UNION ALL SELECT 'visual_text_disagreement', count(*) FROM pages WHERE page_id % 5 = 0 AND html IS NOT NULL"""

QUERIES = (
    scan_transitions, ingestion_accept, scan_process, scan_findings, lease_check, job_heartbeat, job_complete, job_cancel, job_enqueue, delivery_settle, delivery_replay, delivery_enqueue, webhook_endpoints, url_outcomes,
    secret_forms, safe_records, sanitized_json, forbidden_keys, classifier_outputs, contract_schema, benchmark_report, benchmark_corpus, lab_summary, capsule_compose, verdict_explained, agent_deliveries, key_lookup,
    account_holdings, instrument_catalogue, watchlists, traceparents, two_level_limit, key_scopes, first_owners, results_backfilled, point_lookup, service_sessions, identity_workspaces, charset_decode, visual_findings,
)
