"""Queries of evidence, portfolios, queues, access and operations over the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, evidence, ops, portfolio, workqueue
from ..functions import text as T
from ..session import table, workspace_scope

AS_OF = "2024-01-25T00:00:00Z"
NOW = "1997-01-01 00:00:00"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence: a correction is the event 7 ids after the one it corrects, on every eleventh id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("claim_type"), F.when(F.col("event_id") % 2 == 0, "exchange").otherwise("issuer_ir").alias("source_type"),
        F.when(F.col("event_id") % 97 != 0, F.col("ts")).alias("published_at"), F.when(F.col("event_id") % 11 == 0, F.col("event_id") - 7).alias("corrects"), "value", F.when(F.col("event_id") % 3 != 0, F.lit("USD")).alias("currency"), F.date_format("ts", "yyyy-MM-dd HH").alias("period"),
    )


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.timeline(_evidence(spark, sf_dir), AS_OF, 10 * 86_400_000, {"purchase": 3 * 86_400_000, "click": 20 * 86_400_000}, {"exchange": 5 * 86_400_000})


def evidence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each piece of evidence at an instant."""
    return _timeline(spark, sf_dir).select("id", "state", "reason")


_TIMELINE = """e AS (SELECT event_id AS id, user_id::VARCHAR AS entity, event_type AS claim_type, CASE WHEN event_id % 2 = 0 THEN 'exchange' ELSE 'issuer_ir' END AS source_type,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS published_at, CASE WHEN event_id % 11 = 0 THEN event_id - 7 END AS corrects, value, CASE WHEN event_id % 3 <> 0 THEN 'USD' END AS currency, strftime(ts, '%Y-%m-%d %H') AS period FROM events),
b AS (SELECT *, coalesce(CASE claim_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 20 END, CASE source_type WHEN 'exchange' THEN 5 END, 10) AS days,
  CASE WHEN published_at IS NULL THEN 'invalid' WHEN published_at > TIMESTAMP '2024-01-25' THEN 'future' ELSE 'current' END AS basis FROM e),
s AS (SELECT *, CASE WHEN basis <> 'current' THEN basis WHEN id IN (SELECT corrects FROM b WHERE basis = 'current' AND corrects IS NOT NULL) THEN 'superseded'
  WHEN TIMESTAMP '2024-01-25' - published_at > to_days(days::INTEGER) THEN 'stale' ELSE 'current' END AS state FROM b)"""
EVIDENCE_TIMELINE = f"""WITH {_TIMELINE} SELECT id, state, CASE state WHEN 'invalid' THEN 'PUBLISHED_AT_INVALID' WHEN 'future' THEN 'PUBLISHED_AFTER_AS_OF' WHEN 'superseded' THEN 'CORRECTED_BY_NEWER_EVIDENCE'
  WHEN 'stale' THEN 'FRESHNESS_WINDOW_EXCEEDED' ELSE '' END AS reason FROM s"""


def evidence_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current evidence that disagrees about the same entity, claim, period and currency."""
    return evidence.contradictions(_timeline(spark, sf_dir).where("state = 'current'"))


EVIDENCE_CONTRADICTIONS = f"""WITH {_TIMELINE} SELECT a.id AS first_id, b.id AS second_id FROM s a JOIN s b ON a.entity = b.entity AND a.claim_type = b.claim_type AND a.period = b.period
  AND a.currency IS NOT DISTINCT FROM b.currency AND a.id < b.id AND a.value <> b.value WHERE a.state = 'current' AND b.state = 'current'"""


def claim_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about orders' numbers of lines, with lines as evidence; some lines claim another number or currency."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    claims = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("entity"), F.when(F.col("o_orderkey") % 10 != 0, F.col("n").cast("double")).alias("value"), F.lit("USD").alias("currency"), (F.col("o_orderkey") % 7 == 0).alias("ambiguous"), (F.col("o_orderkey") % 9 != 0).alias("type_matches")
    )
    proof = li.join(lines, "l_orderkey").select(F.col("l_orderkey").alias("entity"), F.when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 2 == 0), 0.0).otherwise(F.col("n").cast("double")).alias("value"), F.when(F.col("l_linenumber") == 2, "EUR").alias("currency"), (F.col("l_returnflag") == "A").alias("primary"))
    return evidence.quorum(claims, proof, 2, True)


CLAIM_QUORUM = """WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN n END AS v FROM orders LEFT JOIN n ON o_orderkey = l_orderkey),
p AS (SELECT l.l_orderkey AS k, CASE WHEN l_linenumber = 3 AND l.l_orderkey % 2 = 0 THEN 0 ELSE n END AS v, l_linenumber = 2 AS eur, l_returnflag = 'A' AS a FROM lineitem l JOIN n ON l.l_orderkey = n.l_orderkey),
q AS (SELECT id, any_value(c.v) AS v, count(*) FILTER (p.v = c.v AND NOT eur) AS s, count(*) FILTER (p.v <> c.v) AS x, coalesce(bool_or(p.v = c.v AND NOT eur AND a), false) AS prim FROM c LEFT JOIN p ON c.id = p.k GROUP BY id)
SELECT id AS claim_id, CASE WHEN id % 7 = 0 OR v IS NULL OR id % 9 = 0 THEN 0 ELSE s END AS supporting, CASE WHEN id % 7 = 0 OR v IS NULL OR id % 9 = 0 THEN 0 ELSE x END AS contradicting,
  CASE WHEN id % 7 = 0 THEN 'ambiguous' WHEN v IS NULL OR id % 9 = 0 THEN 'pending' WHEN x > 0 THEN 'contradicted' WHEN s >= 2 AND prim THEN 'verified' ELSE 'unsupported' END AS state FROM q"""


def _portfolio(spark: SparkSession, sf_dir: str):
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    instruments = p.select(key.alias("instrument_id"), F.concat(F.lit("P"), key).alias("symbol"), F.concat(F.lit("B"), key % 300).alias("base_asset"), F.when(key % 3 == 0, "USDT").otherwise("EUR").alias("quote_asset"), F.when(key % 4 == 0, F.concat(F.lit("U"), key % 50)).alias("underlying_symbol"))
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ref"), F.concat(F.element_at(F.array(*map(F.lit, ("$p", " b", "u"))), (F.col("s_suppkey") % 3 + 1).cast("int")), F.col("s_suppkey") % 60).alias("symbol"), ((F.col("s_suppkey") % 10 + 1) / 10).alias("confidence"))
    holdings = table(spark, sf_dir, "lineitem").where("l_partkey % 5 = 0").select(F.concat(F.lit("b"), F.col("l_partkey") % 300).alias("asset")).distinct()
    watch = p.where("p_partkey % 6 = 0").select(F.concat(F.lit("p"), key).alias("instrument"))
    return refs, instruments, holdings, watch


def portfolio_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments that events touch, held or watched."""
    return portfolio.impacts(*_portfolio(spark, sf_dir))


PORTFOLIO_IMPACT = """WITH i AS (SELECT p_partkey AS iid, 'P' || p_partkey AS symbol, 'B' || p_partkey % 300 AS base, p_partkey % 3 = 0 AS usdt, CASE WHEN p_partkey % 4 = 0 THEN 'U' || p_partkey % 50 END AS under FROM part),
r AS (SELECT s_suppkey AS ref, ['P','B','U'][s_suppkey % 3 + 1] || s_suppkey % 60 AS sym, (s_suppkey % 10 + 1) / 10.0::DOUBLE AS conf FROM supplier),
t AS (SELECT ref, conf, i.*, 0 AS tier, 0 AS oq, 'exact_instrument' AS basis, 1.0::DOUBLE AS w FROM r JOIN i ON symbol = sym
  UNION ALL SELECT ref, conf, i.*, 1, CASE WHEN usdt THEN 0 ELSE 1 END, 'base_asset', 0.98::DOUBLE FROM r JOIN i ON base = sym
  UNION ALL SELECT ref, conf, i.*, 2, CASE WHEN usdt THEN 0 ELSE 1 END, 'rtoken_underlying', 0.9::DOUBLE FROM r JOIN i ON under = sym),
b AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY ref ORDER BY tier, oq) AS rk FROM t) WHERE rk = 1),
h AS (SELECT DISTINCT 'B' || l_partkey % 300 AS base FROM lineitem WHERE l_partkey % 5 = 0), wl AS (SELECT 'P' || p_partkey AS x FROM part WHERE p_partkey % 6 = 0),
m AS (SELECT *, floor(conf * w * 10000 + 0.5) / 10000 AS c, CASE WHEN base IN (SELECT base FROM h) THEN 'holding' WHEN symbol IN (SELECT x FROM wl) OR base IN (SELECT x FROM wl) OR under IN (SELECT x FROM wl) THEN 'watchlist' END AS rel FROM b)
SELECT symbol AS instrument, rel AS relationship, c AS mapping_confidence, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.65 THEN 'medium' ELSE 'low' END AS confidence_band, basis AS mapping_basis
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE rel WHEN 'holding' THEN 0 ELSE 1 END, CASE rel WHEN 'holding' THEN -c END, CASE rel WHEN 'holding' THEN ref ELSE -ref END, iid) AS n FROM m WHERE rel IS NOT NULL) WHERE n = 1"""


def holdings_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal sums by supplier, zeros at the end stripped."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round("l_quantity", 2).cast("decimal(20,2)")).alias("q"))
    return li.select("l_suppkey", F.regexp_replace(F.regexp_replace(F.col("q").cast("string"), "(\\.\\d*?)0+$", "$1"), "\\.$", "").alias("quantity"))


HOLDINGS_SUM = "SELECT l_suppkey, rtrim(rtrim(sum(round(l_quantity, 2)::DECIMAL(20,2))::VARCHAR, '0'), '.') AS quantity FROM lineitem GROUP BY 1"


def duplicate_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that occur more than once, which an import reports as errors."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


DUPLICATE_ASSETS = "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders after a cursor."""
    return ops.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 500, 25)


KEYSET_PAGE = """WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 26)
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN (SELECT count(*) FROM r) > 25 THEN (SELECT o_orderkey FROM r WHERE n = 25) END AS next_cursor FROM r WHERE n <= 25"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, at = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    state = F.when(F.col("o_orderstatus") == "O", "available").when(F.col("o_orderstatus") == "F", "leased").otherwise("retry_wait")
    days = lambda n: at + F.make_dt_interval(n)
    return o.select(
        k.alias("job_id"), F.col("o_orderpriority").alias("queue"), state.alias("state"), (k % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), at.alias("available_at"), at.alias("created_at"), days((k % 2000).cast("int")).alias("deadline_at"),
        ((k % 50 + 1) * 1000).alias("timeout_ms"), F.when(state == "leased", days((k % 1500).cast("int"))).alias("lease_expires_at"), F.when((state == "leased") & (k % 3 != 0), days((k % 1700).cast("int"))).alias("execution_expires_at"),
        F.when(k % 13 == 0, at).alias("cancel_requested_at"), F.element_at(F.array(*map(F.lit, ("JOB_DEPENDENCY_UNAVAILABLE", "JOB_HANDLER_FAILED", "JOB_CANCELLED"))), (k % 3 + 1).cast("int")).alias("error_code"), (k % 3 == 0).alias("retryable"),
    )


_JOBS = """j AS (SELECT o_orderkey AS job_id, o_orderpriority AS queue, CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'F' THEN 'leased' ELSE 'retry_wait' END AS state, o_orderkey % 4 AS attempt, o_orderdate AS available_at,
  o_orderdate + to_days((o_orderkey % 2000)::INTEGER) AS deadline_at, (o_orderkey % 50 + 1) * 1000 AS timeout_ms, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days((o_orderkey % 1500)::INTEGER) END AS lease_at,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN o_orderdate + to_days((o_orderkey % 1700)::INTEGER) END AS exec_at, o_orderkey % 13 = 0 AS cancel,
  ['JOB_DEPENDENCY_UNAVAILABLE','JOB_HANDLER_FAILED','JOB_CANCELLED'][o_orderkey % 3 + 1] AS err, o_orderkey % 3 = 0 AS retryable, TIMESTAMP '1997-01-01' AS now,
  least(900000, 1000 * pow(2, (o_orderkey % 4) - 1))::BIGINT AS delay FROM orders)"""


def queue_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that each queue hands out next."""
    return workqueue.claim_next(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp"), 30_000)


QUEUE_CLAIM_NEXT = f"""WITH {_JOBS}, c AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY available_at, job_id) AS n FROM j WHERE state IN ('available', 'retry_wait') AND available_at <= now AND deadline_at > now AND attempt < 3),
x AS (SELECT *, least(now + to_milliseconds(timeout_ms), deadline_at) AS ends FROM c WHERE n = 1)
SELECT queue, job_id, attempt + 1 AS attempt, 'leased' AS state, ends AS execution_expires_at, least(now + INTERVAL 30 SECOND, ends) AS lease_expires_at FROM x"""


def queue_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reaper settles in one queue, 100 jobs at most."""
    jobs = _jobs(spark, sf_dir).where("queue = '1-URGENT'")
    return workqueue.reap(jobs, F.lit(NOW).cast("timestamp"), 100)


QUEUE_REAP = f"""WITH {_JOBS}, q AS (SELECT * FROM j WHERE queue = '1-URGENT'),
a AS (SELECT *, 0 AS turn FROM q WHERE state IN ('available', 'retry_wait') AND deadline_at <= now ORDER BY deadline_at, job_id LIMIT 100),
l AS (SELECT *, row_number() OVER (ORDER BY lease_at, job_id) AS n FROM q WHERE state = 'leased' AND (lease_at <= now OR exec_at <= now OR deadline_at <= now)),
b AS (SELECT *, NOT (deadline_at <= now) AND attempt < 3 AND now + to_milliseconds(delay) < deadline_at AND NOT cancel AS retry FROM l WHERE n <= 100 - (SELECT count(*) FROM a)),
c AS (SELECT job_id, CASE WHEN retry THEN 'retry_wait' WHEN cancel THEN 'cancelled' ELSE 'dead_lettered' END AS state,
  CASE WHEN cancel AND NOT retry THEN 'JOB_CANCELLED' WHEN deadline_at <= now THEN 'JOB_DEADLINE_EXCEEDED' WHEN coalesce(exec_at <= now, false) THEN 'JOB_HANDLER_TIMEOUT' ELSE 'JOB_LEASE_EXPIRED' END AS code, available_at, now, delay, 1 AS turn FROM b
  UNION ALL SELECT job_id, 'dead_lettered', 'JOB_DEADLINE_EXCEEDED', available_at, now, delay, 0 FROM a)
SELECT job_id, state, code AS last_error_code, code IN ('JOB_HANDLER_TIMEOUT', 'JOB_LEASE_EXPIRED', 'JOB_DEPENDENCY_UNAVAILABLE', 'JOB_PAYLOAD_UNAVAILABLE') AS last_error_retryable,
  CASE WHEN state = 'retry_wait' THEN now + to_milliseconds(delay) ELSE available_at END AS available_at, CASE WHEN state <> 'retry_wait' THEN now END AS completed_at, turn FROM c"""


def queue_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leased jobs after their handlers failed."""
    return workqueue.fail(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp"))


QUEUE_FAIL = f"""WITH {_JOBS}, l AS (SELECT *, cancel OR err = 'JOB_CANCELLED' AS gone, now + to_milliseconds(delay) AS retry_at FROM j WHERE state = 'leased'),
c AS (SELECT *, retryable AND attempt < 3 AND retry_at < deadline_at AS again FROM l),
s AS (SELECT *, CASE WHEN gone THEN 'cancelled' WHEN again THEN 'retry_wait' ELSE 'dead_lettered' END AS st, CASE WHEN gone THEN 'JOB_CANCELLED' WHEN again THEN err WHEN retry_at >= deadline_at THEN 'JOB_DEADLINE_EXCEEDED' ELSE err END AS code FROM c)
SELECT job_id, st AS state, code AS last_error_code, code = 'JOB_DEPENDENCY_UNAVAILABLE' AS last_error_retryable, CASE WHEN st = 'retry_wait' THEN retry_at ELSE available_at END AS available_at, CASE WHEN st <> 'retry_wait' THEN now END AS completed_at FROM s"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest dead letters, a page of 50."""
    dead = workqueue.fail(_jobs(spark, sf_dir).withColumn("completed_by", F.col("available_at")), F.lit(NOW).cast("timestamp")).where("state = 'dead_lettered'")
    return dead.orderBy(F.desc("available_at"), "job_id").limit(50).select("job_id", "last_error_code", "available_at")


DEAD_LETTERS = f"""WITH d AS ({QUEUE_FAIL}) SELECT job_id, last_error_code, available_at FROM d WHERE state = 'dead_lettered' ORDER BY available_at DESC, job_id LIMIT 50"""


def replay_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters put back as new jobs with a fresh attempt count."""
    dead = workqueue.fail(_jobs(spark, sf_dir), F.lit(NOW).cast("timestamp")).where("state = 'dead_lettered' and last_error_code <> 'JOB_DEADLINE_EXCEEDED'")
    return dead.select(F.concat(F.lit("replay-"), "job_id").alias("job_id"), F.col("job_id").alias("replay_of"), F.lit("available").alias("state"), F.lit(0).alias("attempt"), F.lit(NOW).cast("timestamp").alias("available_at"))


REPLAY_DEAD = f"""WITH d AS ({QUEUE_FAIL}) SELECT 'replay-' || job_id AS job_id, job_id AS replay_of, 'available' AS state, 0 AS attempt, TIMESTAMP '1997-01-01' AS available_at FROM d WHERE state = 'dead_lettered' AND last_error_code <> 'JOB_DEADLINE_EXCEEDED'"""


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested moves of jobs that the state machine allows, counted."""
    target = F.element_at(F.array(*map(F.lit, workqueue.MOVES)), (F.col("job_id") % len(workqueue.MOVES) + 1).cast("int"))
    return _jobs(spark, sf_dir).select("state", target.alias("target")).withColumn("allowed", workqueue.may_move(F.col("state"), F.col("target"))).groupBy("state", "target", "allowed").agg(F.count("*").alias("n"))


JOB_TRANSITIONS = f"""WITH {_JOBS}, t AS (SELECT state, ['available','leased','retry_wait','succeeded','dead_lettered','cancelled'][job_id % 6 + 1] AS target FROM j)
SELECT state, target, (state = 'available' AND target IN ('leased','cancelled','dead_lettered')) OR (state = 'leased' AND target NOT IN ('available')) OR (state = 'retry_wait' AND target IN ('leased','cancelled','dead_lettered')) AS allowed, count(*) AS n FROM t GROUP BY ALL"""


def delivery_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries that may go out now, in order under each key."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("delivered", "delivered", "delivered", "pending", "delivering", "retry"))), (k % 6 + 1).cast("int"))
    rows = e.select(k.alias("delivery_id"), F.when(k % 5 != 0, F.col("user_id")).alias("ordering_key"), F.when(k % 5 != 0, k).alias("sequence"), state.alias("state"), F.col("ts").alias("next_attempt_at"), F.when(state == "delivering", F.col("ts") + F.make_dt_interval((k % 20).cast("int"))).alias("lease_until"))
    return workqueue.claimable_deliveries(rows, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("delivery_id", "state", "ordering_key")


DELIVERY_CLAIMABLE = """WITH d AS (SELECT event_id AS delivery_id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS ordering_key, CASE WHEN event_id % 5 <> 0 THEN event_id END AS sequence, ['delivered','delivered','delivered','pending','delivering','retry'][event_id % 6 + 1] AS state,
  ts AS due, CASE WHEN event_id % 6 = 4 THEN ts + to_days((event_id % 20)::INTEGER) END AS lease, TIMESTAMP '2024-01-20' AS now FROM events)
SELECT delivery_id, state, ordering_key FROM d WHERE ((state IN ('pending','retry') AND due <= now) OR (state = 'delivering' AND lease <= now)) AND NOT EXISTS (
  SELECT 1 FROM d e WHERE e.ordering_key = d.ordering_key AND e.delivery_id <> d.delivery_id AND (e.state IN ('pending','retry') OR (e.state = 'delivering' AND e.lease > e.now)) AND e.sequence < d.sequence)"""


def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New orders of customers that have none yet, one for each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return workqueue.insert_if_absent(o.where("o_orderkey % 10 <> 0"), o.where("o_orderkey % 10 = 0"), ["o_custkey"], ["o_orderkey"])


IDEMPOTENT_INSERT = """SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 10 <> 0) WHERE n = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)"""


def effect_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against the ledger of effects: accepted, replayed or in conflict."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("effect_key"), F.col("o_orderstatus").alias("digest"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("effect_key"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("digest"))
    return workqueue.replay_check(new, old, "effect_key", "digest")


EFFECT_LEDGER = """SELECT o_orderkey AS effect_key, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS digest, CASE WHEN o_orderkey % 3 <> 0 THEN 'accepted' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'replay' END AS outcome FROM orders WHERE o_orderkey % 2 = 0"""


def cas_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional updates of order states by expected version."""
    o = table(spark, sf_dir, "orders")
    rows = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), (F.col("o_orderkey") % 5).alias("version"))
    asked = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(3).alias("expected_version"), F.lit("O").alias("from_state"), F.lit("F").alias("to_state"))
    return workqueue.compare_and_set(rows, asked, "id")


CAS_TRANSITION = """SELECT r.o_orderkey AS id, CASE WHEN x.s = 'O' AND x.v = 3 THEN 'F' ELSE x.s END AS state, x.v + CASE WHEN x.s = 'O' AND x.v = 3 THEN 1 ELSE 0 END AS version, CASE WHEN x.s IS NULL THEN 'not_found' WHEN x.s = 'O' AND x.v = 3 THEN 'applied' ELSE 'conflict' END AS outcome
FROM orders r LEFT JOIN (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 5 AS v FROM orders WHERE o_orderkey % 4 <> 0) x ON x.k = r.o_orderkey WHERE r.o_orderkey % 3 = 0"""


def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with newer versions put in place."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("role"), (F.col("c_custkey") % 4).alias("version"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("NEW").alias("role"), F.lit(2).cast("long").alias("version"))
    return workqueue.upsert(old, new, "id", "version")


SESSION_UPSERT = """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NOT NULL AND (a.id IS NULL OR 2 > a.version) THEN 'NEW' ELSE a.role END AS role, CASE WHEN b.id IS NOT NULL AND (a.id IS NULL OR 2 > a.version) THEN 2 ELSE a.version END AS version
FROM (SELECT c_custkey AS id, c_mktsegment AS role, c_custkey % 4 AS version FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) b ON a.id = b.id"""


def rbac_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and the actions they may take."""
    return access.matrix(spark)


RBAC_MATRIX = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{a}')" for r, acts in access.PERMISSIONS.items() for a in acts) + ") AS v(role, action)"


def grant_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorization of requests by customers in workspaces (nations)."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pick = lambda xs, by: F.element_at(F.array(*map(F.lit, xs)), (k % by % len(xs) + 1).cast("int"))
    rows = c.select(k.alias("id"), F.when(k % 19 != 0, pick(tuple(access.PERMISSIONS), 10_007)).alias("role"), pick(access.ACTIONS, 997).alias("action"), "c_nationkey")
    out = access.decision(F.col("c_nationkey"), F.when(F.col("id") % 6 == 0, F.lit(3)).otherwise(F.col("c_nationkey")), F.when(F.col("id") % 8 == 0, "suspended").otherwise("active"), F.lit(1), F.when(F.col("id") % 9 == 0, 0).otherwise(1), F.col("role"), F.col("action"))
    return rows.select("id", "role", "action", out.alias("reason"))


_ROLES, _ACTS = "[" + ",".join(f"'{r}'" for r in access.PERMISSIONS) + "]", "[" + ",".join(f"'{a}'" for a in access.ACTIONS) + "]"
GRANT_DECISIONS = f"""WITH m AS ({RBAC_MATRIX}), r AS (SELECT c_custkey AS id, c_nationkey AS ws, CASE WHEN c_custkey % 19 <> 0 THEN {_ROLES}[c_custkey % 10007 % {len(access.PERMISSIONS)} + 1] END AS role, {_ACTS}[c_custkey % 997 % {len(access.ACTIONS)} + 1] AS action FROM customer)
SELECT id, r.role, r.action, CASE WHEN r.role IS NULL THEN 'MISSING_GRANT' WHEN id % 6 = 0 AND ws <> 3 THEN 'WORKSPACE_MISMATCH' WHEN id % 8 = 0 THEN 'INACTIVE_GRANT' WHEN id % 9 = 0 THEN 'STALE_GRANT' WHEN m.role IS NULL THEN 'ROLE_DENIED' ELSE 'ALLOW' END AS reason
FROM r LEFT JOIN m ON r.role = m.role AND r.action = m.action"""


def grant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions joined to membership and identity: customers to nations to regions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.where("c_acctbal > 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


GRANT_RESOLUTION = "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0"


def members_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a workspace by role rank and key; the order is kept in a column."""
    c = workspace_scope(table(spark, sf_dir, "customer"), 3, "c_nationkey")
    role = F.element_at(F.array(*map(F.lit, access.ROLE_ORDER)), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = c.select("c_custkey", role.alias("role"))
    from pyspark.sql import Window

    return rows.withColumn("place", F.row_number().over(Window.orderBy(access.role_rank(F.col("role")), "c_custkey")))


MEMBERS_RANKED = f"SELECT c_custkey, [{','.join(repr(r) for r in access.ROLE_ORDER)}][c_custkey % 6 + 1] AS role, row_number() OVER (ORDER BY c_custkey % 6, c_custkey) AS place FROM customer WHERE c_nationkey = 3"


def owner_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as members: which owners may leave their workspace."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("workspace"), F.when(F.col("s_suppkey") % 4 == 0, "owner").otherwise("analyst").alias("role"), F.when(F.col("s_acctbal") > 0, "active").otherwise("suspended").alias("status"))
    return access.last_owner_guard(s, "workspace", "role", "status")


OWNER_GUARD = """WITH s AS (SELECT s_suppkey, s_nationkey AS workspace, CASE WHEN s_suppkey % 4 = 0 THEN 'owner' ELSE 'analyst' END AS role, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'suspended' END AS status FROM supplier)
SELECT *, NOT (role = 'owner' AND status = 'active') OR count(*) FILTER (role = 'owner' AND status = 'active') OVER (PARTITION BY workspace) > 1 AS removable FROM s"""


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workspace's customers; the filter is pushed to the scan."""
    return workspace_scope(table(spark, sf_dir, "customer"), 7, "c_nationkey").select("c_custkey", "c_name", "c_mktsegment")


TENANT_SCOPE = "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey = 7"


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests per user in fixed windows that begin with a user's first request; at most three a day's window."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis("ts").alias("at_ms"))
    return ops.anchored_windows(e, "user_id", "at_ms", "event_id", 86_400_000, 3)


RATE_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT user_id, event_id, n, ms AS start, 1::BIGINT AS hit FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN w.start + 86400000 <= e.ms THEN e.ms ELSE w.start END, CASE WHEN w.start + 86400000 <= e.ms THEN 1 ELSE w.hit + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id, start AS window_start, hit, hit <= 3 AS allowed FROM w"""


def metric_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter by labels."""
    return ops.counter(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], F.lit(1))


METRIC_COUNTER = "SELECT l_returnflag, l_linestatus, count(*) AS value FROM lineitem GROUP BY ALL"
BOUNDS = (1000.0, 5000.0, 20000.0, 50000.0, 80000.0)


def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative buckets of prices by flag, sums in whole units."""
    li = table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return ops.histogram(li, ["l_returnflag"], F.col("cents"), tuple(b * 100 for b in BOUNDS))


METRIC_HISTOGRAM = "WITH c AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem), b(le, x) AS (VALUES " + ", ".join(f"('{b * 100}', {b * 100})" for b in BOUNDS) + """, ('+Inf', 1e300))
SELECT l_returnflag, le, count(*) FILTER (cents <= x) AS bucket, count(*) AS observations, sum(cents)::BIGINT AS total FROM c, b GROUP BY l_returnflag, le"""


def series_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first 40 users of each event type."""
    e = table(spark, sf_dir, "events")
    return ops.cap_series(e.select("event_type", "user_id", "event_id"), "event_type", "user_id", "event_id", 40).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("series"))


SERIES_CAP = """WITH f AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY min(event_id), user_id) AS k FROM events GROUP BY 1, 2)
SELECT e.event_type, count(*) AS n, count(DISTINCT e.user_id) AS series FROM events e JOIN f ON e.event_type = f.event_type AND e.user_id = f.user_id WHERE k <= 40 GROUP BY 1"""


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter in the OpenMetrics text format."""
    return ops.openmetrics(metric_counter(spark, sf_dir), "lines_total", ["l_returnflag", "l_linestatus"], "value")


METRICS_TEXT = """SELECT 'lines_total{l_returnflag="' || l_returnflag || '",l_linestatus="' || l_linestatus || '"} ' || count(*) AS line FROM lineitem GROUP BY l_returnflag, l_linestatus"""


def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaker state of each user's dependency after all events; errors are events of low value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") < 20).alias("failed"))
    return ops.circuit(e, "user_id", "event_id", "failed")


# states: failures in a row 0 to 2; 3 to 7 open, calls waited; 8 the probe
CIRCUIT_STATES = """WITH RECURSIVE e AS (SELECT user_id, value < 20 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, n, CASE WHEN bad THEN 1 ELSE 0 END AS s, 0 AS opened FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, CASE WHEN w.s = 8 THEN CASE WHEN bad THEN 3 ELSE 0 END WHEN w.s >= 3 THEN w.s + 1 WHEN bad THEN w.s + 1 ELSE 0 END,
    w.opened + CASE WHEN bad AND w.s IN (2, 8) THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, CASE WHEN s = 8 THEN 'half_open' WHEN s >= 3 THEN 'open' ELSE 'closed' END AS state, opened AS times_opened FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS k FROM w) WHERE k = 1"""


def alert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each day's snapshot, made from the day's events."""
    day = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bad"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    c = {"maintenance": F.dayofmonth("day") % 5 == 0, "burn_1h": F.col("bad") / 4, "burn_6h": F.col("bad") / 10, "burn_3d": F.col("bad") / F.col("n") * 5, "oldest_ready_s": F.col("n"), "audit_healthy": F.dayofmonth("day") % 7 != 0, "dead_letters_per_hour": F.col("bad") % 20, "telemetry_age_s": F.col("clicks") * 4}
    return day.select(F.col("day").cast("string").alias("day"), F.array_join(ops.alerts(c), ",").alias("alerts"))


ALERT_REPORT = """WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS bad, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, concat_ws(',', CASE WHEN day(day) % 7 = 0 THEN 'audit_commit_failed' END, CASE WHEN day(day) % 5 <> 0 AND (bad / 4 > 14 OR bad / 10 > 6) THEN 'availability_burn' END, CASE WHEN bad % 20 >= 10 THEN 'dead_letter_growth' END,
  CASE WHEN day(day) % 5 <> 0 AND bad / n * 5 > 1 THEN 'error_budget_burn' END, CASE WHEN n > 300 THEN 'queue_backlog' END, CASE WHEN clicks * 4 > 300 THEN 'telemetry_stale' END) AS alerts FROM d"""


def capacity_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of orders under cost and load budgets."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", ops.capacity(k % 25, k % 520, k % 10, k % 110).alias("outcome"))


CAPACITY_ADMISSION = """SELECT o_orderkey, CASE WHEN o_orderkey % 25 > 20 OR o_orderkey % 520 + o_orderkey % 25 > 500 THEN 'cost_limited' WHEN o_orderkey % 10 >= 8 OR o_orderkey % 110 >= 100 THEN 'overloaded' ELSE 'accepted' END AS outcome FROM orders"""


def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be deleted of orders, each an asset of a class."""
    names = [r[0] for r in ops.RETENTION] + ["unknown"]
    asset = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", asset.alias("asset"), (F.col("o_orderkey") % 10 == 0).alias("held"))
    plan = ops.retention_plan(rows, "asset", "o_orderdate", "held", F.lit("1998-06-01").cast("date"))
    return plan.select("o_orderkey", "asset", F.col("due").cast("string").alias("due"), F.col("backup_due").cast("string").alias("backup_due"), F.coalesce("reason", F.lit("")).alias("reason"), "allowed")


RETENTION_PLAN = "WITH r(asset, days, hold) AS (VALUES " + ", ".join(f"('{a}', {d}, {str(h).lower()})" for a, d, _, h, _ in ops.RETENTION) + f"""),
o AS (SELECT o_orderkey, o_orderdate, [{", ".join(f"'{r[0]}'" for r in ops.RETENTION)}, 'unknown'][o_orderkey % {len(ops.RETENTION) + 1} + 1] AS asset, o_orderkey % 10 = 0 AS held FROM orders),
p AS (SELECT o.*, (o_orderdate::DATE + days::INTEGER) AS due, hold AND held AS h FROM o LEFT JOIN r ON o.asset = r.asset)
SELECT o_orderkey, asset, due::VARCHAR AS due, (due + {ops.BACKUP_DAYS})::VARCHAR AS backup_due, CASE WHEN due IS NULL THEN 'unknown_asset' WHEN h THEN 'legal_hold' WHEN DATE '1998-06-01' < due THEN 'retention_not_due' ELSE '' END AS reason,
  due IS NOT NULL AND NOT coalesce(h, false) AND DATE '1998-06-01' >= due AS allowed FROM p"""


def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries older than 30 days, to be removed."""
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-02-20").cast("timestamp") - F.make_dt_interval(F.lit(30))).select("event_id")


RETENTION_CLEANUP = "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY"


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the time of deletion set where it is not set yet."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return d.select("doc_id", F.when(F.col("deleted_at").isNull() & (F.col("doc_id") % 2 == 0), "2024-02-01").otherwise(F.col("deleted_at")).alias("deleted_at"))


SOFT_DELETE = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-01-01' WHEN doc_id % 2 = 0 THEN '2024-02-01' END AS deleted_at FROM documents"


def audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as one JSON payload, with its digest and count; a user's history is one export."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_millis("ts").alias("at"), "event_id", "event_type")
    item = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return ops.ordered_digest(e, "user_id", ["at", "event_id", "event_type"], item)


AUDIT_EXPORT = """SELECT user_id, count(*) AS n, 'sha256:' || sha256('[' || string_agg('{"id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY epoch_us(ts) // 1000, event_id) || ']') AS digest FROM events GROUP BY 1"""


def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with sorted keys, and its digest."""
    raw = F.concat(F.lit('{"z": '), F.col("event_id"), F.lit(', "a": "'), F.col("event_type"), F.lit('", "m": '), F.col("props"), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.parse_json(raw)).alias("canonical"))
    return e.select("event_id", "canonical", T.digest(F.col("canonical").cast("binary")).alias("digest"))


CANONICAL_JSON = """WITH c AS (SELECT event_id, '{"a":"' || event_type || '","m":' || replace(props, ' ', '') || ',"z":' || event_id || '}' AS canonical FROM events) SELECT *, 'sha256:' || sha256(canonical) AS digest FROM c"""


def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored contents checked against their digests: every tenth is altered."""
    p = table(spark, sf_dir, "pages").select("page_id", T.digest(F.col("html").cast("binary")).alias("stored"), F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("now"))
    return p.select("page_id", "stored", F.when(T.digest(F.col("now").cast("binary")) == F.col("stored"), "verified").otherwise("mismatch").alias("state"))


SNAPSHOT_DIGEST = "SELECT page_id, 'sha256:' || sha256(html) AS stored, CASE WHEN page_id % 10 = 0 THEN 'mismatch' ELSE 'verified' END AS state FROM pages"


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events that break a contract: types, ranges and required keys."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    bad = F.array_compact(F.array(F.when(F.col("k").isNull(), "props.k:required"), F.when(F.col("k") > 50, "props.k:maximum"), F.when(~F.col("event_type").isin("click", "view", "purchase"), "event_type:enum"), F.when(F.col("value") < 5, "value:minimum")))
    return e.select("event_id", F.explode(bad).alias("violation"))


CONTRACT_VIOLATIONS = """WITH e AS (SELECT event_id, (props->>'$.k')::INTEGER AS k, event_type, value FROM events)
SELECT event_id, 'props.k:required' AS violation FROM e WHERE k IS NULL UNION ALL SELECT event_id, 'props.k:maximum' FROM e WHERE k > 50
UNION ALL SELECT event_id, 'event_type:enum' FROM e WHERE event_type NOT IN ('click', 'view', 'purchase') UNION ALL SELECT event_id, 'value:minimum' FROM e WHERE value < 5"""


def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines gathered, as a scan with its findings."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("lines"))
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit("")).alias("lines"))


INSPECT = """SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""


def page_of_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child listing in order: by time, then id."""
    e = table(spark, sf_dir, "events").where("user_id = 17")
    return ops.keyset_page(e.select("event_id", "event_type", "user_id"), "event_id", None, 50).drop("next_cursor")


PAGE_OF_CHILDREN = "SELECT event_id, event_type, user_id FROM events WHERE user_id = 17 ORDER BY event_id LIMIT 50"


def replay_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries accepted once an hour for each user and type: an accepted one keeps others out until it expires, a refused one doesn't prolong that."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), "event_id", F.unix_millis("ts").alias("at"))
    return ops.anchored_windows(e, "key", "at", "event_id", 3_600_000, 1).select("event_id", F.col("allowed").alias("accepted"))


REPLAY_WINDOW = """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
w AS (SELECT user_id, event_type, event_id, n, ms + 3600000 AS expires, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_type, e.event_id, e.n, CASE WHEN w.expires <= e.ms THEN e.ms + 3600000 ELSE w.expires END, w.expires <= e.ms FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
SELECT event_id, accepted FROM w"""


def correlation_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last step, and whether the flow is complete."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("last"), F.count("*").alias("steps"))
    return e.select("user_id", "steps", F.col("last.event_type").alias("terminal"), (F.col("last.event_type") != "view").alias("complete"))


CORRELATION_FLOWS = "SELECT user_id, count(*) AS steps, arg_max(event_type, event_id) AS terminal, arg_max(event_type, event_id) <> 'view' AS complete FROM events GROUP BY 1"


def recovery_drills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of restore drills."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(ops.restore_verdict(k % 10 != 0, k % 7 != 0, k % 25, k % 40).alias("verdict")).agg(F.count("*").alias("n"))


RECOVERY_DRILLS = "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'artifact_missing' WHEN o_orderkey % 7 = 0 THEN 'integrity_failed' WHEN o_orderkey % 25 > 20 THEN 'rto_exceeded' WHEN o_orderkey % 40 > 30 THEN 'rpo_exceeded' ELSE 'passed' END AS verdict, count(*) AS n FROM orders GROUP BY 1"

QUERIES = (
    evidence_timeline, evidence_contradictions, claim_quorum, portfolio_impact, holdings_sum, duplicate_assets, keyset_page, queue_claim_next, queue_reap, queue_fail, dead_letters, replay_dead, job_transitions,
    delivery_claimable, idempotent_insert, effect_ledger, cas_transition, session_upsert, rbac_matrix, grant_decisions, grant_resolution, members_ranked, owner_guard, tenant_scope, rate_limit, metric_counter, metric_histogram,
    series_cap, metrics_text, circuit_states, alert_report, capacity_admission, retention_plan, retention_cleanup, soft_delete, audit_export, canonical_json, snapshot_digest, contract_violations, inspect, page_of_children,
    replay_window, correlation_flows, recovery_drills,
)
