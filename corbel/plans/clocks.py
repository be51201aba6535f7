"""Queries of time: machines with clocks, the same folds as the streams run, and results against those of another run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle, workqueue
from ..session import table
from ..streaming import keyed

COOL_MS, FORGET_MS = 6 * 3_600_000, 30 * 3_600_000


def timed_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as calls of a dependency: what the breaker says of each, and when it was half open by time alone."""
    calls = table(spark, sf_dir, "events").select("user_id", F.unix_millis("ts").alias("at"), "event_id", (F.col("event_id") % 4 != 0).alias("failed"))
    return keyed.replayed(calls, keyed.Breaker(COOL_MS, 3, FORGET_MS), "user_id", "at", "event_id")


# s: how many failures stand, u: when they are forgotten or the breaker cools down (after the call)
TIMED_BREAKERS = f"""WITH RECURSIVE c AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_id % 4 <> 0 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, ms, n, 'closed' AS state, NULL::BIGINT AS cooled, CASE WHEN bad THEN 1 ELSE 0 END AS s, CASE WHEN bad THEN ms + {FORGET_MS} END AS u FROM c WHERE n = 1
  UNION ALL SELECT c.user_id, c.event_id, c.ms, c.n, w.state, CASE WHEN w.state = 'half_open' THEN r.u END,
    CASE WHEN w.state = 'open' THEN r.s WHEN NOT c.bad THEN 0 WHEN w.state = 'half_open' THEN 3 ELSE w.s + 1 END,
    CASE WHEN w.state = 'open' THEN r.u WHEN NOT c.bad THEN NULL WHEN w.state = 'half_open' OR w.s = 2 THEN c.ms + {COOL_MS} ELSE c.ms + {FORGET_MS} END
  FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1, LATERAL (SELECT CASE WHEN r.s >= 3 THEN CASE WHEN c.ms < r.u THEN 'open' ELSE 'half_open' END ELSE 'closed' END AS state, CASE WHEN r.s < 3 AND r.u <= c.ms THEN 0 ELSE r.s END AS s) w)
SELECT user_id, event_id, ms AS "at", state, state <> 'open' AS allowed FROM r UNION ALL SELECT user_id, NULL, cooled, 'half_open', NULL FROM r WHERE cooled IS NOT NULL"""



def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against what another run made of them: some altered, some missing, some added, some with keys that repeat."""
    o, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    after = o.where(k % 7 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, None).otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    added = o.where((k % 11 == 0) & (k > 0)).select((-k).alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    return lifecycle.differences(o.unionByName(o.where(k % 13 == 0)), after.unionByName(added).unionByName(o.where((k % 13 == 0) & (k % 2 == 0))), ["o_orderkey"])


REPLAY_DIFFERENCES = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND NOT (o_orderkey % 13 = 0 AND o_orderkey % 2 = 0) THEN 'missing' WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 2 <> 0) THEN 'altered' ELSE 'equal' END AS state FROM orders
UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey <> 0"""


def deliveries_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each workspace's next delivery, claimed under a lease: heads of their ordering keys only, by sequence."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("delivered", "pending", "delivering", "retry"))), (k % 4 + 1).cast("int"))
    rows = e.select((F.col("user_id") % 30).alias("workspace_id"), k.alias("delivery_id"), F.when(k % 5 != 0, F.col("user_id") % 7).alias("ordering_key"), F.when(k % 5 != 0, k).alias("sequence"), state.alias("state"), (k % 3).cast("int").alias("attempt"), F.col("ts").alias("next_attempt_at"), F.when(state == "delivering", F.col("ts") + F.make_dt_interval(F.lit(9))).alias("lease_until"), F.col("ts").alias("created_at"))
    return workqueue.claim_deliveries(rows, F.lit("2024-01-15 00:00:00").cast("timestamp"), 30_000).withColumn("lease_until", F.unix_millis("lease_until"))


DELIVERIES_CLAIMED = """WITH d AS (SELECT user_id % 30 AS w, event_id AS id, CASE WHEN event_id % 5 <> 0 THEN user_id % 7 END AS key, CASE WHEN event_id % 5 <> 0 THEN event_id END AS seq, ['delivered', 'pending', 'delivering', 'retry'][event_id % 4 + 1] AS state, event_id % 3 AS attempt, ts, TIMESTAMP '2024-01-15' AS now FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY seq NULLS LAST, ts, id) AS n FROM d WHERE ((state IN ('pending', 'retry') AND ts <= now) OR (state = 'delivering' AND ts + INTERVAL 9 DAY <= now))
  AND NOT EXISTS (SELECT 1 FROM d x WHERE x.w = d.w AND x.key = d.key AND x.id <> d.id AND (x.state IN ('pending', 'retry') OR (x.state = 'delivering' AND x.ts + INTERVAL 9 DAY > x.now)) AND x.seq < d.seq))
SELECT w AS workspace_id, id AS delivery_id, (attempt + 1)::INTEGER AS attempt, 'delivering' AS state, epoch_ms(now) + 30000 AS lease_until FROM c WHERE n = 1"""


QUERIES = (timed_breakers, replay_differences, deliveries_claimed)
