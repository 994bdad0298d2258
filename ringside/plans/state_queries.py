"""State, change detection, window gate, matching in time and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringside.operators import changes
from ringside.operators.topk import upsert
from ringside.plans import sqltext as q
from ringside.plans.adapters import runs, table
from ringside.plans.catalog import query

c = F.col


@query("state_upsert", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM r WHERE rn = 1""")
def state_upsert(spark, d):
    """B5"""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    even = c("o_orderkey") % 2 == 0
    return upsert(orders.filter(even), orders.filter(~even), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def changed_sql(order: str = "seq") -> str:
    return f"""WITH {q.RUNS}, p AS (SELECT *, lag(hash) OVER (PARTITION BY key ORDER BY {order}) AS prev FROM runs)
SELECT key, seq, kind FROM p WHERE kind = 'baseline' OR hash IS DISTINCT FROM prev"""


@query("change_detect", changed_sql())
def change_detect(spark, d):
    """G5"""
    return changes.changed_runs(runs(spark, d)).select("key", "seq", "kind")


_OK = "(opened BETWEEN day + CAST((13 - isodow(day)) % 7 AS INTEGER) AND day + CAST((13 - isodow(day)) % 7 AS INTEGER) + 1)"

def gate_sql(order: str = "seq", source: str = "runs") -> str:
    return f"""WITH RECURSIVE {q.RUNS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS rn FROM {source}),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, '' AS kind, '' AS status, '' AS reason, CAST(NULL AS DATE) AS active, '' AS last_hash
  FROM (SELECT DISTINCT key FROM runs)
  UNION ALL
  SELECT key, rn, seq, kind,
    CASE WHEN kind = 'baseline' THEN CASE WHEN ok THEN 'baseline_created' ELSE 'skipped' END
      WHEN active IS NULL OR NOT ok THEN 'skipped' WHEN hash = last_hash THEN 'unchanged' ELSE 'changed' END,
    CASE WHEN kind = 'baseline' THEN CASE WHEN ok THEN 'window_opened' ELSE 'no_event' END
      WHEN active IS NULL THEN 'no_window' WHEN NOT ok THEN 'window_over' WHEN hash = last_hash THEN 'same_hash' ELSE 'new_hash' END,
    CASE WHEN NOT ok THEN NULL WHEN kind = 'baseline' THEN opened ELSE active END,
    CASE WHEN ok AND (kind = 'baseline' OR active IS NOT NULL) THEN hash ELSE last_hash END
  FROM (SELECT *, coalesce({_OK}, false) AS ok FROM (
    SELECT w.key, n.rn, n.seq, n.kind, n.hash, n.run_date AS day, w.active, w.last_hash,
      CASE WHEN n.kind = 'baseline' THEN n.opened_date ELSE w.active END AS opened
    FROM walk w JOIN n ON n.key = w.key AND n.rn = w.rn + 1)))
SELECT key, seq, kind, status, reason FROM walk WHERE rn > 0"""


@query("gate_runs", gate_sql())
def gate_runs(spark, d):
    """J3, batch twin"""
    return changes.gate_runs(runs(spark, d))


def hourly_events(events):
    """Times cut to the hour, so that records and texts of one user often share a time."""
    return events.select("user_id", "event_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type")


_HOURLY = "h AS (SELECT user_id, event_id, date_trunc('hour', ts) AS ts, event_type FROM events)"


@query("asof_bounded", f"""WITH {_HOURLY}
SELECT t.user_id, t.event_id AS text_id, max_by(r.event_id, (r.ts, -r.event_id)) AS open_id
FROM h t JOIN h r ON r.user_id = t.user_id AND r.event_type = 'error' AND r.ts <= t.ts AND t.ts - r.ts <= INTERVAL 2 HOUR
WHERE t.event_type = 'click' GROUP BY ALL""")
def asof_bounded(spark, d):
    """E11, nothing consumed; of equal times the lowest id is found"""
    kind = c("event_type")
    events = hourly_events(table(spark, d, "events"))
    return changes.newest_within(events, "user_id", kind == "error", kind == "click", 2 * 3600)


@query("asof_consumed", f"""WITH RECURSIVE {_HOURLY},
n AS (SELECT user_id, event_id, ts, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'click', CASE event_type WHEN 'error' THEN -event_id ELSE event_id END) AS rn
  FROM h WHERE event_type IN ('error', 'click')),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS text_id, CAST(NULL AS BIGINT) AS open_id, CAST([] AS STRUCT(id BIGINT, since TIMESTAMP)[]) AS stack
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN hit THEN top.id END,
    CASE WHEN event_type = 'error' THEN list_append(stack, {{'id': event_id, 'since': ts}}) WHEN hit THEN stack[:len(stack) - 1] ELSE stack END
  FROM (SELECT *, coalesce(event_type = 'click' AND ts - top.since <= INTERVAL 48 HOUR, false) AS hit FROM (
    SELECT w.user_id, n.rn, n.event_id, n.ts, n.event_type, w.stack, w.stack[-1] AS top FROM walk w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1)))
SELECT user_id, text_id, open_id FROM walk WHERE open_id IS NOT NULL""")
def asof_consumed(spark, d):
    """Each record serves one text"""
    kind = c("event_type")
    events = hourly_events(table(spark, d, "events"))
    return changes.consume_within(events, "user_id", kind == "error", kind == "click", 48 * 3600)


@query("snapshot_diff", """WITH n AS (SELECT CASE WHEN o_orderkey % 10 = 5 THEN -o_orderkey ELSE o_orderkey END AS k,
  CASE WHEN o_orderkey % 10 = 7 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 20 = 7 THEN o_orderpriority || '!' ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey % 10 <> 3),
j AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'added' WHEN k IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  o_orderstatus AS s0, status AS s1, o_orderpriority AS p0, priority AS p1 FROM orders FULL JOIN n ON k = o_orderkey)
SELECT o_orderkey, kind, '*' AS field, NULL AS old, NULL AS new FROM j WHERE kind <> 'changed'
UNION ALL SELECT o_orderkey, kind, 'status', s0, s1 FROM j WHERE kind = 'changed' AND s0 <> s1
UNION ALL SELECT o_orderkey, kind, 'priority', p0, p1 FROM j WHERE kind = 'changed' AND p0 <> p1""")
def snapshot_diff(spark, d):
    """Generated times and spacing do not count"""
    key = c("o_orderkey")
    orders = table(spark, d, "orders")

    def snap(df, k, status, priority):
        return df.select(k.alias("o_orderkey"), status.alias("status"), F.trim(priority).alias("priority"))

    old = snap(orders, key, c("o_orderstatus"), c("o_orderpriority"))
    new = snap(
        orders.filter(key % 10 != 3),
        F.when(key % 10 == 5, -key).otherwise(key),
        F.when(key % 10 == 7, F.lower("o_orderstatus")).otherwise(c("o_orderstatus")),
        F.when(key % 20 == 7, F.concat(c("o_orderpriority"), F.lit("!"))).otherwise(F.concat(c("o_orderpriority"), F.lit("  "))),
    )
    return changes.snapshot_diff(old, new, "o_orderkey", ["status", "priority"])


@query("diff_document", """WITH p AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus AS s0,
  CASE WHEN o_orderkey % 10 = 7 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s1,
  CAST(floor(o_totalprice / 100) AS BIGINT) AS t0, CAST(floor((o_totalprice + CASE WHEN o_orderkey % 10 = 1 THEN 30 ELSE 0 END) / 100) AS BIGINT) AS t1 FROM orders),
f AS (SELECT *, (k % 10 NOT IN (3, 5) AND s0 <> s1) AS ds, (k % 10 NOT IN (3, 5) AND t0 <> t1) AS dt FROM p)
SELECT o_custkey, bool_or(k % 10 IN (3, 5) OR ds OR dt) AS is_changed, count(*) FILTER (k % 10 = 5) AS n_added,
  count(*) FILTER (k % 10 IN (3, 5)) AS n_removed, count(*) FILTER (ds OR dt) AS n_changed,
  CASE WHEN bool_or(ds) AND bool_or(dt) THEN 'status,total' WHEN bool_or(ds) THEN 'status' WHEN bool_or(dt) THEN 'total' ELSE '' END AS summary
FROM f GROUP BY o_custkey""")
def diff_document(spark, d):
    """Per customer what became of the orders; totals count by their step of 100"""
    key, total = c("o_orderkey"), c("o_totalprice")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")

    def snap(df, k, status, amount):
        return df.select(
            k.alias("o_orderkey"), "o_custkey", status.alias("status"), F.floor(amount / 100).alias("total")
        )

    old = snap(orders, key, c("o_orderstatus"), total)
    new = snap(
        orders.filter(key % 10 != 3), F.when(key % 10 == 5, -key).otherwise(key),
        F.when(key % 10 == 7, F.lower("o_orderstatus")).otherwise(c("o_orderstatus")),
        total + F.when(key % 10 == 1, 30).otherwise(0),
    )
    diff = changes.snapshot_diff(old, new, "o_orderkey", ["status", "total"])
    owners = orders.select("o_orderkey", "o_custkey")
    owned = diff.withColumn("owner", F.abs("o_orderkey")).join(
        owners.withColumnRenamed("o_orderkey", "owner"), "owner"
    )
    return changes.diff_document(owned, owners.select("o_custkey").distinct(), "o_custkey", "o_orderkey")
