"""Queries on event logs: rate limits, budgets, breakers, caches, metering."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import state as S
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()


def _events(spark, where):
    return S.with_micros(load(spark, where, "events"))


_ORD = """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),"""


@R.query(
    "token_bucket",
    _ORD + """ b AS (
      SELECT user_id, event_id, rn, us, true AS allowed, CAST(2.0 AS DOUBLE) AS tokens FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, us, t >= 1 AS allowed, CASE WHEN t >= 1 THEN t - 1 ELSE t END AS tokens FROM (
        SELECT e.user_id, e.event_id, e.rn, e.us, least(CAST(3.0 AS DOUBLE), b.tokens + CAST(e.us - b.us AS DOUBLE) / 1e6 * CAST(0.00001 AS DOUBLE)) AS t
        FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))
    SELECT user_id, event_id, allowed, round(tokens, 6) AS tokens FROM b""",
)
def token_bucket(spark, where):
    out = S.token_bucket(_events(spark, where), "user_id", ["at", "event_id"], 3, 0.00001)
    return out.select("user_id", "event_id", "allowed", F.round("tokens", 6).alias("tokens"))


@R.query(
    "budget_ledger",
    _ORD + """ b AS (
      SELECT user_id, event_id, rn, true AS accepted, value AS spent FROM e WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.rn, b.spent < 100, b.spent + CASE WHEN b.spent < 100 THEN e.value ELSE 0 END
      FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)
    SELECT user_id, count(*) AS requests, sum(CAST(accepted AS INT)) AS accepted, round(max(spent), 4) AS spent FROM b GROUP BY 1""",
)
def budget_ledger(spark, where):
    out = S.budget(_events(spark, where).withColumn("cost", F.col("value")), "user_id", ["at", "event_id"], 100.0)
    return out.groupBy("user_id").agg(
        F.count("*").alias("requests"), F.sum(F.col("accepted").cast("int")).alias("accepted"), F.round(F.max("spent"), 4).alias("spent")
    )


@R.query(
    "circuit_breaker",
    _ORD + """ b AS (
      SELECT user_id, event_id, rn, us, true AS called, 'closed' AS state, CAST(event_type = 'error' AS INT) AS failures, CAST(0 AS BIGINT) AS since FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, us, s0 <> 'open',
        CASE WHEN s0 = 'open' THEN 'open' WHEN NOT bad THEN 'closed' WHEN s0 = 'half-open' OR f0 + 1 >= 2 THEN 'open' ELSE s0 END,
        CASE WHEN s0 = 'open' THEN f0 WHEN NOT bad THEN 0 ELSE f0 + 1 END,
        CASE WHEN s0 <> 'open' AND bad AND (s0 = 'half-open' OR f0 + 1 >= 2) THEN us ELSE since END
      FROM (SELECT e.user_id, e.event_id, e.rn, e.us, e.event_type = 'error' AS bad, b.failures AS f0, b.since,
              CASE WHEN b.state = 'open' AND e.us - b.since >= 86400000000 THEN 'half-open' ELSE b.state END AS s0
            FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1))
    SELECT user_id, event_id, called, state, failures FROM b""",
)
def circuit_breaker(spark, where):
    e = _events(spark, where).withColumn("failed", F.col("event_type") == "error")
    out = S.breaker(e, "user_id", ["at", "event_id"], 2, 86400.0)
    return out.select("user_id", "event_id", "called", "state", "failures")


@R.query(
    "replay_check",
    _ORD.replace("PARTITION BY user_id", "PARTITION BY user_id, event_type") + """ b AS (
      SELECT user_id, event_type, event_id, rn, true AS passed, us AS first FROM e WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.event_type, e.event_id, e.rn, e.us - b.first > 259200000000, CASE WHEN e.us - b.first > 259200000000 THEN e.us ELSE b.first END
      FROM b JOIN e ON e.user_id = b.user_id AND e.event_type = b.event_type AND e.rn = b.rn + 1)
    SELECT event_id, passed FROM b""",
)
def replay_check(spark, where):
    """A user's repeat of an event type within three days is a replay."""
    e = _events(spark, where).withColumn("signature", F.concat_ws("/", "user_id", "event_type"))
    return S.replay(e, "signature", ["at", "event_id"], 3 * 86400.0).select("event_id", "passed")


@R.query(
    "quarantine",
    _ORD + """ v AS (SELECT *, CASE event_type WHEN 'error' THEN 'keys' WHEN 'signup' THEN 'malformed' END AS kind FROM e),
    b AS (
      SELECT user_id, event_id, rn, CASE WHEN kind IS NULL THEN 0 ELSE 1 END AS violations, false AS quarantined, false AS refused FROM v WHERE rn = 1
      UNION ALL
      SELECT v.user_id, v.event_id, v.rn, CASE WHEN b.quarantined THEN b.violations WHEN kind IS NULL THEN 0 ELSE b.violations + 1 END,
        b.quarantined OR (kind = 'keys' AND b.violations + 1 >= 2) IS TRUE, b.quarantined
      FROM b JOIN v ON v.user_id = b.user_id AND v.rn = b.rn + 1)
    SELECT event_id, violations, quarantined, refused FROM b""",
)
def quarantine(spark, where):
    e = _events(spark, where).withColumn("violation", F.when(F.col("event_type") == "error", "keys").when(F.col("event_type") == "signup", "malformed"))
    return S.quarantine(e, "user_id", ["at", "event_id"], 2).select("event_id", "violations", "quarantined", "refused")


@R.query(
    "ttl_cache",
    _ORD + """ r AS (SELECT user_id, event_id, rn, us, json_extract_string(props, '$.k') AS k FROM e),
    b AS (
      SELECT user_id, rn, false AS hit, [{'k': k, 't': us}] AS c FROM r WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, hit,
        CASE WHEN hit THEN list_filter(c, lambda x: x.k <> k) || list_filter(c, lambda x: x.k = k)
          ELSE CASE WHEN len(rest) < 4 THEN rest
            WHEN len(list_filter(rest, lambda x: us - x.t > 432000000000)) > 0 THEN list_filter(rest, lambda x: x.k <> list_filter(rest, lambda y: us - y.t > 432000000000)[1].k)
            ELSE rest[2:] END || [{'k': k, 't': us}] END
      FROM (SELECT r.user_id, r.rn, r.us, r.k, b.c, len(list_filter(b.c, lambda x: x.k = r.k AND r.us - x.t <= 432000000000)) > 0 AS hit,
          list_filter(b.c, lambda x: x.k <> r.k) AS rest FROM b JOIN r ON r.user_id = b.user_id AND r.rn = b.rn + 1))
    SELECT user_id, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS hits, CAST(sum(CAST(NOT hit AS INT)) AS BIGINT) AS misses, max(len(c)) AS size, round(avg(CAST(hit AS INT)), 4) AS hit_rate FROM b GROUP BY 1""",
)
def ttl_cache(spark, where):
    e = _events(spark, where).withColumn("request", F.get_json_object("props", "$.k"))
    out = S.ttl_cache(e, "user_id", ["at", "event_id"], 5 * 86400.0, 4)
    return out.groupBy("user_id").agg(
        F.sum(F.col("hit").cast("int")).alias("hits"), F.sum((~F.col("hit")).cast("int")).alias("misses"), F.max("size").cast("long").alias("size"),
        F.round(F.avg(F.col("hit").cast("int")), 4).alias("hit_rate"),
    )


_PADS = ["".join(f"\\x{b ^ x:02X}" for b in b"k".ljust(64, b"\0")) for x in (0x36, 0x5C)]


@R.query(
    "signature_chain",
    _ORD + f""" b AS (
      SELECT user_id, event_id, rn, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(props)))) AS signature FROM e WHERE rn = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.rn, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(b.signature || e.props))))
      FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)
    SELECT event_id, signature FROM b""",
)
def signature_chain(spark, where):
    e = _events(spark, where).withColumn("body", F.col("props"))
    return S.signature_chain(e, "user_id", ["at", "event_id"], b"k").select("event_id", "signature")


@R.query(
    "round_robin",
    """SELECT event_id, ['a', 'a', 'b', 'c', 'c', 'c'][(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 6 + 1] AS provider FROM events""",
)
def round_robin(spark, where):
    return S.round_robin(_events(spark, where), "user_id", ["at", "event_id"], [("a", 2), ("b", 1), ("c", 3)]).select("event_id", "provider")


@R.query(
    "fault_schedule",
    _ORD + """ b AS (
      SELECT user_id, rn, s1, s2, CASE WHEN s1 / 2147483648 < 0.1 THEN 1 ELSE 2 END AS rolls,
        CASE WHEN s1 / 2147483648 < 0.1 THEN 'timeout' WHEN s2 / 2147483648 < 0.2 THEN 'truncated' END AS fault
      FROM (SELECT user_id, rn, s1, (s1 * 1103515245 + 12345) % 2147483648 AS s2 FROM (SELECT user_id, rn, (CAST(20260923 AS BIGINT) * 1103515245 + 12345) % 2147483648 AS s1 FROM e WHERE rn = 1))
      UNION ALL
      SELECT user_id, rn, s1, s2, CASE WHEN s1 / 2147483648 < 0.1 THEN 1 ELSE 2 END,
        CASE WHEN s1 / 2147483648 < 0.1 THEN 'timeout' WHEN s2 / 2147483648 < 0.2 THEN 'truncated' END
      FROM (SELECT user_id, rn, s1, (s1 * 1103515245 + 12345) % 2147483648 AS s2 FROM (
        SELECT e.user_id, e.rn, (CASE WHEN b.rolls = 1 THEN b.s1 ELSE b.s2 END * 1103515245 + 12345) % 2147483648 AS s1
        FROM b JOIN e ON e.user_id = b.user_id AND e.rn = b.rn + 1)))
    SELECT fault, count(*) AS n, CAST(sum(rolls) AS BIGINT) AS rolls FROM b GROUP BY 1""",
)
def fault_schedule(spark, where):
    out = S.fault_schedule(_events(spark, where), "user_id", ["at", "event_id"], [("timeout", 0.1), ("truncated", 0.2)])
    return out.groupBy("fault").agg(F.count("*").alias("n"), F.sum("rolls").alias("rolls"))


@R.query(
    "failover",
    """WITH a AS (SELECT user_id AS request, label AS priority, 'p' || label AS provider, k AS attempt, (user_id * 7 + label * 3 + k * 5) % 4 = 0 AS ok
      FROM (SELECT DISTINCT user_id FROM events), range(3) x(label), range(4) y(k)),
    u AS (SELECT * FROM a WHERE attempt <= 2),
    w AS (SELECT request, min(priority * 10 + attempt) AS won, arg_min(provider, priority * 10 + attempt) AS served_by FROM u WHERE ok GROUP BY 1)
    SELECT u.request, any_value(w.served_by) AS served_by, count(*) AS tries,
      round(sum(CASE WHEN NOT ok AND attempt < 2 THEN 0.25 * pow(2, attempt) ELSE 0 END), 6) AS backoff_s
    FROM u LEFT JOIN w USING (request) WHERE w.won IS NULL OR priority * 10 + attempt <= w.won GROUP BY 1""",
)
def failover(spark, where):
    users = load(spark, where, "events").select(F.col("user_id").alias("request")).distinct()
    grid = users.withColumn("priority", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    a = grid.withColumn("provider", F.concat(F.lit("p"), F.col("priority"))).withColumn("ok", (F.col("request") * 7 + F.col("priority") * 3 + F.col("attempt") * 5) % 4 == 0)
    return S.failover(a, 2)


@R.query("usage_by_month", "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY ALL")
def usage_by_month(spark, where):
    return S.usage(load(spark, where, "events"), "user_id")


@R.query(
    "quota_state",
    """WITH u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS used, ['free', 'pro', 'odd'][user_id % 3 + 1] AS plan FROM events GROUP BY ALL)
    SELECT user_id, month, used, CASE plan WHEN 'free' THEN 60 WHEN 'pro' THEN 70 ELSE 60 END AS quota,
      greatest(CASE plan WHEN 'free' THEN 60 WHEN 'pro' THEN 70 ELSE 60 END - used, 0) AS remaining FROM u""",
)
def quota_state(spark, where):
    used = S.usage(load(spark, where, "events"), "user_id").withColumn("plan", F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("odd")), (F.col("user_id") % 3 + 1).cast("int")))
    plans = spark.createDataFrame([("free", 60), ("pro", 70)], "plan string, quota int")
    return S.quota(used, plans, 60).select("user_id", "month", "used", "quota", "remaining")


@R.query(
    "trace_quantiles",
    """WITH e AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL AND value <> 0 GROUP BY 1)
    SELECT event_type, len(v) AS n, v[least(CAST(floor(len(v) * 0.5) AS BIGINT) + 1, len(v))] AS p50_index, v[greatest(CAST(ceil(len(v) * 0.5) AS BIGINT), 1)] AS p50_nearest,
      v[least(CAST(floor(len(v) * 0.95) AS BIGINT) + 1, len(v))] AS p95_index, v[greatest(CAST(ceil(len(v) * 0.95) AS BIGINT), 1)] AS p95_nearest FROM e""",
)
def trace_quantiles(spark, where):
    return S.quantiles(load(spark, where, "events"), "event_type", "value")


@R.query(
    "trace_stats",
    """WITH r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 200), v AS (SELECT list_sort(list(value) FILTER (value IS NOT NULL AND value <> 0)) AS v FROM r)
    SELECT (SELECT count(*) FROM r) AS n, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95,
      (SELECT CAST(sum(user_id) AS BIGINT) FROM r) AS tokens, (SELECT round(sum(value) / 1000, 4) FROM r) AS cost FROM v""",
)
def trace_stats(spark, where):
    """The latest 200 traces: count, quantiles, token and cost sums."""
    e = load(spark, where, "events").select(F.col("event_id").alias("id"), F.col("value").alias("latency_ms"), F.col("user_id").alias("tokens"), (F.col("value") / 1000).alias("cost"))
    return S.trace_stats(e, 200)


@R.query(
    "reply_violations",
    """WITH r AS (SELECT event_id, value, CASE WHEN event_type = 'signup' THEN '{bad' WHEN event_type = 'click' THEN '{"id": 1}'
        ELSE '{"id": 1, "usage": {"prompt_tokens": ' || (user_id * 10) || ', "completion_tokens": 5}}' END AS body, event_type, user_id FROM events)
    SELECT event_id, CASE WHEN event_type = 'signup' THEN 'malformed' WHEN event_type = 'click' THEN 'missing_keys'
      WHEN (user_id * 10 + 5) / 100.0 < 0.1 OR (user_id * 10 + 5) / 100.0 > 10 THEN 'token_usage_sanity' WHEN value > 100 THEN 'latency_outlier' END AS violation FROM r""",
)
def reply_violations(spark, where):
    """Provider replies checked for their keys, token ratio and latency."""
    t, u = F.col("event_type"), F.col("user_id")
    body = F.when(t == "signup", "{bad").when(t == "click", '{"id": 1}').otherwise(
        F.concat(F.lit('{"id": 1, "usage": {"prompt_tokens": '), (u * 10).cast("string"), F.lit(', "completion_tokens": 5}}'))
    )
    return load(spark, where, "events").select("event_id", S.violation(body, F.col("value"), F.lit(100), ("id", "usage"), 0.1, 10.0, 100.0).alias("violation"))


@R.query(
    "latest_events",
    "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 200",
)
def latest_events(spark, where):
    """The latest 200 traces."""
    return load(spark, where, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(200)


@R.query(
    "provider_stats",
    """SELECT event_type AS provider, count(*) AS requests, count(*) FILTER (value > 50) AS failures, round(arg_max(value, (ts, event_id)), 6) AS last_latency
    FROM events GROUP BY 1""",
)
def provider_stats(spark, where):
    e = load(spark, where, "events")
    return e.groupBy(F.col("event_type").alias("provider")).agg(
        F.count("*").alias("requests"), F.count_if(F.col("value") > 50).alias("failures"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("last_latency")
    )


@R.query(
    "event_windows",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def event_windows(spark, where):
    """Tumbling hours; an addition, the reference has no event-time windows."""
    e = load(spark, where, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )
