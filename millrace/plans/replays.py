"""Queries that replay request logs, transcripts, chaos runs and message lines made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import replays as P
from millrace.operators import state as S
from millrace.operators import textops as O
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()


@R.query(
    "gateway_replay",
    """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    g AS (SELECT user_id, event_id, rn, us, value, user_id % 10 <> 9 AS known, event_type = 'signup' AS bad, event_type = 'error' AS failed, k FROM e),
    b AS (
      SELECT user_id, event_id, rn, us, CASE WHEN NOT known THEN 401 WHEN bad THEN 400 WHEN failed THEN 502 ELSE 200 END AS status, false AS cached,
        CASE WHEN known AND NOT bad AND NOT failed THEN value ELSE 0 END AS spent, CASE WHEN known THEN 2.0 ELSE 3.0 END::DOUBLE AS tokens,
        CASE WHEN known AND NOT bad AND NOT failed THEN [{'k': k, 't': us}] ELSE [] END AS c, known AS began FROM g WHERE rn = 1
      UNION ALL
      SELECT user_id, event_id, rn, us, status, status = 200 AND hit, CASE WHEN status = 200 AND NOT hit THEN spent + value ELSE spent END,
        CASE WHEN NOT known THEN t WHEN t >= 1 THEN t - 1 ELSE t END, CASE WHEN status = 200 AND NOT hit THEN list_filter(c, lambda x: x.k <> k) || [{'k': k, 't': us}] ELSE c END, true
      FROM (SELECT *, CASE WHEN NOT known THEN 401 WHEN t < 1 THEN 429 WHEN spent >= 200 THEN 402 WHEN bad THEN 400 WHEN hit THEN 200 WHEN failed THEN 502 ELSE 200 END AS status
        FROM (SELECT g.user_id, g.event_id, g.rn, g.us, g.value, g.known, g.bad, g.failed, g.k, b.spent, b.c,
            least(CAST(3.0 AS DOUBLE), b.tokens + CAST(g.us - b.us AS DOUBLE) / 1e6 * CAST(0.00001 AS DOUBLE)) AS t,
            len(list_filter(b.c, lambda x: x.k = g.k AND g.us - x.t <= 432000000000)) > 0 AS hit
          FROM b JOIN g ON g.user_id = b.user_id AND g.rn = b.rn + 1)))
    SELECT event_id, status, cached, round(spent, 4) AS spent FROM b""",
)
def gateway_replay(spark, where):
    """A request log through all gates of a gateway, key by key."""
    e = S.with_micros(load(spark, where, "events"))
    r = e.select(
        "event_id", "user_id", "at", (F.col("user_id") % 10 != 9).alias("known"), F.when(F.col("event_type") == "signup", "model").alias("fault"),
        F.get_json_object("props", "$.k").alias("request"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("cost"),
    )
    out = P.gateway(r, "user_id", ["at", "event_id"], 3, 0.00001, 200.0, 5 * 86400.0, 1_000_000, 1_000_000)
    return out.select("event_id", "status", "cached", F.round("spent", 4).alias("spent"))


@R.query("hardened_routes")
def hardened_routes(spark, where):
    """Requests through replay check, scan, providers in turn and their quarantine."""
    d = load(spark, where, "documents").where("text is not null")
    req = d.select(
        F.col("doc_id").alias("request"), F.md5("text").alias("signature"), F.col("text").alias("prompt"), F.coalesce(F.unix_micros("created_at"), F.lit(0)).alias("at")
    )
    r = req.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "request", "turn", F.concat(F.lit("p"), (F.col("request") + F.col("turn")) % 5).alias("provider"), "at",
        F.when((F.col("request") + F.col("turn")) % 5 == 0, "keys").when(F.col("request") % 11 == 0, "malformed").alias("violation"), (F.col("request") % 7 == 0).alias("error"),
    )
    return P.hardened(req, r, ["at", "request"], 1e12)


_REGISTRY = (("lookup", {"key": "str", "n": "int"}, False), ("drop", {"key": "str"}, True))


@R.query(
    "agent_runs",
    """SELECT suite AS conv, CAST(sum(CASE WHEN item_id % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS steps, CAST(sum(CASE WHEN item_id % 4 IN (1, 3) THEN 1 ELSE 0 END) AS BIGINT) AS calls,
      count(*) FILTER (item_id % 4 = 2) AS parse_errors, count(*) FILTER (item_id % 4 = 3) AS tool_errors,
      coalesce(max(CASE WHEN item_id % 4 = 0 THEN answer END), '') AS answer, bool_and(item_id % 4 <> 0) AS stopped
    FROM (SELECT *, min(CASE WHEN item_id % 4 = 0 THEN n END) OVER (PARTITION BY suite) AS last FROM
      (SELECT suite, item_id, answer, row_number() OVER (PARTITION BY suite ORDER BY item_id) AS n FROM eval_items) WHERE n <= 8) WHERE last IS NULL OR n <= last GROUP BY 1""",
)
def agent_runs(spark, where):
    """Transcripts of agents: steps, calls, errors and the answer."""
    k = F.col("item_id") % 4
    call = lambda args: F.concat(F.lit('```tool\n{"name": "lookup", "arguments": '), args, F.lit("}\n```"))
    reply = (
        F.when(k == 0, F.col("answer")).when(k == 1, call(F.lit('{"key": "a", "n": 3}'))).when(k == 2, F.lit("```tool\n{bad\n```")).otherwise(call(F.lit('{"key": "a", "n": "x"}')))
    )
    t = load(spark, where, "eval_items").select(F.col("suite").alias("conv"), F.col("item_id").alias("turn"), reply.alias("reply"))
    return P.transcripts(t, P.tool_registry(list(_REGISTRY)))


@R.query(
    "chaos_run",
    """WITH b AS (SELECT item_id AS "case", answer, 'The result is ' || answer || '.' AS clean, CASE item_id % 4 WHEN 0 THEN 'The result is ' || answer || '.'
        WHEN 1 THEN 'The result is ' || translate(answer, '0123456789', '5678901234') || '.' WHEN 2 THEN 'Sorry, the tool failed.' END AS reply FROM eval_items)
    SELECT "case", 'correct_with_faults' AS base_verdict, CASE item_id_ WHEN 0 THEN 'correct_with_faults' WHEN 2 THEN 'degraded' WHEN 3 THEN 'crashed'
      ELSE CASE WHEN len(list_filter(regexp_extract_all(answer, '[0-9]+'), lambda d: NOT contains(lower(reply), d))) = 0
        AND len(list_filter(string_split(lower(answer), ' '), lambda w: len(w) > 2 AND NOT contains(lower(reply), w))) = 0 THEN 'correct_with_faults' ELSE 'silent_failure' END END AS verdict
    FROM (SELECT *, "case" % 4 AS item_id_ FROM b)""",
)
def chaos_run(spark, where):
    """Every case clean and under a fault, joined."""
    return P.chaos(*_chaos(spark, where))


def _chaos(spark, where):
    e = load(spark, where, "eval_items").select(F.col("item_id").alias("case"), "answer")
    say = lambda c: F.concat(F.lit("The result is "), c, F.lit("."))
    k = F.col("case") % 4
    got = F.when(k == 0, say(F.col("answer"))).when(k == 1, say(O.corrupt("wrong", F.col("answer")))).otherwise("Sorry, the tool failed.")
    base = e.select("case", F.col("answer").alias("expected"), say(F.col("answer")).alias("answer"))
    return base, e.where(k != 3).select("case", got.alias("answer"))


@R.query(
    "chaos_rates",
    """WITH v AS (SELECT CASE item_id % 4 WHEN 0 THEN 'correct_with_faults' WHEN 2 THEN 'degraded' WHEN 3 THEN 'crashed'
      ELSE CASE WHEN len(list_filter(regexp_extract_all(answer, '[0-9]+'), lambda d: NOT contains('the result is ' || translate(answer, '0123456789', '5678901234') || '.', d))) = 0
        AND len(list_filter(string_split(lower(answer), ' '), lambda w: len(w) > 2 AND NOT contains(lower('The result is ' || translate(answer, '0123456789', '5678901234') || '.'), w))) = 0
      THEN 'correct_with_faults' ELSE 'silent_failure' END END AS v FROM eval_items)
    SELECT count(*) AS n, round(avg(CAST(v = 'correct_with_faults' AS INT)), 6) AS recovery_rate, round(avg(CAST(v = 'silent_failure' AS INT)), 6) AS silent_failure_rate,
      round(avg(CAST(v = 'degraded' AS INT)), 6) AS degradation_rate FROM v""",
)
def chaos_rates(spark, where):
    return P.chaos_rates(P.chaos(*_chaos(spark, where)))


@R.query(
    "message_lines",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN NULL ELSE CAST(event_id AS VARCHAR) END AS id,
      CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'tools/call' WHEN 'click' THEN 'nope' ELSE 'ping' END AS method,
      CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'scrub_pii' ELSE 'other' END END AS tool,
      CASE event_type WHEN 'error' THEN -32700 WHEN 'click' THEN -32601 WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN -32602 END END AS error, event_type <> 'signup' AS reply FROM events""",
)
def message_lines(spark, where):
    """Lines of a message stream: methods, tools, errors, and whether a reply is due."""
    t, i = F.col("event_type"), F.col("event_id")
    head = F.concat(F.lit('{"jsonrpc": "2.0", "id": '), i, F.lit(', "method": "'))
    name = F.when(i % 2 == 0, "scrub_pii").otherwise("other")
    line = (
        F.when(t == "error", "{bad").when(t == "signup", '{"jsonrpc": "2.0", "method": "ping"}').when(t == "click", F.concat(head, F.lit('nope"}')))
        .when(t == "view", F.concat(head, F.lit('tools/call", "params": {"name": "'), name, F.lit('"}}'))).otherwise(F.concat(head, F.lit('ping"}')))
    )
    rows = load(spark, where, "events").select("event_id", line.alias("value"))
    return P.messages(rows, ("ping", "initialize", "tools/list", "tools/call"), ("scrub_pii", "quality_score"))


@R.query(
    "call_checks",
    """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'missing n' WHEN 'error' THEN 'extra z' WHEN 'signup' THEN 'type n' ELSE 'unknown none' END AS fault FROM events""",
)
def call_checks(spark, where):
    """Calls checked against a registry of tools."""
    t = F.col("event_type")
    args = F.when(t == "view", '{"key": "a", "n": 1}').when(t == "click", '{"key": "a"}').when(t == "error", '{"key": "a", "n": 1, "z": 0}').otherwise('{"key": "a", "n": true}')
    calls = load(spark, where, "events").select("event_id", F.when(t == "purchase", "none").otherwise("lookup").alias("name"), args.alias("arguments"))
    return O.check_calls(calls, P.tool_registry(list(_REGISTRY))).select("event_id", "fault")
