"""Replays of request logs, agent transcripts, chaos runs and message lines, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import bind
from millrace.operators import safety, state, textops
from millrace.tables import bounded

# -- Gateway


def gateway_step(capacity: float, refill: float, budget: float | None, ttl_s: float, maxsize: int, threshold: int, cooldown_s: float):
    """One request through all gates in order: rate, budget, body, cache, breaker, upstream; then its cost is booked and its answer kept.

    The rate limit is charged whatever comes after it, the budget only for
    answers from upstream. All state is the key's own.
    """
    bucket, cache, breaker = state.bucket_step(capacity, refill), state.cache_step(ttl_s, maxsize), state.breaker_step(threshold, cooldown_s)

    def step(s: dict, r: dict) -> dict:
        out = {"status": 200, "cached": False, "spent": s.get("spent", 0.0)}
        if not r["known"]:
            return {**out, "status": 401}
        if not bucket(s.setdefault("bucket", {}), r)["allowed"]:
            return {**out, "status": 429}
        if budget is not None and out["spent"] >= budget:
            return {**out, "status": 402}
        if r["fault"] is not None:
            return {**out, "status": 400}
        kept = s.setdefault("cache", {})
        held = kept.get("entries", {}).get(r["request"])
        if held is not None and r["at"] - held <= ttl_s * 1e6:
            cache(kept, r)
            return {**out, "cached": True}
        if not breaker(s.setdefault("breaker", {}), r)["called"] or r["failed"]:
            return {**out, "status": 502}
        cache(kept, r)
        s["spent"] = out["spent"] + float(r["cost"] or 0.0)
        return {**out, "spent": s["spent"]}

    return step


def gateway(
    requests: DataFrame, key: str, order: list[str], capacity: float = 60, refill: float = 1.0, budget: float | None = None,
    ttl_s: float = 300.0, maxsize: int = 128, threshold: int = 3, cooldown_s: float = 30.0,
) -> DataFrame:
    """Requests with ``status`` (200, 400, 401, 402, 429, 502), ``cached`` and what the key has ``spent`` after each.

    Needs ``at`` (microseconds), ``known`` (the key exists), ``fault`` (of the
    body, null if none), ``request`` (what makes two requests the same),
    ``failed`` (upstream) and ``cost``. Keys are replayed apart, so that they
    spread over tasks: cache and breaker are per key.
    """
    step = gateway_step(capacity, refill, budget, ttl_s, maxsize, threshold, cooldown_s)
    fields = [("status", "int"), ("cached", "boolean"), ("spent", "double")]
    return state.fold(requests, key, order, dict, step, fields, ["at", "known", "fault", "request", "failed", "cost"])


def hardened(requests: DataFrame, replies: DataFrame, order: list[str], ttl_s: float = 600.0, limit: int = 3) -> DataFrame:
    """Requests with their ``outcome``: replayed, blocked, served or failed, and the provider that served.

    requests: (request, signature, prompt, at). A repeat of a signature within the
    time to live is a replay; a prompt whose scan is blocked goes no further.
    replies: (request, turn, provider, at, violation, error) of the providers asked in turn;
    the first without an error and a violation serves, unless its provider is in
    quarantine by then.
    """
    fresh = state.replay(requests, "signature", order, ttl_s)
    scanned = fresh.withColumn("verdict", safety.request_scan(F.coalesce("prompt", F.lit("")))["verdict"])
    open_ = scanned.where("passed and verdict <> 'blocked'").select("request")
    asked = replies.join(open_, "request", "left_semi")
    held = state.quarantine(asked.where("not error"), "provider", ["at", "request"], limit)
    good = held.where("violation is null and not refused").groupBy("request").agg(F.min(F.struct("turn", "provider")).alias("x"))
    outcome = (
        F.when(~F.col("passed"), "replayed").when(F.col("verdict") == "blocked", "blocked").when(F.col("x").isNotNull(), "served").otherwise("failed")
    )
    return scanned.join(good, "request", "left").select("request", outcome.alias("outcome"), F.col("x.provider").alias("provider"))


# -- Tools and agents


def tool_registry(tools: list[tuple[str, dict[str, str], bool]]) -> Column:
    """A map of tools by name to (declared parameters, dangerous) for :func:`call_faults`."""
    entry = lambda p, d: F.struct(F.create_map(*[F.lit(x) for kv in p.items() for x in kv]).cast("map<string,string>").alias("params"), F.lit(d).alias("dangerous"))
    return F.create_map(*[x for name, p, d in tools for x in (F.lit(name), entry(p, d))])


def call_faults(registry: Column, name: Column, arguments: Column, confirmed: bool = False) -> Column:
    """First fault of a call whose arguments are JSON text: unknown, dangerous, missing, extra or of a wrong type; null if none.

    A whole number passes as float; a boolean as no number.
    """
    kinds = {"str": ("STRING",), "int": ("BIGINT",), "float": ("BIGINT", "DECIMAL", "DOUBLE"), "bool": ("BOOLEAN",)}

    def judge(tool: Column) -> Column:
        def of(args: Column) -> Column:
            declared = F.map_keys(tool["params"])
            given = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
            missing, extra = F.array_sort(F.array_except(declared, given)), F.array_sort(F.array_except(given, declared))

            def fits(k: Column) -> Column:
                kind = F.coalesce(F.schema_of_variant(F.element_at(args, k)), F.lit("VOID"))
                ok = F.lit(False)
                for want, shapes in kinds.items():
                    for shape in shapes:
                        ok = ok | ((tool["params"][k] == want) & F.startswith(kind, F.lit(shape)))
                return ok

            wrong = F.array_sort(F.filter(declared, lambda k: ~fits(k)))
            return (
                F.when(args.isNull(), "arguments are no object")
                .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
                .when(F.size(extra) > 0, F.concat(F.lit("extra "), F.array_join(extra, ", ")))
                .when(F.size(wrong) > 0, F.concat(F.lit("type "), F.array_join(wrong, ", ")))
            )

        parsed = F.from_json(arguments, "map<string,variant>")
        return F.when(tool.isNull(), F.concat(F.lit("unknown "), name)).when(tool["dangerous"] & F.lit(not confirmed), F.concat(F.lit("dangerous "), name)).otherwise(bind(parsed, of))

    return bind(F.try_element_at(registry, name), judge)


def transcripts(replies: DataFrame, registry: Column, most_steps: int = 8) -> DataFrame:
    """Agent runs over replies (conv, turn, reply): one row per conversation.

    Turns run in order until the first reply without a call or error, or until
    ``most_steps``. Gives (conv, steps, calls, parse_errors, tool_errors, answer,
    stopped): a run that ends without an answer has stopped.
    """
    w = Window.partitionBy("conv").orderBy("turn")
    read = replies.withColumn("step", F.row_number().over(w)).where(F.col("step") <= most_steps).withColumn("c", textops.tool_calls(F.col("reply")))
    ends = F.col("c.error").isNull() & (F.size("c.calls") == 0)
    read = read.withColumn("ends", ends).withColumn("faults", F.transform("c.calls", lambda x: call_faults(registry, x["name"], x["arguments"])))
    last = F.min(F.when(F.col("ends"), F.col("step"))).over(Window.partitionBy("conv"))
    run = read.withColumn("last", last).where(F.col("last").isNull() | (F.col("step") <= F.col("last")))
    return run.groupBy("conv").agg(
        F.sum((~F.col("ends")).cast("int")).alias("steps"),
        F.sum(F.size("c.calls")).alias("calls"),
        F.count_if(F.col("c.error").isNotNull()).alias("parse_errors"),
        F.sum(F.size(F.filter("faults", lambda f: f.isNotNull()))).alias("tool_errors"),
        F.coalesce(F.max(F.when(F.col("ends"), F.col("c.clean"))), F.lit("")).alias("answer"),
        F.bool_and(~F.col("ends")).alias("stopped"),
    )


# -- Chaos runs


def chaos(baseline: DataFrame, faulted: DataFrame) -> DataFrame:
    """Clean and faulted answers (case, expected, answer), joined by case: (case, base_verdict, verdict). A case without an answer has crashed."""
    base = baseline.select("case", "expected", textops.recovery(F.col("expected"), F.col("answer")).alias("base_verdict"))
    under = faulted.select("case", F.col("answer").alias("got"))
    return base.join(under, "case", "left").select("case", "base_verdict", textops.recovery(F.col("expected"), F.col("got")).alias("verdict"))


def chaos_rates(cases: DataFrame) -> DataFrame:
    """Cases and the shares that recovered, failed silently or degraded; 0 without cases."""
    rate = lambda v: F.round(F.coalesce(F.avg((F.col("verdict") == v).cast("int")), F.lit(0.0)), 6)
    return cases.agg(
        F.count("*").alias("n"), rate("correct_with_faults").alias("recovery_rate"), rate("silent_failure").alias("silent_failure_rate"), rate("degraded").alias("degradation_rate")
    )


# -- Message lines

#: Error codes of the message protocol.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602


def messages(lines: DataFrame, methods: tuple[str, ...], tools: tuple[str, ...], value: str = "value") -> DataFrame:
    """Lines of a JSON-RPC stream as rows: id, method, tool, error code (null if none), and whether a reply is due; blank lines are skipped.

    A bad line gives an error and the next one is read. Messages without an id
    are notifications and get no reply, whatever is wrong with them.
    """
    text = F.trim(F.regexp_replace(value, r"[\r\n\t]", " "))
    v = F.col("v")
    get = lambda path, kind="variant": F.try_variant_get(v, path, kind)
    is_ = lambda x, kind: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit(kind)), F.lit(False))
    rows = lines.where(text != "").withColumn("v", F.try_parse_json(text))
    named = is_(get("$.method"), "STRING")
    method, tool = get("$.method", "string"), get("$.params.name", "string")
    code = (
        F.when(v.isNull(), PARSE_ERROR)
        .when(~is_(v, "OBJECT") | ~F.coalesce(get("$.jsonrpc", "string") == "2.0", F.lit(False)) | ~named, INVALID_REQUEST)
        .when(~method.isin(*methods), METHOD_NOT_FOUND)
        .when((method == "tools/call") & ~F.coalesce(is_(get("$.params.name"), "STRING") & tool.isin(*tools), F.lit(False)), INVALID_PARAMS)
    )
    cols = [c for c in lines.columns if c != value]
    due = v.isNull() | ~is_(v, "OBJECT") | get("$.id").isNotNull()
    return rows.select(*cols, F.to_json(get("$.id")).alias("id"), F.when(named, method).alias("method"), F.when(method == "tools/call", tool).alias("tool"), code.alias("error"), due.alias("reply"))


def model_replies(prompts: DataFrame, replies: DataFrame, fallback: str | None = None) -> DataFrame:
    """Prompts (id, prompt) answered from a table of replies (prompt, reply): a scripted model. Unknown prompts get the fallback."""
    one = replies.groupBy("prompt").agg(F.min("reply").alias("reply"))
    return prompts.join(one, "prompt", "left").withColumn("reply", F.coalesce("reply", F.lit(fallback)))


def catalog(spark, tools: list[tuple[str, str, dict[str, str]]]) -> DataFrame:
    """The tools (name, description, parameters) as a table with a JSON schema of their parameters."""
    import json

    kinds = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}
    rows = [
        (n, d, json.dumps({"type": "object", "properties": {k: {"type": kinds[v]} for k, v in p.items()}, "required": sorted(p)}, sort_keys=True))
        for n, d, p in tools
    ]
    return spark.createDataFrame(rows, "name string, description string, schema string")


def tool_names(table: DataFrame) -> tuple[str, ...]:
    return tuple(sorted(r.name for r in bounded(table.select("name"), 10_000, "tools")))
