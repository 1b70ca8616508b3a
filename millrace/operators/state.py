"""Keyed state machines over event logs, replayed in order.

Rows are repartitioned by key, sorted within partitions and streamed through a
step function that carries one small state per key. No key's rows are ever held
together, so a hot key costs time in one task but no memory; the order within a
key is part of the semantics and can't be split. The same step functions drive
the streaming twins.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.text import bind


def fold(
    df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], fields: list[tuple[str, str]], reads: list[str]
) -> DataFrame:
    """``df`` with the columns ``fields`` (name, type) that ``step(state, row)`` gives for each row in order.

    ``row`` holds the columns ``reads``; all others pass through as Arrow data.
    Rows without a key form a key of their own. Ties of ``order`` must be broken
    by its last column. Columns of ``df`` that carry the new names are replaced.
    """
    names = [n for n, _ in fields]
    base = df.drop(*names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), {}
        for batch in batches:
            keys = batch.column(key).to_pylist()
            cols = [batch.column(n).to_pylist() for n in reads]
            out: list[dict] = []
            for k, values in zip(keys, zip(*cols) if cols else ((),) * len(keys)):
                if k != last:
                    last, state = k, start()
                out.append(step(state, dict(zip(reads, values))))
            new = [pa.array([o[n] for o in out], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow)), *new], schema=arrow)

    return base.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def micros(at) -> int:
    """Microseconds of a timestamp, or the number itself."""
    return at if isinstance(at, int) else int(round(at.timestamp() * 1_000_000))


# -- Steps: a state (dict) and a row (dict) give the new columns; the state is changed in place.


def bucket_step(capacity: float, refill: float):
    """Token bucket that starts full: allowed if a whole token is there. Time never runs backwards."""

    def step(s: dict, r: dict) -> dict:
        at = r["at"]
        if not s:
            s.update(tokens=float(capacity), at=at)
        s["tokens"] = min(float(capacity), s["tokens"] + max(0, at - s["at"]) / 1e6 * refill)
        s["at"] = max(at, s["at"])
        ok = s["tokens"] >= 1.0
        if ok:
            s["tokens"] -= 1.0
        return {"allowed": ok, "tokens": s["tokens"]}

    return step


def budget_step(budget: float | None):
    """Spending is checked before the call and added after it; a null budget is unlimited."""

    def step(s: dict, r: dict) -> dict:
        spent = s.get("spent", 0.0)
        ok = budget is None or spent < budget
        if ok:
            s["spent"] = spent + float(r["cost"] or 0.0)
        return {"accepted": ok, "spent": s.get("spent", 0.0)}

    return step


def breaker_step(threshold: int = 3, cooldown_s: float = 30.0):
    """closed, open after ``threshold`` failures in a row, half-open after the cool-down; then one call decides."""

    def step(s: dict, r: dict) -> dict:
        if not s:
            s.update(state="closed", failures=0, since=0)
        if s["state"] == "open" and r["at"] - s["since"] >= cooldown_s * 1e6:
            s["state"] = "half-open"
        if s["state"] == "open":
            return {"called": False, "state": "open", "failures": s["failures"]}
        if not r["failed"]:
            s.update(state="closed", failures=0)
        else:
            s["failures"] += 1
            if s["state"] == "half-open" or s["failures"] >= threshold:
                s.update(state="open", since=r["at"])
        return {"called": True, "state": s["state"], "failures": s["failures"]}

    return step


def replay_step(ttl_s: float = 600.0):
    """The first sight of a signature passes; repeats within the time to live fail and don't refresh it."""

    def step(s: dict, r: dict) -> dict:
        first = s.get("first")
        fresh = first is None or r["at"] - first > ttl_s * 1e6
        if fresh:
            s["first"] = r["at"]
        return {"passed": fresh}

    return step


def quarantine_step(limit: int = 3):
    """Violations in a row are collected and cleared by a success; at ``limit`` the provider is quarantined for good.

    A quarantined provider's calls are refused before anything is recorded, so
    its violations stay what they were. Malformed bodies are recorded but don't
    trigger quarantine by themselves.
    """

    def step(s: dict, r: dict) -> dict:
        kind, shut, run = r["violation"], s.get("shut", False), s.get("run", 0)
        if not shut:
            run = 0 if kind is None else run + 1
            s.update(run=run, shut=run >= limit and kind is not None and kind != "malformed")
        return {"violations": run, "quarantined": s["shut"], "refused": shut}

    return step


def violation(body: Column, latency_ms: Column, input_chars: Column, keys: tuple[str, ...], least: float, most: float, max_latency_ms: float) -> Column:
    """First violation of a provider's reply: malformed, missing_keys, token_usage_sanity or latency_outlier; null if none.

    The token ratio is judged only where characters and tokens are known.
    """

    def judge(v: Column) -> Column:
        get = lambda path, kind="variant": F.try_variant_get(v, path, kind)
        tokens = F.coalesce(get("$.usage.prompt_tokens", "double"), F.lit(0.0)) + F.coalesce(get("$.usage.completion_tokens", "double"), F.lit(0.0))
        ratio = tokens / F.greatest(input_chars, F.lit(1))
        lacking = F.lit(False)
        for k in keys:
            lacking = lacking | get(f"$.{k}").isNull()
        return (
            F.when(v.isNull(), "malformed")
            .when(lacking, "missing_keys")
            .when((input_chars > 0) & (tokens > 0) & ~ratio.between(least, most), "token_usage_sanity")
            .when(latency_ms > max_latency_ms, "latency_outlier")
        )

    return bind(F.try_parse_json(body), judge)


def cache_step(ttl_s: float = 300.0, maxsize: int = 128):
    """A cache with time to live: older than it is a miss; when full an expired entry goes, else the least recently used."""

    def step(s: dict, r: dict) -> dict:
        c: dict = s.setdefault("entries", {})  # the least recently used first
        k, at = r["request"], r["at"]
        if k in c:
            if at - c[k] <= ttl_s * 1e6:
                c[k] = c.pop(k)
                return {"hit": True, "size": len(c)}
            del c[k]
        if len(c) >= maxsize:
            old = next((x for x, t in c.items() if at - t > ttl_s * 1e6), None)
            del c[old if old is not None else next(iter(c))]
        c[k] = at
        return {"hit": False, "size": len(c)}

    return step


def chain_step(secret: bytes):
    """Signature chain: each signature covers the one before it and the body."""

    def step(s: dict, r: dict) -> dict:
        body = (r["body"] or "").encode()
        s["sig"] = hmac.new(secret, s.get("sig", "").encode() + body, hashlib.sha256).hexdigest()
        return {"signature": s["sig"]}

    return step


def lcg_step(options: list[tuple[str, float]], seed: int = 20260923):
    """Fault scheduler: one roll per option until one fires; a linear congruence keeps runs repeatable."""

    def step(s: dict, r: dict) -> dict:
        state, fault, rolls = s.get("state", seed), None, 0
        for name, p in options:
            state = (state * 1103515245 + 12345) % 2**31
            rolls += 1
            if state / 2**31 < p:
                fault = name
                break
        s["state"] = state
        return {"fault": fault, "rolls": rolls}

    return step


# -- Operators


def with_micros(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))


def token_bucket(events: DataFrame, key: str, order: list[str], capacity: float = 60, refill: float = 1.0) -> DataFrame:
    """Events with ``allowed`` and the tokens left; needs a column ``at`` in microseconds."""
    return fold(events, key, order, dict, bucket_step(capacity, refill), [("allowed", "boolean"), ("tokens", "double")], ["at"])


def budget(events: DataFrame, key: str, order: list[str], limit: float | None) -> DataFrame:
    """Events with ``accepted`` and what is spent after each; needs a column ``cost``."""
    return fold(events, key, order, dict, budget_step(limit), [("accepted", "boolean"), ("spent", "double")], ["cost"])


def breaker(events: DataFrame, key: str, order: list[str], threshold: int = 3, cooldown_s: float = 30.0) -> DataFrame:
    """Events with ``called``, the breaker's state after each and the failures in a row; needs ``failed`` and ``at``."""
    fields = [("called", "boolean"), ("state", "string"), ("failures", "int")]
    return fold(events, key, order, dict, breaker_step(threshold, cooldown_s), fields, ["failed", "at"])


def replay(events: DataFrame, key: str, order: list[str], ttl_s: float = 600.0) -> DataFrame:
    """Events with ``passed``: not a repeat of its key within the time to live."""
    return fold(events, key, order, dict, replay_step(ttl_s), [("passed", "boolean")], ["at"])


def quarantine(events: DataFrame, key: str, order: list[str], limit: int = 3) -> DataFrame:
    """Events with violations in a row, whether the provider is quarantined, and whether the call was refused; needs ``violation``."""
    fields = [("violations", "int"), ("quarantined", "boolean"), ("refused", "boolean")]
    return fold(events, key, order, dict, quarantine_step(limit), fields, ["violation"])


def ttl_cache(events: DataFrame, key: str, order: list[str], ttl_s: float = 300.0, maxsize: int = 128) -> DataFrame:
    """Events with ``hit`` and the size of their key's cache; needs ``request`` and ``at``."""
    return fold(events, key, order, dict, cache_step(ttl_s, maxsize), [("hit", "boolean"), ("size", "int")], ["request", "at"])


def signature_chain(events: DataFrame, key: str, order: list[str], secret: bytes) -> DataFrame:
    """Events with ``signature``: each covers the one before it of its key; needs ``body``."""
    return fold(events, key, order, dict, chain_step(secret), [("signature", "string")], ["body"])


def round_robin(events: DataFrame, key: str, order: list[str], weights: list[tuple[str, int]], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Events with ``provider``: names take turns by their whole-number weights, excluded ones never; without any left it is null."""
    turns = [n for n, w in weights for _ in range(w) if n not in exclude]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return events.withColumn("provider", F.get(F.array(*map(F.lit, turns)), place % len(turns)) if turns else F.lit(None).cast("string"))


def fault_schedule(calls: DataFrame, key: str, order: list[str], options: list[tuple[str, float]], seed: int = 20260923) -> DataFrame:
    """Calls with the fault that fires, if any, and the rolls it took."""
    return fold(calls, key, order, dict, lcg_step(options, seed), [("fault", "string"), ("rolls", "int")], [])


def failover(attempts: DataFrame, max_retries: int = 2, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Outcome of each request over its candidates in (priority, provider) order, excluded ones never tried.

    attempts: (request, priority, provider, attempt, ok). Of each candidate the
    first ``max_retries + 1`` attempts count; the first success serves. Gives
    (request, served_by, tries, backoff_s), the back-off being 0.25 * 2 ** attempt
    after each failure but a candidate's last.
    """
    used = attempts.where((F.col("attempt") <= max_retries) & ~F.col("provider").isin(*exclude)) if exclude else attempts.where(F.col("attempt") <= max_retries)
    first = F.min(F.when(F.col("ok"), F.struct("priority", "provider", "attempt")))
    won = used.groupBy("request").agg(first.alias("won"))
    spot = F.struct("priority", "provider", "attempt")
    made = used.join(won, "request").where(F.col("won").isNull() | (spot <= F.col("won")))
    wait = F.when(~F.col("ok") & (F.col("attempt") < max_retries), 0.25 * F.pow(F.lit(2.0), F.col("attempt"))).otherwise(0.0)
    return made.groupBy("request").agg(
        F.first("won.provider").alias("served_by"), F.count("*").alias("tries"), F.round(F.sum(wait), 6).alias("backoff_s")
    )


def usage(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Events per key and month."""
    return events.groupBy(key, F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))


def quota(used: DataFrame, plans: DataFrame, default: int = 100) -> DataFrame:
    """used, quota and what remains (never below 0); plans: (plan, quota), an unknown plan has the default."""
    q = F.coalesce("quota", F.lit(default))
    return used.join(plans, "plan", "left").withColumn("quota", q).withColumn("remaining", F.greatest(F.col("quota") - F.col("used"), F.lit(0)))


#: Accuracy of the first pass of :func:`quantiles`, and how many of its steps the second pass looks at on either side.
SKETCH, AROUND = 1_000, 3


def quantiles(df: DataFrame, group: str, value: str, ps: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Index quantiles per group and p: sorted[int(n * p)], and nearest rank ceil(p * n); value 0 and null are left out.

    Exact, in two passes without sorting a group: a sketch brackets every
    quantile, then values within the brackets are counted one by one and those
    below them together. A group of n rows leaves about 6 n / 1000 values per p.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).alias("v")).where("v is not null and v <> 0")
    ends = [min(1.0, max(0.0, p + d * AROUND / SKETCH)) for p in ps for d in (-1, 1)]
    sketch = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", ends, SKETCH).alias("ends")
    )
    # The ends of the range hold for quantiles near 0 and 1.
    each = [
        F.struct(
            F.lit(i).alias("i"),
            (F.col("low") if ends[2 * i] == 0 else F.col("ends")[2 * i]).alias("a"),
            (F.col("high") if ends[2 * i + 1] == 1 else F.col("ends")[2 * i + 1]).alias("b"),
        )
        for i in range(len(ps))
    ]
    bounds = sketch.select("g", "n", F.array(*each).alias("each"))
    near = rows.join(F.broadcast(bounds) if _few(bounds) else bounds, "g").select("g", "n", "v", F.explode("each").alias("e")).where(F.col("v") <= F.col("e.b"))
    # Values below a bracket count as one value that is never taken.
    spot = F.when(F.col("v") >= F.col("e.a"), F.col("v"))
    counted = near.groupBy("g", "n", F.col("e.i").alias("i"), spot.alias("v")).agg(F.count("*").alias("c"))
    until = F.sum("c").over(Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("v")))
    counted = counted.withColumn("until", until).withColumn("before", F.col("until") - F.col("c"))
    aggs = [F.first("n").alias("n")]
    for i, p in enumerate(ps):
        tag = f"p{round(p * 100)}"
        for at, name in ((F.least(F.floor(F.col("n") * p) + 1, F.col("n")), "index"), (F.greatest(F.ceil(F.col("n") * p), F.lit(1)), "nearest")):
            aggs.append(F.max(F.when((F.col("i") == i) & (at > F.col("before")) & (at <= F.col("until")), F.col("v"))).alias(f"{tag}_{name}"))
    return counted.groupBy(F.col("g").alias(group)).agg(*aggs)


def _few(df: DataFrame, limit: int = 100_000) -> bool:
    """Whether a table has at most ``limit`` rows, so that it may be sent to every task."""
    return df.limit(limit + 1).count() <= limit


def trace_stats(traces: DataFrame, last: int = 200, latency: str = "latency_ms") -> DataFrame:
    """Of the latest ``last`` traces (by id): count, p50 and p95 latency by index, token sum and cost sum to 4 places.

    Latencies that are 0 or null are left out of the quantiles. No traces give one row of zeros and nulls.
    """
    recent = traces.orderBy(F.desc("id")).limit(last)
    v = F.array_sort(F.filter(F.collect_list(latency), lambda x: x != 0))  # at most ``last`` values
    at = lambda p: F.get(F.col("v"), F.floor(F.size("v") * p).cast("int"))
    sums = recent.agg(v.alias("v"), F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))
    return sums.select("n", at(0.5).alias("p50"), at(0.95).alias("p95"), "tokens", "cost")
