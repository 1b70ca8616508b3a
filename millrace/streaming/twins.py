"""Structured Streaming twins of the keyed state operators.

They run the same step functions as the batch replay, with the state of a key
kept by the state store. Rows of one key within a micro-batch are processed in
the order of their time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators import state as S


def _stateful(stream: DataFrame, key: str, order: list[str], step: Callable[[dict, dict], dict], fields: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """``keep`` and the step's columns for every row; the state is one JSON text per key."""
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order)
        got = []
        for r in rows.to_dict("records"):
            clean = {k: (None if v is None or v is pd.NaT or v != v else v) for k, v in r.items()}
            got.append({**{c: r[c] for c in keep}, **step(now, clean)})
        state.update((json.dumps(now),))
        yield pd.DataFrame(got, columns=out.names)

    return stream.groupBy(key).applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.NoTimeout)


def token_bucket(stream: DataFrame, key: str, order: list[str], keep: list[str], capacity: float = 60, refill: float = 1.0) -> DataFrame:
    return _stateful(stream, key, order, S.bucket_step(capacity, refill), [("allowed", "boolean"), ("tokens", "double")], keep)


def budget(stream: DataFrame, key: str, order: list[str], keep: list[str], limit: float | None) -> DataFrame:
    return _stateful(stream, key, order, S.budget_step(limit), [("accepted", "boolean"), ("spent", "double")], keep)


def breaker(stream: DataFrame, key: str, order: list[str], keep: list[str], threshold: int = 3, cooldown_s: float = 30.0) -> DataFrame:
    fields = [("called", "boolean"), ("state", "string"), ("failures", "int")]
    return _stateful(stream, key, order, S.breaker_step(threshold, cooldown_s), fields, keep)


def replay(stream: DataFrame, key: str, order: list[str], keep: list[str], ttl_s: float = 600.0) -> DataFrame:
    return _stateful(stream, key, order, S.replay_step(ttl_s), [("passed", "boolean")], keep)


def quarantine(stream: DataFrame, key: str, order: list[str], keep: list[str], limit: int = 3) -> DataFrame:
    return _stateful(stream, key, order, S.quarantine_step(limit), [("violations", "int"), ("quarantined", "boolean"), ("refused", "boolean")], keep)


def ttl_cache(stream: DataFrame, key: str, order: list[str], keep: list[str], ttl_s: float = 300.0, maxsize: int = 128) -> DataFrame:
    return _stateful(stream, key, order, S.cache_step(ttl_s, maxsize), [("hit", "boolean"), ("size", "int")], keep)


def round_robin(stream: DataFrame, key: str, order: list[str], keep: list[str], weights: list[tuple[str, int]], exclude: tuple[str, ...] = ()) -> DataFrame:
    turns = [n for n, w in weights for _ in range(w) if n not in exclude]

    def step(s: dict, r: dict) -> dict:
        at = s["at"] = (s.get("at", -1) + 1) % max(1, len(turns))
        return {"provider": turns[at] if turns else None}

    return _stateful(stream, key, order, step, [("provider", "string")], keep)


def first_within(stream: DataFrame, ts: str, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Rows whose key wasn't seen within the time; the state is dropped by the watermark."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def usage(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per key and window; later than ``late`` is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("used")).select(
        F.col("w.start").alias("start"), key, "used"
    )
