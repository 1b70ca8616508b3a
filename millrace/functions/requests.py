"""Checks, costs, signatures and small parsers for request and job logs."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import SPACE, n_words, strip

#: Prices of 1,000 tokens.
PROMPT_PRICE, COMPLETION_PRICE = 0.002, 0.006


def story_gate(c: Column) -> Column:
    """Whether a reply is a story: 80 to 400 words and no chatty preamble."""
    t = strip(c)
    return n_words(t).between(80, 400) & ~t.rlike(r"(?i)^(#|\d+\.|here('|’)s|sure|certainly)")


def body_fault(body: str | None) -> str | None:
    """First fault of a chat body, or None."""
    try:
        b = json.loads(body or "")
    except ValueError:
        b = None
    if not isinstance(b, dict):
        return "body"
    if not isinstance(b.get("model"), str) or not b["model"].strip():
        return "model"
    if b.get("stream"):
        return "stream"
    messages = b.get("messages")
    if not isinstance(messages, list) or not messages:
        return "messages"
    for i, m in enumerate(messages):
        role, content = (m.get("role"), m.get("content")) if isinstance(m, dict) else (None, None)
        if not isinstance(role, str) or not role.strip() or not isinstance(content, str):
            return f"messages[{i}]"
    most, heat = b.get("max_tokens"), b.get("temperature")
    if most is not None and (type(most) is not int or most <= 0):
        return "max_tokens"
    if heat is not None and (type(heat) not in (int, float) or not 0 <= heat <= 2):
        return "temperature"
    return None


@F.pandas_udf(T.StringType())
def chat_fault(bodies: pd.Series) -> pd.Series:
    return bodies.map(body_fault)


def admission(question: Column, used: Column, quota: Column, anonymous: Column, anonymous_limit: int = 10) -> Column:
    """HTTP status of a request: 400 empty, 429 above the anonymous limit, 402 above the quota, else 200."""
    return (
        F.when(F.coalesce(strip(question), F.lit("")) == "", 400)
        .when(anonymous & (used >= anonymous_limit), 429)
        .when(~anonymous & (used >= quota), 402)
        .otherwise(200)
    )


def token_estimate(c: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)


def cost_usd(prompt: Column, completion: Column, prompt_price: float = PROMPT_PRICE, completion_price: float = COMPLETION_PRICE) -> Column:
    return prompt / 1000 * prompt_price + completion / 1000 * completion_price


def backoff(attempt: Column, base: float = 0.25) -> Column:
    return base * F.pow(F.lit(2.0), attempt)


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a half cosine down to zero."""
    fall = 0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))))
    return F.when(step < warmup, peak * (step + 1) / max(1, warmup)).otherwise(peak * fall)


def sign(body: bytes, secret: bytes, at: int) -> str:
    return hmac.new(secret, str(at).encode() + b":" + body, hashlib.sha256).hexdigest()


def signed(secret: bytes):
    """Column function (body, timestamp) to signature."""

    @F.pandas_udf(T.StringType())
    def f(bodies: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else sign(b.encode(), secret, int(t)) for b, t in zip(bodies, at)])

    return f


def verified(signature: Column, expected: Column, at: Column, now: Column, skew_s: int = 300) -> Column:
    """``ok``, ``signature_mismatch`` or ``timestamp_skew``."""
    return F.when(~signature.eqNullSafe(expected), "signature_mismatch").when(F.abs(now - at) > skew_s, "timestamp_skew").otherwise("ok")


def fingerprint(c: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(digits))


def char_ids(c: Column, alphabet: str) -> Column:
    """Ids of characters in a sorted alphabet; unseen ones count as a blank, or 0 if it has none."""
    chars = sorted(set(alphabet))
    other = chars.index(" ") if " " in chars else 0
    known = F.array(*map(F.lit, chars))
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.coalesce(F.nullif(F.array_position(known, x).cast("int"), F.lit(0)) - 1, F.lit(other)))


def chars_of(ids: Column, alphabet: str) -> Column:
    known = F.array(*map(F.lit, sorted(set(alphabet))))
    return F.array_join(F.transform(ids, lambda i: F.get(known, i)), "")


def progress(kind: Column, line: Column) -> Column:
    """Struct (stage, done, total) of a job's log line; null where a line tells nothing."""
    number = lambda p, g=1: F.regexp_extract(line, p, g).try_cast("int")
    return (
        F.when((kind == "distill") & line.rlike(r"generated \d+/\d+"), F.struct(F.lit("writing stories").alias("stage"), number(r"generated (\d+)/(\d+)").alias("done"), number(r"generated (\d+)/(\d+)", 2).alias("total")))
        .when((kind == "distill") & line.rlike(r"grading: \d+ → \d+"), F.struct(F.lit("grading").alias("stage"), number(r"grading: (\d+) → (\d+)", 2).alias("done"), number(r"grading: (\d+)").alias("total")))
        .when((kind == "distill") & line.startswith("wrote "), F.struct(F.lit("done").alias("stage"), F.lit(None).cast("int").alias("done"), F.lit(None).cast("int").alias("total")))
        .when((kind != "distill") & line.rlike(r"step\s+\d+") & line.contains("loss"), F.struct(F.lit("training").alias("stage"), number(r"step\s+(\d+)").alias("done"), F.lit(None).cast("int").alias("total")))
        .when((kind != "distill") & line.startswith("done in"), F.struct(F.lit("done").alias("stage"), F.lit(None).cast("int").alias("done"), F.lit(None).cast("int").alias("total")))
    )


def lsh_miss(similarity: Column, bands: int = 16, rows: int = 4) -> Column:
    """Probability that a pair of this similarity shares no band of a min-hash index."""
    return F.pow(1 - F.pow(similarity, F.lit(float(rows))), F.lit(float(bands)))


def level_draw(key: Column, scale: float, seed: int = 0) -> Column:
    """Geometric level of an item in a layered graph: floor(-ln u * scale), u from a hash of the key, so it is repeatable."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    return F.floor(-F.log(u) * scale).cast("int")


def key_variable(key: Column, routes: list[tuple[str, str]], default: str) -> Column:
    """The variable that a key belongs to by the first prefix it begins with."""
    return F.coalesce(*[F.when(F.startswith(key, F.lit(p)), F.lit(v)) for p, v in routes], F.lit(default))


def month_key(at: Column) -> Column:
    """``yyyy-MM`` in UTC of seconds since 1970, whatever the session's time zone."""
    days = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(at / 86400).cast("int"))
    return F.date_format(days, "yyyy-MM")


def iso_utc(at: Column) -> Column:
    """ISO text in UTC of seconds since 1970."""
    days, rest = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(at / 86400).cast("int")), F.pmod(F.floor(at).cast("long"), F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", (rest / 3600).cast("int"), (F.pmod(rest, F.lit(3600)) / 60).cast("int"), F.pmod(rest, F.lit(60)).cast("int"))
    return F.concat(F.date_format(days, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("+00:00"))


def context(hits: Column) -> Column:
    """Numbered passages from an array of (doc, heading, text)."""
    part = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), h["doc"], F.lit(" · "), h["heading"], F.lit(")\n"), h["text"])
    return F.array_join(F.transform(hits, part), "\n\n")


def snippet(c: Column, n: int = 280) -> Column:
    return F.regexp_replace(F.substring(c, 1, n), f"[{SPACE}]+", " ")
