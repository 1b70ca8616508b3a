"""Redaction of personal data and secrets: the sequential and the single-pass rule sets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The sequential rules, in order; both secret rules count together.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VENDOR_KEY = (
    r"(?:sk-or-v1-[\w-]{20,}|sk-ant-[\w-]{20,}|sk-[\w]{20,}|nvapi-[\w-]{20,}"
    r"|ghp_[A-Za-z0-9]{30,}|gho_[A-Za-z0-9]{30,}|xox[bap]-[\w-]{10,})"
)
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\b"
DIGIT_ID = r"(?<![\d-])\d{10,}(?![\d-])"
PHONE = r"(?<![\d-])(?:\+?\d[\d\s().-]{7,}\d)(?![\d-])"
DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
#: The alternatives of the single pass, in order of priority.
SINGLE_PASS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    (
        "api_key",
        r"\b(?:sk-or-v1-[A-Za-z0-9_-]{8,}|sk-[A-Za-z0-9_-]{16,}|nvapi-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[aepbrs]-[A-Za-z0-9-]{10,})\b",
    ),
    ("jwt", r"\b[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\b"),
    ("date", r"\b\d{4}-\d{1,2}-\d{1,2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b\d{1,2}-\d{1,2}-\d{4}\b"),
    ("phone", r"\+?\b\d[\d\s.\-()]{7,}\d(?!\w)"),
)
MARK = "[REDACTED]"

_PHONE = re.compile(PHONE)
_DATE = re.compile(DATE)
_ONE = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SINGLE_PASS))


def _phones(text: str) -> tuple[str, int]:
    n = 0

    def sub(m: re.Match) -> str:
        nonlocal n
        got = m.group()
        if _DATE.fullmatch(got.strip()) or sum(c.isdigit() for c in got) < 9:
            return got
        n += 1
        return MARK

    return _PHONE.sub(sub, text), n


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
def _scrub_phones(texts: pd.Series) -> pd.DataFrame:
    """Dates and short numbers stay; what a match is can only be told after it, so this rule needs code."""
    return pd.DataFrame([(None, 0) if t is None else _phones(t) for t in texts], columns=["text", "n"])


def scrub(c: Column) -> Column:
    """Struct (text, counts): email, secrets, long digit runs and phones replaced one rule after another.

    All but the last rule are JVM expressions; texts without nine digits in a row
    of number characters skip the last one's work.
    """
    counts, text = [], c
    for kind, pattern in (("email", EMAIL), ("secret", VENDOR_KEY), ("jwt", JWT), ("digit_id", DIGIT_ID)):
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(kind))
        text = F.regexp_replace(text, pattern, MARK)
    phones = _scrub_phones(text)
    return F.struct(
        phones["text"].alias("text"),
        F.struct(
            counts[0].alias("email"),
            (counts[1] + counts[2]).alias("secret"),
            counts[3].alias("digit_id"),
            phones["n"].alias("phone"),
        ).alias("counts"),
    )


def scrub_one(text: str | None) -> tuple[str | None, dict[str, int]]:
    """The single pass over one text: (text, counts by kind). Dates stay."""
    counts: dict[str, int] = {}
    if not text:
        return text, counts

    def sub(m: re.Match) -> str:
        kind, got = m.lastgroup, m.group()
        if kind == "date":
            return got
        if kind == "phone":
            digits = len(re.sub(r"\D", "", got))
            kind = ("phone" if digits >= 9 else None) if re.search(r"[\s.\-()]", got) else ("digit_run" if digits >= 10 else None)
            if kind is None:
                return got
        counts[kind] = counts.get(kind, 0) + 1
        return MARK

    return _ONE.sub(sub, text), counts


KINDS = ("email", "phone", "digit_run", "api_key", "jwt")


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(k, T.IntegerType()) for k in KINDS]]))
def scrub_single_pass(texts: pd.Series) -> pd.DataFrame:
    """The single-pass rule set as a column function."""
    done = [scrub_one(t) for t in texts]
    return pd.DataFrame([(t, *(n.get(k, 0) for k in KINDS)) for t, n in done], columns=["text", *KINDS])
