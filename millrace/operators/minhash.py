"""MinHash signatures and banded candidate search with the two published hash families.

Family ``a`` takes ``(a * x + b) mod 2**64`` with constants from a plain 64-bit
BLAKE2b of a seed; family ``b`` takes ``(a * h + b) mod (2**61 - 1)`` with a
keyed BLAKE2b. Both use 64 permutations of the five-word shingles.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.graph import components
from millrace.tables import spread

PERMUTATIONS, BANDS, SEED, SHINGLE = 64, 16, 1337, 5
PRIME = (1 << 61) - 1
#: Members of one part of a bucket; pairs of parts are compared apart.
PART = 512
#: The key of family b; signatures made elsewhere with another key need that key here.
KEY_B = b"millrace/minhash/b"


def _h64(data: bytes, **more) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, **more).digest(), "big")


class FamilyA:
    """Words [a-z0-9]+; arithmetic wraps at 64 bits."""

    words = re.compile(r"[a-z0-9]+")

    def __init__(self, key: bytes = b"") -> None:
        h = [_h64(f"{SEED}:{i}".encode()) for i in range(PERMUTATIONS)]
        self.a = np.array([x | 1 for x in h], np.uint64)
        self.b = np.array([(x >> 32) | 1 for x in h], np.uint64)

    def signature(self, shingles: list[str]) -> np.ndarray:
        x = np.frombuffer(b"".join([hashlib.blake2b(s.encode(), digest_size=8).digest() for s in shingles]), ">u8").astype(np.uint64)
        low = None
        for k in range(0, len(x), 512):
            part = (x[k : k + 512, None] * self.a + self.b).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, in 64-bit halves."""
    m, low = np.uint64(PRIME), np.uint64((1 << 32) - 1)
    w = np.uint64(32)
    a1, a0, x1, x0 = a >> w, a & low, x >> w, x & low
    mid = a1 * x0 + a0 * x1  # below 2**62
    # a * x = a1 x1 2**64 + mid 2**32 + a0 x0, and 2**61 = 1
    high = (a1 * x1) << np.uint64(3)
    cross = (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << w)
    base = a0 * x0
    total = high + (cross & m) + (cross >> np.uint64(61))
    total = (total & m) + (total >> np.uint64(61)) + (base & m) + (base >> np.uint64(61))
    total = (total & m) + (total >> np.uint64(61))
    return np.where(total >= m, total - m, total)


class FamilyB:
    """Words \\w+; arithmetic modulo a Mersenne prime, whose products need 122 bits and are taken in halves."""

    words = re.compile(r"\w+")

    def __init__(self, key: bytes = KEY_B) -> None:
        self.key = key
        d = [hashlib.blake2b(f"perm/{i}".encode(), digest_size=16, key=key).digest() for i in range(PERMUTATIONS)]
        self.a = np.array([int.from_bytes(x[:8], "big") % PRIME or 1 for x in d], np.uint64)
        self.b = np.array([int.from_bytes(x[8:], "big") % PRIME for x in d], np.uint64)

    def signature(self, shingles: list[str]) -> np.ndarray:
        x = np.array([_h64(s.encode(), key=self.key) % PRIME for s in shingles], np.uint64)
        m, low = np.uint64(PRIME), None
        for k in range(0, len(x), 512):
            y = _times(self.a, x[k : k + 512, None]) + self.b
            part = np.where(y >= m, y - m, y).min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low


FAMILIES = {"a": FamilyA, "b": FamilyB}
_HAS_WORD = {"a": "[a-z0-9]", "b": r"[\p{L}\p{N}_]"}


def shingle_list(words: list[str], k: int = SHINGLE) -> list[str]:
    """Distinct shingles; fewer than ``k`` words are one, no words none."""
    if not words:
        return []
    return list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))))


def signature(text, family: str = "a", key_b: bytes = KEY_B):
    """Column: the signature of a text; null for null texts and those without a word. The numbers are unsigned, stored as longs."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def f(texts: pa.Array) -> pa.Array:
        made = FAMILIES[family](key_b)
        out = []
        for t in texts.to_pylist():
            shingles = shingle_list(made.words.findall(t.lower())) if t else []
            out.append(made.signature(shingles).view(np.int64) if shingles else None)
        return pa.array(out, pa.list_(pa.int64()))

    return f(text)


def signatures(docs: DataFrame, family: str = "a", text: str = "text", key: str = "doc_id", key_b: bytes = KEY_B) -> DataFrame:
    """(key, signature) of every text with at least one word. Family b gives the numbers of another system only with its key."""
    # The filter stands on the text: one on the signature would compute it twice.
    some = docs.where(F.lower(text).rlike(_HAS_WORD[family])).select(F.col(key).alias("key"), text)
    return spread(some).select("key", signature(F.col(text), family, key_b).alias("signature"))


def estimate(a, b):
    """Share of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(PERMUTATIONS))


def similar_pairs(sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different signatures (a < b) that share a band and are estimated at ``threshold`` or more.

    Equal signatures are one representative (see :func:`cluster`). Buckets with
    more than ``PART`` members are cut into parts and pairs of parts joined
    apart, so that a bucket is not one task.
    """
    rows = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    keys = sigs.select("key", F.explode(bands).alias("band"))
    crowd = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / PART).cast("int")
    # Only members of shared buckets are shuffled with their signatures.
    flat = (
        keys.join(crowd, "band")
        .join(sigs, "key")
        .withColumn("part", F.pmod(F.xxhash64("key"), parts))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("cell", F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")))
    )
    a = flat.select("cell", F.col("key").alias("a"), F.col("signature").alias("sa"))
    b = flat.select("cell", F.col("key").alias("b"), F.col("signature").alias("sb"))
    pairs = a.join(b, "cell").where((F.col("a") < F.col("b")) & (estimate(F.col("sa"), F.col("sb")) >= threshold))
    return pairs.select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("estimate")).distinct()


def cluster(sigs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(key, cluster_id, representative) of keys in clusters of two or more; the least key represents.

    Keys of equal signatures are linked to the least of them and compared once.
    Signatures are made once and kept, since they are read twice.
    """
    marked = sigs.withColumn("h", F.xxhash64("signature")).withColumn("g", F.hash("signature")).persist()
    first = marked.groupBy("h", "g").agg(F.min("key").alias("rep"))
    same = marked.select("key", "h", "g").join(first, ["h", "g"]).where(F.col("key") != F.col("rep")).select(F.col("rep").alias("a"), F.col("key").alias("b"))
    reps = marked.select("key", "signature").join(first.select(F.col("rep").alias("key")), "key", "left_semi")
    edges = similar_pairs(reps, threshold).select("a", "b").unionByName(same)
    return components(edges).select(
        F.col("node").alias("key"), F.col("root").alias("cluster_id"), (F.col("node") == F.col("root")).alias("representative")
    )
