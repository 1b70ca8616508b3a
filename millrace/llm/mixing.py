"""Mixing sources to target weights: cube-method balanced sampling.

Each source needs a certain number of tokens. Its documents are all taken as
often as whole repeats allow; the fraction that is left is an inclusion
probability. The cube method turns these probabilities into a choice: in the
flight phase they move along the null space of the balancing constraints
(number of documents and number of tokens stay what they are) until one of them
is 0 or 1, again and again, until at most a dozen are undecided. The landing
phase tries all choices of those few and takes the one whose tokens come nearest
to the goal. Large sources are dealt to blocks, each block flies on its own, and the few
undecided documents of all blocks of a source fly once more together.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import bounded, spread

#: Documents of one block of the flight phase on average.
DOCS_PER_BLOCK = 50_000
#: Sources with a target at most; the targets are shipped to every task.
MAX_TARGETS = 10_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text before merges; a fixed value that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that the landing phase settles at most, by trying all their choices.
LANDING = 12
_EPS = 1e-9


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text, whatever its length or layout; null and empty have none."""
    return len(_encoding(vocabulary).encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its text in a public byte-level vocabulary."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, vocabulary) for t in texts], dtype="int64")

    return df.withColumn(out, size(F.col(text)))


def flight(ids: list, tokens: list[int], probs: list[float], leave: int = 2) -> tuple[dict, list[tuple]]:
    """The flight phase: ``(decided, undecided)``.

    ``decided`` maps ids to 0 or 1; ``undecided`` lists at most ``leave`` (two or
    more) of (id, tokens, probability). The sums of probabilities and of probability times tokens stay
    what they were, up to rounding. The walk follows the given order and takes
    no random numbers, so it is repeatable.
    """
    decided: dict = {}
    open_: list[list] = []
    flip = 0
    for item in zip(ids, tokens, probs):
        if item[2] <= _EPS or item[2] >= 1 - _EPS:
            decided[item[0]] = int(item[2] > 0.5)
            continue
        open_.append(list(item))
        while len(open_) > max(2, leave):
            (a, b, c) = open_[:3]
            # The null space of ((1, 1, 1), (t1, t2, t3)) is one line; with equal sizes it is wider.
            v = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
            if v == (0, 0, 0):
                v = (1, -1, 0)
            up = min((1 - x[2]) / k if k > 0 else x[2] / -k for x, k in zip((a, b, c), v) if k)
            down = min(x[2] / k if k > 0 else (1 - x[2]) / -k for x, k in zip((a, b, c), v) if k)
            flip = (flip * 1103515245 + 12345) % 2**31
            step = up if flip * (up + down) < down * 2**31 else -down
            for x, k in zip((a, b, c), v):
                x[2] += step * k
            still = []
            for x in open_:
                if x[2] <= _EPS or x[2] >= 1 - _EPS:
                    decided[x[0]] = int(x[2] > 0.5)
                else:
                    still.append(x)
            open_ = still
    return decided, [tuple(x) for x in open_]


def landing(undecided: list[tuple], slack: float = 0.0) -> dict:
    """Settle the few undecided: the choice whose tokens, and then whose number, come nearest to what is owed."""
    n = len(undecided)
    chosen = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    sizes, probs = np.array([t for _, t, _ in undecided], float), np.array([p for *_, p in undecided], float)
    off = np.abs(probs @ sizes + slack - chosen @ sizes) if n else np.zeros(1)
    count = np.abs(probs.sum() - chosen.sum(axis=1))
    best = np.lexsort((np.arange(1 << n), count, np.round(off, 6)))[0]
    return {x[0]: int(c) for x, c in zip(undecided, chosen[best])}


def plan(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, dict]:
    """Tokens each source has to give.

    ``total`` defaults to the largest one at which every source that has any
    token can give its share within its repeats: only then are the shares of all
    of them met at once. With a larger ``total`` a source that can't give its
    share gives all it may and the rest of its share stays open. A source
    without documents gives nothing. Shares are scaled to sum to 1.
    """
    whole = sum(max(0.0, s or 0.0) for _, s, _ in targets) or 1.0
    most = {name: available.get(name, 0) * max(0, r or 0) for name, _, r in targets}
    share = {name: max(0.0, s or 0.0) / whole for name, s, _ in targets}
    limits = [most[n] / s for n, s in share.items() if s > 0 and most[n] > 0]
    size = total if total is not None else min(limits, default=0)
    return {
        name: {"goal": share[name] * size, "gives": min(share[name] * size, most[name]), "share": share[name], "repeats": max(0, r or 0)}
        for name, _, r in targets
    }


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``: the chosen documents with repeats, and the shares reached.

    chosen: doc_id, source, n_tokens, repeats (1 or more). shares: one row per
    target with the documents and tokens there are, the tokens chosen, the share
    reached and how far it is below the target. Documents whose source has no
    target, is null, or whose text has no token, are not chosen. A target named
    twice counts once, with its first row by share and repeats.
    """
    goals = {}
    for r in bounded(targets.select("source", "target_share", "max_repeats"), MAX_TARGETS, "targets"):
        if r.source is not None:
            goals.setdefault(r.source, []).append((r.source, r.target_share, r.max_repeats))
    wanted = [min(v, key=lambda x: (-(x[1] or 0), x[2] or 0)) for v in goals.values()]
    spark = documents.sparkSession
    few = spark.createDataFrame([(w[0],) for w in wanted], "source string")
    sized = (
        with_tokens(spread(documents.select("doc_id", "source", "text")).join(F.broadcast(few), "source", "left_semi"), vocabulary=vocabulary)
        .select("doc_id", "source", "n_tokens")
        .where("n_tokens > 0")
        .persist()
    )
    have = {r.source: r for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    todo = plan({k: r.t for k, r in have.items()}, wanted, total)
    rows = []
    for name, p in todo.items():
        n, t = (have[name].n, have[name].t) if name in have else (0, 0)
        rate = p["gives"] / t if t else 0.0
        base = min(int(rate + _EPS), p["repeats"])
        rows.append((name, base, max(0.0, min(1.0, rate - base)) if base < p["repeats"] else 0.0, max(1, round(n / DOCS_PER_BLOCK))))
    rates = spark.createDataFrame(rows, "source string, base int, part double, blocks int")
    dealt = sized.join(F.broadcast(rates), "source").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    schema = T.StructType([*sized.schema.fields, T.StructField("base", T.IntegerType()), T.StructField("part", T.DoubleType())])

    def fly(last: bool):
        def run(table):
            df = table.to_pandas().sort_values(["n_tokens", "doc_id"], kind="stable").reset_index(drop=True)
            # A fixed shuffle: neighbours of a sorted list would tie the walk to size.
            df = df.iloc[pd.util.hash_pandas_object(df.doc_id, index=False).argsort(kind="stable")]
            decided, left = flight(df.doc_id.tolist(), df.n_tokens.tolist(), df.part.tolist(), LANDING)
            if last:
                decided |= landing(left)
                left = []
            probs = decided | {i: p for i, _, p in left}
            df = df.assign(part=[float(probs[i]) for i in df.doc_id])
            return pa.Table.from_pandas(df[schema.names], schema=_to_arrow(schema), preserve_index=False)

        return run

    flown = dealt.select("source", "block", *[c for c in schema.names if c != "source"])
    first = flown.groupBy("source", "block").applyInArrow(lambda t: fly(False)(t.select(schema.names)), schema).persist()
    open_ = first.where("part > 0 and part < 1").groupBy("source").applyInArrow(fly(True), schema)
    chosen = (
        first.where("part = 0 or part = 1")
        .unionByName(open_)
        .withColumn("repeats", F.col("base") + F.col("part").cast("int"))
        .where("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    return chosen, _shares(chosen, wanted, have, todo, spark)


def _to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _shares(chosen: DataFrame, wanted: list, have: dict, todo: dict, spark) -> DataFrame:
    rows = [
        (n, float(s or 0), int(r or 0), have[n].n if n in have else 0, have[n].t if n in have else 0, float(todo[n]["goal"]))
        for n, s, r in wanted
    ]
    asked = spark.createDataFrame(
        rows, "source string, target_share double, max_repeats int, n_docs long, n_tokens long, goal_tokens double"
    )
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.count("*").alias("chosen_docs"), F.max("repeats").alias("most_repeats")
    )
    out = asked.join(got, "source", "left").fillna(0, ["chosen_tokens", "chosen_docs", "most_repeats"])
    all_ = got.agg(F.coalesce(F.sum("chosen_tokens"), F.lit(0)).alias("all_tokens"))
    return (
        out.join(F.broadcast(all_))  # one row
        .withColumn("share", F.when(F.col("all_tokens") > 0, F.col("chosen_tokens") / F.col("all_tokens")).otherwise(0.0))
        .withColumn("short_tokens", F.greatest(F.lit(0.0), F.col("goal_tokens") - F.col("chosen_tokens")))
        .drop("all_tokens")
    )
