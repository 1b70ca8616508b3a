"""Packing items into windows of fixed capacity: hierarchical multi-length packing.

The capacities form tiers. An item goes to the smallest tier that holds it. The
windows of a capacity are filled from its longest tier downwards: items of the
tier are packed first, the gaps they leave are filled from the shorter tiers,
and what remains of those is packed last. Only an item larger than the window
is split, into full windows and a rest that is packed like any item. Windows
are then dealt to training steps so that all steps hold about as many tokens.

Items are dealt to blocks by a hash of their id and each block is packed on its
own, so no task ever holds the collection; a block loses at most the room of its
last windows, one in about a thousand.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.splitting import WORD_JVM

#: Items of one block on average; a block is packed by one task.
ITEMS_PER_BLOCK = 100_000
#: Tokens of one training step, as a multiple of the largest capacity.
WINDOWS_PER_STEP = 8

PLACED = T.StructType(
    [
        T.StructField("limit_name", T.StringType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("window_id", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("chunk_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("window_words", T.IntegerType()),
    ]
)


class _Stock:
    """Items by size; gives the largest item that fits a gap."""

    def __init__(self) -> None:
        self.by: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def add(self, size: int, item: int) -> None:
        if size not in self.by:
            self.by[size] = []
            insort(self.sizes, size)
        self.by[size].append(item)

    def take(self, size: int) -> int:
        held = self.by[size]
        item = held.pop()
        if not held:
            del self.by[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return item

    def largest(self, gap: int) -> int:
        """The largest size that fits, or 0."""
        k = bisect_right(self.sizes, gap)
        return self.sizes[k - 1] if k else 0

    def pair(self, gap: int, tries: int = 64) -> tuple[int, int] | None:
        """Two sizes that fill the gap exactly, looked for among the largest ``tries``."""
        k = bisect_right(self.sizes, gap - 1)
        for a in reversed(self.sizes[max(0, k - tries) : k]):
            b = gap - a
            if b > a:
                break
            if b in self.by and (b != a or len(self.by[a]) > 1):
                return a, b
        return None


def pack(sizes: np.ndarray, capacity: int, tiers: list[int]) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Windows as lists of (item, first unit, units), and their fills.

    Every unit of every item of positive size is in exactly one window; an item
    is in more than one window only if it exceeds ``capacity``.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    bounds = sorted({t for t in tiers if 0 < t < capacity} | {capacity})
    stock = [_Stock() for _ in bounds]
    windows: list[list[tuple[int, int, int]]] = []
    fills: list[int] = []
    whole: dict[int, int] = {}  # the first unit of a split item's rest
    for item, size in enumerate(sizes.tolist()):
        if size <= 0:
            continue
        at = 0
        while size - at > capacity:
            windows.append([(item, at, capacity)])
            fills.append(capacity)
            at += capacity
        if at:
            whole[item] = at
        rest = size - at
        stock[next(i for i, b in enumerate(bounds) if rest <= b)].add(rest, item)

    def put(window: list, size: int, item: int) -> None:
        window.append((item, whole.get(item, 0), size))

    for level in range(len(bounds) - 1, -1, -1):
        own = stock[level]
        while own.sizes:
            window: list[tuple[int, int, int]] = []
            gap = capacity
            for i in range(level, -1, -1):  # the tier itself, then gaps from shorter tiers
                s = stock[i]
                while gap and s.sizes:
                    size = s.largest(gap)
                    if not size:
                        break
                    if size < gap and gap <= 2 * s.sizes[-1] and (two := s.pair(gap)):
                        for x in two:
                            put(window, x, s.take(x))
                        gap = 0
                        break
                    put(window, size, s.take(size))
                    gap -= size
            windows.append(window)
            fills.append(capacity - gap)
    return windows, fills


def steps(fills: list[int], per_step: int) -> list[int]:
    """Step of each window: windows of falling fill are dealt back and forth over the steps.

    Every step gets ``per_step`` windows or one less, with about equal fill.
    """
    n = -(-len(fills) // max(1, per_step))
    out = [0] * len(fills)
    for k, w in enumerate(sorted(range(len(fills)), key=lambda i: (-fills[i], i))):
        turn, at = divmod(k, n)
        out[w] = at if turn % 2 == 0 else n - 1 - at
    return out


def pack_chunks(chunks: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """Assignment of every chunk to windows, for each ``(limit_name, capacity)``.

    The size of a chunk is the number of words of its text; ``n_tokens`` is only
    meant to be that and is not trusted. Rows repeated under one id count once.
    Chunks without a word (null or empty text) need no room and are in no
    window. One row per chunk and window: ``first_word`` and ``n_words`` give the
    part of the chunk, ``window_words`` the fill of the window. No rows or no
    limits give an empty result. Ties of size are broken by id.
    """
    items = (
        chunks.select("id", F.regexp_count("text", F.lit(WORD_JVM)).cast("int").alias("n"))
        .where("n > 0")
        .groupBy("id")
        .agg(F.max("n").alias("n"))
    )
    if not limits:
        return chunks.sparkSession.createDataFrame([], PLACED)
    items = items.persist()  # two numbers a chunk: texts are read and counted once
    count = items.count()
    blocks = max(1, round(count / ITEMS_PER_BLOCK))
    limits = sorted((int(c), str(name)) for name, c in limits)
    tiers = [c for c, _ in limits]
    each = F.array(*[F.struct(F.lit(name).alias("limit_name"), F.lit(c).alias("capacity")) for c, name in limits])
    dealt = items.select(
        F.explode(each).alias("l"), "id", "n", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    ).select("l.limit_name", "l.capacity", "block", "id", "n")
    largest = max(tiers, default=1)

    def run(key, table):
        name, capacity, block = (x.as_py() for x in key)
        ids = table.column("id").to_numpy()
        n = table.column("n").to_numpy()
        order = np.lexsort((ids, -n))
        ids, n = ids[order], n[order]
        windows, fills = pack(n, capacity, tiers)
        step = steps(fills, max(1, WINDOWS_PER_STEP * largest // capacity))
        rows = [
            (w, step[w], k, int(ids[item]), first // capacity, first, size, fills[w])
            for w, window in enumerate(windows)
            for k, (item, first, size) in enumerate(window)
        ]
        cols = list(zip(*rows))
        m = len(rows)
        return pa.table(
            [
                pa.array([name] * m, pa.string()),
                pa.array([capacity] * m, pa.int32()),
                pa.array([f"{name}/{block}/{w}" for w in cols[0]], pa.string()),
                pa.array([f"{name}/{block}/{s}" for s in cols[1]], pa.string()),
                *(pa.array(c, t) for c, t in zip(cols[2:], (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))),
            ],
            names=PLACED.names,
        )

    return dealt.groupBy("limit_name", "capacity", "block").applyInArrow(run, PLACED)


def fill_report(placed: DataFrame) -> DataFrame:
    """Windows, words, split chunks and fill (used share of all room) per limit."""
    windows = placed.groupBy("limit_name", "capacity", "window_id", "step").agg(
        F.sum("n_words").alias("used"), F.count("*").alias("parts"), F.sum((F.col("piece") > 0).cast("int")).alias("cuts")
    )
    return (
        windows.groupBy("limit_name", "capacity")
        .agg(
            F.count("*").alias("n_windows"),
            F.sum("used").alias("n_words"),
            F.sum("parts").alias("n_parts"),
            F.sum("cuts").alias("n_cuts"),
            F.countDistinct("step").alias("n_steps"),
            F.max("used").alias("fullest"),
        )
        .withColumn("fill", F.round(F.col("n_words") / (F.col("n_windows") * F.col("capacity")), 6))
    )
