"""Exact nearest neighbours, recall, label purity, quality-floor routing and quantisation of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.tables import bounded

#: Query vectors of one pass over the points (they are shipped to every task), and of one block of distances.
PER_PASS, PER_BLOCK = 20_000, 256


class Nearest:
    """The ``k`` nearest points of every row of a query matrix among all points shown so far; ties go to the lower id."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.norms = np.sqrt((q * q).sum(axis=1))
        self.held: list[tuple] = []
        self.n = 0

    def distances(self, q: np.ndarray, norms: np.ndarray, x: np.ndarray) -> np.ndarray:
        dots = q @ x.T
        if self.metric == "ip":
            out = -dots
        elif self.metric == "l2":
            out = np.maximum(0.0, (norms**2)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * dots)
        else:
            n = norms[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
            out = np.where(n > 0, 1 - dots / np.where(n > 0, n, 1), 1.0)
        return np.round(out, 9) + 0.0  # no negative zero

    def show(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Points and, if not all, the rows of the queries that look at them."""
        rows = np.arange(len(self.q)) if rows is None else rows
        for a in range(0, len(rows), PER_BLOCK):
            at = rows[a : a + PER_BLOCK]
            d = self.distances(self.q[at], self.norms[at], x)
            most = np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] if d.shape[1] > self.k else np.full((len(at), 1), np.inf)
            i, j = np.nonzero(d <= most)
            self.held.append((at[i], d[i, j], ids[j]))
            self.n += len(i)
        if self.n > 8 * self.k * max(1, len(self.q)):
            self.held = [self.best()]
            self.n = len(self.held[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, distance, id), at most ``k`` of a row."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        row, d, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, d, row))
        row, d, ids = row[order], d[order], ids[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < self.k
        return row[keep], d[keep], ids[keep]


def blocks_of(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """The rows of a stated query set, block by block of a checked size."""
    n = queries.count()
    blocks = max(1, -(-n // PER_PASS))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        yield bounded(part.select(*columns), 2 * PER_PASS, "queries of one block")


def exact(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """The ``k`` nearest points of every query by a blocked scan: (query, id, distance, rank).

    points and queries are (id, vec). Queries go over the points block by block;
    each task multiplies its points with a block and keeps its own ``k`` best per
    query, so only ``k`` rows per query and task are shuffled. Vectors that are
    null, of another length than the query or not finite take no part. A zero
    vector has cosine distance 1. Ties go to the lower id.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric}")
    kind, asked = points.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    arrow_ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    good = points.select("id", F.col("vec").cast("array<double>").alias("vec")).where(V.finite(F.col("vec"))).withColumn("size", F.size("vec"))
    near = None
    for rows in blocks_of(queries.select("id", F.col("vec").cast("array<double>").alias("vec")).where(V.finite(F.col("vec"))), ["id", "vec"]):
        by = {d: [r for r in rows if len(r.vec) == d] for d in {len(r.vec) for r in rows}}
        shipped = points.sparkSession.sparkContext.broadcast({d: ([r.id for r in some], np.array([r.vec for r in some])) for d, some in by.items()})

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            found = {d: Nearest(q, k, metric) for d, (_, q) in shipped.value.items()}
            for batch in batches:
                sizes = batch.column("size").to_numpy()
                for d, top in found.items():
                    part = batch.filter(pa.array(sizes == d))
                    if part.num_rows:
                        top.show(part.column("id").to_numpy(zero_copy_only=False), part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            for d, top in found.items():
                row, dist, ids = top.best()
                names = shipped.value[d][0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in row.tolist()], arrow_ids[asked]), pa.array(ids, arrow_ids[kind]), pa.array(dist, pa.float64())],
                    names=["query", "id", "distance"],
                )

        one = good.mapInArrow(run, f"query {asked}, id {kind}, distance double")
        near = one if near is None else near.unionByName(one)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true neighbours that were found: one row (queries, recall)."""
    hit = truth.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")).distinct(), ["query", "id"], "left")
    return hit.agg(F.countDistinct("query").alias("queries"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def route(near: DataFrame, outcomes: DataFrame, tiers: DataFrame, floor: float = 0.9, k: int = 5) -> DataFrame:
    """Cheapest model whose pass rate among the ``k`` nearest records reaches ``floor``.

    near: (query, id, rank); outcomes: (id, model, passed); tiers: (model, cost,
    ord), the most expensive one is the fallback. Gives (query, model, pass_rate,
    cost, saved, reason), one row per query with neighbours.
    """
    rates = (
        near.where(F.col("rank") <= k).join(outcomes, "id").groupBy("query", "model").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    )
    priced = rates.join(tiers, "model")
    ok = F.col("pass_rate") >= floor
    pick = F.min(F.when(ok, F.struct("cost", "ord", "model", "pass_rate")))
    best = priced.groupBy("query").agg(pick.alias("best"))
    top = tiers.orderBy(F.desc("cost"), F.desc("ord")).limit(1).select(F.col("model").alias("top_model"), F.col("cost").alias("top_cost"))
    return best.join(F.broadcast(top)).select(
        "query",
        F.coalesce("best.model", "top_model").alias("model"),
        F.round(F.col("best.pass_rate"), 6).alias("pass_rate"),
        F.coalesce("best.cost", "top_cost").alias("cost"),
        F.greatest(F.lit(0.0), F.col("top_cost") - F.coalesce("best.cost", "top_cost")).alias("saved"),
        F.when(F.col("best").isNotNull(), "floor met").otherwise("fallback").alias("reason"),
    )


def with_feedback(outcomes: DataFrame, new: DataFrame) -> DataFrame:
    """Outcomes (id, model, passed) with new ones appended; a later outcome of the same id and model replaces the earlier one."""
    both = outcomes.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    last = both.groupBy("id", "model").agg(F.max(F.struct("turn", "passed")).alias("x"))
    return last.select("id", "model", "x.passed")


def ledger(routed: DataFrame) -> DataFrame:
    """Calls and savings per model."""
    return routed.groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("saved"), 6).alias("saved"))


MODES = ("per-tensor", "per-row", "per-channel", "fp16")


def _half_up(x):
    """Round half away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def quantize(cells: DataFrame, mode: str) -> DataFrame:
    """int8 codes and their values back: cells (tensor, row, col, value) plus scale, code, back.

    The scale is the largest magnitude of the group over 127, or 1 for a group of
    zeros; codes are clamped to -127..127. ``fp16`` keeps half-precision values.
    """
    if mode == "fp16":
        half = F.pandas_udf(lambda s: s.astype("float16").astype("float64"), "double")
        return cells.select("*", F.lit(1.0).alias("scale"), F.lit(None).cast("int").alias("code"), half("value").alias("back"))
    keys = {"per-tensor": ["tensor"], "per-row": ["tensor", "row"], "per-channel": ["tensor", "col"]}[mode]
    scales = cells.groupBy(*keys).agg(F.max(F.abs("value")).alias("most"))
    scales = scales.select(*keys, F.when(F.col("most") > 0, F.col("most") / 127).otherwise(1.0).alias("scale"))
    code = F.greatest(F.lit(-127), F.least(F.lit(127), _half_up(F.col("value") / F.col("scale")))).cast("int")
    return cells.join(scales, keys).withColumn("code", code).withColumn("back", F.col("code") * F.col("scale"))


def quantize_error(quantized: DataFrame) -> DataFrame:
    """Per tensor: largest and mean absolute error, signal-to-noise in dB (infinite without noise)."""
    e = F.col("value") - F.col("back")
    g = quantized.groupBy("tensor").agg(
        F.max(F.abs(e)).alias("max_abs_error"),
        F.avg(F.abs(e)).alias("mean_abs_error"),
        F.sum(F.col("value") * F.col("value")).alias("signal"),
        F.sum(e * e).alias("noise"),
    )
    snr = F.when(F.col("noise") == 0, float("inf")).when(F.col("signal") == 0, float("-inf")).otherwise(10 * F.log10(F.col("signal") / F.col("noise")))
    return g.select("tensor", F.round("max_abs_error", 6).alias("max_abs_error"), F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round(snr, 4).alias("snr_db"))


def argmax_agreement(quantized: DataFrame) -> DataFrame:
    """Per tensor: share of rows whose largest value stays at the same column (ties to the lowest column)."""
    a = F.max(F.struct("value", (-F.col("col")).alias("c")))
    b = F.max(F.struct("back", (-F.col("col")).alias("c")))
    rows = quantized.groupBy("tensor", "row").agg(a.alias("a"), b.alias("b"))
    return rows.groupBy("tensor").agg(F.round(F.avg((F.col("a.c") == F.col("b.c")).cast("double")), 6).alias("agreement"))


def sizes(cells: DataFrame, mode: str) -> DataFrame:
    """Bytes per tensor: one per code and four per scale, or two per value."""
    g = cells.groupBy("tensor").agg(F.count("*").alias("n"), F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("cols"))
    n = {"per-tensor": F.col("n") + 4, "per-row": F.col("n") + 4 * F.col("rows"), "per-channel": F.col("n") + 4 * F.col("cols"), "fp16": 2 * F.col("n")}[mode]
    return g.select("tensor", n.alias("bytes"))


def calibrate(cells: DataFrame, floor: float = 0.95) -> DataFrame:
    """Per tensor the smallest mode whose agreement reaches ``floor``: (tensor, mode, bytes, agreement)."""
    tried = None
    for i, mode in enumerate(MODES):
        one = argmax_agreement(quantize(cells, mode)).join(sizes(cells, mode), "tensor").withColumn("mode", F.lit(mode)).withColumn("ord", F.lit(i))
        tried = one if tried is None else tried.unionByName(one)
    ok = F.struct((F.col("agreement") < floor).alias("short"), "bytes", (-F.col("agreement")).alias("loss"), "ord", "mode", "agreement")
    best = tried.groupBy("tensor").agg(F.min(ok).alias("b"))
    return best.select("tensor", "b.mode", "b.bytes", "b.agreement")


def saved_bytes(chosen: DataFrame, cells: DataFrame) -> DataFrame:
    """Totals over all tensors: bytes as 32-bit numbers, bytes quantised, and the ratio (0 without bytes)."""
    before = cells.groupBy("tensor").agg((F.count("*") * 4).alias("was"))
    sums = before.join(chosen.select("tensor", "bytes"), "tensor").agg(F.coalesce(F.sum("was"), F.lit(0)).alias("was"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("ratio", F.round(F.coalesce(F.try_divide("was", "bytes"), F.lit(0.0)), 4))
