"""A stored index for approximate neighbours: add, remove, search with an effort, load with checks.

The index is a folder of tables. ``centres`` places the lists; ``points`` holds
the vectors of every list, ``removed`` the ids that were taken out, each with the
number of the change that wrote it, so an id may be added again after its
removal; ``meta`` has the format and the counts. All are written by all tasks.
A search ships a block of queries to the tasks and scans the lists that some
query of the block probes; no vector is shuffled, so a list of any size costs
only its scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import vectors as V
from millrace.operators import nearest as N
from millrace.tables import bounded

FORMAT = "millrace-lists/1"
#: Rows that the centres are fitted on, at most (every row is indexed), rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MAX_LISTS = 20_000, 8, 4096


def centres_of(x: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of a sample by a few rounds of k-means on the sphere."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, sums, centres)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _usable(df: DataFrame) -> DataFrame:
    ok = V.finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)
    return df.select("id", F.col("vec").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & ok)


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    @F.pandas_udf(T.IntegerType())
    def own(vecs: pd.Series) -> pd.Series:
        return pd.Series((np.stack(vecs.to_numpy()) @ centres.T).argmax(axis=1).astype(np.int32)) if len(vecs) else pd.Series([], dtype="int32")

    return points.withColumn("list", own("vec"))


def _write(df: DataFrame, at: str, name: str, mode: str = "append") -> None:
    (df.repartition("list").sortWithinPartitions("list") if name == "points" else df).write.mode(mode).parquet(f"{at}/{name}")


class Index:
    """A stored index that has been opened: see :func:`build` and :func:`load`."""

    def __init__(self, spark: SparkSession, at: str, dim: int, metric: str, centres: np.ndarray):
        self.spark, self.at, self.dim, self.metric, self.centres = spark, at, dim, metric, centres

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    def _change(self) -> int:
        """The number of the next change."""
        last = [self._table(t).agg(F.max("change")).first()[0] for t in ("points", "removed")]
        return 1 + max((x for x in last if x is not None), default=-1)

    def points(self) -> DataFrame:
        """(id, vec, list) of all that are in the index now."""
        gone = self._table("removed").groupBy("id").agg(F.max("change").alias("gone"))
        return self._table("points").join(gone, "id", "left").where("gone is null or change > gone").select("id", "vec", "list")

    def add(self, points: DataFrame) -> None:
        """Add points (id, vec). Unusable vectors are left out; an id that is in the index, or another length, is refused."""
        new = _usable(points).dropDuplicates(["id"])
        if new.where(F.size("vec") != self.dim).limit(1).count():
            raise ValueError(f"all vectors must have {self.dim} numbers")
        if new.join(self.points().select("id"), "id", "left_semi").limit(1).count():
            raise ValueError("some of these ids are in the index already")
        _write(_assigned(new, self.centres).withColumn("change", F.lit(self._change()).cast("long")), self.at, "points")

    def remove(self, ids: DataFrame) -> None:
        """Take ids out; one that is not in the index is refused."""
        gone = ids.select("id").distinct()
        if gone.join(self.points().select("id"), "id", "left_anti").limit(1).count():
            raise ValueError("some of these ids are not in the index")
        _write(gone.withColumn("change", F.lit(self._change()).cast("long")), self.at, "removed")

    def compact(self, at: str) -> Index:
        """The same index, written anew without what was removed."""
        _write(self.points().withColumn("change", F.lit(0).cast("long")), at, "points", "overwrite")
        _write(self._table("removed").limit(0), at, "removed", "overwrite")
        _write(self._table("centres"), at, "centres", "overwrite")
        _write(self._table("meta"), at, "meta", "overwrite")
        return load(self.spark, at)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(query, id, distance, rank): the ``k`` nearest among the ``probes`` lists nearest to each query.

        With as many probes as lists the result is exact. Ties go to the lower id.
        """
        kind, asked = (df.schema["id"].dataType.simpleString() for df in (self._table("points"), queries))
        arrow_ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        metric, centres, lists, out = self.metric, self.centres, len(self.centres), None
        for rows in N.blocks_of(_usable(queries).where(F.size("vec") == self.dim), ["id", "vec"]):
            names, q = [r.id for r in rows], np.array([r.vec for r in rows]).reshape(-1, self.dim)
            reach = np.zeros((len(q), lists), bool)
            order = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, : max(1, probes)]
            np.put_along_axis(reach, order, True, axis=1)
            shipped = self.spark.sparkContext.broadcast((names, q, reach))

            def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                names, q, reach = shipped.value
                top = N.Nearest(q, k, metric)
                for batch in batches:
                    own = batch.column("list").to_numpy()
                    ids = batch.column("id").to_numpy(zero_copy_only=False)
                    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    for j in np.unique(own):
                        at = np.flatnonzero(reach[:, j])
                        if len(at):
                            top.show(ids[own == j], x[own == j], at)
                row, d, ids = top.best()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in row.tolist()], arrow_ids[asked]), pa.array(ids, arrow_ids[kind]), pa.array(d, pa.float64())],
                    names=["query", "id", "distance"],
                )

            probed = [int(j) for j in np.flatnonzero(reach.any(axis=0))]
            here = self.points() if len(probed) == lists else self.points().where(F.col("list").isin(*probed))
            one = here.mapInArrow(run, f"query {asked}, id {kind}, distance double")
            out = one if out is None else out.unionByName(one)
        w = Window.partitionBy("query").orderBy("distance", "id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build(points: DataFrame, at: str, lists: int | None = None, metric: str = "cosine") -> Index:
    """Build an index of points (id, vec) in a folder and open it.

    Unusable vectors (null, not finite, zero) are left out, ids that repeat count
    once; all usable ones must have one length. Without a number of lists there
    are about as many as the square root of the points. The centres are fitted on
    at most ``SAMPLE`` rows, those of smallest hash; every row is indexed.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric}")
    spark = points.sparkSession
    good = _usable(points).dropDuplicates(["id"])
    seen = good.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
    if not seen.n or seen.a != seen.b:
        raise ValueError("an index needs vectors, all of one length")
    wanted = lists or max(1, min(MAX_LISTS, round(seen.n**0.5)))
    share = SAMPLE / seen.n
    drawn = good.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, share))) if share < 1 else good
    x = np.array([r.vec for r in drawn.select("vec").limit(2 * SAMPLE).collect()])
    centres = centres_of(x, wanted)
    _write(_assigned(good, centres).withColumn("change", F.lit(0).cast("long")), at, "points", "overwrite")
    _write(good.select("id", F.lit(0).cast("long").alias("change")).limit(0), at, "removed", "overwrite")
    _write(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>"), at, "centres", "overwrite")
    _write(spark.createDataFrame([(FORMAT, seen.a, metric, len(centres))], "format string, dim int, metric string, lists int"), at, "meta", "overwrite")
    return load(spark, at)


def load(spark: SparkSession, at: str) -> Index:
    """Open a stored index; another format, missing centres or vectors of another length are refused."""
    meta = spark.read.parquet(f"{at}/meta").collect()
    if len(meta) != 1 or meta[0].format != FORMAT:
        raise ValueError("this is no index of this format")
    m = meta[0]
    rows = sorted(bounded(spark.read.parquet(f"{at}/centres"), MAX_LISTS, "lists of an index"), key=lambda r: r.list)
    if [r.list for r in rows] != list(range(m.lists)) or any(len(r.centre) != m.dim for r in rows):
        raise ValueError("the centres of the index are not complete")
    if spark.read.parquet(f"{at}/points").where((F.size("vec") != m.dim) | (F.col("list") < 0) | (F.col("list") >= m.lists)).limit(1).count():
        raise ValueError("the points of the index don't fit its centres")
    return Index(spark, at, m.dim, m.metric, np.array([r.centre for r in rows]))


def effort_table(index: Index, queries: DataFrame, truth: DataFrame, k: int, efforts: tuple[int, ...]) -> DataFrame:
    """Recall of the index by the number of lists probed: (probes, queries, recall)."""
    out = None
    for p in efforts:
        one = N.recall(index.search(queries, k, p), truth).select(F.lit(p).alias("probes"), "queries", "recall")
        out = one if out is None else out.unionByName(one)
    return out
