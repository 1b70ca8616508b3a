"""Histories of runs: scores by iteration, trends, best values so far, and the loop that stops at a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = "run string, n int, at timestamp, domain string, score double, rank int"


def append_history(scores: DataFrame, path: str, run: str, n: int) -> None:
    """Append the scores (domain, score, rank) of one iteration to the history table."""
    scores.select(F.lit(run).alias("run"), F.lit(n).alias("n"), F.current_timestamp().alias("at"), "domain", "score", "rank").write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY).parquet(path)


def trend(history: DataFrame) -> DataFrame:
    """Scores of every domain by iteration, as an ordered array; a domain has one score an iteration."""
    return history.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda x: x["score"]).alias("scores"))


def best_so_far(losses: DataFrame, key: str = "run", order: str = "step", value: str = "loss") -> DataFrame:
    """Rows with ``best`` (the least value up to here, nulls passed over) and ``improved`` (below all before it)."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return losses.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "improved", F.col(value).isNotNull() & (before.isNull() | (F.col(value) < before))
    )


def mean_loss(batches: DataFrame) -> DataFrame:
    """Mean loss per split and step over batches (split, step, loss)."""
    return batches.groupBy("split", "step").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


def improve(probe: Callable[[int], DataFrame], act: Callable[[DataFrame, int], None], target: float = 0.6, most: int = 3) -> int:
    """Probe, stop when every domain reaches the target, else act on the scores; the number of iterations made.

    ``probe(n)`` gives (domain, score, rank); only whether one is below the target reaches the driver.
    """
    for n in range(1, most + 1):
        scores = probe(n)
        if not scores.where(F.col("score") < target).limit(1).count():
            return n
        act(scores, n)
    return most


def sample_windows(docs: DataFrame, block: int, per_doc: int = 1, seed: int = 0, ids: str = "ids") -> DataFrame:
    """Contiguous windows of ids with their successors: (doc_id, draw, start, x, y), y being x shifted by one.

    Starts are drawn by a hash of id, draw and seed; documents shorter than ``block + 1`` give none.
    """
    room = F.size(ids) - block
    rows = docs.where(room > 0).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_doc))))
    start = F.pmod(F.xxhash64("doc_id", "draw", F.lit(seed)), room).cast("int")
    rows = rows.withColumn("start", start)
    return rows.select("doc_id", "draw", "start", F.slice(ids, F.col("start") + 1, block).alias("x"), F.slice(ids, F.col("start") + 2, block).alias("y"))


def sampled_token(rows: DataFrame, logits: str = "logits", key: str = "id", k: int = 40, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """Rows with ``token``: drawn from the ``k`` largest logits after softmax at a temperature; ties go to the lower place.

    The draw is Gumbel's: the largest of logit over temperature plus noise, where
    noise comes from a hash of row, place and seed, so it is repeatable.
    """
    spots = F.transform(logits, lambda x, i: F.struct((-x).alias("o"), i.alias("i"), x.alias("x")))
    top = F.slice(F.array_sort(spots), 1, k)
    u = lambda i: (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(2**52)) + 0.5) / F.lit(float(2**52))
    noisy = F.transform(top, lambda s: F.struct((s["x"] / temperature - F.log(-F.log(u(s["i"])))).alias("g"), (-s["i"]).alias("i")))
    return rows.withColumn("token", -F.array_max(noisy)["i"])
