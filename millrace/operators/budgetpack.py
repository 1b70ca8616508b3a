"""Choosing documents under a character budget: greedy, by density, and exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.state import fold


def framed(docs: DataFrame, overhead: int = 40) -> DataFrame:
    """docs (grp, id, text, score) with ``chars`` and the cost of a document in its frame; null texts have 0 characters."""
    n = F.coalesce(F.length("text"), F.lit(0))
    return docs.select("grp", "id", "score", n.alias("chars"), (n + overhead).alias("cost"))


def _step(usable: int, greedy: bool):
    def step(s: dict, r: dict) -> dict:
        used = s.get("used", 0)
        if used + r["cost"] <= usable:
            s["used"] = used + r["cost"]
            return {"reason": None, "used": s["used"]}
        alone = r["cost"] > usable and (used == 0 or not greedy)
        return {"reason": "too_large_alone" if alone else "budget_exhausted" if greedy else "too_large_skipped", "used": used}

    return step


def greedy(docs: DataFrame, usable: int) -> DataFrame:
    """Highest score first; what doesn't fit is skipped and the next one tried. ``reason`` is null for chosen ones.

    Groups are streamed in order, none is collected.
    """
    order = docs.withColumn("o", -F.col("score"))
    return fold(order, "grp", ["o", "id"], dict, _step(usable, True), [("reason", "string"), ("used", "int")], ["cost"]).drop("o")


def density(docs: DataFrame, usable: int) -> DataFrame:
    """Highest score per character first, otherwise like :func:`greedy`."""
    order = docs.withColumn("o", -F.col("score") / F.greatest(F.col("chars"), F.lit(1)))
    return fold(order, "grp", ["o", "id"], dict, _step(usable, False), [("reason", "string"), ("used", "int")], ["cost"]).drop("o")


def exact(docs: DataFrame, usable: int) -> DataFrame:
    """The choice of the greatest total score per group: (grp, id, score, cost) of the chosen.

    Of the documents of one cost only the best ``usable // cost`` can be part of
    it, so a group shrinks to about usable * ln(usable) rows before it reaches one
    task, whatever its size. Ties go to lower ids.
    """
    w = Window.partitionBy("grp", "cost").orderBy(F.desc("score"), "id")
    few = docs.where((F.col("cost") <= usable) & (F.col("score") > 0)).withColumn("turn", F.row_number().over(w))
    few = few.where(F.col("turn") * F.col("cost") <= usable).select("grp", "id", "score", "cost")
    schema = few.schema

    def run(table):
        df = table.to_pandas().sort_values("id", kind="stable").reset_index(drop=True)
        best = np.zeros(usable + 1)
        took = []
        for cost, score in zip(df.cost, df.score):
            new = best.copy()
            with_it = best[: usable + 1 - cost] + score
            better = with_it > best[cost:]
            new[cost:][better] = with_it[better]
            flag = np.zeros(usable + 1, bool)
            flag[cost:] = better
            took.append(np.packbits(flag))
            best = new
        at, chosen = int(best.argmax()), []
        for i in range(len(df) - 1, -1, -1):
            if took[i][at >> 3] >> (7 - (at & 7)) & 1:
                chosen.append(i)
                at -= int(df.cost[i])
        return pa.Table.from_pandas(df.iloc[sorted(chosen)], preserve_index=False)

    return few.groupBy("grp").applyInArrow(run, schema)


def utilization(chosen: DataFrame, usable: int) -> DataFrame:
    """Per group: documents, characters used, total score, and the share of the budget used (at most 1)."""
    return chosen.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.sum("cost").alias("used"),
        F.round(F.sum("score"), 6).alias("total"),
        F.round(F.least(F.sum("cost") / usable, F.lit(1.0)), 4).alias("utilization"),
    )
