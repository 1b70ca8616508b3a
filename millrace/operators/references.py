"""References to records that do not exist.

Parents are reduced to one row per key, cut into key ranges and stored as one
sorted array per range. References are routed to the range of their key and
probed there batch by batch with a binary search. A range that many references
hit is split: its parent array is repeated, its references are dealt out.

Only (key, id, timestamp) columns are shuffled; of the references only broken
ones leave the probe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shuffle_partitions

#: References that one probe task takes at most, on average, before its range is split.
REFS_PER_TASK = 500_000
#: Keys of one parent array on average; whatever the number of keys, arrays don't grow beyond it.
KEYS_PER_RANGE = 200_000
#: Keys drawn per range to place the range bounds; they shape the layout, never the result.
DRAWN_PER_RANGE = 20
MAX_RANGES = 4096

_NEVER = np.int64(2**63 - 1)
_ALWAYS = np.int64(-(2**63))

MISSES = T.StructType(
    [
        T.StructField("ref_table", T.StringType()),
        T.StructField("ref_id", T.StringType()),
        T.StructField("period", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)


def parents_by_key(targets: DataFrame, key: str, since: str | None, deleted: str | None) -> DataFrame:
    """One row per key: ``live_from``, the first microsecond at which a live row is there.

    A live row without a time counts as always there. A key all of whose rows
    are deleted gets the largest long. Null keys are dropped, they match nothing.
    """
    at = F.coalesce(F.unix_micros(F.col(since).cast("timestamp")), F.lit(int(_ALWAYS))) if since else F.lit(int(_ALWAYS))
    live = F.col(deleted).isNull() if deleted else F.lit(True)
    return (
        targets.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(F.when(live, at)).alias("live_from"))
        .withColumn("live_from", F.coalesce("live_from", F.lit(int(_NEVER))))
    )


def references(table: str, rows: DataFrame, ref_id: Column, key: str, at: str | None) -> DataFrame:
    """The references of one table in the form :func:`find_orphans` takes; null keys are no reference."""
    return rows.where(F.col(key).isNotNull()).select(
        F.lit(table).alias("ref_table"),
        ref_id.cast("string").alias("ref_id"),
        F.col(key).alias("key"),
        (F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(None).cast("long")).alias("ref_at"),
        (F.date_format(F.col(at), "yyyy-MM") if at else F.lit(None).cast("string")).alias("period"),
    )


def _route(bounds: list) -> Column:
    """Range number of a key: how many bounds lie at or below it (found by binary search)."""
    if not bounds:
        return lambda c: F.lit(0)
    cut = np.array(bounds, dtype=object if isinstance(bounds[0], str) else np.int64)

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        codes, seen = pd.factorize(keys.to_numpy())
        at = np.searchsorted(cut, np.asarray(seen, dtype=cut.dtype), side="right") if len(seen) else np.zeros(0)
        return pd.Series(at.astype(np.int32)[codes])

    return number


def _probe(left: pa.Table, right: pa.Table) -> pa.Table:
    """Binary search of one batch of references in the sorted array of its range."""
    kind = left.schema.field("key").type
    keys = left.column("key").combine_chunks()
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.chunk(0) if keys.num_chunks else pa.array([], kind)
    if right.num_rows:
        held = right.column("parents").combine_chunks()
        held = (held.chunk(0) if isinstance(held, pa.ChunkedArray) else held).flatten()
        parent, since = held.field("key"), held.field("live_from").to_numpy(zero_copy_only=False)
    else:
        parent, since = pa.array([], kind), np.zeros(0, np.int64)
    uniq = keys.dictionary_encode()
    codes = uniq.indices.to_numpy(zero_copy_only=False)
    have, want = (x.to_numpy(zero_copy_only=False) for x in (parent, uniq.dictionary))
    at = np.searchsorted(have, want)
    inside = np.minimum(at, max(len(have) - 1, 0))
    hit = (at < len(have)) & (have[inside] == want) if len(have) else np.zeros(len(want), bool)
    live = np.where(hit, since[inside] if len(have) else 0, _NEVER)[codes]
    hit = hit.astype(bool)[codes]
    at_ref = left.column("ref_at")
    known = pc.is_valid(at_ref).to_numpy(zero_copy_only=False)
    when = pc.fill_null(at_ref, 0).to_numpy()
    state = np.full(len(codes), "", dtype=object)
    state[hit & (live != _NEVER) & known & (live > when)] = "late"
    state[hit & (live == _NEVER)] = "deleted"
    state[~hit] = "missing"
    bad = pa.array(state != "")
    out = left.select(["ref_table", "ref_id", "period"]).append_column("state", pa.array(state, pa.string()))
    return out.filter(bad)


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every broken reference once: ``(ref_table, ref_id, period, state)``.

    ``refs`` comes from :func:`references`, ``parents`` from :func:`parents_by_key`.
    state is ``missing`` (no target row has the key), ``deleted`` (all target
    rows with it are deleted) or ``late`` (live ones exist, all of them after the
    reference's own time). Keys match only when exactly equal. A reference
    without a time is never late. Rows repeated under one id give one row. Empty
    parents make every reference missing; empty references give no row.
    """
    spark = refs.sparkSession
    parents = parents.persist(StorageLevel.MEMORY_AND_DISK)  # two values a key, read three times
    n_keys, n_refs = parents.count(), refs.count()
    ranges = int(min(MAX_RANGES, max(1, shuffle_partitions(spark), -(-n_keys // KEYS_PER_RANGE))))
    # Beyond the most ranges there are, each is cut into arrays of bounded size by a hash of the key.
    arrays = max(1, -(-n_keys // (ranges * KEYS_PER_RANGE)))
    # The keys of smallest hash are a uniform, repeatable draw of bounded size.
    drawn = (
        parents.select("key").orderBy(F.xxhash64("key"), "key").limit(DRAWN_PER_RANGE * ranges).collect()
        if ranges > 1
        else []
    )
    drawn = sorted({r.key for r in drawn})
    bounds = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else drawn[1:]
    number = _route(bounds)
    which = F.pmod(F.xxhash64("key"), F.lit(arrays)).cast("int") if arrays > 1 else F.lit(0)
    placed = refs.withColumn("range", number(F.col("key"))).withColumn("array", which)
    if n_refs > REFS_PER_TASK * 2:
        crowd = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}  # at most MAX_RANGES rows
    else:
        crowd = {}
    splits = [max(1, -(-crowd.get(i, 0) // (REFS_PER_TASK * arrays))) for i in range(len(bounds) + 1)]
    parts = F.element_at(F.array(*[F.lit(x) for x in splits]), F.col("range") + 1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("ref_id", "ref_at"), parts).cast("int"))
    stored = (
        parents.withColumn("range", number(F.col("key")))
        .withColumn("array", which)
        .groupBy("range", "array")
        .agg(F.array_sort(F.collect_list(F.struct("key", "live_from"))).alias("parents"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    )
    found = (
        placed.groupBy("range", "array", "part")
        .cogroup(stored.groupBy("range", "array", "part"))
        .applyInArrow(lambda a, b: _probe(a, b), MISSES)
    )
    return found.dropDuplicates(["ref_table", "ref_id", "state"])


def orphan_report(found: DataFrame) -> DataFrame:
    """Broken references per table, period and state, each reference once."""
    return found.groupBy("ref_table", "period", "state").agg(F.count("*").alias("n_refs"))
