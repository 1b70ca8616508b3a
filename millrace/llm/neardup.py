"""Near-duplicate texts with small edits: tiled exclusive-or and bit counts.

A text is the set of its five-word runs. Sets that are equal form one class and
are represented once. A class carries an odd sketch: bit ``j`` is the parity of
the runs that hash to ``j``. Two sketches differ in at most as many bits as the
sets differ in members, so for a similarity of at least ``t`` the distance is at
most ``(1 - t) / (1 + t)`` times the sum of the set sizes: a radius that loses
nothing. Sketches are compared tile by tile with exclusive-or and bit counts;
tile pairs whose population counts differ beyond the radius are skipped. What is
within the radius is verified on the sets themselves.

Comparing all tiles with all grows with the square of the collection. So
sketches first meet in buckets of equal min-hash bands, as many as the threshold
asks for (a pair at the threshold shares none with probability below 5e-5), and
tiles are formed within buckets; many small buckets make up one tile. A bucket
above a certain size is cut into parts, and pairs of parts are separate tasks, so
no bucket has to fit one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.graph import components
from millrace.session import checkpointed, shuffle_partitions

SHINGLE = 5
THRESHOLD = 0.7
#: Minima in a band, and how likely a pair at the threshold may share no band.
ROWS, MISS = 3, 5e-5
#: Rows of one tile; buckets above HOT rows are cut into parts of about that many.
TILE, HOT = 512, 4096
LEAST_BITS = 128

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def bands_for(t: float) -> int:
    """Bands that a pair of similarity ``t`` must be given so that it misses all of them with probability ``MISS`` at most."""
    if not 0 < t <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    return 1 if t == 1 else max(1, int(np.ceil(np.log(MISS) / np.log1p(-(t**ROWS)))))


_IS_WORD = np.array([chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" for c in range(256)])
#: Characters of texts that are hashed together; a longer text is hashed alone.
AT_ONCE = 1 << 18


def hashed_runs(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted 64-bit hashes of the distinct runs of ``k`` words of every text, and where those of text ``i`` begin.

    Words are the maximal runs of a-z and 0-9 in the lower-cased text. Characters
    of all texts are hashed at once, a word being the sum over its characters and places.
    """
    none = np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = [t.lower().encode("ascii", "replace") if t else b"" for t in texts]
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    word = _IS_WORD[flat]
    at = np.flatnonzero(word)
    if not len(at):
        return none
    begins = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    lengths = np.diff(np.r_[begins, len(at)])
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    codes = np.add.reduceat(_mix(flat[at].astype(np.uint64) + place.astype(np.uint64) * np.uint64(257) + _POS[3]), begins)
    n = len(codes) - k + 1
    if n < 1:
        return none
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    of = np.searchsorted(starts, at[begins], side="right") - 1
    whole = of[:n] == of[k - 1 :]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mix(out + codes[i : i + n] * _POS[i % len(_POS)] + np.uint64(i + 1))
    out, of = out[whole], of[:n][whole]
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (of[1:] != of[:-1])] if len(out) else np.zeros(0, bool)
    return out[new], np.searchsorted(of[new], np.arange(len(texts) + 1))


def in_groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Places (first, end) of neighbouring texts that are hashed together."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > AT_ONCE and i > first:
            yield first, i
            first, held = i, len(t or "")
    if first < len(texts):
        yield first, len(texts)


class Shingler:
    """Sorted 64-bit hashes of the distinct five-word runs of one text."""

    def __init__(self, k: int = SHINGLE):
        self.k = k

    def __call__(self, text: str | None) -> np.ndarray:
        return hashed_runs([text], self.k)[0]


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of ``n``: a power of two, so that sketches fold onto each other."""
    return max(LEAST_BITS, 1 << int(np.ceil(np.log2(max(2, 1.5 * n)))))


def odd_sketches(sh: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The sketch of every set of an array of sets."""
    n = np.diff(bounds)
    bits = np.array([sketch_bits(int(x)) for x in n], np.int64)
    first = np.cumsum(np.r_[0, bits])
    at = (_mix(sh ^ _POS[2]) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(first[:-1], n)
    packed = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip((first[:-1] // 8).tolist(), (first[1:] // 8).tolist())]


def odd_sketch(sh: np.ndarray) -> bytes:
    return odd_sketches(sh, np.array([0, len(sh)]))[0]


def bands_of(sh: np.ndarray, bounds: np.ndarray, bands: int) -> np.ndarray:
    """Keys of the min-hash bands of every (not empty) set of an array of sets: one row per set."""
    factors = _mix(np.arange(1, bands * ROWS + 1, dtype=np.uint64) * _POS[0]) | np.uint64(1)
    low = np.stack([np.minimum.reduceat(sh * f, bounds[:-1]) for f in factors], axis=1)
    key = np.tile(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _POS[1]), (len(low), 1))
    for r in range(ROWS):
        key = _mix(key ^ low[:, r::ROWS])
    return key


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def tiled_pairs(sketches: list[bytes], sizes: np.ndarray, parts: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket within the radius, tile by tile.

    If two parts are present only pairs across them are compared, else all pairs.
    """
    across = len(np.unique(parts)) > 1
    widths = np.array([len(s) // 8 for s in sketches])
    sets = {}
    for w in np.unique(widths):
        for p in np.unique(parts):
            at = np.flatnonzero((widths == w) & (parts == p))
            if len(at):
                rows = np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), w)
                order = np.argsort(np.bitwise_count(rows).sum(axis=1), kind="stable")
                sets[int(w), int(p)] = (at[order], rows[order])
    keys = sorted(sets)
    rate = (1 - t) / (1 + t)
    for x, (w, p) in enumerate(keys):
        for v, q in keys[x:]:
            if across == (p == q):
                continue
            same = (w, p) == (v, q)
            (ia, ra), (ib, rb) = sets[w, p], sets[v, q]
            rb = _fold(rb, w)
            pa_, pb = np.bitwise_count(ra).sum(axis=1).astype(np.int64), np.bitwise_count(rb).sum(axis=1).astype(np.int64)
            for a in range(0, len(ia), TILE):
                sa = slice(a, a + TILE)
                for b in range(a if same else 0, len(ib), TILE):
                    sb = slice(b, b + TILE)
                    widest = rate * (sizes[ia[sa]].max() + sizes[ib[sb]].max())
                    if pb[sb].min() - pa_[sa].max() > widest or pa_[sa].min() - pb[sb].max() > widest:
                        continue  # population counts alone put all of these beyond the radius
                    radius = np.floor(rate * (sizes[ia[sa]][:, None] + sizes[ib[sb]][None, :]) + 1e-9)
                    dist = np.zeros(radius.shape, np.int32)
                    for k in range(w):
                        dist += np.bitwise_count(ra[sa, k][:, None] ^ rb[sb, k][None, :])
                    na, nb = sizes[ia[sa]][:, None], sizes[ib[sb]][None, :]
                    near = (dist <= radius) & (np.minimum(na, nb) >= t * np.maximum(na, nb))
                    if same and a == b:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    if len(i):
                        yield ia[sa][i], ib[sb][j]


def small_tile(sketches: list[bytes], sizes: np.ndarray, parts: np.ndarray, starts: np.ndarray, ends: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius of many small buckets (rows ``starts`` to ``ends``), compared as one tile.

    As in :func:`tiled_pairs`, pairs whose set sizes put them beyond the radius
    are skipped, and only pairs across parts count where a bucket has several.
    """
    m = ends - starts
    first = np.repeat(np.arange(starts[0], ends[-1]), np.repeat(ends, m) - np.arange(starts[0], ends[-1]) - 1) if len(m) else np.zeros(0, np.int64)
    n = np.bincount(first - starts[0], minlength=ends[-1] - starts[0]) if len(first) else np.zeros(0, np.int64)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
    several = np.repeat(np.array([len(set(parts[s:e].tolist())) > 1 for s, e in zip(starts, ends)]), m)[first - starts[0]] if len(first) else np.zeros(0, bool)
    a, b = sizes[first], sizes[second]
    ok = (np.minimum(a, b) >= t * np.maximum(a, b)) & ~(several & (parts[first] == parts[second]))
    first, second = first[ok], second[ok]
    radius = np.floor((1 - t) / (1 + t) * (sizes[first] + sizes[second]) + 1e-9)
    widths = np.array([len(s) // 8 for s in sketches], np.int64)
    narrow = np.minimum(widths[first], widths[second])
    near = np.zeros(len(first), bool)
    for w in np.unique(narrow):
        at = np.flatnonzero(narrow == w)
        rows, place = np.unique(np.r_[first[at], second[at]], return_inverse=True)
        folded = np.empty((len(rows), w), np.uint64)
        for v in np.unique(widths[rows]):
            some = np.flatnonzero(widths[rows] == v)
            folded[some] = _fold(np.frombuffer(b"".join(sketches[rows[i]] for i in some), np.uint64).reshape(len(some), v), w)
        for c in range(0, len(at), TILE * TILE):
            x, y = place[: len(at)][c : c + TILE * TILE], place[len(at) :][c : c + TILE * TILE]
            near[at[c : c + TILE * TILE]] = np.bitwise_count(folded[x] ^ folded[y]).sum(axis=1) <= radius[at[c : c + TILE * TILE]]
    return first[near], second[near]


_SIGNED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("class_a", T.LongType()),
        T.StructField("class_b", T.LongType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("runs", T.ArrayType(T.LongType())),
    ]
)


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """id, class key, set size, sketch, band keys and hashed runs of every text with five words or more, once per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for start, end in in_groups(texts):
                sh, bounds = hashed_runs(texts[start:end])
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                first = np.r_[bounds[some], len(sh)]
                with np.errstate(over="ignore"):
                    a = np.bitwise_xor.reduceat(sh, first[:-1])
                    b = np.add.reduceat(_mix(sh), first[:-1]) + n[some].astype(np.uint64)
                keys = bands_of(sh, first, bands)
                lists = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(start + some)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.array(n[some].astype(np.int32)),
                        pa.array(odd_sketches(sh, first), pa.binary()),
                        lists(np.ascontiguousarray(keys).ravel(), np.arange(len(some) + 1) * bands),
                        lists(sh, first),
                    ],
                    names=_SIGNED.names,
                )

    # A stated number of partitions, which AQE doesn't merge: the work per row is heavy.
    dealt = docs.select("id", "text").where("id is not null and text is not null").repartition(shuffle_partitions(docs.sparkSession), "id")
    return dealt.dropDuplicates(["id"]).mapInArrow(run, _SIGNED)


def _compare(t: float):
    """Streams over rows sorted by cell and gives the pairs of each cell that are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = table.column("cell").to_numpy()
            cut = np.flatnonzero(np.diff(cells)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(cells)]
            ids = table.column("rep").combine_chunks()
            sizes, parts = table.column("n").to_numpy().astype(np.int64), table.column("part").to_numpy()
            sketches = table.column("sketch").to_pylist()
            large = ends - starts > TILE
            for s, e in zip(starts[large].tolist(), ends[large].tolist()):
                for i, j in tiled_pairs(sketches[s:e], sizes[s:e], parts[s:e], t):
                    yield _pairs(ids, s + i, s + j)
            # Small cells in turn, until their pairs fill some tiles.
            pairs = np.where(large, 0, (ends - starts) * (ends - starts - 1) // 2)
            group = np.cumsum(pairs) // (4 * TILE * TILE)
            for g in np.unique(group):
                mine = (group == g) & ~large & (pairs > 0)
                if mine.any():
                    rows = np.concatenate([np.arange(s, e) for s, e in zip(starts[mine], ends[mine])])
                    until = np.cumsum(ends[mine] - starts[mine])
                    i, j = small_tile([sketches[r] for r in rows], sizes[rows], parts[rows], np.r_[0, until[:-1]], until, t)
                    yield _pairs(ids, rows[i], rows[j])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell")
            last = cells[-1].as_py()
            k = int(np.searchsorted(cells.to_numpy(), last, side="left"))
            if held and k == 0:
                held.append(batch)  # the cell goes on
                continue
            done = pa.Table.from_batches([*held, batch.slice(0, k)]) if held or k else None
            held = [batch.slice(k)]
            if done is not None:
                yield from flush(done)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _pairs(ids: pa.Array, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
    less = pc.less(a, b)
    return pa.RecordBatch.from_arrays([pc.if_else(less, a, b), pc.if_else(less, b, a)], names=["a", "b"])


def candidates(reps: DataFrame, t: float) -> DataFrame:
    """Distinct pairs (a, b) of representatives whose sketches are within the radius.

    Band keys are counted first, so that only rows that share a bucket are
    shuffled with their sketches, each to its cells.
    """
    keys = reps.select("rep", F.explode("bands").alias("band"))
    crowds = keys.groupBy("band").agg(F.count("*").alias("crowd")).where("crowd > 1")
    parts = F.ceil(F.col("crowd") / HOT).cast("int")
    split = (
        keys.join(crowds, "band")
        .join(reps.select("rep", "n", "sketch"), "rep")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.when(F.col("parts") == 1, F.col("band"))
            .otherwise(F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other")))
            .alias("cell"),
            "part",
            "rep",
            "n",
            "sketch",
        )
    )
    return (
        split.repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(_compare(t), "a string, b string")
        .dropDuplicates(["a", "b"])
    )


def verified(cand: DataFrame, sig: DataFrame, t: float) -> DataFrame:
    """Candidate pairs with their exact similarity, of at least ``t``: (a, b, similarity)."""
    ids = cand.select(F.col("a").alias("id")).union(cand.select("b")).distinct()
    sets = sig.select("id", "runs").join(ids, "id", "left_semi")
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    return (
        cand.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b")
        .select("a", "b", (both / (F.size("runs_a") + F.size("runs_b") - both)).alias("similarity"))
        .where(F.col("similarity") >= t)
    )


def links(docs: DataFrame, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: id with its class representative, and similar pairs of representatives.

    Texts with fewer than five words, null and empty ones are in neither. Rows
    repeated under one id count once; ids are compared as text. Texts with the
    same set of runs are one class, however many they are; no link between
    different classes is dropped.
    """
    sig = signatures(docs, bands_for(t)).persist(StorageLevel.MEMORY_AND_DISK)
    keys = ["class_a", "class_b", "n"]
    first = sig.groupBy(*keys).agg(F.min("id").alias("rep"))
    members = sig.select("id", *keys).join(first, keys).select("id", "rep").persist(StorageLevel.MEMORY_AND_DISK)  # two ids a row, read several times
    reps = sig.select("id", "n", "sketch", "bands").join(first.select(F.col("rep").alias("id")), "id", "left_semi").withColumnRenamed("id", "rep")
    # Read three times: for the ids, and for either side's sets.
    cand = candidates(reps, t).persist(StorageLevel.MEMORY_AND_DISK)
    return members, verified(cand, sig, t)


def similar_pairs(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """All pairs of ids with similarity of at least ``t``, those of equal texts too: (id_a, id_b), id_a < id_b.

    Grows with the square of a class of equal texts by its very definition;
    :func:`groups` doesn't.
    """
    members, pairs = links(docs, t)
    left, right = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(x)) for x in "ab")
    apart = pairs.join(left, "a").join(right, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    several = members.groupBy("rep").agg(F.count("*").alias("size")).where("size > 1").select("rep")
    within = (
        left.withColumnRenamed("a", "rep").join(several, "rep").join(right.withColumnRenamed("b", "rep"), "rep").where("id_a < id_b").select("id_a", "id_b")
    )
    return apart.unionByName(within)


def groups(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """One row per document that has a near duplicate: id, source, group_id (least id), n_links.

    n_links counts links of its class to other classes; documents whose only
    duplicates are equal texts have 0.
    """
    members, pairs = links(docs, t)
    pairs = checkpointed(pairs)
    roots = components(pairs)
    degree = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    crowd = members.groupBy("rep").agg(F.count("*").alias("size"))
    placed = (
        members.join(crowd, "rep")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .where("size > 1 or root is not null")
        .select("id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    sources = docs.select("id", "source").dropDuplicates(["id"])
    return placed.join(sources, "id").select("id", "source", "group_id", "n_links")


def group_report(found: DataFrame) -> DataFrame:
    """Size and sources of every group."""
    per = found.groupBy("group_id", "source").agg(F.count("*").alias("n"))
    return per.groupBy("group_id").agg(
        F.sum("n").alias("n_docs"), F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.coalesce("source", F.lit("")))).alias("sources")
    )
