"""Most similar vectors for every vector: forests of random-projection trees.

Two levels of the same idea. At the top a few trees, fitted on a bounded sample,
cut the collection into cells of about ``CELL`` vectors. Every vector is a
member of its cell in each top tree; as a query it also goes to the cells behind
the split planes it lies nearest to, taken from all top trees through one shared
priority queue. In a cell, one task builds a forest on all members, searches it
for all queries through a shared priority queue over the trees (nearest plane
first), and reranks the candidates of the leaves reached by exact cosine.

The sample places the planes of the top trees only: every row is indexed. Of a
vector that would crowd a cell alone only the least ids are indexed, which no
result can tell; the other copies share one exact search. A cell that is crowded
nevertheless (proportional vectors, say) is cut into parts by a hash of the id,
and every part is searched for every part, so no task grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import bounded

#: Vectors of one cell on average, and sample rows per cell and at most.
CELL, SAMPLE_PER_CELL, MAX_SAMPLE = 32_768, 512, 65_536
#: Kinds of vectors at most (their top trees are shipped to every task), and sample rows of all kinds on average.
MAX_KINDS, MAX_DRAWN = 10_000, 131_072
_HASHES = 1 << 40
#: Top trees, and cells a query visits besides its own ones.
TOP_TREES, EXTRA_CELLS = 2, 1
#: Trees of a cell's forest, members of a leaf, leaves a query reaches besides its own ones.
TREES, LEAF, EXTRA_LEAVES = 5, 192, 5
BLOCK = 8192

EDGES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("query_id", T.LongType()),
        T.StructField("found_id", T.LongType()),
        T.StructField("cosine", T.DoubleType()),
    ]
)


def usable(vec: str = "vec", dim: str = "dim") -> Column:
    """Not null, exactly ``dim`` finite numbers, not all of them zero."""
    v = F.col(vec)
    return (
        v.isNotNull()
        & (F.size(v) == F.col(dim))
        & (F.col(dim) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )


class Tree:
    """A complete binary tree of split planes over unit vectors; node 1 is the root, leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        self.depth = depth
        n, d = x.shape
        self.planes = np.zeros((1 << depth, d), np.float32)
        self.cuts = np.zeros(1 << depth, np.float32)
        self.flat = np.zeros(1 << depth, bool)
        groups = {1: np.arange(n)}
        for level in range(depth):
            for node in range(1 << level, 2 << level):
                at = groups.pop(node)
                half = len(at) // 2
                plane = self._plane(x, at, rng)
                self.planes[node] = plane
                if len(at) < 2:
                    groups[2 * node], groups[2 * node + 1] = at, at[:0]
                    continue
                side = x[at] @ plane
                order = np.argpartition(side, half)
                self.cuts[node] = side[order[half]]
                groups[2 * node], groups[2 * node + 1] = at[order[:half]], at[order[half:]]
        first = 1 << depth
        self.members = [groups[first + i] for i in range(first)]

    @staticmethod
    def _plane(x: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The normal between two centres, each moved towards what lies nearer to it (a few steps of two-means)."""
        if len(at) < 2:
            return np.zeros(x.shape[1], np.float32)
        a, b = x[at[rng.integers(len(at))]].copy(), x[at[rng.integers(len(at))]].copy()
        some = x[at[rng.integers(len(at), size=min(len(at), 64))]]
        for _ in range(3):
            near = some @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
        plane = a - b
        norm = float(np.linalg.norm(plane))
        if norm < 1e-6:
            plane = rng.standard_normal(x.shape[1]).astype(np.float32)
            norm = float(np.linalg.norm(plane))
        return (plane / norm).astype(np.float32)


def search(trees: list[Tree], q: np.ndarray, extra: int) -> np.ndarray:
    """Leaves that each query reaches, as tree * leaves + leaf: its own one in every tree, then ``extra`` more.

    All trees share one queue per query; it gives the node behind the nearest
    plane first, where a node counts as far as the farthest plane on its way.
    The queues of all queries advance together, so the work is vectorised.
    """
    n, depth, t = len(q), trees[0].depth, len(trees)
    leaves = 1 << depth
    if depth == 0:
        return np.tile(np.arange(t), (n, 1))
    sides = [q @ tree.planes.T - tree.cuts for tree in trees]
    width = depth * (t + extra)
    far = np.full((n, width), np.inf, np.float32)
    node = np.zeros((n, width), np.int32)
    of = np.zeros((n, width), np.int8)
    out = np.empty((n, t + extra), np.int32)
    rows = np.arange(n)
    side = np.stack(sides)  # tree, query, node

    def descend(tree: np.ndarray, v: np.ndarray, way: np.ndarray, col: int) -> np.ndarray:
        for k in range(depth):
            inner = v < leaves
            if not inner.any():
                break
            m = side[tree, rows, np.where(inner, v, 0)]
            right = m >= 0
            far[:, col + k] = np.where(inner, np.maximum(way, np.abs(m)), np.inf)
            node[:, col + k] = 2 * v + ~right
            of[:, col + k] = tree
            v = np.where(inner, 2 * v + right, v)
        return v

    for i in range(t):
        tree = np.full(n, i, np.int8)
        v = descend(tree, np.ones(n, np.int32), np.zeros(n, np.float32), i * depth)
        out[:, i] = i * leaves + v - leaves
    for e in range(extra):
        best = far.argmin(axis=1)
        way, v, tree = far[rows, best], node[rows, best], of[rows, best]
        far[rows, best] = np.inf
        gone = ~np.isfinite(way)
        v = np.where(gone, leaves, v)
        v = descend(tree, v, way, (t + e) * depth)
        out[:, t + e] = np.where(gone, -1, tree.astype(np.int32) * leaves + v - leaves)
    return out


def _top(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries above ``least``, at most the ``k`` best of a row."""
    if least > -1:
        r, c = np.nonzero(scores >= least)
        if len(r) <= k * len(scores):
            return r, c
    if scores.shape[1] > k:
        c = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        r = np.repeat(np.arange(len(scores)), k)
        c = c.ravel()
    else:
        r, c = (x.ravel() for x in np.indices(scores.shape))
    keep = scores[r, c] >= least
    return r[keep], c[keep]


def cell_edges(
    ids: np.ndarray, vecs: np.ndarray, member: np.ndarray, query: np.ndarray, k: int, least: float, seed: int = 7, trees: int = TREES, extra: int = EXTRA_LEAVES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, found id, cosine): of each query the at most ``k`` best members found, of cosine ``least`` or more."""
    x = vecs.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    unit = (x / norm[:, None]).astype(np.float32)
    mem = np.flatnonzero(member)
    if not len(mem):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u = unit[mem]
    depth = max(0, int(np.ceil(np.log2(len(mem) / LEAF))))
    rng = np.random.default_rng(seed)
    forest = [Tree(u, depth, rng) for _ in range(trees if depth else 1)]
    asked = np.flatnonzero(query)
    got_q, got_m, got_s = [], [], []
    for a in range(0, len(asked), BLOCK):
        block = asked[a : a + BLOCK]
        reach = search(forest, unit[block], extra if depth else 0)
        flat = reach.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[flat[order] >= 0]
        bins, first = np.unique(flat[order], return_index=True)
        for b, s, e in zip(bins, first, np.r_[first[1:], len(order)]):
            rows = block[order[s:e] // reach.shape[1]]
            cols = forest[b >> depth].members[b & ((1 << depth) - 1)]
            if not len(cols):
                continue
            scores = unit[rows] @ u[cols].T
            scores[ids[rows][:, None] == ids[mem[cols]][None, :]] = -2
            r, c = _top(scores, k, max(-1.5, least - 1e-4))
            got_q.append(rows[r])
            got_m.append(mem[cols[c]])
            got_s.append(scores[r, c])
    if not got_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, m = np.concatenate(got_q), np.concatenate(got_m)
    key = np.unique(q.astype(np.int64) * len(ids) + m)  # one candidate may come from several leaves
    q, m = key // len(ids), key % len(ids)
    cos = np.empty(len(q))
    for a in range(0, len(q), 1 << 18):  # exact reranking in double precision
        s = slice(a, a + (1 << 18))
        cos[s] = np.einsum("ij,ij->i", x[q[s]], x[m[s]]) / (norm[q[s]] * norm[m[s]])
    qi, mi = ids[q], ids[m]
    keep = cos >= least
    qi, mi, cos = qi[keep], mi[keep], cos[keep]
    # Rows repeated under one id are identical; each found id counts once.
    order = np.lexsort((mi, -cos, qi))
    qi, mi, cos = qi[order], mi[order], cos[order]
    both = np.unique(np.stack((qi, mi), axis=1), axis=0, return_index=True)[1]
    both.sort()
    qi, mi, cos = qi[both], mi[both], cos[both]
    new = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(new, np.diff(np.r_[new, len(qi)])) if len(qi) else np.zeros(0, np.int64)
    return qi[rank < k], mi[rank < k], cos[rank < k]


class Top:
    """The top trees of one kind of vectors, and where cells have to be dealt out."""

    def __init__(self, kind: str, dim: int, sample: np.ndarray, count: int, base: int):
        self.kind, self.dim, self.base = kind, dim, base
        depth = max(0, int(np.ceil(np.log2(max(1, count) / CELL)))) if len(sample) > 1 else 0
        depth = min(depth, int(np.log2(MAX_SAMPLE // 16)), int(np.log2(max(1, len(sample)))))
        rng = np.random.default_rng(11)
        unit = _unit(sample)
        self.trees = [Tree(unit, depth, rng) for _ in range(TOP_TREES if depth else 1)]
        self.cells = 1 << depth
        self.parts = np.ones(len(self.trees) * self.cells, np.int64)
        for i, tree in enumerate(self.trees):
            own = search([tree], unit, 0)[:, 0]
            share = np.bincount(own, minlength=self.cells) / max(1, len(unit))
            self.parts[i * self.cells : (i + 1) * self.cells] = np.maximum(1, np.round(share * count / (2 * CELL)))
            tree.members = None  # not shipped
        self.next = base + int((self.parts**2).sum())
        self.starts = base + np.cumsum(np.r_[0, self.parts**2])[:-1]

    def route(self, ids: np.ndarray, x: np.ndarray, extra: int, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, task, role): where each row goes, and whether it is indexed there (1), asks there (2) or both (3).

        The tasks of a cell in parts are a square: its rows are the parts as members, its columns the parts as queries.
        """
        reach = search(self.trees, _unit(x), extra if self.cells > 1 else 0)
        row, col = np.nonzero(reach >= 0)
        cell = reach[row, col]
        n, member, asks = self.parts[cell], col < len(self.trees), asks[row]
        part = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
        of = np.repeat(np.arange(len(row)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        row, part, n, first, member, asks = row[of], part[of], n[of], self.starts[cell][of], member[of], asks[of]
        own = k == part
        down = asks & ~(own & member)
        return (
            np.r_[row[member], row[down]],
            np.r_[(first + part * n + k)[member], (first + k * n + part)[down]],
            np.r_[(1 + 2 * (own & asks))[member], np.full(int(down.sum()), 2)],
        )


def _bytes(x: np.ndarray) -> np.ndarray:
    """Rows of a matrix as values that can be compared and sorted; both zeros are one."""
    return np.ascontiguousarray(x + np.float32(0)).view(f"V{x.shape[1] * x.dtype.itemsize}")[:, 0]


class Hot:
    """Vectors with so many copies that they would crowd a cell, by kind and length, and which copies are indexed."""

    def __init__(self):
        self.numbers: dict = {}
        self.vectors: list[np.ndarray] = []
        self.keys: list[tuple] = []
        self.least: list[np.ndarray] = []
        self.answers: list[list[tuple[int, float]]] = []

    def add(self, key: tuple, sample: np.ndarray, count: int) -> np.ndarray:
        """Take up what is hot in a sample; the sample without the other copies of it."""
        _, first, of, n = np.unique(_bytes(sample), return_index=True, return_inverse=True, return_counts=True)
        hot = (n > 1) & (n * count > len(sample) * CELL / 4)
        for i in first[hot]:
            self.numbers.setdefault(key, {})[_bytes(sample[i : i + 1])[0].tobytes()] = len(self.vectors)
            self.vectors.append(sample[i])
            self.keys.append(key)
        keep = ~hot[of]
        keep[first] = True
        return sample[keep]

    def of(self, key: tuple, x: np.ndarray) -> np.ndarray:
        """The number of each row's vector, -1 if it is not hot."""
        mine = self.numbers.get(key)
        return np.array([mine.get(v.tobytes(), -1) for v in _bytes(x)], np.int64) if mine else np.full(len(x), -1)

    def others(self, key: tuple, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The number of each row's vector if it is a copy that is not indexed, else -1."""
        number = self.of(key, x)
        for h in np.unique(number[number >= 0]):
            number[(number == h) & np.isin(ids, self.least[h])] = -1
        return number


def _by_kind(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, np.ndarray, np.ndarray]]:
    """((kind, length), ids, vectors, who asks) of a batch."""
    groups: dict = {}
    for i, key in enumerate(zip(batch.column("kind").to_pylist(), batch.column("dim").to_pylist())):
        groups.setdefault(key, []).append(i)
    for key, at in groups.items():
        part = batch.take(pa.array(at, pa.int32()))
        asks = part.column("asks").to_numpy(zero_copy_only=False)
        yield key, part.column("id").to_numpy(), _matrix(part.column("vec"), key[1]), np.array([bool(a) for a in asks]) if asks.dtype == object else asks


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]).astype(np.float32)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def _draw(good: DataFrame, counts: dict) -> dict[tuple, np.ndarray]:
    """Samples of all kinds that need more than one cell, in one pass: rows whose hash of the id is below the kind's rate.

    A sample has about ``SAMPLE_PER_CELL`` rows a cell, at most ``MAX_SAMPLE`` a
    kind and ``MAX_DRAWN`` in all, on average.
    """
    size = {k: min(MAX_SAMPLE, SAMPLE_PER_CELL * max(1, n // CELL)) for k, n in counts.items() if n > CELL}
    if not size:
        return {}
    less = min(1.0, MAX_DRAWN / sum(size.values()))
    rows = [(*k, int(less * m / counts[k] * _HASHES)) for k, m in size.items()]
    at = F.pmod(F.xxhash64("id"), F.lit(_HASHES))
    if len(rows) <= 100:  # as one expression; the same as the join
        taken = F.lit(False)
        for k, d, rate in rows:
            taken = taken | (F.col("kind").eqNullSafe(F.lit(k)) & (F.col("dim") == d) & (at < rate))
        some = good.where(taken)
    else:
        rates = good.sparkSession.createDataFrame(rows, "k string, d int, rate long")
        some = good.join(F.broadcast(rates), F.col("kind").eqNullSafe(F.col("k")) & (F.col("dim") == F.col("d"))).where(at < F.col("rate"))
    out: dict = {}
    for batch in some.select("kind", "dim", "id", "vec", F.lit(False).alias("asks")).toArrow().to_batches():
        for key, ids, x, _ in _by_kind(batch):
            out.setdefault(key, []).append((ids, x))
    return {k: np.concatenate([x for _, x in v])[np.argsort(np.concatenate([i for i, _ in v]), kind="stable")] for k, v in out.items()}


def _settle(good: DataFrame, hot: Hot, k: int, least: float) -> None:
    """Choose the copies of hot vectors that are indexed, and find what the others are nearest to.

    Ties go to the lower id, so no result has another copy than the ``k + 1``
    least ids (a query is not its own neighbour). Those not among them all have
    the same neighbours, found by exact comparison with every row.
    """
    spark = good.sparkSession
    first = spark.sparkContext.broadcast(hot)

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, ids, x, _ in _by_kind(batch):
                number = first.value.of(key, x)
                for h in np.unique(number[number >= 0]):
                    mine = np.unique(ids[number == h])[: k + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), h)), pa.array(mine)], names=["hot", "id"])

    low = Window.partitionBy("hot").orderBy("id")
    ids = good.mapInArrow(ids_of, "hot long, id long").distinct().withColumn("at", F.row_number().over(low)).where(F.col("at") <= k + 1)
    hot.least = [np.zeros(0, np.int64) for _ in hot.vectors]
    for r in ids.groupBy("hot").agg(F.collect_list("id").alias("ids")).collect():
        hot.least[r.hot] = np.array(sorted(r.ids), np.int64)
    second = spark.sparkContext.broadcast(hot)

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = second.value
        for batch in batches:
            for key, ids, x, _ in _by_kind(batch):
                if key not in hot.numbers:
                    continue
                rest = hot.others(key, ids, x) < 0
                ids, at = np.unique(ids[rest], return_index=True)
                x64 = x[rest][at].astype(np.float64)
                norm = np.sqrt((x64 * x64).sum(axis=1))
                for h in hot.numbers[key].values():
                    v = hot.vectors[h].astype(np.float64)
                    cos = np.einsum("ij,j->i", x64, v) / (norm * np.sqrt((v * v).sum()))
                    best = np.lexsort((ids, -cos))[:k]
                    best = best[cos[best] >= least]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), h)), pa.array(ids[best]), pa.array(cos[best])], names=["hot", "id", "cosine"])

    order = Window.partitionBy("hot").orderBy(F.desc("cosine"), "id")
    found = good.mapInArrow(nearest_of, "hot long, id long, cosine double").dropDuplicates(["hot", "id"])
    hot.answers = [[] for _ in hot.vectors]
    for r in found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).orderBy("hot", "at").collect():
        hot.answers[r.hot].append((r.id, r.cosine))


def nearest(
    vectors: DataFrame,
    k: int,
    least: float = -1.0,
    queries: Column | None = None,
    extra_cells: int = EXTRA_CELLS,
    trees: int = TREES,
    extra_leaves: int = EXTRA_LEAVES,
) -> DataFrame:
    """The ``k`` most similar vectors found for each query: kind, query_id, found_id, cosine, rank.

    ``queries`` picks the rows that ask (all if None); every usable row is
    indexed. Only neighbours with a cosine of at least ``least`` are given.
    Vectors of one kind and one length are compared with each other; a null kind
    is a kind of its own. Rows repeated under one id count once, a vector is
    never its own neighbour; ties of similarity go to the lower id. No usable
    row gives no result.
    """
    spark = vectors.sparkSession
    asks = queries if queries is not None else F.lit(True)
    good = vectors.where(usable() & F.col("chunk_id").isNotNull()).select(
        F.col("chunk_id").cast("long").alias("id"), F.col("kind"), F.size("vec").alias("dim"), F.col("vec"), asks.alias("asks")
    )
    tops: dict = {}
    hot = Hot()
    base = 0
    counts = {(r.kind, r.dim): r["count"] for r in bounded(good.groupBy("kind", "dim").count(), MAX_KINDS, "kinds of vectors")}
    drawn = _draw(good, counts)
    for key in sorted(counts, key=lambda k: (k[0] or "", k[0] is None, k[1])):
        n, x = counts[key], drawn.get(key)
        if x is None or not len(x):
            top = Top(*key, np.ones((1, key[1]), np.float32), n, base)
        else:
            few = hot.add(key, x, n)
            top = Top(*key, few, round(n * len(few) / len(x)), base)
        base = top.next
        tops[key] = top
    if hot.vectors:
        _settle(good, hot, k, least)
    shipped = spark.sparkContext.broadcast((tops, hot))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, hot = shipped.value
        for batch in batches:
            for key, ids, x, asks in _by_kind(batch):
                if key in hot.numbers:
                    rest = hot.others(key, ids, x) < 0
                    ids, x, asks = ids[rest], x[rest], asks[rest]
                rows, tasks, roles = tops[key].route(ids, x, extra_cells, asks)
                for a in range(0, len(rows), 1 << 16):
                    row, task, role = (v[a : a + (1 << 16)] for v in (rows, tasks, roles))
                    raw = np.ascontiguousarray(x[row])
                    ends = (np.arange(len(row) + 1) * key[1] * 4).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array([key[0]] * len(row), pa.string()), pa.array(ids[row]), blob],
                        names=["task", "role", "kind", "id", "vec"],
                    )

    def look(table):
        blob = table.column("vec").combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        role, ids = table.column("role").to_numpy(), table.column("id").to_numpy()
        n = len(ids)
        offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + n + 1]
        x = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(n, -1)
        kind = table.column("kind")[0].as_py()
        # A repeated row would only find the same again.
        first = np.unique(ids * 2 + (role & 1), return_index=True)[1]
        q, m, cos = cell_edges(ids[first], x[first], (role[first] & 1) > 0, (role[first] & 2) > 0, k, least, trees=trees, extra=extra_leaves)
        return pa.table([pa.array([kind] * len(q), pa.string()), pa.array(q), pa.array(m), pa.array(cos)], names=EDGES.names)

    edges = good.mapInArrow(route, "task int, role byte, kind string, id long, vec binary").groupBy("task").applyInArrow(look, EDGES)
    best = Window.partitionBy("kind", "query_id").orderBy(F.desc("cosine"), "found_id")
    ranked = edges.dropDuplicates(["kind", "query_id", "found_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if not hot.vectors:
        return ranked

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shipped.value[1]
        for batch in batches:
            for key, ids, x, asks in _by_kind(batch):
                number = np.where(asks, hot.others(key, ids, x), -1)
                for h in np.unique(number[number >= 0]):
                    mine, answer = np.unique(ids[number == h]), hot.answers[h]
                    m = len(answer)
                    cols = (np.repeat(mine, m), np.tile(np.array([i for i, _ in answer], np.int64), len(mine)), np.tile(np.array([c for _, c in answer], np.float64), len(mine)))
                    rank = np.tile(np.arange(1, m + 1, dtype=np.int32), len(mine))
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rank), pa.string()), *map(pa.array, cols), pa.array(rank)], names=[*EDGES.names, "rank"])

    schema = "kind string, query_id long, found_id long, cosine double, rank int"
    return ranked.unionByName(good.mapInArrow(copies, schema).dropDuplicates(["kind", "query_id", "found_id"]))


def close_pairs(vectors: DataFrame, k: int = 5, least: float = 0.9) -> DataFrame:
    """Pairs of one kind with cosine of at least ``least``, at least one among the ``k`` nearest of the other."""
    found = nearest(vectors, k, least)
    return found.select(F.least("query_id", "found_id").alias("chunk_a"), F.greatest("query_id", "found_id").alias("chunk_b")).distinct()
