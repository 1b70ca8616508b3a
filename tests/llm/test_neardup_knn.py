import random
import re

import numpy as np

from millrace.llm import knn as K
from millrace.llm import neardup as N


def within(a: bytes, b: bytes, na: int, nb: int, t: float) -> bool:
    """Whether two sketches are within the radius, in plain integers (the plain form that tiles are checked against)."""
    if min(na, nb) < t * max(na, nb):
        return False
    most = int((1 - t) / (1 + t) * (na + nb) + 1e-9)
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    la, lb = len(a), len(b)
    while la > lb:
        la //= 2
        x = (x >> (8 * la)) ^ (x & ((1 << (8 * la)) - 1))
    while lb > la:
        lb //= 2
        y = (y >> (8 * lb)) ^ (y & ((1 << (8 * lb)) - 1))
    return (x ^ y).bit_count() <= most


def corpus(seed=1, base=25, copies=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(base):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        out.append(" ".join(text))
        for _ in range(copies):
            t = list(text)
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(t))
                t[k : k + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            out.append(" ".join(t))
    return out


def brute(texts, t):
    sets = []
    for x in texts:
        w = re.findall("[a-z0-9]+", (x or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])}


def frame(spark, texts):
    rows = [(f"d{i:04d}", "s" if i % 3 else None, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, source string, text string, a string, n int")


def test_all_pairs_against_brute_force(spark, monkeypatch):
    texts = corpus() + [None, "", "one two three four", "Same text as the other one here", "same TEXT as the other one: here", "İ K same text as the other one here"]
    want = {(f"d{i:04d}", f"d{j:04d}") for i, j in brute(texts, 0.7)}
    got = {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, texts)).collect()}
    assert got == want and len(want) > 30
    doubled = frame(spark, texts).union(frame(spark, texts))
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(doubled).collect()} == want
    monkeypatch.setattr(N, "HOT", 3)  # buckets are cut into parts
    assert {(r.id_a, r.id_b) for r in N.similar_pairs(frame(spark, texts)).collect()} == want


def test_groups(spark):
    texts = corpus(base=6)
    got = {r.id: r.group_id for r in N.groups(frame(spark, texts)).collect()}
    root = {}
    for i, j in sorted(brute(texts, 0.7)):
        a, b = root.get(i, i), root.get(j, j)
        for k in range(len(texts)):
            if root.get(k, k) == max(a, b):
                root[k] = min(a, b)
        root[i] = root[j] = min(a, b)
    assert got == {f"d{i:04d}": f"d{r:04d}" for i, r in root.items()}
    assert N.groups(frame(spark, ["x", None])).collect() == [] and N.similar_pairs(frame(spark, [])).collect() == []


def test_many_equal_texts_are_one_class(spark):
    texts = ["the very same text again and again"] * 300 + ["the very same text again and again and more"]
    rows = N.groups(frame(spark, texts)).collect()
    assert len(rows) == 300 or len(rows) == 301
    assert len({r.group_id for r in rows}) == 1


def test_tiles_find_what_plain_comparison_finds():
    sh = N.Shingler()
    sets = [sh(t) for t in corpus(3, 12, 3)]
    sk, n = [N.odd_sketch(s) for s in sets], np.array([len(s) for s in sets])
    want = {(i, j) for i in range(len(sk)) for j in range(i + 1, len(sk)) if within(sk[i], sk[j], int(n[i]), int(n[j]), 0.7)}
    got = {(min(i, j), max(i, j)) for a, b in N.tiled_pairs(sk, n, np.zeros(len(sk), int), 0.7) for i, j in zip(a.tolist(), b.tolist())}
    assert got == want
    parts = np.arange(len(sk)) % 2
    across = {(min(i, j), max(i, j)) for a, b in N.tiled_pairs(sk, n, parts, 0.7) for i, j in zip(a.tolist(), b.tolist())}
    assert across == {(i, j) for i, j in want if parts[i] != parts[j]}


def test_small_buckets_make_up_one_tile():
    sh = N.Shingler()
    sets = [sh(t) for t in corpus(5, 12, 3)] + [sh("only five words are here")]
    sk, n = [N.odd_sketch(s) for s in sets], np.array([len(s) for s in sets])
    starts, ends = np.array([0, 1, 3, 20, 20]), np.array([1, 3, 20, 20, 49])
    parts = np.zeros(len(sk), int)
    parts[25:40] = 1
    want = {
        (i, j)
        for s, e in zip(starts.tolist(), ends.tolist())
        for i in range(s, e)
        for j in range(i + 1, e)
        if within(sk[i], sk[j], int(n[i]), int(n[j]), 0.5) and (s != 20 or parts[i] != parts[j])
    }
    i, j = N.small_tile(sk, n, parts, starts, ends, 0.5)
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_bands_follow_the_threshold(spark):
    assert N.bands_for(0.7) == 24 and N.bands_for(0.4) > 100 and N.bands_for(1.0) == 1
    texts = corpus(9, 6, 3)
    got = {(int(r.id_a[1:]), int(r.id_b[1:])) for r in N.similar_pairs(frame(spark, texts), 0.4).collect()}
    assert {(min(p), max(p)) for p in got} == brute(texts, 0.4)


def vectors(n=900, d=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32) * rng.uniform(0.1, 9, (n, 1)).astype(np.float32)
    for i in range(0, n // 3):
        x[2 * n // 3 + i] = x[i] * 2 + rng.standard_normal(d).astype(np.float32) * 0.1 * np.linalg.norm(x[i]) / 2
    return x


def close(x, k, least):
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k] if s[i, j] >= least}


SCHEMA = "chunk_id long, kind string, dim int, vec array<float>, id string, rank int"


def test_pairs_recall(spark, monkeypatch):
    x = vectors()
    rows = [(i, "k", 16, v.tolist(), "x", 0) for i, v in enumerate(x)]
    bad = [(9000, "k", 16, None, "x", 0), (9001, "k", 16, [0.0] * 16, "x", 0), (9002, "k", 16, [float("nan")] * 16, "x", 0), (9003, "k", 99, x[0].tolist(), "x", 0), (9004, "k", None, x[0].tolist(), "x", 0), (9005, "other", 16, x[0].tolist(), "x", 0)]
    df = spark.createDataFrame(rows + rows[:5] + bad, SCHEMA)
    want = close(x, 5, 0.9)
    got = {(r.chunk_a, r.chunk_b) for r in K.close_pairs(df).collect()}
    assert got == want and len(want) > 200
    monkeypatch.setattr(K, "CELL", 128)  # several cells and trees at the top
    got = {(r.chunk_a, r.chunk_b) for r in K.close_pairs(df).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert K.close_pairs(df.limit(0)).collect() == []


def test_knn_recall_against_brute_force(spark):
    x = vectors()
    df = spark.createDataFrame([(i, None, 16, v.tolist(), "x", 0) for i, v in enumerate(x)], SCHEMA)
    rows = K.nearest(df, 10, queries=df.chunk_id % 20 == 0, trees=8, extra_leaves=8).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(0, len(x), 20) for j in np.argsort(-s[i])[:10]}
    assert len(want & {(r.query_id, r.found_id) for r in rows}) >= 0.9 * len(want)
    assert all(r.query_id % 20 == 0 and 1 <= r.rank <= 10 for r in rows)


def test_equal_vectors_dont_fill_one_leaf(spark):
    x = np.ones((2000, 8), np.float32)
    ids = np.arange(2000)
    q, m, cos = K.cell_edges(ids, x, np.ones(2000, bool), np.ones(2000, bool), 5, 0.9)
    assert np.bincount(q, minlength=2000).min() == 5 and np.allclose(cos, 1)


def test_crowded_cells_lose_no_neighbours(spark, monkeypatch):
    monkeypatch.setattr(K, "CELL", 64)
    x = vectors(600)
    spread = np.random.default_rng(3).uniform(0.5, 3, (300, 1)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    for crowd in (np.repeat(x[:1], 300, axis=0), x[:1] * spread):  # equal, and merely proportional
        rows = [(i, "k", 16, v.tolist(), "x", 0) for i, v in enumerate(np.r_[x, crowd])]
        got = K.nearest(spark.createDataFrame(rows, SCHEMA), 5, extra_cells=64, extra_leaves=48).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append((r.rank, r.found_id, r.cosine))
        assert all(len({f for _, f, _ in v}) == len(v) == 5 for v in found.values()) and len(found) == 900
        c = np.r_[u, crowd / np.linalg.norm(crowd, axis=1, keepdims=True)]
        t = c @ c.T
        np.fill_diagonal(t, -2)
        fifth = np.sort(t, axis=1)[:, -5]
        hit = sum(cos >= fifth[q] - 1e-5 for q, v in found.items() for _, _, cos in v)
        assert hit >= 0.995 * 4500
    # Of equal vectors every copy names the least ids.
    got = K.nearest(spark.createDataFrame([(i, "k", 16, v.tolist(), "x", 0) for i, v in enumerate(np.r_[x, np.repeat(x[:1], 300, axis=0)])], SCHEMA), 5).where("query_id > 650").collect()
    assert {(r.rank, r.found_id) for r in got} == {(1, 0), (2, 600), (3, 601), (4, 602), (5, 603)}


def test_parts_of_a_cell_meet(monkeypatch):
    monkeypatch.setattr(K, "CELL", 64)
    x = np.r_[vectors(300), np.repeat(vectors(1), 600, axis=0)]
    top = K.Top("k", 16, x, len(x), 5)
    assert top.parts.max() > 1
    ids, asks = np.arange(len(x)), np.arange(len(x)) % 2 == 0
    row, task, role = top.route(ids, x, 1, asks)
    assert task.min() >= 5 and task.max() < top.next and set(role.tolist()) == {1, 2, 3}
    member = {i: set() for i in ids.tolist()}
    query = {i: set() for i in ids.tolist()}
    for r, t, k in zip(row.tolist(), task.tolist(), role.tolist()):
        if k & 1:
            member[r].add(t)
        if k & 2:
            query[r].add(t)
    cells = K.search(top.trees, K._unit(x), 0)
    for q in ids[asks].tolist():
        assert all(query[q] & member[m] for m in np.flatnonzero((cells == cells[q]).any(axis=1)).tolist())
    assert not any(query[q] for q in ids[~asks].tolist())
