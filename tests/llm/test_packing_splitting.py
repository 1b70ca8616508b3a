import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing as P
from millrace.llm import splitting as S

SCHEMA = "id long, text string, n_tokens int, capacity int, block string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(1, 40))
def test_every_unit_is_in_one_window(sizes, capacity):
    windows, fills = P.pack(np.array(sizes, int), capacity, [5, 12])
    seen = {}
    for w, fill in zip(windows, fills):
        assert sum(n for _, _, n in w) == fill <= capacity
        for item, first, n in w:
            seen.setdefault(item, []).append((first, n))
    for item, size in enumerate(sizes):
        parts = sorted(seen.get(item, []))
        assert sum(n for _, n in parts) == max(size, 0)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert len(parts) == -(-size // capacity)  # split only above the capacity


def test_fill_is_close_to_full():
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 300) for _ in range(4000)])
    for capacity in (512, 2048, 8192):
        _, fills = P.pack(sizes, capacity, [512, 2048, 8192])
        assert len(fills) <= -(-int(sizes.sum()) // capacity) + 1


def test_steps_are_balanced():
    fills = [random.Random(2).randint(1, 100) for _ in range(96)]
    step = P.steps(fills, 8)
    totals = [sum(f for f, s in zip(fills, step) if s == k) for k in range(12)]
    assert max(totals) - min(totals) <= 100 and all(step.count(k) == 8 for k in range(12))
    assert P.steps([], 8) == []


def test_pack_chunks(spark):
    rows = [(1, "a b c", -5, 9, "x"), (1, "a b c", -5, 9, "x"), (2, None, 4, 9, "x"), (3, "", 1, 9, "x"), (4, "w " * 25, None, 9, "x"), (5, "\t\n ", 0, 9, "x"), (6, "d e", 2, 9, "x")]
    got = P.pack_chunks(spark.createDataFrame(rows, SCHEMA), [("small", 10), ("large", 100)])
    by = {}
    for r in got.collect():
        by.setdefault((r.limit_name, r.chunk_id), []).append(r.n_words)
    assert {k: sorted(v) for k, v in by.items()} == {
        ("small", 1): [3], ("small", 4): [5, 10, 10], ("small", 6): [2], ("large", 1): [3], ("large", 4): [25], ("large", 6): [2],
    }
    fill = {r.limit_name: (r.n_windows, r.n_words, r.fullest) for r in P.fill_report(got).collect()}
    assert fill == {"small": (3, 30, 10), "large": (1, 30, 30)}
    assert P.pack_chunks(spark.createDataFrame([], SCHEMA), [("small", 10)]).collect() == []
    assert P.pack_chunks(spark.createDataFrame(rows, SCHEMA), []).collect() == []


TEXTS = st.text(alphabet=st.sampled_from("ab .!?\n\t\r é"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 12), st.integers(0, 14))
def test_pieces_join_to_the_text(text, limit, overlap):
    got = S.pieces(text, limit, overlap)
    words = S.WORD.findall(text)
    if not words:
        assert got == []
        return
    joined, at = "", 0
    for n, carried, a, b, _ in got:
        assert len(S.WORD.findall(text[a:b])) == n <= limit
        assert carried == (min(overlap, limit - 1) if at else 0)
        new = text[a:b] if not at else text[at:b]
        joined += new
        assert a <= at
        at = b
    assert joined == text


def test_cuts_at_the_topic_change():
    a, b = "The boat sailed over the cold sea to the harbour. ", "The index stores vectors and ranks chunks by score. "
    got = S.cut(a * 12 + b * 12, 200, 10)
    assert len(got) == 2 and got[0][1] == 12 * 10 and got[0][3] == "sentence"


def test_split_oversized(spark):
    schema = "id long, doc string, heading string, text string, piece int, start_char int"
    rows = [(1, "d", "h", "w " * 50, 1, 2), (1, "d", "h", "w " * 50, 1, 2), (2, None, None, "x " * 30, 1, 2), (3, "d", "h", "y " * 10, 1, 2), (4, "d", "h", None, 1, 2), (5, "d", "h", "", 1, 2)]
    got = S.split_oversized(spark.createDataFrame(rows, schema), 10, 3).collect()
    assert {r.id for r in got} == {1, 2} and all(r.n_words <= 10 for r in got)
    assert [r.piece for r in sorted((r for r in got if r.id == 1), key=lambda r: r.piece)] == list(range(len([r for r in got if r.id == 1])))
    assert {(r.doc, r.heading) for r in got if r.id == 2} == {(None, None)}
    assert S.split_oversized(spark.createDataFrame([], schema), 10, 3).collect() == []
    with pytest.raises(ValueError, match="limit"):
        S.cut("a b", 0, 0)


def test_a_very_long_text_is_cut_in_linear_time():
    text = "Some words stand here and there. " * 40_000
    assert sum(n - c for n, c, *_ in S.pieces(text, 220, 30)) == 240_000


def test_a_short_first_line_loses_no_text():
    """A first line shorter than the overlap, then words without a sentence end, at the limits of production."""
    text = "Two words\n" + "word " * 400
    got = S.pieces(text, 220, 30)
    assert [c for _, c, *_ in got] == [0, 30, 30][: len(got)]
    for n, _, a, b, _ in got:
        assert len(S.WORD.findall(text[a:b])) == n <= 220
    assert text[got[0][2] : got[0][3]] + "".join(text[p[3] : q[3]] for p, q in zip(got, got[1:])) == text
