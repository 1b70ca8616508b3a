"""Cutting oversized texts into pieces at natural boundaries (lexical cohesion).

A text is seen as words with the gaps between them. Every gap after a sentence,
a line or a paragraph is a candidate cut. The words left and right of a
candidate form two blocks; the cosine of their term counts is the cohesion
there, and how far it lies below the peaks on both sides is the depth of its
valley. In each size window the deepest valley is cut; a window without any
candidate is cut at the last word gap. Pieces are slices of the text, so
without their overlaps they join to the text again, character by character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import spread

#: Words are maximal runs of characters other than these four.
WORD = re.compile(r"[^ \t\n\r]+")
WORD_JVM = "[^ \\t\\n\\r]+"
#: Words on each side of a gap whose terms are compared.
BLOCK_WORDS = 40
#: The least share of a size window that a piece fills, unless the text ends.
LEAST_FILL = 0.5

_ENDS = re.compile(r"""[.!?…。！？;:]["'”’»)\]]*$""")

PIECES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doc", T.StringType()),
        T.StructField("heading", T.StringType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
        T.StructField("overlap_words", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _rank(gap: str, word: str) -> int:
    """How natural a cut in this gap is: 3 paragraph, 2 line, 1 sentence, 0 none."""
    lines = gap.count("\n") + gap.count("\r") - gap.count("\r\n")
    return 3 if lines > 1 else 2 if lines else 1 if _ENDS.search(word) else 0


def _depths(terms: list[int], gaps: np.ndarray, block: int) -> np.ndarray:
    """Depth of the cohesion valley at each candidate gap (before word ``gap``).

    The counts of both blocks slide along the text, so the cost follows the
    number of words, not candidates times block size.
    """
    n, sims = len(terms), np.empty(len(gaps))
    left: Counter = Counter()
    right: Counter = Counter()
    dot, ll, rr, at = 0, 0, 0, 0

    def add(c: Counter, o: Counter, w: int, d: int) -> tuple[int, int]:
        """Change of the block's squared norm and of the dot product."""
        was = c[w]
        c[w] = was + d
        return (was + d) ** 2 - was**2, d * o[w]

    for w in terms[: min(block, n)]:
        s, p = add(right, left, w, 1)
        rr, dot = rr + s, dot + p
    for i, g in enumerate(gaps):
        while at < g:
            w = terms[at]
            s, p = add(right, left, w, -1)
            rr, dot = rr + s, dot + p
            s, p = add(left, right, w, 1)
            ll, dot = ll + s, dot + p
            if at + block < n:
                s, p = add(right, left, terms[at + block], 1)
                rr, dot = rr + s, dot + p
            if at >= block:
                s, p = add(left, right, terms[at - block], -1)
                ll, dot = ll + s, dot + p
            at += 1
        sims[i] = dot / (ll * rr) ** 0.5 if ll and rr else 0.0
    # The peak on a side is reached by climbing until cohesion falls again.
    up_left, up_right = sims.copy(), sims.copy()
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            up_left[i] = up_left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            up_right[i] = up_right[i + 1]
    return up_left + up_right - 2 * sims


def cut(text: str, limit: int, overlap: int, block: int = BLOCK_WORDS) -> list[tuple[int, int, int, str]]:
    """Pieces of ``text`` as (first new word, word after the last, overlap words, boundary kind).

    No piece has more than ``limit`` words, its overlap included; each piece
    after the first begins with the ``overlap`` last words before it (at most
    ``limit - 1``, so that every piece brings a new word). For that the first
    piece has at least ``overlap`` words. A text within the limit is one piece; a
    text without words none.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    overlap = max(0, min(overlap, limit - 1))
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(spans)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, 0, "end")]
    ranks = np.zeros(n + 1, np.int8)
    terms, seen = [], {}
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        terms.append(seen.setdefault(word.strip(".,;:!?\"'()[]").lower(), len(seen)))
        if i + 1 < n:
            ranks[i + 1] = _rank(text[b : spans[i + 1][0]], word)
    gaps = np.flatnonzero(ranks)
    depths = _depths(terms, gaps, block) if len(gaps) else np.zeros(0)
    # A stronger layout break adds to the depth: paragraphs before lines before sentences.
    scores = depths + 0.15 * (ranks[gaps].astype(float) - 1)
    out, at = [], 0
    while at < n:
        # The first piece holds at least one overlap, so all later ones begin with a full one.
        carried, least = (overlap, 1) if at else (0, max(1, overlap))
        room = limit - carried
        if n - at <= room:
            out.append((at, n, carried, "end"))
            break
        low = at + max(least, int(room * LEAST_FILL))
        a, b = np.searchsorted(gaps, low), np.searchsorted(gaps, at + room, side="right")
        if a == b:  # none in the upper part of the window: take any later than its start
            a = np.searchsorted(gaps, at + least)
        if a < b:
            best = a + int(np.argmax(scores[a:b]))
            end, kind = int(gaps[best]), ("", "sentence", "line", "paragraph")[ranks[gaps[best]]]
        else:
            end, kind = at + room, "word"
        out.append((at, end, carried, kind))
        at = end
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """Pieces as (words, overlap words, first character, character after the last, boundary).

    White space before the first word and after each piece stays with the piece
    before it, so slices without overlaps join to the whole text.
    """
    spans = [m.span() for m in WORD.finditer(text)]
    out = []
    for first, end, carried, kind in cut(text, limit, overlap):
        start = spans[first - carried][0] if first else 0
        stop = spans[end][0] if end < len(spans) else len(text)
        out.append((end - first + carried, carried, start, stop, kind))
    return out


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of every chunk whose text has more than ``limit`` words, whatever ``n_tokens`` says.

    ``chunks`` needs id, doc, heading and text; other columns are ignored. Rows
    repeated under one id count once; null and empty texts have no words and give
    no piece. Each piece keeps id, doc and heading of its chunk and its order;
    ``start_char`` and ``end_char`` are 0-based code points. The word count that
    picks the chunks runs in the JVM, so short ones never reach Python.
    """
    long = (
        spread(chunks.select("id", "doc", "heading", "text"))
        .where(F.regexp_count("text", F.lit(WORD_JVM)) > limit)
        .dropDuplicates(["id"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in PIECES]
            for i, doc, heading, text in zip(*(batch.column(k).to_pylist() for k in ("id", "doc", "heading", "text"))):
                for k, (n, carried, a, b, kind) in enumerate(pieces(text, limit, overlap)):
                    for col, v in zip(cols, (i, doc, heading, k, n, carried, a, b, kind, text[a:b])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, _ARROW.types)], schema=_ARROW
            )

    return long.mapInArrow(run, PIECES)


_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("doc", pa.string()),
        ("heading", pa.string()),
        ("piece", pa.int32()),
        ("n_words", pa.int32()),
        ("overlap_words", pa.int32()),
        ("start_char", pa.int32()),
        ("end_char", pa.int32()),
        ("boundary", pa.string()),
        ("text", pa.string()),
    ]
)
