"""Evaluation texts leaking into training text: q-gram lemma filtering.

Texts are reduced to their words (lower-case runs of a-z and 0-9) joined by one
blank. A passage of ``w`` characters that differs from its copy by at most ``e``
edits shares at least ``w - q + 1 - q * e`` q-grams with it, and all of these
lie within ``e`` diagonals of each other (q-gram lemma). So for each document the
q-grams it shares with an item are counted in overlapping bands of diagonals;
bands below the bound are dropped for many documents at once, and in those that
are left every passage of ``min_words`` words of the item that reaches its own
bound is verified by an alignment within its band.

The held-out items form an index that every task gets, in blocks of a checked
size if there are many. Documents stay where they are, nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import bounded, spread

#: Characters of the items of one block on average, and rows of one at most; a block's index is shipped to every task (about 20 bytes a character).
BLOCK_CHARS, BLOCK_ITEMS = 2_000_000, 2_000_000
#: Characters of documents whose q-grams are looked up together; a longer text is looked up alone.
AT_ONCE = 1 << 20
Q = 8
MIN_WORDS = 12
#: Upper-case ASCII letters are gone before this; all that is no word character becomes a blank.
_PLAIN = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))

LEAKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("aligned_chars", T.IntegerType()),
    ]
)


def flatten(text: str | None) -> bytes:
    """The words of a text joined by one blank."""
    return b" ".join(text.lower().encode("ascii", "replace").translate(_PLAIN).split()) if text else b""


def words(text: str | None) -> list[str]:
    return flatten(text).decode().split()


def _grams(flat: bytes, q: int) -> np.ndarray:
    """Codes of all q-grams of a byte string, q at most 8."""
    n = len(flat) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = np.frombuffer(flat + b"\n" * 8, np.uint8)
    code = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[:n]).view(np.uint64)[:, 0]
    return code if q == 8 else code & np.uint64((1 << 8 * q) - 1)


class Index:
    """Held-out items by q-gram, with the passages of ``min_words`` consecutive words of each."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = MIN_WORDS, edits: int = 0, q: int = Q):
        if not 1 <= q <= 8:
            raise ValueError("q must be from 1 to 8")
        self.q, self.edits, self.min_words = q, edits, min_words
        self.ids, self.texts, self.passages, least = [], [], [], []
        for i, text in items:
            flat = flatten(text)
            w = flat.split()
            if len(w) < min_words:
                continue
            n = np.cumsum([0] + [len(x) + 1 for x in w])
            #: First and last character (exclusive) of every passage.
            begin, end = n[: len(w) - min_words + 1], n[min_words:] - 1
            self.ids.append(i)
            self.texts.append(flat)
            self.passages.append((begin, end))
            least.append(int((end - begin).min()))
        self.least = np.array(least, np.int64)
        #: Shared q-grams that a region must reach, by the lemma; at least one.
        self.need = np.maximum(1, self.least - q + 1 - q * edits)
        if edits and len(self.least) and (self.least - q + 1 - q * edits).min() < 1:
            raise ValueError("the edit budget leaves no q-gram that a passage must share; take a smaller q or budget")
        sizes = np.array([len(t) for t in self.texts], np.int64)
        starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
        code = _grams(b"\n".join(self.texts), q)
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)[: len(code)]
        at = np.arange(len(code)) - starts[item] if len(code) else np.zeros(0, np.int64)
        inside = at <= (sizes - q)[item] if len(code) else np.zeros(0, bool)
        code, item, at = code[inside], item[inside], at[inside].astype(np.int32)
        order = np.argsort(code, kind="stable")
        code, self.item, self.at = code[order], item[order], at[order]
        self.code, first = np.unique(code, return_index=True)
        self.first = np.append(first, len(code)).astype(np.int64)
        self.seen = np.zeros(1 << 22, bool)  # 4 MB: most q-grams of the corpus end here
        self.seen[self._slot(self.code)] = True

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).view(np.int64)

    def _dense(self, pos: np.ndarray) -> np.ndarray:
        """Places (rising) that lie with enough others in a stretch as long as the shortest passage.

        Every part of a passage that is as long as the shortest one keeps the bound
        of the shortest one, so no q-gram of a passage is lost.
        """
        need = int(self.need.min())
        if need < 2 or len(pos) < need:
            return pos if len(pos) >= need else pos[:0]
        first = np.flatnonzero(pos[need - 1 :] - pos[: len(pos) - need + 1] <= int(self.least.min()) - self.q + self.edits)
        marks = np.bincount(first, minlength=len(pos) + 1) - np.bincount(first + need, minlength=len(pos) + 1)[: len(pos) + 1]
        return pos[np.cumsum(marks)[: len(pos)] > 0]

    def shared(self, flats: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The q-grams that texts share with items: (text, item, diagonal, place in the text), in order of text and place.

        Only texts and items are kept that have, in some band of diagonals, as
        many shared q-grams as the lemma asks for.
        """
        none = (np.zeros(0, np.int64),) * 4
        sizes = np.array([len(t) for t in flats], np.int64)
        starts = np.cumsum(np.r_[0, sizes + 1])[:-1]
        code = _grams(b"\n".join(flats), self.q)
        if not len(self.code) or not len(code):
            return none
        pos = self._dense(np.flatnonzero(self.seen[self._slot(code)]))
        code = code[pos]
        k = np.searchsorted(self.code, code)
        k[k == len(self.code)] = 0
        good = self.code[k] == code
        pos, k = pos[good], k[good]
        keep = np.isin(pos, self._dense(pos), assume_unique=True)
        pos, k = pos[keep], k[keep]
        if not len(pos):
            return none
        doc = np.searchsorted(starts, pos, side="right") - 1
        n = self.first[k + 1] - self.first[k]
        entry = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        doc, pos = np.repeat(doc, n), np.repeat(pos - starts[doc], n)
        item = self.item[entry].astype(np.int64)
        diagonal = pos - self.at[entry]
        # Bands of 2 (e + 1) diagonals that overlap by half: any e + 1 neighbours lie in one.
        full = np.zeros(len(pos), bool)
        pair = (doc * len(self.ids) + item).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        need = self.need[item]
        for shift in (0, self.edits + 1):
            band = ((diagonal + shift) // (2 * self.edits + 2)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            slot = ((pair + band) >> np.uint64(44)).view(np.int64)  # bands that meet in a slot only keep each other
            full |= np.bincount(slot, minlength=1 << 20)[slot] >= need
        return doc[full], item[full], diagonal[full], pos[full]


def banded_edits(a: str, b: str, most: int, loose: bool = False) -> int:
    """Edit distance of two texts within ``most`` diagonals, or ``most + 1`` if it is larger.

    With ``loose`` the end of ``b`` is free: the distance to its best beginning.
    """
    if not loose and abs(len(a) - len(b)) > most or len(a) - len(b) > most:
        return most + 1
    if a == b or loose and b.startswith(a):
        return 0
    inf = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, inf) + 1
            if j:
                best = min(best, new.get(j - 1, inf) + 1, row.get(j - 1, inf) + (a[i - 1] != b[j - 1]))
            else:
                best = min(best, i)
            new[j] = min(best, inf)
        row = new
        if min(row.values()) >= inf:
            return inf
    return min(inf, min(row.values()) if loose else row.get(len(b), inf))


def passage_edits(a: bytes, text: bytes) -> int:
    """Edits between ``a`` and the stretch of ``text`` that is most similar to it (bit-parallel; begin and end are free)."""
    if a in text:
        return 0
    m = len(a)
    places: dict[int, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = places.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | mask & ~(h | up), up & h
        if more & top:
            score += 1
        elif less & top:
            score -= 1
            best = min(best, score)
        more, less = more << 1 & mask, less << 1 & mask
        up, down = less | mask & ~(v | more), more & v
    return best


def whole_words(flat: bytes, other: bytes, first: int, end: int, diagonal: int) -> tuple[int, int, int]:
    """Of an equal stretch that can't be extended, the words that are whole in both texts: (words, begin, end)."""
    blank = 32
    if first and flat[first - 1] != blank or first - diagonal and other[first - diagonal - 1] != blank:
        first = flat.find(b" ", first, end) + 1
        if not first:
            return 0, 0, 0
    if end < len(flat) and flat[end] != blank or end - diagonal < len(other) and other[end - diagonal] != blank:
        end = flat.rfind(b" ", first, end)
    return (flat.count(b" ", first, end) + 1, first, end) if end > first else (0, 0, 0)


def stretches(item: np.ndarray, diagonal: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring q-grams on one diagonal of one item: (item, diagonal, first, number)."""
    order = np.lexsort((pos, diagonal, item))
    i, d, p = item[order], diagonal[order], pos[order]
    new = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (np.diff(p) != 1)])
    return i[new], d[new], p[new], np.diff(np.r_[new, len(p)])


def _passages(flat: bytes, index: Index, it: int, diagonal: np.ndarray, pos: np.ndarray) -> tuple[int, int, int] | None:
    """The best passage of one item within the budget: (edits, minus its characters, its place in the text), or None.

    Passages that hold too few of the band's q-grams are passed over. Neighbouring
    ones that are within the budget together are one; else each is aligned on its
    own. Fewest edits come first, then the longest.
    """
    most, q, width = index.edits, index.q, index.edits + 1
    begin, stop = index.passages[it]
    item, best = index.texts[it], None
    for shift in (0, width):
        band = (diagonal + shift) // (2 * width)
        order = np.argsort(band, kind="stable")
        b, d, at = band[order], diagonal[order], (pos - diagonal)[order]
        new = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        end = np.r_[new[1:], len(b)]
        full = end - new >= index.need[it]
        for a, z in zip(new[full].tolist(), end[full].tolist()):
            shared = np.unique(at[a:z])
            lost = stop - begin - q + 1 - (np.searchsorted(shared, stop - q + 1) - np.searchsorted(shared, begin))
            fit = np.flatnonzero(lost <= q * most)
            if not len(fit):
                continue
            low, high = int(d[a:z].min()) - most, int(d[a:z].max()) + most

            def edits(first: int, last: int) -> int:
                s, e = int(begin[first]), int(stop[last])
                return passage_edits(item[s:e], flat[max(0, s + low) : max(0, e + high)])

            cut = np.flatnonzero(np.diff(fit) > 1)
            for x, y in zip(fit[np.r_[0, cut + 1]].tolist(), fit[np.r_[cut, len(fit) - 1]].tolist()):
                tried = [(edits(x, y), x, y)]
                if tried[0][0] > most and y > x:
                    least = most + 1
                    for k in (x + np.argsort(lost[x : y + 1], kind="stable")).tolist():
                        if -(-int(lost[k]) // q) >= least:  # no fewer edits can destroy so many q-grams
                            break
                        tried.append((edits(k, k), k, k))
                        least = min(least, tried[-1][0])
                for n, f, g in tried:
                    one = (n, int(begin[f] - stop[g]), max(0, int(begin[f]) + low + most))
                    if n <= most and (best is None or one < best):
                        best = one
    return best


def _equal_run(flat: bytes, index: Index, it: int, diagonal: np.ndarray, pos: np.ndarray) -> tuple[int, int, int]:
    """The longest run of whole words equal in text and item: (words, begin, end); runs of q-grams on one diagonal show it."""
    best = (0, 0, 0)
    _, ds, ps, ns = stretches(np.zeros(len(pos), np.int64), diagonal, pos)
    for k in np.argsort(-ns, kind="stable").tolist():
        if (ns[k] + index.q) // 2 <= best[0]:
            break
        got = whole_words(flat, index.texts[it], int(ps[k]), int(ps[k] + ns[k]) + index.q - 1, int(ds[k]))
        if got[0] > best[0]:
            best = got
    return best


def leaks_in(texts: list[str | None], index: Index, exact: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """Leaks of many documents: (place in ``texts``, item, longest run of whole equal words, first word, edits, characters).

    Every pair comes through the bands and an alignment within the budget. With
    ``exact`` it must have ``min_words`` equal words in a row besides; the place
    is then that run's, else that of the run or, without one, of the passage.
    """
    out = []
    flats = [flatten(t) for t in texts]
    sizes = np.cumsum([len(f) + 1 for f in flats])
    first = 0
    while first < len(flats):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + AT_ONCE, side="right")))
        group = flats[first:last]
        doc, item, diagonal, pos = index.shared(group)
        order = np.lexsort((pos, diagonal, item, doc))
        doc, item, diagonal, pos = doc[order], item[order], diagonal[order], pos[order]
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.zeros(0, np.int64)
        for a, z in zip(new.tolist(), np.r_[new[1:], len(doc)].tolist()):
            if z - a < index.need[item[a]]:
                continue
            flat, it = group[doc[a]], int(item[a])
            got = _passages(flat, index, it, diagonal[a:z], pos[a:z])
            if got is None:
                continue
            run, s, e = _equal_run(flat, index, it, diagonal[a:z], pos[a:z])
            if exact and run < index.min_words:
                continue
            place = s if run else got[2]
            out.append((first + int(doc[a]), index.ids[it], run, flat.count(b" ", 0, place), got[0], e - s if exact else -got[1]))
        first = last
    return out


def leaks_of(text: str | None, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Items with ``min_words`` equal words in a row in one document: (item, whole words, first word, edits, characters)."""
    return [x[1:] for x in leaks_in([text], index, exact=True)]


def near_leaks_of(text: str | None, index: Index) -> list[tuple[int, int, int, int, int]]:
    """Items with a passage within the edit budget in one document: (item, longest equal run, first word, edits, characters)."""
    return [x[1:] for x in leaks_in([text], index)]


def find_leaks(
    documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, edits: int = 0, q: int = Q, exact: bool = True
) -> DataFrame:
    """One row per document and item that leaked into it.

    With ``exact`` a pair counts if at least ``min_words`` consecutive words are
    in common; else if a passage of ``min_words`` words of the item is within
    ``edits`` edits of some stretch of the document. Needs doc_id and text of ``documents``, item_id and text of
    ``items``; other columns are ignored. Null and empty texts, and those with
    fewer than ``min_words`` words, are in no pair. Rows repeated under one id
    count once. Whole texts are searched. Items beyond one block are searched for
    block by block, each against all documents.
    """
    held = items.select("item_id", "text").where("text is not null")
    size = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    found = None
    for k in range(blocks):
        mine: dict = {}
        for r in bounded(held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), BLOCK_ITEMS, "items of one block"):
            mine[r.item_id] = min(mine.get(r.item_id, r.text), r.text)
        shared = documents.sparkSession.sparkContext.broadcast(Index(sorted(mine.items()), min_words, 0 if exact else edits, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[x[0]], *x[1:]) for x in leaks_in(batch.column("text").to_pylist(), shared.value, exact)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names=LEAKS.names)

        one = spread(documents.select("doc_id", "text")).mapInArrow(run, LEAKS)
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates(["doc_id", "item_id"])
