"""Text decoded with the wrong character encoding: finding and restoring it.

Three steps. (1) Over all documents adjacent character pairs are counted; from
the counts comes each pair's share of the corpus's mutual information.
(2) In a text, pairs that carry less than the mean share score above zero;
maximum-scoring segments of these scores are the improbable runs. (3) Only
inside those runs inverse mappings are tried: bytes of the wrong charset are
decoded by the right one, and a reading is taken where it is strictly valid and,
where validity alone proves nothing, where its pairs are clearly more common in
the corpus. Where a run of a text has proved garbled, its other runs are isolated
again with more generosity. Lost characters and character references are judged
inside runs like all else.

The pair table has a fixed number of slots, so what is shipped to every task has
a fixed size whatever the corpus holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.tables import spread

#: Slots of the table of pairs and of single characters: 2 x 4 MB and 0.5 MB, whatever the corpus.
PAIR_SLOTS, CHAR_SLOTS = 1 << 20, 1 << 16
#: A pair is improbable if it carries less than this many times the mean share of the mutual information; in a text that has proved garbled, the second.
GENEROSITY, AFTER_A_FIND = 1.0, 20.0
#: How much more common (in nats per pair) a reading must be where its validity proves nothing.
MARGIN = 1.0
PASSES = 3
LOST = "�"

#: Charsets in which UTF-8 bytes are commonly misread (fixed values, names of Python's codecs).
_WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "koi8-r", "cp866", "cp1254", "iso8859-15")
_WRONG_WIDE = ("gb18030", "big5", "shift_jis", "euc_kr")
#: Multi-byte charsets whose bytes are misread one by one.
_REALLY_WIDE = ("shift_jis", "euc_jp", "gbk", "big5", "euc_kr")
#: Single-byte charsets: what a text is read as, and what it really is in.
_READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "cp1250", "mac_roman", "cp437", "iso8859-2", "iso8859-5")
_REALLY = ("cp1251", "koi8-r", "iso8859-2", "cp1250", "cp866", "cp1252", "iso8859-5", "mac_roman", "cp850")

RESTORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_runs", T.IntegerType()),
        T.StructField("n_lost", T.IntegerType()),
        T.StructField("charsets", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def _char_slot(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


class Pairs:
    """Counts of adjacent characters; pairs of two ASCII characters are left out, they are never garbled alone."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        n = max(1.0, float(pairs.sum()))
        self.log = np.log(pairs + 0.1).astype(np.float32)
        self.n, self.chars = n, chars
        self.pairs = pairs
        self.seen: dict[str, float] = {}
        self.distinct = max(1, int((pairs > 0).sum()))
        #: Mean log count over all pairs as they occur: how common ordinary text is.
        self.usual = float((pairs * self.log).sum() / n)

    @staticmethod
    def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        pairs, chars = np.zeros(PAIR_SLOTS, np.int64), np.zeros(CHAR_SLOTS, np.int64)
        for t in texts:
            Pairs.add(t, pairs, chars)
        return pairs, chars

    @staticmethod
    def add(text: str | None, pairs: np.ndarray, chars: np.ndarray) -> None:
        if not text or text.isascii():
            return
        p = _points(" " + text + " ")
        a, b = p[:-1], p[1:]
        keep = (a > 127) | (b > 127)
        a, b = a[keep], b[keep]
        np.add.at(pairs, _pair_slot(a, b), 1)
        np.add.at(chars, _char_slot(np.concatenate((a, b))), 1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def scores(self, p: np.ndarray, generosity: float = GENEROSITY) -> np.ndarray:
        """Score of each adjacent pair: above zero if it carries little of the mutual information."""
        out = np.full(len(p) - 1, -0.4)
        high = p > 127
        at = np.flatnonzero(high[:-1] | high[1:])
        a, b = p[at], p[at + 1]
        n = self.pairs[_pair_slot(a, b)].astype(np.float64)
        one = self.chars[_char_slot(a)].astype(np.float64) * self.chars[_char_slot(b)] + 1
        # The share of one pair, p(a, b) * log(p(a, b) / (p(a) p(b))), against the mean over pairs.
        share = n * np.maximum(0.1, np.log((n + 0.1) * 4 * self.n / one))
        mean = self.n * 3.0 / self.distinct
        out[at] = np.clip(np.log(generosity * mean / (share + 1e-3)), -4, 4)
        odd = (p == 0xFFFD) | (p > 127) & (p < 160)
        out[odd[:-1] | odd[1:]] = 4
        return out

    def known(self, text: str) -> bool:
        """Whether every character occurs in the corpus."""
        p = _points(text)
        return bool((self.chars[_char_slot(p)] > 0)[p > 127].all())

    def common(self, text: str) -> float:
        """Mean log count of the pairs of a text that hold a non-ASCII character; 0 if there are none."""
        if len(text) > 24:
            return self._common(text)
        if (got := self.seen.get(text)) is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            got = self.seen[text] = self._common(text)
        return got

    def _common(self, text: str) -> float:
        p = _points(text)
        a, b = p[:-1], p[1:]
        keep = (a > 127) | (b > 127)
        return float(self.log[_pair_slot(a[keep], b[keep])].mean()) if keep.any() else 0.0


def runs(scores: np.ndarray) -> list[tuple[int, int]]:
    """Maximum-scoring segments: disjoint, as (first pair, after the last pair), each with a score above zero.

    All maximal ones are given: a segment ends where what follows costs more
    than it has won so far.
    """
    out, total, best, start, end = [], 0.0, 0.0, 0, 0
    at = np.flatnonzero(scores > 0)
    own, until = scores[at].tolist(), np.r_[0.0, np.cumsum(scores)]
    # From the end of the last positive pair to the next one everything scores below zero.
    between = np.r_[0.0, until[at[1:]] - until[at[:-1] + 1]].tolist() if len(at) else []
    for i, won, lost in zip(at.tolist(), own, between):
        if total > 0:
            total += lost
        if total <= 0:
            if best > 0:
                out.append((start, end))
            total, best, start = 0.0, 0.0, i
        total += won
        if total > best:
            best, end = total, i + 1
    if best > 0:
        out.append((start, end))
    return out


@lru_cache(maxsize=64)
def _table(codec: str) -> tuple[dict[str, int], list[str]]:
    """Characters by byte in a charset; bytes it leaves out stand for the control characters they came from."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


@lru_cache(maxsize=64)
def _sequences(codec: str) -> re.Pattern:
    """Characters that are a UTF-8 sequence of two to four bytes when read in ``codec``."""
    _, chars = _table(codec)

    def some(a: int, b: int) -> str:
        return "[" + "".join(re.escape(c) for c in chars[a : b + 1]) + "]"

    tail = some(0x80, 0xBF)
    return re.compile(f"(?:{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}})+")


def _utf8(text: str, codec: str) -> str | None:
    try:
        return bytes(_table(codec)[0][c] for c in text).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def _printable(text: str, controls: bool = False) -> bool:
    """Whether a text can be shown; with ``controls`` the upper control characters pass: bytes that a charset leaves out."""
    return text.isprintable() or all(c.isprintable() or controls and "\x80" <= c <= "\x9f" or c in "\n\t\r ­​‎‏   ﻿" for c in text)


_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uff00-\uffef\ue000-\uf8ff]")
_DENSE = re.compile("[^\x00-\x7f]{2,}")


def _codecs(text: str) -> tuple[str, ...]:
    """Charsets in which some stretch of the text could be misread UTF-8; the cheap test before all others."""
    dense = " ".join(_DENSE.findall(text))
    return tuple(c for c in _WRONG_FOR_UTF8 if dense and _sequences(c).search(dense))


def _as_utf8(part: str, stats: Pairs, codecs: tuple[str, ...], before: str = "", after: str = "") -> tuple[str, str] | None:
    """The best reading of a part as misread UTF-8: (charset, text), or None."""
    best, at = None, 0.0
    readings = []
    for codec in codecs:
        out, last, changed = [], 0, 0
        for m in _sequences(codec).finditer(part):
            old = m.group()
            new = _utf8(old, codec)
            if new is None or not _printable(new, controls=True):
                continue
            letters = old.isalpha()
            if len(old) < 3 or letters:
                # Two characters, or nothing but letters, may be valid by chance; then the corpus has a say.
                a = part[max(0, m.start() - 1) : m.start()] or before
                b = part[m.end() : m.end() + 1] or after
                gain = stats.common(a + new + b) - stats.common(a + old + b)
                if gain < (MARGIN if letters else -4.0) or not stats.known(new):
                    continue
            out += [part[last : m.start()], new]
            last = m.end()
            changed += len(old)
        if changed:
            readings.append((codec, "".join([*out, part[last:]]), changed))
    if _WIDE.search(part):
        for codec in _WRONG_WIDE:
            out, last, changed = [], 0, 0
            for m in re.finditer(r"[^\x00-\x7f]+", part):
                try:
                    new = m.group().encode(codec).decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
                a = part[max(0, m.start() - 1) : m.start()] or before
                b = part[m.end() : m.end() + 1] or after
                if not _printable(new) or stats.common(a + new + b) < stats.common(a + m.group() + b) + MARGIN:
                    continue
                out += [part[last : m.start()], new]
                last, changed = m.end(), changed + len(m.group())
            if changed:
                readings.append((codec, "".join([*out, part[last:]]), changed))
    if len(readings) == 1:
        return readings[0][:2]
    for codec, text, changed in readings:
        score = stats.common(before + text + after) + 0.05 * changed
        if best is None or score > at:
            best, at = (codec, text), score
    return best


@lru_cache(maxsize=256)
def _recode(wrong: str, right: str) -> dict[int, str]:
    """Characters of the wrong charset to those that the same bytes mean in the right one."""
    return {ord(c): _table(right)[1][b] for c, b in _table(wrong)[0].items() if b > 127}


@lru_cache(maxsize=64)
def _alphabet(codec: str) -> frozenset[str]:
    return frozenset(_table(codec)[0])


def _as_single(part: str, stats: Pairs) -> tuple[str, str] | None:
    """The best reading of a sentence in another single-byte charset, if it is clearly more common."""
    high = [c for c in part if c > "\x7f"]
    n = len(high)
    if n < 2:
        return None
    was = stats.common(part)
    best, at = None, was + MARGIN + 4.0 / n
    if at > stats.usual + 1.0:  # no reading could be so much more common
        return None
    letters = frozenset(high)
    for wrong in _READ_AS:
        if not letters <= _alphabet(wrong):
            continue
        for right in _REALLY:
            if wrong == right:
                continue
            new = part.translate(_recode(wrong, right))
            if new == part or not _printable(new):
                continue
            score = stats.common(new)
            if score > at:
                best, at = (f"{right}>{wrong}", new), score
    return best


_BYTES = re.compile("(?:[^\x00-\x7f][\x20-\x7e]?){3,}")


def _as_wide(part: str, stats: Pairs) -> tuple[str, str] | None:
    """The best reading of a sentence as multi-byte text whose bytes were read one by one, if it is clearly more common."""
    if not _BYTES.search(part):
        return None
    best, at = None, stats.common(part) + MARGIN
    for wrong in ("cp1252", "latin-1"):
        if any(c > "\x7f" and c not in _alphabet(wrong) for c in part):
            continue
        raw = bytes(_table(wrong)[0][c] for c in part)
        for right in _REALLY_WIDE:
            try:
                new = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if _printable(new) and stats.known(new) and stats.common(new) > at:
                best, at = (f"{right}>{wrong}", new), stats.common(new)
    return best


_ENTITIES = re.compile(r"(?:&(?:#\d{2,6}|#x[0-9A-Fa-f]{2,5}|[A-Za-z][A-Za-z0-9]{1,30});){2,}")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|\n+")
_GROUP = re.compile(r"[^ \t]+(?:[ \t]+[^ \t]*[^\x00-\x7f][^ \t]*)*")


_ODD = re.compile("[\x80-\x84\x86-\x9f]")


def _marks(text: str, stats: Pairs, generosity: float) -> np.ndarray | None:
    """Whether each character lies in an improbable run; None if there is no run."""
    found = runs(stats.scores(_points(" " + text + " "), generosity))
    if not found:
        return None
    marks = np.zeros(len(text) + 2, bool)
    for a, b in found:
        marks[a : b + 1] = True
    return marks[1:-1]


def _references(text: str, stats: Pairs, generosity: float) -> tuple[str, int, list[str]]:
    """Character references whose characters are a garbled run, restored; others stay as they are written."""
    spans, shown, at, used = [], [], 0, []
    n = 0
    for m in _ENTITIES.finditer(text):
        plain = html.unescape(m.group())
        shown += [text[at : m.start()], plain]
        n += m.start() - at
        spans.append((m, plain, n))
        n += len(plain)
        at = m.end()
    if not spans:
        return text, 0, used
    marks = _marks("".join([*shown, text[at:]]), stats, generosity)
    if marks is None:
        return text, 0, used
    out, at, garbled = [], 0, 0
    for m, plain, n in spans:
        done = plain
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        for _ in range(PASSES if marks[n : n + len(plain)].any() else 0):
            got = _as_utf8(done, stats, tuple(c for c in ("cp1252", "latin-1") if _sequences(c).search(done)), before, after)
            if got is None:
                break
            used.append(got[0])
            done = got[1]
        if done != plain:
            garbled += 1
            out += [text[at : m.start()], done]
            at = m.end()
    return "".join([*out, text[at:]]), garbled, used


def restore(text: str | None, stats: Pairs) -> tuple[str | None, int, int, list[str]]:
    """(restored text, garbled runs, lost characters, charsets). Clean, null and empty texts come back as they are.

    Runs with lost characters count as garbled; what is left of them is restored.
    """
    if not text:
        return text, 0, 0, []
    used: list[str] = []
    garbled = 0
    for generosity in (GENEROSITY, AFTER_A_FIND):
        if "&" in text and (garbled or generosity == GENEROSITY):
            text, n, more = _references(text, stats, generosity)
            garbled, used = garbled + n, used + more
    if text.isascii():
        return text, garbled, 0, used
    broken = False
    for turn in range(PASSES + 1):
        marks = _marks(text, stats, AFTER_A_FIND if garbled else GENEROSITY)
        if marks is None:
            break
        broken = broken or any(marks[m.start()] for m in _ODD.finditer(text))
        codecs, wide = _codecs(text), bool(_WIDE.search(text))
        # Runs are widened to the words they touch; a sentence is the scope of single-byte readings.
        out, at, changed, single, most = [], 0, 0, turn < PASSES, 0
        for m in [*_SENTENCE_END.finditer(text), None]:
            end = m.start() if m else len(text)
            part = text[at:end]
            if part and not part.isascii() and marks[at:end].any():
                new = _words(part, marks[at:end], stats, codecs) if codecs or wide else None
                if new is None and single:
                    got = _as_single(part, stats) or _as_wide(part, stats)
                    new = (got[1], [got[0]]) if got else None
                    most = max(most, sum(c > "\x7f" for c in part))
                if new is not None and new[0] != part:
                    used += new[1]
                    changed += 1
                    part = new[0]
            out += [part, m.group() if m else ""]
            at = m.end() if m else end
        if not changed and most == 1 and not garbled:  # one such letter a sentence tells nothing; all of them together may
            got = _as_single(text, stats)
            if got:
                used.append(got[0])
                out, changed = [got[1]], 1
        if not changed:
            break
        garbled += changed
        text = "".join(out)
    lost = text.count(LOST)  # always in a run, by their score
    if (lost or broken) and not garbled:
        garbled = 1
    return text, garbled, lost, used


def _words(part: str, marks: np.ndarray, stats: Pairs, codecs: tuple[str, ...]) -> tuple[str, list[str]] | None:
    """Try UTF-8 readings on the marked stretches of a sentence, widened to white space."""
    out, used, last = [], [], 0
    for m in _GROUP.finditer(part):
        if m.group().isascii() or not marks[m.start() : m.end()].any():
            continue
        got = _as_utf8(m.group(), stats, codecs)
        if got:
            out += [part[last : m.start()], got[1]]
            used.append(got[0])
            last = m.end()
    return ("".join([*out, part[last:]]), used) if used else None


def pair_counts(documents: DataFrame) -> Pairs:
    """Counts over all documents; at most ``PAIR_SLOTS + CHAR_SLOTS`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, chars = np.zeros(PAIR_SLOTS, np.int64), np.zeros(CHAR_SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                Pairs.add(text, pairs, chars)
        both = np.concatenate((pairs, chars))
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[at])], names=["slot", "n"])

    got = (
        documents.select("text")
        .where(F.col("text").rlike("[^\\x00-\\x7f]"))
        .mapInArrow(run, "slot int, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    both = np.zeros(PAIR_SLOTS + CHAR_SLOTS, np.int64)
    both[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return Pairs(both[:PAIR_SLOTS], both[PAIR_SLOTS:])


def find_garbled(documents: DataFrame) -> DataFrame:
    """Every document with a garbled stretch: doc_id, n_runs, n_lost, charsets, restored text.

    Needs doc_id and text; other columns are ignored. Null, empty and plain ASCII
    texts are never garbled (an ASCII text may hold garbled character references,
    which are tested). Rows repeated under one id give one row.
    """
    stats = documents.sparkSession.sparkContext.broadcast(pair_counts(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                new, n, lost, used = restore(text, stats.value)
                if n:
                    rows.append((i, n, lost, ",".join(sorted(set(used))), new))
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=RESTORED.names)

    maybe = documents.select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7f]|&#?[A-Za-z0-9]+;&"))
    return spread(maybe).mapInArrow(run, RESTORED).dropDuplicates(["doc_id"])
