"""Personal information inside free text: finding, and format-preserving pseudonyms.

Items are found by rules per kind, checked (digit counts, check digits, labels
that say otherwise) and replaced by a typed placeholder. Numbers keep their
format inside the placeholder: their digits go through a keyed Feistel network,
a permutation of all numbers of that length, so equal values stay linked across
documents and different values stay different, without a table. Check digits
(payment cards, IBAN) are made valid again, letters of IBAN bank codes are
permuted too. Valid calendar dates are permuted within a range of days and keep
their notation. Words (names, addresses, email) become keyed tags of 128 bits.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.tables import bounded, spread

#: Person names at most; they are shipped to every task as a hashed table (about 200 bytes each).
MAX_NAMES = 500_000
KINDS = ("email", "id_number", "address", "phone", "name")
ROUNDS = 10

ITEMS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("n_chars", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)
MASKED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_items", T.IntegerType()),
        T.StructField("n_dates", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

# -- Feistel ----------------------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    h = hashlib.blake2b(f"{i}:{half}".encode() + tweak, key=key[:64], digest_size=16).digest()
    return int.from_bytes(h, "big") % size


def feistel(value: int, digits: int, key: bytes, tweak: bytes = b"", back: bool = False, base: int = 10) -> int:
    """A keyed permutation of the numbers below ``base ** digits`` (two digits or more; one digit shifts)."""
    if digits < 2:
        shift = _round(key, tweak, 0, 0, base)
        return (value - shift if back else value + shift) % base
    sizes = (base ** (digits // 2), base ** (digits - digits // 2))
    a, b = divmod(value, sizes[1])
    halves = [a, b]
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = i % 2
        f = _round(key, tweak, i, halves[1 - side], sizes[side])
        halves[side] = (halves[side] + (-f if back else f)) % sizes[side]
    return halves[0] * sizes[1] + halves[1]


def permute_digits(text: str, key: bytes, tweak: bytes = b"", back: bool = False) -> str:
    """``text`` with its decimal digits permuted as one number; everything else stays."""
    digits = [c for c in text if c.isascii() and c.isdigit()]
    if not digits:
        return text
    new = iter(str(feistel(int("".join(digits)), len(digits), key, tweak, back)).zfill(len(digits)))
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in text)


def permute_letters(text: str, key: bytes, tweak: bytes = b"", back: bool = False) -> str:
    """``text`` with its ASCII letters permuted as one word; case and everything else stay."""
    letters = [c.lower() for c in text if c.isascii() and c.isalpha()]
    if not letters:
        return text
    value = 0
    for c in letters:
        value = value * 26 + ord(c) - 97
    value, new = feistel(value, len(letters), key, tweak, back, 26), []
    for _ in letters:
        value, r = divmod(value, 26)
        new.append(chr(97 + r))
    return "".join((new.pop().upper() if c.isupper() else new.pop()) if c.isascii() and c.isalpha() else c for c in text)


def permute_date(day: date, key: bytes, first: date, days: int, back: bool = False) -> date:
    """Another day of the same range, by cycle walking; days outside the range stay."""
    n = (day - first).days
    if not 0 <= n < days:
        return day
    width = max(2, len(str(days - 1)))
    while True:
        n = feistel(n, width, key, b"date", back)
        if n < days:
            return first + timedelta(n)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in "0123456789" if luhn(body + c))


def _replace_digits(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in text)


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a value: same value and key, same placeholder."""
    label = kind.upper()
    if kind == "phone":
        return f"[{label} {permute_digits(value, key, b'phone')}]"
    if kind == "id_number":
        digits = re.sub(r"\D", "", value)
        if re.match(r"[A-Za-z]{2}\d\d", value) and len(digits) > 8 and re.match(r"[A-Za-z]{2}\d\d ?[A-Za-z0-9]{4}", value):
            rest = permute_letters(permute_digits(value[4:], key, b"iban"), key, b"bank")
            plain = re.sub(r"\s", "", rest).upper() + value[:2].upper() + "00"
            check = 98 - int("".join(str(int(c, 36)) for c in plain)) % 97
            return f"[{label} {value[:2]}{check:02d}{rest}]"
        if len(digits) in range(13, 20) and luhn(digits):
            body = str(feistel(int(digits[:-1]), len(digits) - 1, key, b"card")).zfill(len(digits) - 1)
            return f"[{label} {_replace_digits(value, body + _luhn_digit(body))}]"
        return f"[{label} {permute_digits(value, key, b'id')}]"
    plain = " ".join(unicodedata.normalize("NFKC", value).casefold().replace(",", " ").split())
    return f"[{label} {hashlib.blake2b(plain.encode(), key=key[:64], digest_size=16).hexdigest()}]"


#: Names of months.
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "may" else m for m in _MONTHS)
_DATE = re.compile(
    rf"""(?<![\w.,:/\-+])(?:
      (?P<y1>\d{{4}})(?P<s1>[\-/.])(?P<m1>\d{{1,2}})(?P=s1)(?P<d1>\d{{1,2}})
    | (?P<d2>\d{{1,2}})(?P<s2>[\-/.])(?P<m2>\d{{1,2}})(?P=s2)(?P<y2>\d{{4}})
    | (?P<d3>\d{{1,2}})\s(?P<m3>{_MONTH})\.?\s(?P<y3>\d{{4}})
    | (?P<m4>{_MONTH})\.?\s(?P<d4>\d{{1,2}}),?\s(?P<y4>\d{{4}})
    )(?![\w/\-]|[.,:]\d)""",
    re.X | re.I,
)
#: Dates are permuted among the days of a century.
FIRST_DAY, DAYS = date(1950, 1, 1), 36_525


def find_dates(text: str | None) -> list[tuple[int, int, date, tuple]]:
    """Valid calendar dates as (start, end, day, spans of year, month and day), in order.

    Of ``d/m/y`` and ``m/d/y`` the first that is a valid day is taken. Days
    outside the century that is permuted are left out.
    """
    out = []
    for m in _DATE.finditer(text) if text else ():
        k = next(k for k in "1234" if m.group("y" + k))
        y, mo, d = (m.span(x + k) for x in "ymd")
        word = m.group("m" + k)
        month = int(word) if word.isdigit() else next(i for i, x in enumerate(_MONTHS, 1) if x.startswith(word[:3].lower()))
        for spans, mm, dd in ((y, mo, d), month, int(m.group("d" + k))), ((y, d, mo), int(m.group("d" + k)), month):
            try:
                day = date(int(m.group("y" + k)), mm, dd)
            except ValueError:
                if k != "2":
                    break
                continue
            if 0 <= (day - FIRST_DAY).days < DAYS:
                out.append((*m.span(), day, spans))
            break
    return out


def date_pseudonym(text: str, found: tuple[int, int, date, tuple], key: bytes) -> str:
    """The typed placeholder of a date: another day in the same notation."""
    a, b, day, spans = found
    new = permute_date(day, key, FIRST_DAY, DAYS)
    out, at = [], a
    for (x, y), v in sorted(zip(spans, (new.year, new.month, new.day))):
        old = text[x:y]
        if old.isdigit():
            shown = str(v).zfill(len(old))
        else:
            name = _MONTHS[v - 1] if len(old) > 3 or old.lower() == "may" else _MONTHS[v - 1][:3]
            shown = name.upper() if old.isupper() else name.capitalize() if old[0].isupper() else name
        out += [text[at:x], shown]
        at = y
    return f"[DATE {''.join([*out, text[at:b]])}]"


# -- Finding ----------------------------------------------------------------

_DOT = r"(?:[.．。]|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_AT = r"(?:@|＠|%40|&\#64;|\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*)"
_LOCAL = r"(?<![\w.+\-])[^\W_][\w.+\-'’]{0,63}?"
_LABEL = r"[a-z0-9](?:[a-z0-9\-]{0,62})"
_EMAIL = re.compile(
    rf"{_LOCAL}(?:{_AT}(?:{_LABEL}{_DOT}){{1,4}}[a-z]{{2,24}}|\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL}){{0,3}}\s+dot\s+[a-z]{{2,24}})(?![a-z0-9_])",
    re.I,
)
_SPELLED = re.compile(r"[\[({<]\s*at\s*[\])}>]|\sat\s+[\w\-]+\s+dot\s", re.I)

_SEP = r"[\s.\-‐‑–]"
_PHONE = re.compile(
    rf"""(?<![\w@#$€£])(?<!\d[.,:/\-‑])(?:
      \+\d{{1,3}}(?:{_SEP}?\(\d{{1,4}}\))?(?:{_SEP}?\d{{2,5}}){{2,5}}
    | \+\d{{7,15}}
    | 00\d{{1,3}}(?:{_SEP}\d{{2,5}}){{2,5}}
    | (?:1{_SEP})?\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}?\d{{4}}
    | (?:1{_SEP})?\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}
    | 07\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}
    | \(0\d{{1,4}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,4}}
    | \d{{3}}[.\-‐‑–]\d{{4}}
    )(?![\w])(?![.\-‑/,:]\d)""",
    re.X,
)
_PASSPORT_WORDS = frozenset(("passport", "ppt", "pass"))
_NOT_PHONE = re.compile(r"(?:order|ticket|trace|checksum|build|version|ref|invoice|login|shard|row|serial)[\s.:#no]*$", re.I)

_LABELLED = re.compile(
    r"(?:\b(?:passport|ppt)(?:\s*(?:no|number|nr|num|\#))?[.:\s=\#]*|\bpass(?:port)?\s*:\s*)([A-Z]{1,2}\s?\d{6,9}|\d{8,9})(?!\w)", re.I
)
_ID = re.compile(
    r"""(?<![\w@#$+])(?<!\d[.,:/\-])(?:
      (?P<iban>[A-Za-z]{2}\d{2}[  ]?(?:[A-Za-z]{4}|\d{4})(?:[  ]?\d{4}){1,6}(?:[  ]?\d{1,3})?)
    | (?P<card>\d{4}(?P<s>[ \- ‑])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|3\d{3}[ \-]\d{6}[ \-]\d{5})
    | (?P<bare>\d{13,19})
    | (?P<ssn>\d{3}(?P<t>[ \- ‑])\d{2}(?P=t)\d{4})
    | (?P<tin>\d{2}[\-‑]\d{7})
    | (?P<national>\d{11})
    | (?P<nine>\d{9})
    | (?P<passport>[A-Za-z]{2}\d{7})
    )(?![\w])(?![.\-‑/:]\d)""",
    re.X,
)
_ID_LABEL = re.compile(
    r"(?:card(?:\s+number|\s+no\.?)?|paid\s+with|ssn|soc\.?\s*sec\.?(?:\s*(?:no|number)\.?)?|social\s+security(?:\s+(?:number|no\.?))?|"
    r"tin|tax(?:payer)?\s*(?:id|number|no\.?)?|national\s+(?:id|number|no\.?)|personal\s+(?:no\.?|number|id)|identity\s+(?:number|no\.?)|"
    r"\bid(?:\s+(?:no\.?|number|card))?|pesel|iban|account|pay\s+into)[\s:=#)]*$",
    re.I,
)
_NOT_ID = re.compile(r"(?:order|ticket|trace|checksum|build|version|ref|reference|invoice|login|shard|hash|serial|item|batch)\s*(?:no\.?|number|id)?[\s:=#]*$", re.I)

#: Street words by which an address is known.
_STREET = r"(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|close|court|ct|crescent|mews|boulevard|blvd|way|place|pl|square|sq|terrace|gardens|grove|row|walk|parade|highway|hwy|parkway)"
#: Words that stand in no street name; they tell capitals from names in upper-case text.
_PLAIN = r"(?:a|an|the|in|of|on|at|and|or|by|to|with|from|after|for|as|was|is|were|are|be|came|bad|returned|per|than|that|this|which|when|while|because|since|but|so|if|no|not)"
_FLAT = r"(?:(?:(?i:flat|apt\.?|apartment|unit|suite|ste\.?|room|rm\.?|floor)\s+\#?\w{1,5}|\#\w{1,5}),?\s+)?"
_ADDRESS = re.compile(
    rf"""(?<![\w\-/])(?:
      {_FLAT}\d{{1,5}}[A-Za-z]?(?:\s?[\-–/]\s?\d{{1,5}}[A-Za-z]?)?,?\s+(?:[NSEWnsew]{{1,2}}\.\s+)?(?:(?!(?i:{_PLAIN})\s)[A-Z][\w'’.]*\s+){{1,4}}(?i:{_STREET})(?![\w\-])
    | (?:[A-ZÄÖÜ][\w\-]*\s+)?[A-ZÄÖÜ][\w\-]*(?i:gasse|stra(?:ß|ss)e|str\.|weg|platz|allee)\s+\d{{1,4}}\s?[A-Za-z]?(?![\w])
    | (?i:ul\.|al\.|ulica)\s+(?:[^\W\d_][\w\-]*\s+){{1,4}}\d{{1,4}}[A-Za-z]?(?:\s?/\s?\d{{1,4}}[A-Za-z]?)?(?![\w])
    | (?i:p\.?\s?o\.?\s*box|post\s+office\s+box|postfach)\s+\#?\d{{1,6}}(?!\w)
    )""",
    re.X,
)


def _letters(name: str) -> str:
    """A pattern for a name in any spelling of its apostrophes, blanks and composed letters."""
    out = []
    for c in unicodedata.normalize("NFC", name):
        if c in "'’ʼ‘`":
            out.append("['’ʼ‘`]")
        elif c in "-‐‑":
            out.append("[-‐‑]")
        elif c.isspace():
            out.append(r"\s+")
        else:
            plain = unicodedata.normalize("NFD", c)
            out.append(f"(?:{re.escape(c)}|{re.escape(plain)})" if plain != c else re.escape(c))
    return "".join(out)


def _plain_name(name: str) -> str:
    return unicodedata.normalize("NFC", name).lower()


class People:
    """Names of persons in a hashed table by their longest part; patterns are made of those that a text can hold."""

    def __init__(self, given: tuple[str, ...], family: tuple[str, ...]):
        self.given, self.family = self._by_part(given), self._by_part(family)
        self.initials = "".join(sorted({_plain_name(n)[0] for n in given}))

    @staticmethod
    def _by_part(names: tuple[str, ...]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for n in sorted(set(names)):
            out.setdefault(max(_TOKEN.findall(_plain_name(n)), key=len, default=""), []).append(n)
        out.pop("", None)
        return out

    def pattern(self, tokens: set[str]) -> re.Pattern | None:
        """A pattern of all names whose longest part is among the words of a text; None if it can hold none."""
        family = tuple(n for t in tokens & self.family.keys() for n in self.family[t])
        if not family or not self.initials:
            return None
        return _pattern(tuple(sorted(n for t in tokens & self.given.keys() for n in self.given[t])), tuple(sorted(family)), self.initials)


@lru_cache(maxsize=50_000)
def _pattern(given: tuple[str, ...], family: tuple[str, ...], initials: str) -> re.Pattern:
    g = "|".join(map(_letters, sorted(given, key=lambda n: (-len(n), n))))
    f = "|".join(map(_letters, sorted(family, key=lambda n: (-len(n), n))))
    first = (rf"(?:(?:{g})(?![\w])|" if g else "(?:") + rf"[{re.escape(initials)}]\.)"
    middle = r"(?:[,\s]\s*[^\W\d_]\.?(?=[\s,]))?"
    return re.compile(
        rf"(?<![\w@.%+\-'’])(?:{first}{middle}(?:\s*,\s*|\s+|(?<=\.))(?:{f})|(?:{f})(?:\s*,\s*|\s+){first})(?![\w@]|[-‐‑]\w|\.\w*@)", re.I
    )


@lru_cache(maxsize=8)
def _names(given: tuple[str, ...], family: tuple[str, ...]) -> People:
    return People(given, family)


_TOKEN = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_STREET_WORDS = frozenset(_STREET[3:-1].split("|"))
_FLAT_WORDS = frozenset("flat apt apartment unit suite ste room rm floor".split())
#: Words and their ends by which an address may begin before its number.
_OTHER_WORDS, _OTHER_ENDS = frozenset("ul al ulica box postfach".split()), ("gasse", "straße", "strasse", "str", "weg", "platz", "allee")


def _at_numbers(pattern: re.Pattern, text: str, starts: list[int], before: str) -> Iterator[re.Match]:
    """Matches of a pattern that can begin at the first digit of a number or some characters before it, as ``finditer`` gives them.

    ``before`` tells what may come before the digit: two letters ("2") or one of some signs.
    """
    at = 0
    for p in starts:
        if p < at:
            continue
        m = None
        if before == "2":
            if p - 2 >= at and text[p - 2 : p].isalpha():
                m = pattern.match(text, p - 2)
        elif p > at and text[p - 1] in before:
            m = pattern.match(text, p - 1)
        m = m or pattern.match(text, p)
        if m:
            yield m
            at = m.end()


def find(text: str | None, given: tuple[str, ...] = (), family: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """Items of a text as (0-based start, end, kind), in order, not overlapping.

    Null and empty texts have none. Where rules overlap the earlier kind of
    ``KINDS`` wins.
    """
    if not text:
        return []
    got: list[tuple[int, int, str]] = []

    def put(a: int, b: int, kind: str) -> None:
        if not any(a < y and x < b for x, y, _ in got):
            got.append((a, b, kind))

    tokens = set(_TOKEN.findall(_plain_name(text)))
    signed = "@" in text or "＠" in text or "%40" in text or "&#64;" in text
    if signed or "at" in tokens and ("dot" in tokens or any(c in text for c in "[({<")) and _SPELLED.search(text):
        for m in _EMAIL.finditer(text):
            put(*m.span(), "email")
    numbers = [m.span() for m in _DIGITS.finditer(text)]
    if any(b - a > 1 for a, b in numbers):
        starts = [a for a, _ in numbers]
        if tokens & _PASSPORT_WORDS:
            for m in _LABELLED.finditer(text):
                put(*m.span(1), "id_number")
        for m in _at_numbers(_ID, text, starts, "2"):
            before = text[max(0, m.start() - 40) : m.start()]
            digits = re.sub(r"\D", "", m.group())
            labelled = bool(_ID_LABEL.search(before))
            if _NOT_ID.search(before) and not labelled:
                continue
            kind = m.lastgroup if m.lastgroup not in ("s", "t") else ("card" if m.group("card") else "ssn")
            if kind == "bare" and not (labelled or luhn(digits) and len(digits) in (15, 16)):
                continue
            if kind in ("nine",) and not labelled:
                continue
            if kind == "iban" and len(digits) < 8:
                continue
            put(*m.span(), "id_number")
        if "#" in text or tokens & _FLAT_WORDS or tokens & _OTHER_WORDS or any(t.endswith(_OTHER_ENDS) for t in tokens):
            addresses = _ADDRESS.finditer(text)
        else:
            addresses = _at_numbers(_ADDRESS, text, starts if tokens & _STREET_WORDS else [], "")
        for m in addresses:
            put(*m.span(), "address")
        for m in _at_numbers(_PHONE, text, starts, "+("):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 15 and not _NOT_PHONE.search(text[max(0, m.start() - 16) : m.start()]):
                put(*m.span(), "phone")
    names = _names(given, family).pattern(tokens)
    for m in names.finditer(text) if names else ():
        put(*m.span(), "name")
    return sorted(got)


def mask(text: str | None, items: list[tuple[int, int, str]], key: bytes, dates: list[tuple] = ()) -> str | None:
    """The text with every item, and every date outside of items, replaced by its placeholder; the rest stays as it is."""
    if not text or not (items or dates):
        return text
    places = [(a, b, pseudonym(kind, text[a:b], key)) for a, b, kind in items]
    places += [(d[0], d[1], date_pseudonym(text, d, key)) for d in dates if not any(d[0] < b and a < d[1] for a, b, _ in items)]
    out, at = [], 0
    for a, b, new in sorted(places):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def _people(names: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    rows = bounded(names.select("name", "name_part").where("name is not null and trim(name) <> ''"), MAX_NAMES, "person names")
    return tuple(tuple(sorted({r.name for r in rows if r.name_part == part})) for part in ("given", "family"))


def find_items(docs: DataFrame, names: DataFrame) -> DataFrame:
    """One row per item: id, kind, start_pos (1-based code point), n_chars and value.

    Needs id and text; other columns are ignored. Rows repeated under one id
    count once; null and empty texts have no items. Each text is searched whole;
    only the items are shuffled.
    """
    given, family = _people(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, kind, a + 1, b - a, text[a:b])
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())
                for a, b, kind in find(text, given, family)
            ]
            cols = list(zip(*rows)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=ITEMS.names)

    return spread(docs.select("id", "text")).mapInArrow(run, ITEMS).dropDuplicates(["id", "kind", "start_pos"])


def mask_docs(docs: DataFrame, names: DataFrame, key: bytes) -> DataFrame:
    """Every document once with its items and dates replaced: id, source, n_items, n_dates, text (null stays null)."""
    given, family = _people(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            items, dates = [find(t, given, family) for t in texts], [find_dates(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(pa.string()),
                    batch.column("source").cast(pa.string()),
                    pa.array([len(x) for x in items], pa.int32()),
                    pa.array([len(x) for x in dates], pa.int32()),
                    pa.array([mask(t, x, key, d) for t, x, d in zip(texts, items, dates)], pa.string()),
                ],
                names=MASKED.names,
            )

    return docs.select("id", "source", "text").dropDuplicates(["id"]).mapInArrow(run, MASKED)
