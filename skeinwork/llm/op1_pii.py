"""Operator 1: format-preserving pseudonyms for personal data.

Card numbers (Luhn), IBANs (mod 97), social security numbers, telephone numbers, IPv4 addresses, calendar dates and
e-mail addresses are found and validated, brought to one canonical value each, permuted by a keyed Feistel network within
their format, and written back in the notation that they were found in: a card stays a valid card of its network and
grouping, a date a date with its month's name in the same language. The permutation depends on the key, the kind and the
canonical value alone, so equal values get equal pseudonyms in every document, whatever their separators or notation: a
telephone number is its country calling code and the rest (ten-digit North American numbers have code 1), a date its day
in the calendar. Days up to the twelfth stay among themselves, so that what could be read as day or month still can.

The key comes from the session's configuration, KEY_NAME; a session without one makes its own at random and keeps it for
as long as it lives, so pseudonyms can't be undone from the source, nor linked to those of another session.

One pass over the rows, no shuffle. Null and empty texts stay as they are; texts without personal data are returned
byte for byte; repeated rows get equal results; very long texts are whole; empty tables give empty tables; other
columns are kept. What only looks like a number of some kind but fails its validation is left alone.
"""

from __future__ import annotations

import bisect
import calendar
import datetime
import functools
import hashlib
import math
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROUNDS = 8
KEY_NAME = "spark.skeinwork.pii.key"
_made: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The configured key, or this application's own random one."""
    given = spark.conf.get(KEY_NAME, None)
    if given:
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    return _made.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


@functools.lru_cache(1 << 16)
def permute(value: int, size: int, kind: str, key: bytes) -> int:
    """A keyed permutation of range(size): an alternating Feistel network over two halves, walked until inside the range."""
    left = math.isqrt(size - 1) + 1
    right = -(-size // left)
    tag = f"{kind}|{size}|".encode()

    def rounds(x: int) -> int:
        a, b = divmod(x, right)
        for i in range(ROUNDS):
            half, m = (b, left) if i % 2 == 0 else (a, right)
            f = hashlib.blake2b(tag + b"%d|%d" % (i, half), key=key, digest_size=32).digest()
            f = int.from_bytes(f * (1 + m.bit_length() // 192), "big") % m
            if i % 2 == 0:
                a = (a + f) % left
            else:
                b = (b + f) % right
        return a * right + b

    out = rounds(value)
    while out >= size:
        out = rounds(out)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


#: Issuer prefixes of card networks that are longer than one digit, by how many digits they have.
NETWORKS = {2: {34, 37, 36, 38, 39, 62, 65, *range(51, 56)}, 3: {*range(300, 306), *range(644, 650)}, 4: {6011, *range(2221, 2721), *range(3528, 3590)}}


def _card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    keep = next((n for n, known in NETWORKS.items() if int(d[:n]) in known), 1)
    n = len(d) - 1 - keep
    body = d[:keep] + str(permute(int(d[keep:-1]), 10**n, f"card{d[:keep]}", key)).zfill(n)
    return _refill(s, body + luhn_digit(body))


def _ssn(s: str, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    at = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", key)
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    area += 1 + (area + 1 >= 666)
    return f"{area:03}-{group + 1:02}-{serial + 1:04}"


#: Country calling codes of two digits; 1 and 7 have one, all others three.
CALLING = {20, 27, *range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}


def _phone(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 7 <= len(d) <= 15:
        return None
    keep = 0
    if s[0] == "+":
        keep = 1 if d[0] in "17" else 2 if int(d[:2]) in CALLING else 3
    code, rest = d[:keep] or "1", d[keep:]
    trunk = len(rest) > 1 and "(0)" in s and rest[0] == "0"  # a trunk prefix shown in brackets is no part of the number
    rest = rest[trunk:]
    return _refill(s, d[:keep] + "0" * trunk + str(permute(int(rest), 10 ** len(rest), f"phone{code}", key)).zfill(len(rest)))


def _ip(s: str, key: bytes) -> str | None:
    value = functools.reduce(lambda x, y: x << 8 | int(y), s.split("."), 0)
    out = permute(value, 1 << 32, "ipv4", key)
    return ".".join(str(out >> k & 255) for k in (24, 16, 8, 0))


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


_RUN = 64


def _chars(body: str, kind: str, key: bytes) -> str:
    """Letters a-z and A-Z and digits of body permuted together, each within its own class; other characters stay.

    The case of letters is part of the format, not of the value. More than _RUN of them are permuted run by run, each
    run under a key that hangs on the ones before it.
    """
    at = [(i, *(("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("0", 10))) for i, c in enumerate(body) if c.isascii() and c.isalnum()]
    out, before = list(body), ""
    for lo in range(0, len(at), _RUN):
        value, size = 0, 1
        for i, base, n in at[lo : lo + _RUN]:
            value, size = value * n + ord(body[i]) - ord(base), size * n
        shape = "".join("9" if n == 10 else "a" for _, _, n in at[lo : lo + _RUN])
        was = str(value)
        value = permute(value, size, f"{kind}{before}{shape}", key)
        before = hashlib.blake2b(f"{before}|{shape}|{was}".encode(), digest_size=16).hexdigest()
        for i, base, n in reversed(at[lo : lo + _RUN]):
            value, r = divmod(value, n)
            out[i] = chr(ord(base) + r)
    return "".join(out)


def _iban(s: str, key: bytes) -> str | None:
    while s:
        d = s.replace(" ", "")
        if 15 <= len(d) <= 34 and _iban_check(d[:2], d[4:]) == d[2:4]:
            body = _chars(d[4:], "iban" + d[:2], key)
            it = iter(d[:2] + _iban_check(d[:2], body) + body)
            return "".join(c if c == " " else next(it) for c in s)
        s = s.rpartition(" ")[0]
    return None


FIRST_YEAR, LAST_YEAR = 1900, 2099
#: Month names and their usual short forms by language.
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "de": ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    "es": ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
}
SHORT = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _valid(y: int, m: int, d: int) -> bool:
    return FIRST_YEAR <= y <= LAST_YEAR and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]


@functools.lru_cache(1)
def _late_days() -> list[int]:
    """How many days after a month's twelfth come before each month of the calendar, and in all."""
    out = [0]
    for m in range((LAST_YEAR - FIRST_YEAR + 1) * 12):
        out.append(out[-1] + calendar.monthrange(FIRST_YEAR + m // 12, m % 12 + 1)[1] - 12)
    return out


def _other_day(y: int, m: int, d: int, key: bytes) -> datetime.date:
    """The date's pseudonym: a day up to the twelfth if it is one, else a later one."""
    month, late = (y - FIRST_YEAR) * 12 + m - 1, _late_days()
    if d <= 12:
        month, day = divmod(permute(month * 12 + d - 1, 12 * (len(late) - 1), "early", key), 12)
        day += 1
    else:
        at = permute(late[month] + d - 13, late[-1], "late", key)
        month = bisect.bisect_right(late, at) - 1
        day = at - late[month] + 13
    return datetime.date(FIRST_YEAR + month // 12, month % 12 + 1, day)


def _month(name: str, said: str) -> tuple[int, list[str]]:
    """(number, the names to answer with) of a month's name; said: which languages to try first, by what stands beside it."""
    low = name.lower()
    for lang in (["es", "de", "fr", "en"] if said == "de" else ["de", "en", "fr", "es"] if said == "." else ["en", "fr", "de", "es"]):
        for i, m in enumerate(MONTHS[lang], 1):
            if low == m.lower():
                like = [x.upper() if name.isupper() else x.title() if name[0].isupper() else x.lower() for x in MONTHS[lang]]
                return i, like
    for i, m in enumerate(SHORT, 1):
        if low == m.lower():
            return i, [x.upper() if name.isupper() else x.lower() if name.islower() else x for x in SHORT]
    return 0, []


def _date(s: str, key: bytes) -> str | None:
    a, s1, b, s2, c = re.match(r"(\w+)(\W+(?:de )?)(\w+)(\W+(?:de )?)(\w+)", s).groups()
    two = lambda x, like: f"{x:02}" if like[0] == "0" or len(like) == 2 and x < 10 else str(x)
    if not a.isdigit() or not b.isdigit():
        first = not a.isdigit()
        name, day = (a, b) if first else (b, a)
        month, names = _month(name, "." if "." in s1 else "de" if "de" in s1 else "")
        if not _valid(int(c), month, int(day)):
            return None
        new = _other_day(int(c), month, int(day), key)
        word = names[new.month - 1]
        one, other = (word, two(new.day, day)) if first else (two(new.day, day), word)
        return f"{one}{s1}{other}{s2}{new.year}"
    if s1 != s2:
        return None
    if len(a) == 4:
        if not _valid(int(a), int(b), int(c)):
            return None
        new = _other_day(int(a), int(b), int(c), key)
        return f"{new.year}{s1}{two(new.month, b)}{s2}{two(new.day, c)}"
    if _valid(int(c), int(b), int(a)):
        new = _other_day(int(c), int(b), int(a), key)
        return f"{two(new.day, a)}{s1}{two(new.month, b)}{s2}{new.year}"
    if _valid(int(c), int(a), int(b)):
        new = _other_day(int(c), int(a), int(b), key)
        return f"{two(new.month, a)}{s1}{two(new.day, b)}{s2}{new.year}"
    return None


_MONTH = "(?:" + "|".join(sorted({m for names in [*MONTHS.values(), SHORT] for x in names for m in (x, x.lower(), x.title(), x.upper())}, key=lambda x: (-len(x), x))) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
KINDS = {
    "iban": (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", _iban),
    "date": (rf"(?<![\w./-])(?:\d{{4}}-\d\d-\d\d|\d{{4}}/\d\d/\d\d|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}\.? (?:de )?{_MONTH} (?:de )?\d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}})(?![\w/-]|\.\d)", _date),
    "ipv4": (rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)", _ip),
    "card": (r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w|\.\d)", _card),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    "phone": (r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\+\d{1,3}[ -]?(?:\(\d{1,4}\)[ -]?)?\d{1,4}(?:[ -]?\d{2,4}){1,5}(?!\w|\.\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\w-]|\.\d)", _phone),
}
_EACH = [(k, re.compile(p), f) for k, (p, f) in KINDS.items()]
_DOMAIN = re.compile(r"(?:\w(?:[\w-]*\w)?\.)+[A-Za-z]{2,24}(?![\w-])")
_DIGIT = re.compile(r"\d")


def _emails(text: str, key: bytes) -> Iterator[tuple[int, int, str, str]]:
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start and ((c := text[start - 1]).isalnum() or c in "_.+%-"):
                start -= 1
            if user := text[start:at].lstrip(".-+%"):
                host, _, last = domain.group().rpartition(".")
                yield at - len(user), domain.end(), "email", f"{_chars(f'{user}@{host}', 'mail', key)}.{last}"
        at = text.find("@", at + 1)


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the personal data in a text, in order, none overlapping; earlier kinds win."""
    spans = list(_emails(text, key))
    if _DIGIT.search(text):
        for kind, pattern, change in _EACH:
            for m in pattern.finditer(text):
                if (new := change(m.group(), key)) is not None:
                    spans.append((m.start(), m.start() + len(m.group()) if kind != "iban" else m.start() + len(new), kind, new))
    out: list[tuple[int, int, str, str]] = []
    if len(spans) < 2:
        return spans
    order = {k: i for i, k in enumerate(["email", *KINDS])}
    taken: list[tuple[int, int]] = []
    for span in sorted(spans, key=lambda x: order[x[2]]):
        i = bisect.bisect(taken, (span[0], span[1]))
        if (i == 0 or taken[i - 1][1] <= span[0]) and (i == len(taken) or taken[i][0] >= span[1]):
            taken.insert(i, (span[0], span[1]))
            out.append(span)
    return sorted(out)


def scrub(text: str, key: bytes) -> tuple[str, list[str]]:
    """(text with pseudonyms, kinds found in order)."""
    spans = find(text, key)
    if not spans:
        return text, []
    parts, at = [], 0
    for a, b, _, new in spans:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]]), [x[2] for x in spans]


def pseudonymise(df: DataFrame, key: bytes | None = None, text: str = "text", found: str | None = None) -> DataFrame:
    """df with its text column scrubbed; found: name of a new last column (array<string>) with the kinds replaced. key: the session's if none is given."""
    key = key or session_key(df.sparkSession)
    if found in df.columns:
        raise ValueError(f"df has a column {found}")
    fields = [*df.schema.fields, *([T.StructField(found, T.ArrayType(T.StringType()))] if found else [])]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else scrub(t, key) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], batch.schema.field(at).type)
            if found:
                columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
