"""Personal data replaced by pseudonyms of the same format, equal for equal values."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date, timedelta
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import table, text_batches

ROUNDS = 10
#: For tests and the registered query. Whoever has the key can undo the pseudonyms: keep your own secret.
EXAMPLE_KEY = b"an example key, not a secret"
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ("email", "ip", "iban", "card", "ssn", "date", "phone")
REMEMBERED = 200_000

_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<card>(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![/-]|\.\d|(?!T\d{2})\w))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w))",
    re.ASCII,
)
_OF_KIND = {kind: re.compile(source, re.ASCII) for kind, source in zip(KINDS, re.split(r"\|(?=\(\?P<)", _FIND.pattern), strict=True)}
#: Kinds whose digit groups may run on into what follows, and the fewest characters of a value.
_RUNNING = {"iban": 15, "card": 13}


class Feistel:
    """A keyed permutation of 0 to ``size`` - 1 for each kind and size.

    A number is two parts of about equal size. Each round adds a keyed hash of
    one part to the other. The grid of both is a little larger than the domain;
    what falls outside goes through again until it is inside.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _noise(self, tweak: bytes, turn: int, part: int, size: int) -> int:
        data = tweak + bytes([turn]) + part.to_bytes((part.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, digest_size=32, key=self.key).digest(), "big") % size

    def _grid(self, size: int) -> tuple[int, int]:
        a = 1
        while a * a < size:
            a = a * 2 if a * a * 16 < size else a + max(1, (size - a * a) // (4 * a + 4))
        return a, -(-size // a)

    def permute(self, number: int, size: int, kind: str, back: bool = False) -> int:
        if size < 2:
            return number
        a, b = self._grid(size)
        tweak = f"{kind}:{size}:".encode()
        while True:
            left, right = divmod(number, b)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if turn % 2:
                    right = (right + sign * self._noise(tweak, turn, left, b)) % b
                else:
                    left = (left + sign * self._noise(tweak, turn, right, a)) % a
            number = left * b + right
            if number < size:
                return number

    def within(self, number: int, size: int, kind: str, valid, back: bool = False) -> int:
        """The permutation of those numbers for which ``valid`` holds, to which ``number`` belongs."""
        while True:
            number = self.permute(number, size, kind, back)
            if valid(number):
                return number


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` and it valid."""
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return str(-sum(d // 10 + d % 10 for d in doubled) % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _valid_ssn(number: int) -> bool:
    area, group, serial = number // 1_000_000, number // 10_000 % 100, number % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _group(day: date) -> tuple[int, int]:
    """What the spellings of a date tell of it: digits of the day and whether it is no month's number, digits of the month."""
    return (day.day > 9) + (day.day > 12), int(day.month > 9)


@cache
def _days() -> dict[tuple[int, int], list[date]]:
    """All days by their group, in order."""
    groups: dict[tuple[int, int], list[date]] = {}
    for n in range((LAST_DAY - FIRST_DAY).days + 1):
        day = FIRST_DAY + timedelta(n)
        groups.setdefault(_group(day), []).append(day)
    return groups


def _refill(shape: str, characters: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    fresh = iter(characters)
    return "".join(next(fresh) if c.isalnum() else c for c in shape)


class Pseudonyms:
    """Pseudonyms of found values; ``back`` undoes them."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym of a value, or None if it isn't valid and stays."""
        if back:
            return getattr(self, f"_{kind}")(value, True)
        key = kind, value
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = getattr(self, f"_{kind}")(value, False)
        return self.known[key]

    def _mixed(self, text: str, kind: str, back: bool) -> str:
        """Letters become letters of the same case and digits digits, all of one number."""
        number, size, radices = 0, 1, []
        for c in text:
            base, first = (10, "0") if c.isdigit() else (26, "a" if c.islower() else "A")
            radices.append((base, first))
            number, size = number * base + ord(c) - ord(first), size * base
        number = self.feistel.permute(number, size, f"{kind}:{''.join(f for _, f in radices)}", back)
        out = []
        for base, first in reversed(radices):
            number, digit = divmod(number, base)
            out.append(chr(ord(first) + digit))
        return "".join(reversed(out))

    def _email(self, value: str, back: bool) -> str | None:
        name, _, domain = value.rpartition("@")
        plain = "".join(c for c in name if c.isalnum())
        return f"{_refill(name, self._mixed(plain, 'email@' + domain.lower(), back))}@{domain}"

    def _ip(self, value: str, back: bool) -> str | None:
        parts = [int(p) for p in value.split(".")]
        if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        number = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
        return ".".join(str(b) for b in number.to_bytes(4, "big"))

    def _iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_digits(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = self._mixed(plain[4:], f"iban{plain[:2]}", back)
        return _refill(value, plain[:2] + iban_digits(plain[:2], rest) + rest)

    def _card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        body = len(digits) - 1
        plain = lambda n: len({*(s := f"{n:0{body}d}"), luhn_digit(s)}) > 1
        fresh = f"{self.feistel.within(int(digits[:-1]), 10**body, 'card', plain, back):0{body}d}"
        return _refill(value, fresh + luhn_digit(fresh))

    def _ssn(self, value: str, back: bool) -> str | None:
        number = int(value.replace("-", ""))
        if not _valid_ssn(number):
            return None
        return _refill(value, f"{self.feistel.within(number, 10**9, 'ssn', _valid_ssn, back):09d}")

    def _date(self, value: str, back: bool) -> str | None:
        """A day of the years 1900 to 2099, written in the same way.

        With slashes the month comes first, unless only the other order is a
        date. Days are permuted within their ``_group``, whatever the spelling,
        so equal dates stay equal and every spelling stays one of its kind.
        """
        parts = re.split(r"[-/.]", value)
        if len(parts[0]) > 2:
            order = "ymd"
        elif "." in value:
            order = "dmy"
        else:
            order = "mdy" if int(parts[0]) <= 12 else "dmy"
        named = dict(zip(order, parts, strict=True))
        try:
            day = date(*(int(named[c]) for c in "ymd"))
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        group = _group(day)
        days = _days()[group]
        fresh = days[self.feistel.permute(bisect_left(days, day), len(days), f"date{group}", back)]
        digits = {"y": f"{fresh.year:04d}", "m": f"{fresh.month:0{len(named['m'])}d}", "d": f"{fresh.day:0{len(named['d'])}d}"}
        return _refill(value, "".join(digits[c] for c in order))

    def _phone(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        country, national = digits[:-10], digits[-10:]
        fresh = self.feistel.permute(int(national), 10**10, "phone", back)
        return _refill(value, f"{country}{fresh:010d}")

    def _valid(self, text: str, found: re.Match) -> tuple[str, str, str | None]:
        """(kind, value, pseudonym) of what stands at a match; if it fails its check, of a shorter one or of a later kind there."""
        kind, value = found.lastgroup, found[0]
        fresh = self.of(kind, value)
        if fresh is not None or kind not in _RUNNING:
            return kind, value, fresh
        for other in KINDS[KINDS.index(kind) :]:
            match = _OF_KIND[other].match(text, found.start())
            if not match:
                continue
            ends = [match.end()]
            if other in _RUNNING:  # the ends of its groups, the longest first
                ends += [match.start() + m.start() for m in reversed([*re.finditer("[ -]", match[0])])]
            for end in ends:
                shorter = text[match.start() : end]
                if sum(c.isalnum() for c in shorter) < _RUNNING.get(other, 0):
                    break
                fresh = self.of(other, shorter)
                if fresh is not None:
                    return other, shorter, fresh
        return kind, value, None

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms and (kind, start, end) of each in it."""
        out, spans, done, length, at = [], [], 0, 0, 0
        while found := _FIND.search(text, at):
            start = found.start()
            kind, value, fresh = self._valid(text, found)
            if fresh is None:
                at = start + len(re.match("[A-Za-z0-9]+", value)[0]) if kind in _RUNNING else found.end()
                continue
            out += [text[done:start], fresh]
            length += start - done
            spans.append((kind, length, length + len(fresh)))
            length += len(fresh)
            at = done = start + len(value)
        return "".join([*out, text[done:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, passed: list[str] | None = None) -> DataFrame:
    """Each row with its text pseudonymised and ``found``, an array of (kind, start, end) in the new text.

    Found are e-mail addresses, IPv4 addresses with all parts up to 255, IBANs
    and card numbers with right check digits, social security numbers outside
    the ranges that are never given out, dates of 1900 to 2099 that exist, and
    phone numbers of ten digits. What fails its check stays as it is; a card or
    IBAN that runs on into other groups is found at the end of one of its own. A value
    is a number within its format and goes through a keyed Feistel permutation
    of all such numbers: marks, lengths and cases stay, check digits are made
    anew, and two values have the same pseudonym just if they are equal, in
    any document and with any spacing or, for dates, spelling. Days are
    permuted among those with as many digits in day and month, days over 12
    among themselves, so that a date can be read in one way only. The domain
    of an e-mail address, the country of an IBAN and the country code of a
    phone number stay.

    Rows are independent: no shuffle, no table of pseudonyms. Edge cases: a
    null text stays null with nothing found, an empty one empty. In very long
    texts values are found one after another, so memory is that of the text.
    Columns other than text pass (``passed``, if given); ``found`` is replaced.
    """
    own = [c for c in (passed if passed is not None else docs.columns) if c not in ("found", "text")]
    rows = docs.select(F.struct(*own).alias("row"), F.col("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pseudonyms(key)
        for batch in text_batches(batches):
            done = [(None, []) if t is None else known.replace(t) for t in batch.column("text").to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([t for t, _ in done], pa.string()), pa.array(spans, pa.list_(span))], ["row", "text", "found"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, found array<struct<kind:string,start:int,end:int>>"
    order = [c for c in (passed if passed is not None else docs.columns) if c != "found"]
    return rows.mapInArrow(scrub, schema).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in order), *([] if "text" in order else ["text"]), "found")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents"), EXAMPLE_KEY, passed=["doc_id", "text"])
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *map(of, KINDS))
