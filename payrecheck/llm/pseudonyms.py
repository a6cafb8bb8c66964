"""Personal data under format-preserving pseudonyms.

Mail addresses, cards, IBANs, phone and social security numbers, IP addresses and
dates are found by their shape and validated by their checksum, ranges or the calendar.
Each is replaced by a keyed Feistel permutation within its own format: digits stay digits,
letters stay letters, separators stay in place, cards and IBANs stay valid, dates stay dates.
As the permutation depends on the key, kind and format only, equal values
have equal pseudonyms in all documents, and different ones stay different.

Documents are read once, where they lie, without a shuffle.

Defined results: a null text stays null with no findings; what fails validation
stays as it is; values that overlap are read from the left, the longest kind first; repeated
rows are replaced alike; other columns are carried through.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
ROUNDS = 10
_EPOCH = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2100, 1, 1).toordinal() - _EPOCH


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 .. a * b - 1, by alternating modular addition on both halves."""

    key: bytes

    def _round(self, tweak: bytes, k: int, value: int, mod: int) -> int:
        size = (mod.bit_length() + 7) // 8 + 8
        text = k.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8, "big")
        out = b""
        while len(out) < size:
            block = hashlib.blake2b(tweak + b"|" + text, key=self.key, salt=len(out).to_bytes(2, "big"))
            out += block.digest()
        return int.from_bytes(out[:size], "big") % mod

    def permute(self, value: int, a: int, b: int, tweak: bytes, back: bool = False) -> int:
        x, y = divmod(value, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                y = (y + sign * self._round(tweak, k, x, b)) % b
            else:
                x = (x + sign * self._round(tweak, k, y, a)) % a
        return x * b + y

    def within(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """The permutation on 0 .. size - 1, by walking the cycle of a slightly larger one."""
        a = int(size**0.5) + 1
        b = -(-size // a)
        while True:
            value = self.permute(value, a, b, tweak, back)
            if value < size:
                return value

    def text(self, value: str, tweak: str, back: bool = False) -> str:
        """Digits and ASCII letters permuted, each within its class; the rest stays."""
        radix = [10 if c in "0123456789" else 26 for c in value if c.isascii() and c.isalnum()]
        digits = [
            ord(c) - 48 if c in "0123456789" else ord(c.lower()) - 97
            for c in value
            if c.isascii() and c.isalnum()
        ]
        if not radix:
            return value
        half = (len(radix) + 1) // 2
        a, b, number = 1, 1, 0
        for k, (r, d) in enumerate(zip(radix, digits, strict=True)):
            number = number * r + d
            if k < half:
                a *= r
            else:
                b *= r
        shape = "".join("d" if r == 10 else "l" for r in radix)
        number = self.permute(number, a, b, f"{tweak}|{shape}".encode(), back)
        out = []
        for r in reversed(radix):
            number, d = divmod(number, r)
            out.append(chr(48 + d) if r == 10 else chr(97 + d))
        fresh = iter(reversed(out))
        return "".join(
            (n.upper() if c.isupper() else n)
            if c.isascii() and c.isalnum() and (n := next(fresh))
            else c
            for c in value
        )


def luhn_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 if k % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{rest}{country}00".upper())
    return f"{98 - int(number) % 97:02d}"


def _respaced(like: str, compact: str) -> str:
    fresh = iter(compact)
    return "".join(next(fresh) if c.isalnum() else c for c in like)


def _card(f: Feistel, v: str, back: bool) -> str | None:
    digits = re.sub(r"[ -]", "", v)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = f.text(digits[:-1], "card", back)
    # A single repeated digit is no card: the walk goes on past it.
    while len(set(body + luhn_digit(body))) == 1:
        body = f.text(body, "card", back)
    return _respaced(v, body + luhn_digit(body))


def _iban(f: Feistel, v: str, back: bool) -> str | None:
    compact = v.replace(" ", "")
    if iban_digits(compact[:2], compact[4:]) != compact[2:4]:
        return None
    rest = f.text(compact[4:], "iban", back)
    return _respaced(v, compact[:2] + iban_digits(compact[:2], rest) + rest)


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(f: Feistel, v: str, back: bool) -> str | None:
    digits = v.replace("-", "")
    if not _ssn_valid(digits):
        return None
    while True:
        digits = f.text(digits, "ssn", back)
        if _ssn_valid(digits):
            return _respaced(v, digits)


def _phone(f: Feistel, v: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", v)
    if not 10 <= len(digits) <= 15:
        return None
    own = len(digits) - 10
    return _respaced(v, digits[:own] + f.text(digits[own:], "phone", back))


def _ip(f: Feistel, v: str, back: bool) -> str | None:
    parts = [int(p) for p in v.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in v.split(".")):
        return None
    number = int.from_bytes(bytes(parts), "big")
    return ".".join(map(str, f.permute(number, 1 << 16, 1 << 16, b"ip", back).to_bytes(4, "big")))


def _date(f: Feistel, v: str, back: bool) -> str | None:
    mark = next(c for c in v if not c.isdigit())
    p = v.split(mark)
    order = (0, 1, 2) if mark == "-" else (2, 1, 0) if mark == "." else (2, 0, 1)
    try:
        day = dt.date(*(int(p[k]) for k in order)).toordinal() - _EPOCH
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = dt.date.fromordinal(_EPOCH + f.within(day, _DAYS, b"date", back))
    out = [""] * 3
    for k, n in zip(order, (new.year, new.month, new.day), strict=True):
        out[k] = f"{n:04d}" if k == order[0] else f"{n:02d}"
    return mark.join(out)


def _email(f: Feistel, v: str, back: bool) -> str | None:
    at = v.rindex("@")
    last = v.rindex(".")
    return f.text(v[:at], "mail", back) + "@" + f.text(v[at + 1 : last], "host", back) + v[last:]


_RULES: tuple[tuple[str, str, Callable], ...] = (
    ("email", r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])", _email),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    ("card", r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])", _card),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-]|\.\d)", _date),
    ("phone", r"(?<![\w(])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)", _phone),
    ("phone", r"(?<![\w(+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w(+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])", _phone),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", _ip),
)
_COMPILED = [(kind, re.compile(pattern, re.ASCII), change) for kind, pattern, change in _RULES]
_ANY = re.compile(r"[0-9@]")


def replace_values(
    text: str, key: bytes, back: bool = False
) -> tuple[str, list[tuple[str, int, int]]]:
    """The text under pseudonyms, and (kind, start, end) of each value in it before.

    ``back`` turns pseudonyms into the values again.
    """
    if not _ANY.search(text):
        return text, []
    feistel, taken = Feistel(key), []
    for kind, pattern, change in _COMPILED:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, _, _ in taken) and (
                new := change(feistel, m[0], back)
            ):
                taken.append((m.start(), m.end(), kind, new))
    out, at = [], 0
    taken.sort()
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in taken]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its texts; added: ``found`` (kind, start, end)."""
    names = docs.columns
    at = names.index(text)
    held = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def change(batches):
        for batch in batches:
            texts, found = [], []
            for value in batch.column(at):
                new, spans = (None, []) if not value.is_valid else replace_values(value.as_py(), key)
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.list_(kind))], [*batch.schema.names, "found"]
            )

    schema = ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(docs.dtypes))
    return held.mapInArrow(
        change, f"{schema}, found array<struct<kind:string,start:int,end:int>>"
    ).toDF(*names, "found")
