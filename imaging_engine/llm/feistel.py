"""Keyed permutations that keep a value's format: the same value gets the same pseudonym wherever it stands.

A number of n digits is permuted among all numbers of n digits by an alternating Feistel network, whose round function is a keyed hash; where
only some numbers are valid, the network is walked until it is on a valid one again, which is a permutation of the valid ones.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable

ROUNDS = 10
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049  # to 2099-12-31
_FORMATS = ((re.compile(r"^(\d{4})(\d{2})(\d{2})$"), "{y:04}{m:02}{d:02}"), (re.compile(r"^(\d{4})-(\d{2})-(\d{2})$"), "{y:04}-{m:02}-{d:02}"), (re.compile(r"^(\d{4})\.(\d{2})\.(\d{2})$"), "{y:04}.{m:02}.{d:02}"))
_GERMAN = re.compile(r"^(\d{2})\.(\d{2})\.(\d{4})$")


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    h = hashlib.blake2b(value.to_bytes(-(-max(1, value.bit_length()) // 8), "big"), key=key[:64], salt=i.to_bytes(2, "big"), person=hashlib.blake2b(tweak, digest_size=16).digest())
    return int.from_bytes(h.digest(), "big") % modulus


def permute(value: int, size: int, key: bytes, tweak: bytes = b"", back: bool = False) -> int:
    """A permutation of range(size), or its inverse. The halves are a * b >= size; values beyond size are walked on."""
    if size < 2:
        return value
    a = int(size**0.5) or 1
    while a * a < size:
        a += 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        steps = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        sign = -1 if back else 1
        for i in steps:
            if i % 2:
                right = (right + sign * _round(key, tweak, i, left, b)) % b
            else:
                left = (left + sign * _round(key, tweak, i, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def permute_digits(digits: str, key: bytes, tweak: bytes = b"", valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
    """Another number of as many digits; of the valid ones, where this one is valid."""
    if not digits:
        return digits
    walk = valid is not None and valid(digits)
    out = digits
    while True:
        out = str(permute(int(out), 10 ** len(out), key, tweak + len(digits).to_bytes(4, "big"), back)).zfill(len(digits))
        if not walk or valid(out):
            return out


def permute_date(text: str, key: bytes, back: bool = False) -> str | None:
    """Another day between 1900 and 2099 in the same format; None if the text is no such day. One day has one pseudonym in all formats."""
    for pattern, form in (*_FORMATS, (_GERMAN, "{d:02}.{m:02}.{y:04}")):
        if m := pattern.match(text):
            y, mo, d = (int(m[k]) for k in ((3, 2, 1) if pattern is _GERMAN else (1, 2, 3)))
            try:
                day = dt.date(y, mo, d).toordinal() - _FIRST_DAY
            except ValueError:
                return None
            if not 0 <= day < _DAYS:
                return None
            new = dt.date.fromordinal(_FIRST_DAY + permute(day, _DAYS, key, b"date", back))
            return form.format(y=new.year, m=new.month, d=new.day)
    return None


def mod11(digits: str) -> bool:
    """Ten digits of which the last is the check digit of weights 10 to 2 modulo 11."""
    if len(digits) != 10:
        return False
    check = 11 - sum(int(c) * w for c, w in zip(digits, range(10, 1, -1))) % 11
    return check != 10 and check % 11 == int(digits[9])


def social(digits: str) -> bool:
    return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _fill(text: str, digits: str) -> str:
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), text)


def phone(text: str, key: bytes, back: bool = False) -> str:
    """Country code and trunk zero stay; the other digits are permuted, whatever separates them and however the country is dialled."""
    digits = re.sub(r"[^0-9]", "", text)
    head = 0
    if m := re.match(r"\s*(?:\+|00)\s?(?=\d)", text):
        head = len(re.sub(r"[^0-9]", "", m[0])) + 2
        if re.match(r"\D*\(0\)", text[m.end() + 2 :]):
            head += 1
    elif digits.startswith("0"):
        head = 1
    head = min(head, max(0, len(digits) - 4))
    return _fill(text, digits[:head] + permute_digits(digits[head:], key, b"phone", None, back))


def identity(text: str, key: bytes, back: bool = False) -> str:
    """The digits are permuted, among the numbers that pass the same check as this one; letters and separators stay."""
    digits = re.sub(r"[^0-9]", "", text)
    valid = mod11 if mod11(digits) else social if re.fullmatch(r"\D*\d{3}-\d{2}-\d{4}\D*", text) and social(digits) else None
    return _fill(text, permute_digits(digits, key, b"idnum" + (valid.__name__.encode() if valid else b""), valid, back))


def label(kind: str, text: str, key: bytes) -> str:
    """A short keyed name for a text that has no numbers to permute: the same for the same words in any letter case."""
    same = " ".join(re.findall(r"\w+", text.casefold()))
    return hashlib.blake2b(same.encode(), key=key[:64], person=kind.encode()[:16], digest_size=5).hexdigest()
