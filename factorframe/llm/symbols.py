"""Character symbols for n-gram models: whole texts as 6-bit integers, in numpy.  The alphabet is fixed, so a table of
n-grams has at most 64 ** n entries however large the corpus is."""

from __future__ import annotations

import sys

import numpy as np

BITS = 6
_TABLES: dict[bool, np.ndarray] = {}


def _letter(c: int) -> int:
    """1-26 a-z without case, 27-63 other letters, 0 what is no letter."""
    x = chr(c)
    if not x.isalpha():
        return 0
    low = ord(x.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low % 37


def _any(c: int) -> int:
    """0 white space, 1 digits, 2-27 a-z, 28-53 A-Z, 54-57 other letters, 58 full stop and comma, 59 other marks of
    prose, 60-63 the rest."""
    x = chr(c)
    if x.isspace():
        return 0
    if x.isdigit():
        return 1
    if 97 <= c <= 122:
        return c - 95
    if 65 <= c <= 90:
        return c - 37
    if x.isalpha():
        return 54 + c % 4
    return 58 if x in ".," else 59 if x in ";:'\"?!-()" else 60 + c % 4


def table(letters: bool) -> np.ndarray:
    """Symbol of each code point."""
    if letters not in _TABLES:
        n = sys.maxunicode + 1
        _TABLES[letters] = np.fromiter(map(_letter if letters else _any, range(n)), dtype=np.uint8, count=n)
    return _TABLES[letters]


def points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the number of points before each byte."""
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), before
