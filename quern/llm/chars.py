"""Texts as arrays of code points, for steps that numpy takes over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TOP = 0x110000
#: Classes of characters, by ``classes``.
SPACE, LINE, DIGIT, LOWER, UPPER, OTHER_LETTER, MARK, HIGH = range(8)
N_CLASSES = 8

#: First and past-last code point of the main blocks of each script.
SCRIPT_RANGES = (
    ("Latin", ((0x41, 0x5B), (0x61, 0x7B), (0xAA, 0xAB), (0xBA, 0xBB), (0xC0, 0x250), (0x250, 0x2B0), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFF21, 0xFF5B))),
    ("Greek", ((0x370, 0x400), (0x1F00, 0x2000))),
    ("Cyrillic", ((0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0))),
    ("Armenian", ((0x530, 0x590),)),
    ("Hebrew", ((0x590, 0x600),)),
    ("Arabic", ((0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900), (0xFB50, 0xFE00), (0xFE70, 0xFF00))),
    ("Devanagari", ((0x900, 0x980),)),
    ("Bengali", ((0x980, 0xA00),)),
    ("Tamil", ((0xB80, 0xC00),)),
    ("Thai", ((0xE00, 0xE80),)),
    ("Georgian", ((0x10A0, 0x1100), (0x1C90, 0x1CC0))),
    ("Hangul", ((0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0))),
    ("Kana", ((0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0))),
    ("Han", ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))),
)
N_SCRIPTS = len(SCRIPT_RANGES) + 1


def _where(test) -> np.ndarray:
    return np.fromiter(map(test, map(chr, range(TOP))), bool, TOP)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return _where(str.isalpha)


@lru_cache(maxsize=1)
def lowered() -> np.ndarray:
    """The lower-case code point of each, itself where that is not one character."""
    return np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in map(chr, range(TOP))), np.uint32, TOP)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    out = np.full(TOP, MARK, np.uint8)
    out[0x80:] = HIGH
    out[letters()] = OTHER_LETTER
    out[_where(str.islower) & letters()] = LOWER
    out[_where(str.isupper) & letters()] = UPPER
    out[_where(str.isnumeric)] = DIGIT
    out[_where(str.isspace)] = SPACE
    out[10] = LINE
    return out


@lru_cache(maxsize=1)
def scripts() -> np.ndarray:
    """The index of each code point's script in SCRIPT_RANGES, the last for any other."""
    out = np.full(TOP, N_SCRIPTS - 1, np.uint8)
    for i, (_, ranges) in enumerate(SCRIPT_RANGES):
        for a, b in ranges:
            out[a:b] = i
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with a line feed after each text, and where each text begins (and past the last)."""
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), begins


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last index of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


_PLACES = 4096


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.full(_PLACES, 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each run; the runs are ascending and apart."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = last - first
    at = np.repeat(first, size) + (place := np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    sums = np.add.reduceat((codes[at].astype(np.uint64) + np.uint64(1)) * _powers()[place % _PLACES], np.cumsum(size) - size)
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return sums ^ (sums >> np.uint64(29))
