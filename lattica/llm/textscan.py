"""Vectorised scans over the UTF-8 bytes of many texts at once.

All word patterns of the operators separate words at ASCII bytes, and UTF-8
never uses an ASCII byte inside another character, so scanning bytes gives the
same words as scanning code points.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Splitmix finaliser: spreads 64-bit values."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def byte_values(lower: bool) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte; A-Z as a-z where ``lower``."""
    values = mix(np.arange(256, dtype=np.uint64), 7)
    if lower:
        values[65:91] = values[97:123]
    return values


def class_table(pattern_bytes: list[int]) -> np.ndarray:
    """A 256-entry boolean table that is true for all bytes but those given."""
    table = np.ones(256, dtype=bool)
    table[pattern_bytes] = False
    return table


#: Bytes that separate words in `[^\x20\x09-\x0D]+`.
BLANK_WORDS = class_table([0x20, *range(0x09, 0x0E)])
#: Bytes that separate words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM_WORDS = class_table([b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A)])


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a text boundary."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(raw) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        terms = byte_values(lower)[raw]
        terms *= up[: len(raw)]
        np.cumsum(terms, out=prefix[1:])
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive values from each place; the last ``n``-1 places have none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:count].copy()
        for k in range(1, n):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[k : k + count]
    return mix(out, n)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``starts``."""
    change = np.zeros(n + width + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change)[:n] > 0


def per_text(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted byte positions each text holds, as cumulative bounds."""
    return np.searchsorted(positions, offsets, side="left")
