"""Words of many texts at once: positions and 64-bit hashes, by numpy over UTF-8 bytes.

A word is a longest run of ASCII letters and digits and of bytes above 0x7F.
Upper case counts as lower case if the caller lowers the texts first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _range in ("09", "az", "AZ"):
    _IS_WORD[ord(_range[0]) : ord(_range[1]) + 1] = True
_POWERS: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]].

    start and end are byte positions in data, text the number of the text, and
    first[i]:first[i + 1] the words of text i.
    """
    n = len(data)
    word = _IS_WORD[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = word
    cut = offsets[:-1][offsets[:-1] < n]
    begins = word & ~before[:-1]
    begins[cut] = word[cut]
    start = np.flatnonzero(begins)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    inner = cut[cut > 0]
    after[inner - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_R, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(_RINV, n + 1)[start])
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), hashes, first)
