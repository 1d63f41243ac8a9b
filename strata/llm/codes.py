"""Token hashes of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strata.llm.common import WHITE_BYTES, flat_utf8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Texts are taken together up to so many bytes; a longer text is taken alone.
STEP = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def folded_codes() -> np.ndarray:
    """Byte codes under which A-Z and a-z are the same."""
    codes = byte_codes().copy()
    codes[65:91] = codes[97:123]
    return codes


def word_classes() -> np.ndarray:
    """1 for every byte but the six of white space."""
    kinds = np.ones(256, np.uint8)
    kinds[list(WHITE_BYTES)] = 0
    return kinds


def word_or_mark_classes() -> np.ndarray:
    """0 white space and controls, 1 letters, digits and bytes beyond ASCII, 2 marks."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 2
    kinds[128:] = 1
    for a, b in ((48, 58), (65, 91), (97, 123)):
        kinds[a:b] = 1
    return kinds


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(max(n, STEP + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def steps(texts: pa.Array, step: int = STEP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of at most ``step`` bytes, or of one text."""
    data, offsets = flat_utf8(pc.fill_null(texts, ""))
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def token_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each maximal run of one kind other than 0, and the n + 1 token offsets of the texts."""
    n = len(data)
    kind = kinds[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[offsets] = True
    at = np.flatnonzero(change)
    begin, end = at[:-1], at[1:]
    real = kind[begin] != 0 if n else np.zeros(0, bool)
    begin, end = begin[real], end[real]
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[data] * power[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * inverse[begin])
    return hashes, np.searchsorted(begin, offsets)
