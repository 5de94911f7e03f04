"""Texts as sequences of 128 letter symbols, and packed character n-grams of them."""

from __future__ import annotations

import functools

import numpy as np

from aisle.llm.batches import code_points, counts_between

SYMBOL_BITS = 7


@functools.cache
def _symbols() -> np.ndarray:
    """Symbol of every code point: 0 for all but letters.

    1-26 are a-z, 27-59 the small letters U+00DF to U+00FF; all other letters share
    the rest by a hash of their lower case, so the alphabet never grows.
    """
    table = np.zeros(0x110000, np.uint8)
    for code in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0x1E900, 0x1E944)]:
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            if 97 <= low <= 122:
                table[code] = low - 96
            elif 0xDF <= low <= 0xFF:
                table[code] = 27 + low - 0xDF
            else:
                table[code] = 60 + (low * 2654435761 >> 8) % 68
    for low, high in ((0x3400, 0xA000), (0x11000, 0x1D400), (0x20000, 0x32000)):
        codes = np.arange(low, high)
        letter = np.fromiter((chr(c).isalpha() for c in codes), bool, len(codes))
        table[low:high] = np.where(letter, 60 + (codes.astype(np.int64) * 2654435761 >> 8) % 68, 0)
    return table


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, bounds, letters) of the texts of a chunk.

    Each text begins with 0, and every run of other characters than letters
    is one 0. ``letters`` is the number of letters of each text.
    """
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = counts_between(code_points(data), offsets)
    bounds = np.append(0, np.cumsum(points))
    symbol = _symbols()[np.minimum(codes, 0x10FFFF)]
    letters = counts_between(symbol > 0, bounds)
    # one 0 before each text, then drop every 0 that follows another
    spread = np.zeros(len(symbol) + len(points) + 1, np.uint8)
    begin = bounds + np.arange(len(bounds))
    place = np.ones(len(spread), bool)
    place[begin] = False
    spread[place] = symbol
    keep = spread > 0
    keep[1:] |= spread[:-1] > 0
    keep[begin] = True
    kept_before = np.append(0, np.cumsum(keep))
    return spread[keep][:-1], kept_before[begin], letters


def grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """Packed n-grams; entry i covers ``symbols[i : i + size]``."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = np.zeros(n, np.int64)
    for k in range(size):
        packed <<= SYMBOL_BITS
        packed |= symbols[k : k + n]
    return packed


def histories(symbols: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams that end at each symbol but the texts' first, and their bounds.

    A text's own symbols are all it sees: before them stand zeros.
    """
    packed = grams(np.append(np.zeros(size - 1, np.uint8), symbols), size)
    begin = bounds[:-1]
    for known in range(1, size):
        at = begin + known - 1
        at = at[at < bounds[1:]]
        packed[at] &= (1 << SYMBOL_BITS * known) - 1
    keep = np.ones(len(packed), bool)
    keep[begin] = False
    return packed[keep], bounds - np.arange(len(bounds))
