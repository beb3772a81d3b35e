"""64-bit hashes of words and of runs of words, over the bytes of many texts at once.

A word's hash is a polynomial of its bytes modulo 2^64: differences of one running sum, shifted
back to the word's start by the inverse of an odd base. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BYTES_AT_ONCE = 1 << 18
SPACES = b"\t\n\x0b\x0c\r "
_BASE, _RUN_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)

#: Capital letters as small ones, white space as spaces.
SMALL = bytes(32 if b in SPACES else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Also all other ASCII but letters and digits as spaces.
ALPHANUMERIC = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, as far as they have been needed."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            size = max(count, BYTES_AT_ONCE + 4096)
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, value, np.uint64))])
                for value in (self.base, inverse)
            )
        return self.up, self.down


_POWERS, _RUN_POWERS = _Powers(_BASE), _Powers(_RUN_BASE)


@dataclass
class Words:
    """Hashes of the words of several texts, in order, with where each word starts."""

    hashes: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    #: first word of each text, and the number of words
    bounds: np.ndarray
    #: first byte of each text in ``data``, and the end
    offsets: np.ndarray


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes, and bytes behind the last, of UTF-8 characters of scripts that put no spaces between words.

    These are Thai, Lao, Myanmar, Khmer, U+3000 to U+9FFF (kana, Chinese), U+F900 to U+FAFF, the full and half
    width forms and the planes of rarer Chinese characters; Korean puts spaces.
    """
    then = np.concatenate([data[1:], data[:1]])
    three = (data >= 0xE3) & (data <= 0xE9)
    three |= (data == 0xE0) & (then >= 0xB8) & (then <= 0xBB)
    three |= (data == 0xE1) & (((then >= 0x80) & (then <= 0x82)) | (then == 0x9E) | (then == 0x9F))
    three |= (data == 0xEF) & (((then >= 0xA4) & (then <= 0xAB)) | ((then >= 0xBC) & (then <= 0xBF)))
    four = (data == 0xF0) & (then >= 0xA0) & (then <= 0xBF)
    out = three | four
    out[3:] |= three[:-3]
    out[4:] |= four[:-4]
    return out


def words_of(texts: list[bytes], table: bytes, apart: bool = False) -> Words:
    """Runs of bytes that ``table`` doesn't turn into spaces; ``apart``: ``unspaced`` characters one by one."""
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(table), np.uint8)
    inside = data != 32
    if apart and data.max() >= 0xE0:
        cuts = unspaced(data)
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts[1:])) + 1
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cuts[1:])) + 1
    else:
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
    up, down = _POWERS.need(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    lengths = np.array([len(text) for text in texts], np.int64)
    offsets = np.concatenate([[1], np.cumsum(lengths + 1) + 1])
    return Words(hashes, starts, np.frombuffer(joined, np.uint8), np.searchsorted(starts, offsets), offsets)


def run_of_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    up, down = _POWERS.need(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def run_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each run ``hashes[first:last]``, in order; of an empty run, a fixed value."""
    up, down = _RUN_POWERS.need(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def by_bytes(texts: list[bytes], most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)
