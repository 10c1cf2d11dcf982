"""Words of many texts at once: boundaries and 64-bit hashes by array operations.

A word is a run of bytes other than \\x20 and \\x09 to \\x0D in the UTF-8 text. Its hash is a difference of
prefix sums of byte * P**i modulo 2**64, brought to a common power and mixed, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

#: Bytes of text taken together.
BLOCK = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C55)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up.size < n:
            n = 1 << (n - 1).bit_length()  # each worker keeps them, so no more than twice what its texts need
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _P, np.uint64))]) if n > 1 else cls.up
                cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, inverse, np.uint64))]) if n > 1 else cls.down
        return cls.up, cls.down


class Words(NamedTuple):
    """Of one block: the hash of each word, the text (position in the block) it is in, its first byte and the byte past it."""

    hashes: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words(raw: list[bytes], lower: bool) -> Words:
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.need(buf.size)
    with np.errstate(over="ignore"):
        total = np.cumsum(buf * up[: buf.size], dtype=np.uint64)
        # a space stands before every word but one at 0, so the sum up to the word ends at start - 1
        before = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))
        hashes = mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(x) + 1 for x in raw])
    return Words(hashes, np.searchsorted(ends, start, side="right"), start, end)


def pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most BLOCK bytes cut at white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = max(raw.rfind(x, at + 1, at + BLOCK) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            after = [i for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := raw.find(x, at + BLOCK)) >= 0]
            if not after:
                break
            cut = min(after)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def grouped(items: Iterable[tuple[object, bytes]]) -> Iterator[tuple[list[object], list[bytes]]]:
    """(keys, texts) of consecutive items with about BLOCK bytes together."""
    keys: list[object] = []
    raw: list[bytes] = []
    size = 0
    for key, x in items:
        if raw and size + len(x) > BLOCK:
            yield keys, raw
            keys, raw, size = [], [], 0
        keys.append(key)
        raw.append(x)
        size += len(x) + 1
    if raw:
        yield keys, raw
