"""Words of many texts as numpy arrays, for use inside tasks."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

#: An odd multiplier of the running hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes of words: digits, lower-case letters (after lower-casing) and whatever is not ASCII.
ALNUM = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


def batches(texts: Sequence[str | None], limit: int, lower: bool = True) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, A-Z lower-cased unless told not to, about `limit` bytes at a time; a long text stays whole."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode() if isinstance(text, str) else b""
        raw = raw.lower() if lower else raw
        if held and size + len(raw) > limit:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield start, held


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * MIX
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a batch: start and end byte, hash, number of the text, and first word of each text."""

    def __init__(self, raws: list[bytes], is_word: np.ndarray):
        self.buf = np.frombuffer(b"\n".join(raws) + b"\n", dtype=np.uint8)
        inside = is_word[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.array([len(r) + 1 for r in raws])
        self.text_end = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, self.text_end - sizes)
        self.count = np.diff(np.append(self.first, len(self.start)))
        self.text = np.repeat(np.arange(len(raws)), self.count)
        self._sums = None

    def _prefix(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sums is None:
            n = 1 << max(16, (len(self.buf)).bit_length())
            up, down = _powers(n)
            sums = np.zeros(len(self.buf) + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:len(self.buf)], out=sums[1:])
            self._sums = sums, down
        return self._sums

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte ranges, by default of the words; never zero."""
        sums, down = self._prefix()
        start = self.start if start is None else start
        end = self.end if end is None else end
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)) | np.uint64(1)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word, by text."""
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.first + self.count] - sums[self.first]
