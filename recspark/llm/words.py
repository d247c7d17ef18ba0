"""Words and rolling hashes of many texts at once, as NumPy arrays over one byte buffer.

A batch of texts is laid out as UTF-8 bytes with one space after each. Hashes of byte ranges come
from prefix sums of ``byte * B**position`` (modulo 2**64) divided by ``B**start``, so no step loops
over words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
# Texts are hashed in batches of about this many bytes; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grows and is kept up to the usual batch size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BATCH_BYTES + 4096)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BATCH_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def batches(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """UTF-8 bytes of the texts (null: empty) in lists of about ``BATCH_BYTES``."""
    part: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        if part and size + len(raw) > BATCH_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield part


class Words:
    """Word positions of a list of texts.

    ``start`` and ``end`` index ``data``; ``first[i]:first[i + 1]`` are the words of text ``i``.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.data = LOWER[data] if lower else data
        space = IS_SPACE[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        if len(at) % 2:
            at = np.append(at, len(data))
        self.start, self.end = at[0::2], at[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.text_end = np.cumsum(sizes + 1) - 1
        self.text_start = self.text_end - sizes
        self.first = np.concatenate(([0], np.searchsorted(self.start, self.text_end)))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def _prefix_sums(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(BASE, n),
                  out=sums[1:])
        return sums

    def hashes(self, *heads: int) -> np.ndarray | list[np.ndarray]:
        """64-bit hash of every word, the same for equal bytes anywhere.

        With ``heads``, a list: the words' hashes and those of their first ``n`` bytes for each.
        """
        sums = self._prefix_sums()
        scale = _power_table(INVERSE, len(sums))[self.start]
        first = sums[self.start]
        out = []
        for n in (None, *heads):
            end = self.end if n is None else np.minimum(self.end, self.start + n)
            out.append(mixed((sums[end] - first) * scale + (end - self.start).astype(np.uint64)))
        return out if heads else out[0]

    def gram_hashes(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes at every position (``len(data) - n + 1`` of them)."""
        data = self.data.astype(np.uint64) + np.uint64(1)
        m = max(len(data) - n + 1, 0)
        h = np.zeros(m, dtype=np.uint64)
        for k in range(n):
            h *= np.uint64(BASE)
            h += data[k:m + k]
        return mixed(h)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of ``width`` consecutive words (A-Z in lower case).

    Fewer words count as one sequence; a text without words has none.
    """
    w = Words(texts)
    h = w.hashes()
    whole = np.full(max(len(h) - width + 1, 0), width, dtype=np.uint64)
    for k in range(width):
        whole = mixed(whole * np.uint64(BASE) + h[k:k + len(whole)])
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(whole[a:b - width + 1])
            fresh = np.empty(len(s), dtype=bool)
            fresh[0] = True
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            yield s[fresh]
        else:
            one = np.full(min(b - a, 1), b - a, dtype=np.uint64)
            for k in range(b - a):
                one = mixed(one * np.uint64(BASE) + h[a + k])
            yield one
