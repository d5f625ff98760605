"""Hashes of many substrings at once, with numpy.

``Rolling`` holds prefix sums of a polynomial over 64-bit values, one per unit (byte or word); the
hash of any range of units follows from two of them. Equal ranges have equal hashes anywhere.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):  # in place, to hold few arrays of a block's size
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


#: A value for each byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0, 1, ... n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        up = powers(_BASE, n)
        up *= values
        np.cumsum(up, out=self.sums[1:])
        self.down = powers(_INVERSE, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def windows(self, length: int) -> np.ndarray:
        """The hash of the ``length`` units from each start that has so many."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.sums[length:] - self.sums[:n]
        out *= self.down[:n]
        return mixed(out)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a line feed, and where each text starts."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return data, np.cumsum(sizes) - sizes


#: Bytes of words of letters and digits; all bytes of longer characters count as such.
ALNUM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
#: The same without digits.
LETTERS = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
