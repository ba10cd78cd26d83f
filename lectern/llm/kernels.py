"""NumPy kernels on the UTF-8 bytes of one text: words, word hashes, window hashes.

All hashes are polynomial sums modulo 2**64 over random tables, so the hash of
any run comes from two prefix sums and one multiplication.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE, _WORD_BASE, _OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_MASK = (1 << 64) - 1

#: Bytes that part words: the six ASCII white space characters.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of plain words: ASCII letters and digits and every byte of a longer character.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True
PLAIN[128:] = True


class _Powers:
    """Powers of an odd base and of its inverse, grown as texts need them."""

    def __init__(self, base: int):
        self.base, self.n = base, 0
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(1 << 16, 1 << (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(self.n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers, _other_powers = (_Powers(b) for b in (_BYTE_BASE, _WORD_BASE, _OTHER_BASE))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_bounds(data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``word_bytes`` in ``data``."""
    inside = word_bytes[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _byte_powers.get(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(data: bytes, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words of a text."""
    array = np.frombuffer(data, dtype=np.uint8)
    starts, ends = word_bounds(array, word_bytes)
    return word_hashes(array, starts, ends), starts, ends


def window_hashes(words: np.ndarray, length: int, other: bool = False) -> np.ndarray:
    """A hash of every window of ``length`` consecutive words; ``other``: an independent one."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = (_other_powers if other else _word_powers).get(len(words))
    total = np.empty(len(words) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((words ^ np.uint64(0x5851F42D4C957F2D) if other else words) * up, out=total[1:])
    return mix((total[length:] - total[:n]) * down[:n])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the least hash of some run of ``width`` hashes.

    Any two texts that share ``width`` consecutive hashes select the same
    positions in them; equal hashes are all taken. Fewer hashes than ``width``:
    none.
    """
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64)
    least = sliding(hashes, width, np.minimum)
    padded = np.concatenate((np.zeros(width - 1, dtype=least.dtype), least, np.zeros(width - 1, dtype=least.dtype)))
    return np.flatnonzero(sliding(padded, width, np.maximum) == hashes)


def texts(column) -> list[bytes]:
    """The UTF-8 texts of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
