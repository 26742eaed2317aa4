"""Fixed-length byte windows of a text, grouped into pieces by their least fingerprint.

A window is a string of ``width`` bytes. Its key is the least hash of the ``gram``
byte strings in it, so equal windows have equal keys wherever they stand.
Consecutive windows whose key is found first at the same place form a piece; so the
windows of one piece differ from each other, also in periodic text.
"""

from __future__ import annotations

WIDTH, GRAM = 200, 64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = 0xD6E8FEB86659FD93


class Hasher:
    """Hashes of all substrings of a text from running sums modulo 2**64."""

    def __init__(self):
        import numpy as np

        self.table = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, np.uint64, endpoint=True)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        import numpy as np

        self.powers = np.ones(n + 1, np.uint64)
        self.powers[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        self.inverse = np.ones(n + 1, np.uint64)
        self.inverse[1:] = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 2**64), np.uint64))

    def sums(self, data):
        import numpy as np

        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def between(self, sums, start, end):
        """Mixed hash of each ``data[start:end]``; arrays of positions."""
        return mixed((sums[end] - sums[start]) * self.inverse[start])

    def grams(self, sums, gram: int):
        return mixed((sums[gram:] - sums[:-gram]) * self.inverse[: len(sums) - gram])


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def least_of_windows(values, span: int):
    """Minimum of each ``span`` consecutive values, by doubling."""
    import numpy as np

    length, out = 1, values
    while 2 * length <= span:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = span - length
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(hasher: Hasher, data, width: int = WIDTH, gram: int = GRAM):
    """``keys, hashes, starts, counts``: per piece its key, the hash of its bytes, its first window and its windows.

    ``data`` is an array of bytes; shorter than ``width``: no pieces. The bytes of a
    piece reach from its first window's start to its last window's end.
    """
    import numpy as np

    windows = len(data) - width + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = hasher.sums(data)
    grams = hasher.grams(sums, gram)
    key = least_of_windows(grams, width - gram + 1)
    # the place moves on if the key changes, or if the window has just left it
    first = np.flatnonzero((key[1:] != key[:-1]) | (grams[: windows - 1] == key[:-1])) + 1
    starts = np.concatenate((np.zeros(1, np.int64), first))
    counts = np.diff(np.concatenate((starts, [windows])))
    return key[starts], hasher.between(sums, starts, starts + counts - 1 + width), starts, counts
