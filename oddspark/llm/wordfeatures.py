"""Words, structure statistics and hashed features of a text, used inside Arrow batches."""

from __future__ import annotations

import zlib

#: Byte table: ASCII letters lower-cased, other ASCII to space, bytes of other letters as they are.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
BUCKETS = 1 << 18


def letter_words(raw: bytes) -> list[bytes]:
    """Runs of letters in lower case; one pass in C whatever the length."""
    return raw.translate(LETTERS).split()


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


class Hashed(dict):
    """Bucket of each word, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = found = bucket(word)
        return found


STRUCTURE = [
    "upper", "digits", "symbols", "marks_end", "spaces", "short_words", "long_words", "distinct_words", "repeated_lines",
    "distinct_lines", "words_a_line", "bars", "longest_word", "words", "chars", "urls",
]
_CLASS = bytes(
    0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\n\r\x0b\x0c" else 5 if c >= 128 else 4
    for c in range(256)
)


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """Statistics of the whole text, each between 0 and about 1."""
    import math

    n = max(1, len(raw))
    kinds = raw.translate(_CLASS)
    upper, digits, symbols, blanks = kinds.count(1), kinds.count(2), kinds.count(4), kinds.count(3)
    chunks = raw.split()
    m = max(1, len(chunks))
    marks = sum(1 for c in chunks if not (c[-1:].isalnum() or c[-1] >= 128 or c[-1:] in b".,"))
    lengths = list(map(len, chunks))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    different = len(set(lines))
    return [
        upper / n, digits / n, symbols / n, marks / m, blanks / n,
        sum(x <= 2 for x in lengths) / m, sum(x >= 12 for x in lengths) / m,
        len(set(words)) / max(1, len(words)), 1 - different / max(1, len(lines)), min(1.0, math.log1p(different) / 6),
        min(1.0, math.log1p(m / max(1, len(lines))) / 6), min(1.0, 10 * raw.count(b"|") / m),
        min(1.0, max(lengths, default=0) / 40), min(1.0, math.log1p(len(chunks)) / 10), min(1.0, math.log1p(len(raw)) / 12),
        min(1.0, 10 * raw.count(b"://") / m),
    ]
