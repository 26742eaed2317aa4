"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last few bytes ends a chunk wherever it takes a certain value
modulo the block size, so boundaries depend on the text near them alone. Every chunk
gives one letter, a fingerprint is the letters at a block size and at its double, and
two fingerprints are compared by edit distance where they have a block size in common.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import text_of

#: Bytes that decide a boundary, smallest block size, letters of a signature at most.
CONTEXT, LEAST_BLOCK, LETTERS = 7, 4, 64
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = 0x9E3779B97F4A7C15 | 1


class Fingerprinter:
    """Fingerprints of texts; keeps tables of powers that grow with the longest text."""

    def __init__(self):
        import numpy as np

        self.table = np.random.default_rng(77).integers(1, 2**64 - 1, 256, np.uint64, endpoint=True)
        self.alphabet = np.frombuffer(_ALPHABET, np.uint8)
        self._grow(1 << 15)

    def _grow(self, n: int) -> None:
        import numpy as np

        self.powers, self.inverse = (
            np.multiply.accumulate(np.array([1] + [base] * n, np.uint64)) for base in (_BASE, pow(_BASE, -1, 2**64))
        )

    @staticmethod
    def _mix(x):
        import numpy as np

        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def _letters(self, sums, marks, block: int) -> bytes:
        """One letter for each chunk; what follows the last letter but one is the last chunk, so the whole text counts."""
        import numpy as np

        n = len(sums) - 1
        ends = np.flatnonzero(marks % np.uint64(block) == block - 1) + CONTEXT
        ends = np.concatenate((ends[ends < n][: LETTERS - 1], [n])).astype(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        chunk = self._mix((sums[ends] - sums[starts]) * self.inverse[starts])
        return self.alphabet[(chunk >> np.uint64(40)) & np.uint64(63)].tobytes()

    def of(self, raw: bytes) -> str:
        """``block:letters:letters``; an empty text is ``4::``."""
        import numpy as np

        if not raw:
            return f"{LEAST_BLOCK}::"
        if len(raw) >= len(self.powers):
            self._grow(2 * len(raw))
        data = np.frombuffer(raw, np.uint8)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(raw)], out=sums[1:])
        marks = np.zeros(0, np.uint64)
        if len(raw) > CONTEXT:
            marks = self._mix((sums[CONTEXT:] - sums[:-CONTEXT]) * self.inverse[: len(raw) - CONTEXT + 1])
        block = LEAST_BLOCK
        while block * LETTERS < len(raw):
            block *= 2
        first = self._letters(sums, marks, block)
        while block > LEAST_BLOCK and len(first) < LETTERS // 2:
            block //= 2
            first = self._letters(sums, marks, block)
        return f"{block}:{first.decode()}:{self._letters(sums, marks, 2 * block).decode()}"


def distances(left: list[bytes], right: list[bytes]):
    """Edit distances of pairs of strings of at most 64 letters, all pairs at once.

    Columns of the table of distances are kept as bits of the rises and falls along
    ``left``, one machine word a pair; each letter of ``right`` moves a column on.
    """
    import numpy as np

    n = len(left)
    size = np.fromiter(map(len, left), np.int64, n)
    where = np.zeros((n, 128), np.uint64)
    for i, text in enumerate(left):
        for at, letter in enumerate(text):
            where[i, letter] |= np.uint64(1 << at)
    longest = max(map(len, right), default=0)
    letters = np.zeros((n, longest), np.int64)
    for i, text in enumerate(right):
        letters[i, : len(text)] = np.frombuffer(text, np.uint8)
    steps = np.fromiter(map(len, right), np.int64, n)
    one = np.uint64(1)
    top = one << np.maximum(size - 1, 0).astype(np.uint64)
    rise, fall, score = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64), size.copy()
    rows = np.arange(n)
    for j in range(longest):
        live = (j < steps) & (size > 0)
        same = where[rows, letters[:, j]]
        step = same | fall
        flat = (((same & rise) + rise) ^ rise) | same
        up, down = fall | ~(flat | rise), rise & flat
        score += np.where(live & (up & top > 0), 1, 0) - np.where(live & (down & top > 0), 1, 0)
        up, down = up << one | one, down << one
        rise = np.where(live, down | ~(step | up), rise)
        fall = np.where(live, up & step, fall)
    return np.where(size > 0, score, steps)


def likeness(pairs: list[tuple[str, str]]):
    """Between 0 and 1 for each pair of fingerprints: 1 if equal, 0 if no block size is in common.

    At each common block size, one less the edit distance over the mean length of
    the signatures (not below 0); the best counts.
    """
    import numpy as np

    best = np.zeros(len(pairs))
    at, left, right = [], [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            best[i] = 1.0
            continue
        (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
        x, y = int(x), int(y)
        for s, t in [(x1, y1), (x2, y2)] if x == y else [(x2, y1)] if 2 * x == y else [(x1, y2)] if x == 2 * y else []:
            at.append(i)
            left.append(s.encode())
            right.append(t.encode())
    if at:
        length = np.fromiter((len(s) + len(t) for s, t in zip(left, right)), np.float64, len(at))
        near = 1 - 2 * distances(left, right) / np.maximum(length, 1)
        np.maximum.at(best, np.array(at), np.clip(near, 0, None))
    return best


#: Ranges of ids for each shuffle partition.
RANGES = 4
_NONE = -(2**63)
_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _ranges(rows: DataFrame) -> list[tuple[int, int]]:
    """First (id, hash of text) of each of a fixed number of ranges that split the rows evenly."""
    most = RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = (
        rows.select(F.struct("i", "h").alias("place"))
        .repartitionByRange(most, "place")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min("place").alias("place"))
    )
    return sorted((r["place"]["i"], r["place"]["h"]) for r in firsts.collect())


def edit(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the first of the following text (or all it has)."""
    part = len(text) // 4
    return text[: len(text) - part] + following[:part]


def chained(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. The following document is the next in order of id, then of a hash
    of the text; null ids come first, and after the last comes the first (a single
    document follows itself). Null texts count as empty. Equal texts have equal
    fingerprints; two empty texts are alike.

    Ids are cut into ranges by measured quantiles, a fixed number for each shuffle
    partition. A task streams through a range in order with one row of memory, and
    the first row of each range also goes to the end of the range before it, so the
    texts move once and none waits for its neighbour.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.withColumn("i", F.coalesce("doc_id", F.lit(_NONE))).withColumn("h", F.xxhash64("text"))
    firsts = _ranges(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            part = [max(0, bisect_right(firsts, p) - 1) for p in places]
            opens = [n for n, p in enumerate(places) if firsts[part[n]] == p]
            at = pa.array([*range(len(places)), *opens], pa.int64())
            part += [(part[n] - 1) % len(firsts) for n in opens]
            ahead = [False] * len(places) + [True] * len(opens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(ahead), *(c.take(at) for c in batch.columns)],
                ["part", "ahead", *batch.schema.names],
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Fingerprinter()

        def describe(steps: list[tuple]) -> pa.RecordBatch:
            """Of (id, text, fingerprint, next text, next fingerprint)."""
            ids, sha, prints = [], [], []
            for doc_id, text, _, following, _ in steps:
                raw = edit(text, following).encode("utf-8")
                ids.append(doc_id)
                sha.append(hashlib.sha256(raw).hexdigest())
                prints.append(hashing.of(raw))
            near = likeness([(s[2], p) for s, p in zip(steps, prints)] + [(s[2], s[4]) for s in steps])
            n = len(steps)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(s[1]) for s in steps], pa.int64()), pa.array(sha, pa.string()),
                    pa.array([s[2] for s in steps], pa.string()), pa.array(prints, pa.string()), pa.array(near[:n]), pa.array(near[n:]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        held = None  # part, id, text, fingerprint of a row that waits for the next
        for batch in batches:
            steps = []
            for part, ahead, doc_id, text in zip(*(batch.column(c) for c in ("part", "ahead", "doc_id", "text"))):
                part, ahead, text = part.as_py(), ahead.as_py(), text.as_py()
                if ahead and (held is None or held[0] != part):
                    continue  # the range before is done: repeats of its first row
                own = hashing.of(text.encode("utf-8"))
                if held is not None and held[0] == part:
                    steps.append((*held[1:], text, own))
                held = None if ahead else (part, doc_id.as_py(), text, own)
            if steps:
                yield describe(steps)

    dealt = rows.mapInArrow(deal, "part long, ahead boolean, doc_id long, text string, i long, h long")
    return (
        dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
        .sortWithinPartitions("part", "ahead", "i", "h")
        .mapInArrow(walk, _OUT)
    )
