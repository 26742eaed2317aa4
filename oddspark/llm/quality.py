"""Quality by a factorisation machine.

A document is a sparse vector: hashed words (term weights of length one), structure
statistics of the whole text, and its length class. Every feature has a weight and a
short factor; every two features interact by the product of their factors. The sum
over all pairs is half of (square of the sum - sum of the squares) for each factor
dimension, so scoring takes time linear in the number of features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import text_of
from oddspark.llm.sampling import crc_of_id, learnable
from oddspark.llm.wordfeatures import STRUCTURE, Hashed, letter_words, structure

#: Labelled rows used to fit the model: a bound, drawn by hash.
SAMPLE_ROWS = 20_000
WORD_BUCKETS = 1 << 14
#: Each statistic also enters as one of so many classes, so that a weight need not be linear in it.
LEVELS = 12
FACTORS = 8
SIZE = WORD_BUCKETS + len(STRUCTURE) * (1 + LEVELS)


def features(text: str, hashed: Hashed):
    """Indices and values of a text's features."""
    import numpy as np

    raw = text.encode("utf-8")
    words = letter_words(raw)
    found = Counter(words)
    ids = np.fromiter((hashed[w] % WORD_BUCKETS for w in found), np.int64, len(found))
    values = np.sqrt(np.fromiter(found.values(), np.float64, len(found)))
    ids, back = np.unique(ids, return_inverse=True)
    values = np.bincount(back, values, len(ids)) if len(ids) else np.zeros(0)
    values = values / max(1e-9, np.sqrt((values**2).sum()))
    stats = np.array(structure(raw, words))
    classes = np.minimum(LEVELS - 1, np.sqrt(np.clip(stats, 0, 1)) * LEVELS).astype(np.int64)
    plain = WORD_BUCKETS + np.arange(len(stats))
    levels = WORD_BUCKETS + len(stats) + LEVELS * np.arange(len(stats)) + classes
    return np.concatenate((ids, plain, levels)), np.concatenate((values, stats, np.full(len(stats), 0.5)))


class Machine:
    """Weights, factors and their fit by adaptive gradients on the logistic loss."""

    def __init__(self, size: int = SIZE, factors: int = FACTORS, seed: int = 7):
        import numpy as np

        self.bias = 0.0
        self.weight = np.zeros(size)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (size, factors))

    def scores(self, ids, values, row, rows: int):
        """Log odds of each row, and the factor sums that the gradient needs too."""
        import numpy as np

        part = self.factor[ids] * values[:, None]
        sums = np.stack([np.bincount(row, part[:, f], rows) for f in range(part.shape[1])], axis=1)
        squares = np.bincount(row, (part**2).sum(axis=1), rows)
        pairs = 0.5 * ((sums**2).sum(axis=1) - squares)
        return self.bias + np.bincount(row, self.weight[ids] * values, rows) + pairs, sums

    def fit(self, rows: list[tuple], target, passes: int = 10, batch: int = 128, rate: float = 0.08, l2: float = 1e-4):
        import numpy as np

        if not rows:
            self.factor[:] = 0
            return self
        draw = np.random.default_rng(3)
        share = min(max(float(np.mean(target)), 0.01), 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_f = np.full(len(self.weight), 1e-4), np.full(self.factor.shape, 1e-4)
        for _ in range(passes):
            order = draw.permutation(len(rows))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                ids = np.concatenate([rows[i][0] for i in take])
                values = np.concatenate([rows[i][1] for i in take]).astype(float)
                row = np.repeat(np.arange(len(take)), [len(rows[i][0]) for i in take])
                score, sums = self.scores(ids, values, row, len(take))
                slip = (1 / (1 + np.exp(-score.clip(-30, 30))) - target[take]) / len(take)
                self.bias -= rate * slip.sum()
                touched, back = np.unique(ids, return_inverse=True)
                g = np.bincount(back, slip[row] * values, len(touched)) + l2 * self.weight[touched]
                seen_w[touched] += g**2
                self.weight[touched] -= rate * g / np.sqrt(seen_w[touched])
                pull = (slip[row] * values)[:, None] * (sums[row] - self.factor[ids] * values[:, None])
                g = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(pull.shape[1])], axis=1) + l2 * self.factor[touched]
                seen_f[touched] += g**2
                self.factor[touched] -= rate * g / np.sqrt(seen_f[touched])
        return self


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Labels are learned only from ids whose CRC-32 modulo 4 is not 2, a bounded
    sample of them. Null texts count as empty and are scored by their statistics.
    Documents with a null id are never learned from and are not held out. Without
    any label every score is one half.
    """
    import numpy as np

    fold = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("held_out", fold)
    known = learnable(labels, "quality", fold, sample_rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            found = [features(text.as_py(), hashed) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ],
                ["y", "ids", "values"],
            )

    # at most sample_rows rows of two numbers
    taught = texts.where(~F.col("held_out")).join(F.broadcast(known), "doc_id").select("text", "y")
    sample = taught.mapInArrow(describe, "y int, ids binary, values binary").toArrow()
    rows = [
        (np.frombuffer(x.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32))
        for x, v in zip(sample.column("ids"), sample.column("values"))
    ]
    machine = Machine().fit(rows, sample.column("y").to_numpy().astype(float))
    del rows, sample
    shared = docs.sparkSession.sparkContext.broadcast(
        (machine.bias, machine.weight.astype(np.float32), machine.factor.astype(np.float32))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(1)
        own.bias, own.weight, own.factor = shared.value
        hashed = Hashed()
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column(2)):
                ids, values = features(text.as_py(), hashed)
                odds, _ = own.scores(ids, values, np.zeros(len(ids), np.int64), 1)
                p[i] = 1 / (1 + np.exp(-np.clip(odds[0], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return texts.select("doc_id", "held_out", "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
