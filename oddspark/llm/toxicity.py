"""Toxicity by weak supervision.

Many voters look at a text: themed word lists, patterns, and words and word stems
found to be typical of the labelled toxic documents. A generative label model, a tree of voters
under a hidden label (each voter depends on the label and on the voter it is most
correlated with), is fitted by expectation maximisation to the vote patterns of all
documents, known labels being held fixed; it yields accuracies, correlations and
the posterior label of every pattern. A linear classifier on words and votes is
trained on posterior labels of a bounded sample and scores every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.llm.common import in_sketch, publish, sketch_of, text_of
from oddspark.llm.sampling import crc_of_id, learnable
from oddspark.llm.wordfeatures import BUCKETS, Hashed, letter_words

# --- Fixed values: word lists by theme ------------------------------------------
LEXICONS = {
    "intellect": "idiot idiots moron morons imbecile stupid dumb dimwit fool foolish brainless cretin halfwit dunce".split(),
    "worth": "worthless useless loser losers pathetic failure nobody garbage trash rubbish waste".split(),
    "disgust": "disgusting gross vile filthy scum filth vermin repulsive revolting nasty sickening".split(),
    "mockery": "clown clowns joke laughable ridiculous buffoon jerk freak creep".split(),
    "menace": "kill die hurt destroy beat smash punish hang burn".split(),
    "contempt": "hate despise loathe detest shame disgrace coward liar traitor".split(),
}
# --- Fixed values: patterns -------------------------------------------------------
PATTERNS = {
    "you_are": rb"\b(?:you|u)\s+(?:are|r)\s+(?:such\s+)?(?:an?|the|so)\b",
    "shut_up": rb"\b(?:shut\s+up|get\s+lost|go\s+away|go\s+to\s+hell)\b",
    "masked_word": rb"\b[a-z]{1,3}[*#@$]{2,}[a-z]{0,3}\b",
    "shouting": rb"(?:\b[A-Z]{4,}\b[ ,!]+){4}",
    "exclaiming": rb"!{3,}",
}
#: Documents used to fit the classifier: a bound, drawn by hash.
SAMPLE_ROWS = 20_000
#: Typical words and stems that become voters; with lists and patterns a vote pattern fits in 63 bits.
TYPICAL = 48
#: A stem is a word beginning of so many letters.
STEM_LETTERS = range(3, 9)
#: A stem votes where it occurs twice and in so large a share of the words; all stems together, three times and double that share.
STEM_SHARE = 1 / 200
#: Levels of the joint share of stems that the classifier sees.
LEVELS = 8
ROUNDS = 6
#: A document of unknown label counts as so many of known label at most, and all unknown ones together as this share
#: of all known ones, lest the unknown ones pull the classes apart where few documents are labelled.
UNKNOWN_WEIGHT = 0.1


class Voters:
    """What votes on a text: word lists, patterns, typical words and stems, and all stems together."""

    def __init__(self, words: list[str], stems: list[str]):
        self.names = [*LEXICONS, *PATTERNS, *words, *(s + "-" for s in stems), "any stem"]
        self.lists = len(LEXICONS)
        self.words: dict[bytes, int] = {}
        first = len(LEXICONS) + len(PATTERNS)
        for at, listed in [*enumerate(LEXICONS.values()), *((first + i, [w]) for i, w in enumerate(words))]:
            for word in listed:
                self.words[word.encode()] = self.words.get(word.encode(), 0) | 1 << at
        self.stems = {s.encode(): first + len(words) + i for i, s in enumerate(stems)}
        self.widths = sorted({len(s) for s in self.stems})
        self.joint = first + len(words) + len(stems)
        self.patterns = [(re.compile(p), 1 << (self.lists + i)) for i, p in enumerate(PATTERNS.values())]
        self.known: dict[bytes, int] = {}

    def _of(self, word: bytes) -> int:
        """Bits of the lists, words and stems that a word belongs to."""
        out = self.words.get(word, 0)
        for width in self.widths:
            if width < len(word) and (at := self.stems.get(word[:width])) is not None:
                out |= 1 << at
        if len(self.known) >= 200_000:
            self.known.clear()
        self.known[word] = out
        return out

    def vote(self, raw: bytes, counted: Counter, total: int) -> tuple[int, int]:
        """The votes as bits, and the level of the joint share of stems."""
        known, of, out, stemmed = self.known, self._of, 0, 0
        times: dict[int, int] = {}
        for word, n in counted.items():
            bits = known.get(word)
            if bits is None:
                bits = of(word)
            if bits:
                out |= bits & ((1 << (self.joint - len(self.stems))) - 1)
                deep = bits >> (self.joint - len(self.stems))
                if deep:
                    stemmed += n
                    at = self.joint - len(self.stems)
                    while deep:
                        if deep & 1:
                            times[at] = times.get(at, 0) + n
                        deep, at = deep >> 1, at + 1
        for at, n in times.items():
            if n >= 2 and n >= total * STEM_SHARE:
                out |= 1 << at
        if stemmed >= 3 and stemmed >= 2 * total * STEM_SHARE:
            out |= 1 << self.joint
        for pattern, bit in self.patterns:
            if pattern.search(raw):
                out |= bit
        level = 0 if stemmed < 2 else min(LEVELS - 1, 1 + int(2 * stemmed / (total * STEM_SHARE)))
        return out, level


def typical(labelled: DataFrame, most: int = TYPICAL, least_docs: int = 8) -> tuple[list[str], list[str]]:
    """Words whose presence, and stems whose frequency, is far commoner under ``y`` = 1; bounded lists.

    Each candidate is weighed by its documents times the logarithm of the ratio. A
    candidate that begins with a stem already taken adds nothing and is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = Counter(w for w in letter_words(text.as_py().encode("utf-8")) if len(w) <= 64)
                total, stems = words.total(), Counter()
                for word, n in words.items():
                    word = word.decode("utf-8", "replace")
                    seen.setdefault("=" + word, [0, 0])[y] += 1
                    for letters in STEM_LETTERS:
                        if letters < len(word):
                            stems[word[:letters]] += n
                for stem, n in stems.items():
                    if n >= 2 and n >= total * STEM_SHARE:
                        seen.setdefault("^" + stem, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *(pa.array([v[y] for v in seen.values()], pa.int64()) for y in (0, 1))],
                ["unit", "n0", "n1"],
            )

    units = labelled.select("text", "y").mapInArrow(count, "unit string, n0 long, n1 long")
    units = units.groupBy("unit").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    units = units.where((F.col("n1") >= least_docs) & (F.col("n1") > 4 * F.col("n0")))
    gain = F.col("n1") * F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5))
    words, stems = [], []
    for unit in (r["unit"] for r in units.orderBy(F.desc(gain), "unit").limit(40 * most).collect()):
        body = unit[1:]
        if len(words) + len(stems) < most and not any(body.startswith(s) or (unit[0] == "^" and s.startswith(body)) for s in stems):
            (words if unit[0] == "=" else stems).append(body)
    return words, stems


class LabelModel:
    """Label, and voters in a tree; tables of probabilities kept as log odds."""

    def __init__(self, pairs, totals):
        """``pairs[y, i, j]``: weight of label y with voters i and j both firing; ``totals[y]``: weight of y."""
        import numpy as np

        n = pairs.shape[1]
        total = totals + 2.0
        self.prior = float(np.log(total[1] / total[0]))
        fire = np.einsum("yii->yi", pairs)
        p11 = pairs
        cells = np.stack(
            [totals[:, None, None] - fire[:, :, None] - fire[:, None, :] + p11, fire[:, None, :] - p11, fire[:, :, None] - p11, p11]
        ).clip(0)
        share = (cells + 0.25) / (cells + 0.25).sum(axis=0)
        pi, pj = share[2] + share[3], share[1] + share[3]
        alone = np.stack([(1 - pi) * (1 - pj), (1 - pi) * pj, pi * (1 - pj), pi * pj])
        weight = totals / max(1.0, totals.sum())
        self.correlation = np.einsum("y,kyij,kyij->ij", weight, share, np.log(share / alone))
        np.fill_diagonal(self.correlation, -1)
        self.parent = np.full(n, -1)
        inside, best, near = np.zeros(n, bool), np.full(n, -np.inf), np.full(n, -1)
        for _ in range(n):
            i = int(np.where(inside, -np.inf, np.where(best == -np.inf, -1, best)).argmax())
            inside[i], self.parent[i] = True, near[i]
            closer = ~inside & (self.correlation[i] > best)
            best[closer], near[closer] = self.correlation[i][closer], i
        self.accuracy = (fire + 0.02) / (totals[:, None] + 1.0)
        own = np.log(np.stack([1 - self.accuracy, self.accuracy]))
        self.odds = np.zeros((n, 2, 2))  # voter, vote of the parent, own vote
        for i, p in enumerate(self.parent):
            for up in (0, 1):
                if p < 0:
                    self.odds[i, up] = own[:, 1, i] - own[:, 0, i]
                    continue
                there = fire[:, p] if up else totals - fire[:, p]
                both = p11[:, i, p] if up else fire[:, i] - p11[:, i, p]
                # as if each voter had fired once more at its own rate
                rate = (both.clip(0) + 2 * self.accuracy[:, i]) / (there.clip(0) + 2)
                self.odds[i, up, 1] = np.log(rate[1] / rate[0])
                self.odds[i, up, 0] = np.log((1 - rate[1]) / (1 - rate[0]))

    def posterior(self, votes):
        """Probability of label 1 for each row of a 0/1 matrix of votes."""
        import numpy as np

        score = np.full(len(votes), self.prior)
        for i, p in enumerate(self.parent):
            up = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            score += self.odds[i, up, votes[:, i]]
        return 1 / (1 + np.exp(-score.clip(-30, 30)))


def _bits(masks, n: int):
    import numpy as np

    return ((masks[:, None] >> np.arange(n)) & 1).astype(np.int64)


def fit_label_model(patterns: DataFrame, voters: int, lexicons: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over ``mask, y, n`` (y null where unknown); one Spark aggregation a round.

    Before the first round an unknown label is held likely where a word list fires.
    """
    import numpy as np

    weights = patterns.agg(F.sum(F.when(F.col("y").isNull(), F.col("n"))), F.sum(F.when(F.col("y").isNotNull(), F.col("n")))).first()
    unknown, known = (w or 0 for w in weights)
    weight = UNKNOWN_WEIGHT * (min(1.0, known / unknown) if known and unknown else 1.0)
    model: LabelModel | None = None
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total, pairs = np.zeros(2), np.zeros((2, voters, voters))
            for batch in batches:
                votes = _bits(batch.column(0).to_numpy(), voters)
                y = np.array([-1 if v is None else v for v in batch.column(1).to_pylist()], int).reshape(-1)
                n = batch.column(2).to_numpy() * np.where(y >= 0, 1.0, weight)
                p = model.posterior(votes) if model else np.where(votes[:, :lexicons].any(axis=1), 0.7, 0.02)
                p = np.where(y >= 0, y, p)
                for label, w in ((0, n * (1 - p)), (1, n * p)):
                    total[label] += w.sum()
                    pairs[label] += (votes * w[:, None]).T @ votes
            values = np.concatenate((total, pairs.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["at", "value"])

        sums = patterns.mapInArrow(expect, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        values = np.zeros(2 + 2 * voters * voters)
        values[sums["at"].to_numpy(int)] = sums["value"].to_numpy(float)
        model = LabelModel(values[2:].reshape(2, voters, voters), values[:2])
    return model


def fit_linear(rows: list[tuple], size: int, words: int, least_docs: int = 20, steps: int = 4000, l2: float = 3e-3, batch: int = 64):
    """Logistic regression on index arrays and soft labels by adaptive gradients; returns weights and intercept.

    Of the first ``words`` features (hashed words) only those in ``least_docs``
    documents take part: rarer ones would learn single documents by heart.
    """
    import numpy as np

    weight, bias = np.zeros(size), 0.0
    if not rows:
        return weight, -2.0
    seen = np.zeros(size, np.int64)
    for x, _ in rows:
        seen[x] += 1
    kept = seen >= least_docs
    kept[words:] = True
    target = np.array([y for _, y in rows])
    draw = np.random.default_rng(3)
    lists = [x[kept[x]] for x, _ in rows]
    squares, bias_squares = np.full(size, 1e-4), 1e-4
    for _ in range(-(-steps * batch // len(rows))):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            ids = np.concatenate([lists[i] for i in take])
            row = np.repeat(np.arange(len(take)), [len(lists[i]) for i in take])
            score = np.bincount(row, weight[ids], len(take)) + bias
            slip = 1 / (1 + np.exp(-score.clip(-30, 30))) - target[take]
            touched, back = np.unique(ids, return_inverse=True)
            slope = np.bincount(back, slip[row], len(touched)) / len(take)
            slope += np.where(touched < words, l2, l2 / 1000) * weight[touched]
            squares[touched] += slope**2
            weight[touched] -= 0.2 * slope / np.sqrt(squares[touched])
            bias_squares += slip.mean() ** 2
            bias -= 0.2 * slip.mean() / bias_squares**0.5
    return weight, bias


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, carry: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted, posterior, votes`` for every row; with ``carry`` also the row as ``row``.

    Labels are learned only from ids whose CRC-32 modulo 5 is not 0; other documents
    take no part in any fit. Null texts count as empty: no voter fires and the score
    is that of the intercept. All labels teach the label model; ``sample_rows``
    bounds the classifier's sample alone. Documents with a null id are never learned from and
    are not held out. Without any label the lists alone start the label model.
    """
    import numpy as np

    fold = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("held_out", fold)
    known = learnable(labels, "toxic", fold)
    hashed_id = F.xxhash64("doc_id").alias("h")
    near = in_sketch(texts.where(~F.col("held_out")).select("doc_id", "text", hashed_id), sketch_of(known.select(hashed_id)))
    # texts without a label stay where they are; the others meet their labels by the same plan at every size
    taught = near.join(known.hint("merge"), "doc_id")
    voters = Voters(*typical(taught))
    n = len(voters.names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for text in batch.column(2):
                raw = text.as_py().encode("utf-8")
                words = letter_words(raw)
                masks.append(voters.vote(raw, Counter(words), len(words))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int64())], ["doc_id", "held_out", "mask"])

    votes = publish(texts.select("doc_id", "held_out", "text").mapInArrow(look, "doc_id long, held_out boolean, mask long"), "votes")
    open_votes = votes.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    patterns = publish(
        open_votes.join(known, "doc_id", "left").groupBy("mask", "y").agg(F.count(F.lit(1)).alias("n")), "patterns"
    ).select("mask", "y", "n")
    model = fit_label_model(patterns, n, len(LEXICONS))

    # a hash threshold that lets about sample_rows documents through, equal rows once
    share = min(1.0, sample_rows / max(1, open_votes.count()))
    learned = texts.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    drawn = learned.where(F.xxhash64("doc_id", "text", F.lit(11)) <= F.lit(min(2**63 - 1, int((share - 0.5) * 2**64)))).select("doc_id", "text").distinct()

    def described(raw: bytes, hashed: Hashed):
        """Votes, and the features: buckets of words, one index per vote, one per level of stems."""
        words = letter_words(raw)
        counted = Counter(words)
        mask, level = voters.vote(raw, counted, len(words))
        ids = np.unique(np.fromiter((hashed[w] for w in counted), np.int32, len(counted)))
        own = [BUCKETS + i for i in range(n) if mask >> i & 1] + [BUCKETS + n + level]
        return mask, np.concatenate((ids, np.array(own, np.int32)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            found = [described(text.as_py().encode("utf-8"), hashed) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["mask", "ids"]
            )

    sample = drawn.select("text").mapInArrow(features, "mask long, ids binary").toArrow()
    masks = sample.column("mask").to_numpy().astype(np.int64)
    target = model.posterior(_bits(masks, n)) if len(masks) else []
    rows = [(np.frombuffer(x.as_py(), np.int32), float(p)) for x, p in zip(sample.column("ids"), target)]
    weight, bias = fit_linear(rows, BUCKETS + n + LEVELS, BUCKETS)
    del rows, sample
    used = np.flatnonzero(weight)
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), weight[used].astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        full = np.zeros(BUCKETS + n + LEVELS)
        full[at] = values
        hashed = Hashed()
        for batch in batches:
            out, masks = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(2)):
                masks[i], ids = described(text.as_py().encode("utf-8"), hashed)
                out[i] = full[ids].sum() + bias
            p = 1 / (1 + np.exp(-out.clip(-30, 30)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(model.posterior(_bits(masks, n))), pa.array(np.bitwise_count(masks).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted", "posterior", "votes"],
            )

    scored = "doc_id long, held_out boolean, score double, predicted int, posterior double, votes int"
    if not carry:
        return texts.select("doc_id", "held_out", "text").mapInArrow(score, scored)

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in score([batch]):
                yield pa.RecordBatch.from_arrays([*found.columns, batch.column(3)], [*found.schema.names, "row"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.struct("*").alias("row"))
    whole = whole.withColumn("held_out", fold).select("doc_id", "held_out", "text", "row")
    return whole.mapInArrow(beside, T._parse_datatype_string(scored).add("row", whole.schema["row"].dataType))
