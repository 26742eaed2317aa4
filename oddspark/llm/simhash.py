"""SimHash near duplicates with pigeonring filtering.

Fingerprints are 64 bits in 16 segments on a ring. If two differ in at most 3 bits,
then from some segment on every chain of ``l`` consecutive segments differs in at
most ``3 * l / 16`` bits (the pigeonring principle): the first five segments are
equal, the next five hold one difference at most, and so on. So each distinct
fingerprint is filed 16 times, under its first five segments from each start, and
within a file the chain budgets prune pairs before the full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import publish, text_of
from oddspark.llm.components import components

SEGMENTS, SEGMENT_BITS = 16, 4
SEED = 42
#: Members of a file above which it is cut into blocks that are compared pair by pair.
FILE_BLOCK = 4096
#: Files up to this size are compared by shifting the sorted column against itself.
SMALL_FILE = 64


def majority(hashes):
    """The bits that are set in over half of the 64-bit hashes; 0 if there are none."""
    import numpy as np

    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: the majority bits of the XXH64 of all word shingles, repeats included.

    Texts without words get 0; texts with fewer words than a shingle are one shingle.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest as xxh

        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(1)):
                words = text.as_py().encode("utf-8").lower().split()
                if not words:
                    continue
                if len(words) <= shingle:
                    out[i] = xxh(b" ".join(words), seed)
                    continue
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate(([0], ends[:-shingle])).tolist()
                hashes = np.fromiter(
                    (xxh(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts)
                )
                out[i] = majority(hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(sign, "doc_id long, fp long")


def _files(distinct: DataFrame) -> DataFrame:
    """``start, key, turned``: each fingerprint turned to begin at each segment, filed under its first five."""
    turned = [
        F.struct(
            F.lit(i).alias("start"),
            (F.shiftleft("fp", SEGMENT_BITS * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - SEGMENT_BITS * i)) if i else F.col("fp")).alias("turned"),
        )
        for i in range(SEGMENTS)
    ]
    rows = distinct.select(F.explode(F.array(*turned)).alias("t")).select("t.start", "t.turned")
    same = (SEGMENTS + 2) // 3 - 1
    return rows.withColumn("key", F.shiftrightunsigned("turned", 64 - SEGMENT_BITS * same))


def _chains(differences, most: int):
    """Mask of the xor values whose chains keep within their budgets, checked from short to long."""
    import numpy as np

    keep = np.arange(len(differences))
    held = 0
    for chain in range(1, SEGMENTS + 1):
        budget = chain * most // SEGMENTS
        if chain < SEGMENTS and (chain + 1) * most // SEGMENTS == budget:
            held = chain
            continue
        bits = np.bitwise_count(differences[keep] >> np.uint64(64 - SEGMENT_BITS * chain))
        keep = keep[bits <= budget]
    return keep


def _search(file, most: int):
    """Links that connect what is connected within one file: breadth first over the members not yet reached."""
    import numpy as np

    left, a, b = file, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = _chains(left ^ node, most)
            if len(near):
                found = left[near]
                a.append(np.full(len(found), node))
                b.append(found)
                queue.extend(found)
                left = np.delete(left, near)
    return (np.concatenate(a), np.concatenate(b)) if a else (file[:0], file[:0])


def links(distinct: DataFrame, most: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` with the same components as all pairs within ``most`` bits.

    Every such pair meets in a file; within a file a link is left out only where
    its ends are already connected. A file that outgrows a block is cut into blocks,
    and every two blocks (and each with itself) are searched together elsewhere.
    """
    filed = publish(_files(distinct), "files")
    large = (
        filed.groupBy("start", "key").count().where(F.col("count") > FILE_BLOCK)
        .select(F.col("start").alias("_s"), F.col("key").alias("_k"), F.ceil(F.col("count") / FILE_BLOCK).cast("long").alias("_blocks"))
    )
    joined = filed.join(large, (F.col("start") == F.col("_s")) & (F.col("key") == F.col("_k")), "left")
    blocks = F.coalesce("_blocks", F.lit(1).cast("long"))
    own = F.pmod(F.xxhash64("turned"), blocks)
    dealt = joined.select(
        "start", "key", "turned", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_other")
    ).select("start", "key", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), "turned")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def solve(key, turned):
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(key) > 1 else np.zeros(0, int)
            first = np.concatenate(([0], new))
            size = np.diff(np.concatenate((first, [len(key)])))
            group = np.repeat(np.arange(len(first)), size)
            small = np.repeat(size, size) <= SMALL_FILE
            a, b, start = [], [], []
            short = np.flatnonzero(small)
            for shift in range(1, min(SMALL_FILE, int(size[size <= SMALL_FILE].max(initial=1)))):
                left = short[short + shift < len(key)]
                left = left[group[left] == group[left + shift]]
                left = left[_chains(turned[left] ^ turned[left + shift], most)]
                a.append(turned[left])
                b.append(turned[left + shift])
                start.append(key[left, 0])
            for g in np.flatnonzero(size > SMALL_FILE):
                x, y = _search(turned[first[g] : first[g] + size[g]], most)
                a.append(x)
                b.append(y)
                start.append(np.full(len(x), key[first[g], 0]))
            if not a:
                return None
            back = (SEGMENT_BITS * np.concatenate(start)).astype(np.uint64)
            rest = (np.uint64(64) - back) % np.uint64(64)
            ends = [np.where(back > 0, (v >> back) | (v << rest), v).view(np.int64) for v in (np.concatenate(a), np.concatenate(b))]
            return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

        kept_key, kept = np.zeros((0, 4), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            kept_key, kept = np.concatenate((kept_key, key)), np.concatenate((kept, batch.column(4).to_numpy().view(np.uint64)))
            if not len(kept):
                continue
            open_from = int(np.flatnonzero((kept_key != kept_key[-1]).any(axis=1)).max(initial=-1)) + 1
            if open_from and (found := solve(kept_key[:open_from], kept[:open_from])):
                yield found
            kept_key, kept = kept_key[open_from:], kept[open_from:]
        if len(kept) and (found := solve(kept_key, kept)):
            yield found

    key = ["start", "key", "low", "high"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Null texts count as empty. All texts without words share fingerprint 0 and are
    linked with it like any other. Equal fingerprints are one node, so copies cost
    one row each. ``component_id`` is the smallest non-null id that can be reached.
    Repeated rows stay.
    """
    signed = publish(fingerprints(docs, shingle), "fingerprints")
    distinct = publish(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(distinct.select("fp"), most))
    joined = distinct.join(root, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = joined.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id"))
    named = publish(joined.join(ids, F.col("root") == F.col("_r")).select(F.col("fp").alias("_fp"), "component_id"), "components")
    return signed.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
