"""Packing: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt at random into groups of bounded size and every group is
packed on its own, so the work is one pass over texts (tokens are counted, cut
and summed up where they are made; ids never move) and one shuffle of a small
row per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import publish, text_of
from oddspark.llm.tokens import Encoder, default_path

SEQUENCE = 2048
#: Fixed value: the id that ends a document.
END_ID = 1
#: Pieces in a group on average; a group is packed by one task.
GROUP_PIECES = 8192
#: Sequence ids of pieces that fill a sequence start here; groups number theirs below.
_FULL_FROM = 1 << 62
_BINS_IN_GROUP = 1 << 22

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Cut each document's ids (and its end id) into full sequences and one rest.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens``. Null and empty texts
    are the end id alone. Every row is a document of its own, also if its id
    repeats or is null.
    """
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = int(end_id).to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        kinds = [pa.int64()] * 5
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(encoder.encode(text.as_py()) + end)
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(cut, _PIECE)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items are taken longest first, ties in the given order.

    The tree holds at each node the most room left in a bin below it: the first bin
    with enough room is found by going left wherever the left child has it.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[item], 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        where[item] = node - leaves
        offset[item] = capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return where, offset


def pack(cut: DataFrame, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """Place pieces into sequences: adds ``sequence_id`` and ``offset``.

    A full piece is a sequence by itself and takes no part in the grouping. The
    others go to random groups; the row number written beside each piece is part
    of the draw, so that many rows of the same document spread as well.
    """
    numbered = publish(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = numbered.where(F.col("length") >= length)
    rest = numbered.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_pieces))
    place = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_row", "ascending")])
        where, offset = first_fit_decreasing(rows.column("length").to_pylist(), length)
        first = key[0].as_py() * _BINS_IN_GROUP
        out = rows.select(place)
        out = out.append_column("sequence_id", pa.array([first + w for w in where], pa.int64()))
        return out.append_column("offset", pa.array(offset, pa.int64()))

    group = F.pmod(F.xxhash64(F.col("doc_id"), F.col("_row"), F.lit(seed)), F.lit(groups).cast("long"))
    packed = (
        rest.withColumn("_group", group)
        .groupBy("_group")
        .applyInArrow(fill, _PIECE + ", sequence_id long, offset long")
    )
    alone = full.select(
        *place, (F.col("_row") + F.lit(_FULL_FROM)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return alone.unionByName(packed)


def pack_documents(docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives an empty result."""
    return pack(pieces(docs, length, tokenizer), length)
