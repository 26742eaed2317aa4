"""Suffix-array removal of repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement.

Only windows of ``WIDTH`` bytes that can repeat are sorted. Equal windows have equal
keys (see ``windows``), so every key is a bucket of its own: a piece of text whose
key occurs once holds no repeated window, pieces with equal bytes are repeated as a
whole, and different pieces of one key are the input of the merge.

Within a task the pieces of many keys are dealt to shards. Every shard gets its
suffix order, its transform (the bytes before each suffix) and its own repeats. The
merge then starts with all suffixes in one interval and refines the interleaving:
the order by h + 8 bytes is the order by h bytes put in order of the eight bytes
before each suffix, as read from the shards' transforms, and two neighbours stay in
one interval while those bytes are equal and the shorter suffixes were in one
interval. Intervals of a single shard are done and leave. What is left after 200
bytes are the windows that repeat across shards, with common prefixes of 200 bytes
or more. No suffix is compared or sorted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.llm.common import publish, text_of
from oddspark.llm.windows import WIDTH, Hasher, pieces

#: Bytes sorted together in a task, each of which needs about 65 bytes of memory, and shards they are dealt to.
BATCH_BYTES = 500_000
SHARDS = 4
#: Documents that are cut, and leave Python, at once.
HELD_ROWS = 512
_STEP = 8


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``HELD_ROWS``."""
    for batch in batches:
        for start in range(0, batch.num_rows, HELD_ROWS):
            yield batch.slice(start, HELD_ROWS)


def _words(text):
    """The eight bytes from each position on as one big-endian number; zeros follow the text."""
    import numpy as np

    padded = np.concatenate((text, np.zeros(_STEP, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for i in range(_STEP):
        out = out << np.uint64(8) | padded[i : i + len(text)]
    return out


class Shard:
    """Suffix order of some pieces (to 128 bytes), the bytes before each suffix, the step back to there, and the shard's own repeated windows."""

    def __init__(self, texts: list[bytes], first: int, width: int):
        import numpy as np

        # each piece ends with the empty suffix, from which the merge starts
        lengths = np.fromiter(map(len, texts), np.int32, len(texts)) + 1
        text = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        size = len(text)
        ends = np.cumsum(lengths, dtype=np.int32)
        at = np.arange(size, dtype=np.int32)
        left = np.repeat(ends, lengths) - 1 - at  # bytes to the end of the own piece
        words = _words(text)
        order, rank = self._double(words, left)
        whole = np.flatnonzero(left >= width).astype(np.int32)
        del left
        pair = rank[whole].astype(np.uint64) << np.uint64(32) | rank[whole + (width - 128)].astype(np.uint64)
        del rank
        pair_order = np.argsort(pair).astype(np.int32)
        pair = pair[pair_order]
        alike = pair[1:] == pair[:-1]
        self.repeated = np.zeros(size, bool)
        self.repeated[whole[pair_order[1:][alike]]] = True
        self.repeated[whole[pair_order[:-1][alike]]] = True
        del whole, pair, pair_order, alike
        inverse = np.empty(size, np.int32)
        inverse[order] = at
        self.order, self.first, self.size = order, first, size
        before = np.maximum(order - _STEP, 0)
        self.transform = words[before]
        # -1: the piece starts less than a step before
        done = at - np.repeat(ends - lengths, lengths)
        self.step = np.where(done[order] >= _STEP, inverse[before] + np.int32(first), np.int32(-1))

    @staticmethod
    def _double(words, left):
        """Suffix order by prefix doubling from 8 to 128 bytes; only suffixes that share their prefix are sorted on."""
        import numpy as np

        size = len(words)
        order = np.argsort(words).astype(np.int32)
        rank = np.empty(size, np.int32)
        keys, slots, depth = words[order], np.arange(size, dtype=np.int32), _STEP
        while True:
            # slots are the places of ``order`` that were just sorted, keys their sorted keys
            new = np.ones(len(slots), bool)
            new[1:] = keys[1:] != keys[:-1]
            del keys
            first = slots[new]
            group = np.cumsum(new, dtype=np.int32) - 1
            rank[order[slots]] = first[group]
            if depth == 128:
                return order, rank
            shared = ~new
            shared[:-1] |= shared[1:]
            slots = slots[shared]
            del first, group, new, shared
            here = order[slots]
            follow = np.where(left[here] > depth, rank[np.minimum(here + depth, size - 1)] + 1, 0)
            keys = rank[here].astype(np.uint64) << np.uint64(32)
            keys |= follow.astype(np.uint64)
            del follow
            sort = np.argsort(keys).astype(np.int32)
            order[slots], keys = here[sort], keys[sort]
            del here, sort
            depth *= 2


def merge_repeats(texts: list[bytes], width: int = WIDTH, shards: int = SHARDS) -> list:
    """For each text a mask of its window starts: does the window also start elsewhere in the texts?"""
    import numpy as np

    if not texts:
        return []
    dealt = [list(range(s, len(texts), shards)) for s in range(min(shards, len(texts)))]
    made, first = [], 0
    for own in dealt:
        made.append(Shard([texts[i] for i in own], first, width))
        first += made[-1].size
    step = np.concatenate([s.step for s in made])
    shard_of = np.repeat(np.arange(len(made), dtype=np.uint8), [s.size for s in made])
    # equal eight bytes get equal numbers, whose halves are sorted one after the other
    symbols = np.concatenate([s.transform for s in made])
    for shard in made:
        del shard.step, shard.transform
    by_symbol = np.argsort(symbols).astype(np.int32)
    symbols = symbols[by_symbol]
    number = np.zeros(first, np.uint32)
    number[by_symbol[1:]] = np.cumsum(symbols[1:] != symbols[:-1], dtype=np.uint32)
    del symbols, by_symbol
    low, high = number.astype(np.uint16), (number >> 16).astype(np.uint16)
    entry, interval = np.arange(first, dtype=np.int32), np.zeros(first, np.int32)
    for _ in range(width // _STEP if len(made) > 1 else 0):
        follow = step[entry]
        keep = follow >= 0
        entry, interval, follow = entry[keep], interval[keep], follow[keep]
        if not len(entry):
            break
        order = np.argsort(low[entry], kind="stable").astype(np.int32)
        order = order[np.argsort(high[entry[order]], kind="stable").astype(np.int32)]
        symbol, interval, shard = number[entry[order]], interval[order], shard_of[entry[order]]
        new = np.ones(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        group = np.cumsum(new, dtype=np.int32) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][~new[1:] & (shard[1:] != shard[:-1])]] = True
        keep = mixed[group]
        entry, interval = follow[order[keep]], group[keep]
    across = np.zeros(first, bool)
    if len(made) > 1:
        across[entry] = True
    out: list = [None] * len(texts)
    for own, shard in zip(dealt, made):
        flags = shard.repeated.copy()
        flags[shard.order[across[shard.first : shard.first + shard.size]]] = True
        at = 0
        for i in own:
            out[i] = flags[at : at + max(0, len(texts[i]) - width + 1)]
            at += len(texts[i]) + 1
    return out


_PIECE = "doc_id long, tag long, key long, hash long, start long, count long, more array<long>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each text; equal pieces of one text are one row with their other places in ``more``."""
    import numpy as np

    hasher = Hasher()
    for batch in _held(batches):
        out: list[list] = [[], [], [], []]
        counts, more = [], []
        for text in batch.column(2):
            found = pieces(hasher, np.frombuffer(text.as_py().encode("utf-8"), np.uint8))
            _, kept, back = np.unique(found[1], return_index=True, return_inverse=True)
            places: list = [None] * len(kept)
            if len(kept) < len(back):
                again = np.ones(len(back), bool)
                again[kept] = False
                for piece in np.flatnonzero(again).tolist():
                    at = int(back[piece])
                    places[at] = [*(places[at] or []), int(found[2][piece])]
            for column, values in zip(out, found):
                column.append(values[kept])
            counts.append(len(kept))
            more.extend(places)
        per = pa.array(np.repeat(np.arange(batch.num_rows), counts))
        columns = [np.concatenate(c or [np.zeros(0, np.int64)]) for c in out]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(per), batch.column(1).take(per), *(pa.array(x.view(np.int64)) for x in columns), pa.array(more, pa.list_(pa.int64()))],
            ["doc_id", "tag", "key", "hash", "start", "count", "more"],
        )


_SIFTED = ["doc_id", "tag", "key", "start", "count", "more", "whole"]


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, hash): what repeats as a whole, and one piece of each hash where a key has several.

    It streams, however many pieces a key has: the last row waits for the one that
    follows it, and the last piece of new bytes for the next one of its key.
    """
    import numpy as np

    def select(block: pa.Table, mask, whole: bool) -> Iterator[pa.RecordBatch]:
        if mask.any():
            found = block.select(_SIFTED[:-1]).filter(pa.array(mask))
            yield from found.append_column("whole", pa.array(np.full(found.num_rows, whole))).combine_chunks().to_batches()

    def column(block: pa.Table, name: str):
        return block.column(name).to_numpy()

    def first_of_each(block: pa.Table, final: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table]:
        """Of pieces with different bytes, those with another one of their key next to them; the last one waits."""
        key, before = column(block, "key"), column(block, "beside")
        after = np.zeros(len(key), bool)
        after[:-1] = key[1:] == key[:-1]
        before = before.copy()
        before[1:] |= after[:-1]
        ready = np.ones(len(key), bool)
        ready[-1] = final
        rest = block.slice(block.num_rows - 1)
        rest = rest.set_column(rest.column_names.index("beside"), "beside", pa.array(before[-1:]))
        return select(block, (before | after) & ready, False), rest

    def step(block: pa.Table, last, final: bool):
        key, hashed = column(block, "key"), column(block, "hash")
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = (key[1:] == key[:-1]) & (hashed[1:] == hashed[:-1])
        same[0] = last is not None and last == (key[0], hashed[0])
        ready = np.ones(len(key), bool)
        ready[-1] = final
        fresh = block.filter(pa.array(~same[:-1] & ready))
        fresh = fresh.append_column("beside", pa.array(np.zeros(fresh.num_rows, bool)))
        before = (key[-2], hashed[-2]) if len(key) > 1 else last
        twice = block.column("more").is_valid().to_numpy()
        return select(block, (same[:-1] | same[1:] | twice) & ready, True), fresh, before

    held = waiting = last = None
    for batch in batches:
        if batch.num_rows:
            block = pa.Table.from_batches([batch])
            block = block if held is None else pa.concat_tables([held, block]).combine_chunks()
            out, fresh, last = step(block, last, False)
            yield from out
            held = block.slice(block.num_rows - 1)
            fresh = fresh if waiting is None else pa.concat_tables([waiting, fresh]).combine_chunks()
            if fresh.num_rows:
                out, waiting = first_of_each(fresh, False)
                yield from out
    if held is not None:
        out, fresh, _ = step(held, last, True)
        yield from out
        fresh = fresh if waiting is None else pa.concat_tables([waiting, fresh]).combine_chunks()
        if fresh.num_rows:
            yield from first_of_each(fresh, True)[0]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key: keys are gathered to batches of bounded bytes and merged; repeated runs of windows come out."""
    import numpy as np

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for (doc_id, tag, _, start, _), flags in zip(rows, merge_repeats([r[4] for r in rows])):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            for a, b in edges.reshape(-1, 2).tolist():
                for column, value in zip(out, (doc_id, tag, start + a, b - a)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "tag", "start", "count"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size >= BATCH_BYTES and row[2] != rows[-1][2]:
                yield solve(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield solve(rows)


def _flat(lists: pa.Array, *names: str):
    """Where the list of each row begins (and ends), and the fields of all lists as flat arrays; null is empty."""
    import numpy as np

    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return np.concatenate(([0], np.cumsum(lengths))).tolist(), [flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, runs``: for each document (by id and hash of its text) the runs of repeated windows.

    A run is ``start, count``: windows of 200 bytes start at ``count`` consecutive
    bytes from ``start`` and each also starts at another place of the table.
    """
    tagged = docs.select("doc_id", "tag", "text")
    sifted = publish(
        tagged.where(F.octet_length("text") >= WIDTH)
        .mapInArrow(_cut, _PIECE)
        .repartition("key")
        .sortWithinPartitions("key", "hash")
        .mapInArrow(_sift, "doc_id long, tag long, key long, start long, count long, more array<long>, whole boolean"),
        "sifted",
    )
    wanted = (
        sifted.where(~F.col("whole"))
        .groupBy(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"))
        .agg(F.collect_set(F.struct("key", "start", "count")).alias("_pieces"))
    )

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in _held(batches):
            out: list[list] = [[], [], [], [], []]
            own, (keys, starts, counts) = _flat(batch.column(3), "key", "start", "count")
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, text in enumerate(batch.column(2)):
                raw = text.as_py().encode("utf-8")
                for i in range(own[row], own[row + 1]):
                    part = raw[starts[i] : starts[i] + counts[i] + WIDTH - 1]
                    for column, value in zip(out, (ids[row], tags[row], keys[i], starts[i], part)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "tag", "key", "start", "part"])

    merged = (
        tagged.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")))
        .select("doc_id", "tag", "text", "_pieces")
        .mapInArrow(slices, "doc_id long, tag long, key long, start long, part binary")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_merge, "doc_id long, tag long, start long, count long")
    )
    every = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<bigint>")))
    runs = sifted.where("whole").select("doc_id", "tag", F.explode(every).alias("start"), "count").unionByName(merged)
    return runs.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "count")).alias("runs"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``kept`` (text), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Texts are judged as UTF-8 bytes, null as empty; a byte goes if some window of
    200 bytes that covers it also starts anywhere else in the table. Texts shorter
    than a window lose nothing. Repeated rows count as different documents, so they
    remove each other. ``kept`` leaves out characters of which only some bytes stay;
    the hash is of all bytes that stay. Columns of ``docs`` named like a new one are
    replaced.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept_columns = [c for c in docs.columns if c.lower() not in new]
    source = docs.select(
        F.struct(*kept_columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")
    ).withColumn("tag", F.xxhash64("text"))
    runs = repeated_windows(source).select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t"), "runs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in _held(batches):
            out: list[list] = [[], [], [], [], []]
            own, (starts, counts) = _flat(batch.column("runs"), "start", "count")
            for row, text in enumerate(batch.column("text")):
                raw = text.as_py().encode("utf-8")
                kept, removed, spans = raw, 0, 0
                first, last = own[row], own[row + 1]
                if first < last:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, starts[first:last], 1)
                    np.subtract.at(edge, starts[first:last] + counts[first:last] + (WIDTH - 1), 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for column, value in zip(out, (kept.decode("utf-8", "ignore"), len(raw), removed, spans, hashlib.sha256(kept).hexdigest())):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["row", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = source.join(runs, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    fields = [T.StructField("row", source.schema["row"].dataType)]
    made = T.StructType(fields)
    for name, kind in (("kept", T.StringType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())):
        made = made.add(name, kind)
    return joined.select("row", "text", "runs").mapInArrow(remove, made).select("row.*", *new)
