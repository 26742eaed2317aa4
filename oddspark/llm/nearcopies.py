"""Near copies: SimHash links and sets of word shingles joined by prefixes, checked by exact Jaccard similarity.

Fingerprints of the sets are linked by the pigeonring search of ``simhash``; this
finds copies with few changes, however many there are, without meeting in pairs.
What differs in more bits is found by prefixes. Two sets whose similarity is at least
4/5 have an element in common among the first ``n - ceil(4n/5) + 1`` of each, in any
order that is the same for all sets (prefix filter). So every set is filed under
those elements, shingles that are common in a sample last, and no similar pair is
lost. Where two sets meet under an element, what follows it in either must suffice
for the overlap they need (positional filter). Of files with the same members only the
one whose element comes first is kept. Bits that the elements of a set flip give the
least number of elements in which two sets differ (bitmap filter). Each file first links its members to
the one that has its element furthest to the front, which has the fewest shingles of
its own; then only members that are not connected yet meet. Every link is compared in
full, for which the sets are made again; equality of shingles is by 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import discard, in_sketch, not_in_sketch, publish, sketch_of, text_of
from oddspark.llm.components import components
from oddspark.llm.simhash import links as simhash_links
from oddspark.llm.simhash import majority

#: Similarity as a fraction, lest rounding decide.
NUMERATOR, DENOMINATOR = 4, 5
SHINGLE = 5
#: Members up to which a file is compared in one task; larger ones are cut into blocks, every two of which meet.
SMALL_FILE = 4096
#: Members up to which files are compared by shifting their sorted rows against themselves.
SHORT_FILE = 64
#: Bits of the parity of a set: two to four times its size, up to this.
MARK_BITS = 1 << 14
#: Pairs whose parities are compared at once.
MARKED_PAIRS = 4096
#: Documents whose sets leave Python at once: sets are twice as large as texts.
HELD_ROWS = 256
#: Documents in which common shingles are looked for, and how many of them make one common; this only orders the prefixes.
ORDER_ROWS, ORDER_LEAST, ORDER_MOST = 20_000, 4, 500_000


class Shingles:
    """Distinct hashes of the word shingles of a text; texts with fewer words than a shingle are one shingle."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[bytes, int] = {}

    def of(self, text: str):
        import numpy as np
        from xxhash import xxh64_intdigest as xxh

        words = text.encode("utf-8").lower().split()
        known = self.words
        if len(known) >= 200_000:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, word in enumerate(words):
            h = known.get(word)
            if h is None:
                h = known[word] = xxh(word, 42)
            out[i] = h
        if not words:
            return out
        width = min(self.width, len(words))
        line = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            line = line * np.uint64(0x9E3779B97F4A7C15) + out[i : i + len(line)]
        line ^= line >> np.uint64(31)
        line *= np.uint64(0xD6E8FEB86659FD93)
        line ^= line >> np.uint64(32)
        return np.unique(line)


def _mark(held) -> bytes:
    """Which of a power of two of bits an odd number of the set's hashes has for its last bits; halves add up to the mark of half as many bits."""
    import numpy as np

    bits = min(MARK_BITS, max(64, 1 << (2 * len(held)).bit_length()))
    odd = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Marks:
    """Marks of sets; ``differ`` bounds from below the number of elements that only one of two sets has. An empty mark tells nothing."""

    def __init__(self, marks: list[bytes]):
        import numpy as np

        self.width, self.place, self.rows = np.array([len(m) for m in marks], np.int64), np.zeros(len(marks), np.int64), {}
        for width in np.unique(self.width[self.width > 0]).tolist():
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            self.rows[width] = np.frombuffer(b"".join(marks[i] for i in at.tolist()), np.uint64).reshape(len(at), width // 8)

    def _folded(self, i, width: int):
        import numpy as np

        out = np.empty((len(i), width // 8), np.uint64)
        for own in np.unique(self.width[i]).tolist():
            at = np.flatnonzero(self.width[i] == own)
            out[at] = np.bitwise_xor.reduce(self.rows[own][self.place[i[at]]].reshape(len(at), own // width, width // 8), axis=1)
        return out

    def differ(self, i, j):
        import numpy as np

        out, least = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(least[least > 0]).tolist():
            pairs = np.flatnonzero(least == width)
            for start in range(0, len(pairs), MARKED_PAIRS):
                at = pairs[start : start + MARKED_PAIRS]
                out[at] = np.bitwise_count(self._folded(i[at], width) ^ self._folded(j[at], width)).sum(axis=1, dtype=np.int64)
        return out


def _named(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text_of().alias("text"), F.xxhash64(doc_id, text_of()).alias("ref"))


def _common(docs: DataFrame, shingle: int):
    """Hashes that several of a sample of documents hold, sorted; a bounded list."""
    import numpy as np

    share = min(1.0, ORDER_ROWS / max(1, docs.count()))
    drawn = docs.where(F.xxhash64("doc_id", "text", F.lit(7)) <= F.lit(min(2**63 - 1, int((share - 0.5) * 2**64)))) if share < 1 else docs

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(shingle)
        for batch in batches:
            found = [cut.of(t.as_py()) for t in batch.column(0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    held = _named(drawn).select("text").mapInArrow(each, "h long").groupBy("h").count().where(F.col("count") >= ORDER_LEAST)
    found = held.orderBy(F.desc("count"), "h").limit(ORDER_MOST).toArrow().column("h").to_numpy().astype(np.int64)
    return np.sort(found.view(np.uint64))


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, ref, node, size, fp, keys, mark``: a hash of id and text, the hash of the set, its size, its SimHash, the prefix, in order, under which it is filed, and its mark."""
    import numpy as np

    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        cut, common = Shingles(shingle), shared.value
        for batch in batches:
            node, fp, size, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), []
            marks = []
            for i, text in enumerate(batch.column(1)):
                held = cut.of(text.as_py())
                node[i], size[i], fp[i] = xxh(held.tobytes(), 42), len(held), majority(held)
                marks.append(_mark(held))
                first = len(held) - -(-NUMERATOR * len(held) // DENOMINATOR) + 1 if len(held) else 0
                if len(common) and len(held):
                    at = np.searchsorted(common, held).clip(max=len(common) - 1)
                    often = common[at] == held
                    held = np.concatenate((held[~often], held[often]))
                keys.append(held[:first].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            columns = [batch.column(0), batch.column(2), pa.array(node.view(np.int64)), pa.array(size), pa.array(fp.view(np.int64)), lists, pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ref", "node", "size", "fp", "keys", "mark"])

    return _named(docs).mapInArrow(sign, "doc_id long, ref long, node long, size long, fp long, keys array<bigint>, mark binary")


def _simhash_pairs(prints: DataFrame) -> DataFrame:
    """``a, b`` from ``node, fp``: nodes whose fingerprints are equal or linked by pigeonring."""
    heads = publish(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = publish(simhash_links(heads.select("fp")).distinct(), "simhash")
    head = lambda name: heads.select(F.col("fp").alias(f"_{name}"), F.col("head").alias(name))
    near = found.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(head("a"), "_a").join(head("b"), "_b").select("a", "b")
    return equal.unionByName(near)


def _fits(x, y, i, j):
    """Sizes may be similar enough, and what stands from here on in both suffices for the overlap."""
    import numpy as np

    left = np.minimum(x - i, y - j)
    return (NUMERATOR * np.maximum(x, y) <= DENOMINATOR * np.minimum(x, y)) & ((NUMERATOR + DENOMINATOR) * left >= NUMERATOR * (x + y))


def _met(filed: DataFrame) -> DataFrame:
    """``key, node, size, at, first`` of the files ``key, node, size, at`` (where in the prefix) that have several members.

    ``first`` is the member that has the key furthest to the front, where it may be similar enough.
    """
    import numpy as np

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, told = np.zeros((4, 0), np.int64), False  # first row of the file that is open, and whether it has been given
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate((head, [batch.column(i).to_numpy().astype(np.int64) for i in range(4)]), axis=1)
            key, node, size, at = rows
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.concatenate((start, [len(key)])))
            first, keep = np.repeat(start, count), np.repeat(count > 1, count)
            if told:
                keep[0] = False
            near = (first != np.arange(len(key))) & _fits(size, size[first], at, at[first])
            columns = [pa.array(v[keep]) for v in rows] + [pa.array(node[first][keep], mask=~near[keep])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "size", "at", "first"])
            head, told = rows[:, start[-1] : start[-1] + 1], bool(count[-1] > 1)

    ordered = filed.repartition("key").sortWithinPartitions("key", "at", "node")
    return ordered.mapInArrow(meet, "key long, node long, size long, at long, first long")


def _first_files(met: DataFrame) -> DataFrame:
    """The rows of ``met`` without the files whose members have met in an earlier file.

    Files with equal members are in the same order for each of them, so the first
    has all their positions furthest to the front and gives every pair that a later one
    gives. Equality of members is by their number and two 64-bit hashes.
    """
    files = met.groupBy("key").agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("_y"), F.min("at").alias("_at")
    )
    return met.join(files.groupBy("_n", "_x", "_y").agg(F.min_by("key", "_at").alias("key")).select("key"), "key", "left_semi")


def _crossed(parted: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """``a, b`` from files ``key, node, size, at, part``: members of different parts that may be similar enough, by their ``node, mark`` too if given."""
    import numpy as np

    mixed = parted.groupBy("key").agg(F.min("part").alias("_p"), F.max("part").alias("_q"), F.count(F.lit(1)).alias("_n")).where("_p <> _q")
    mixed = mixed.select("key", F.ceil(F.col("_n") / SMALL_FILE).cast("long").alias("_blocks"))
    dealt = parted.join(mixed, "key")
    dealt = dealt.withColumn("mark", F.lit(None).cast("binary")) if marks is None else dealt.join(marks, "node", "left")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "_blocks"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    place = ["key", "low", "high"]
    dealt = dealt.select("key", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "node", "size", "at", "part", "mark")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b)], ["a", "b"])

        def solve(rows, marks):
            key, low, high, own, node, size, at, part = rows
            marked = Marks(marks)
            start = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
            count = np.diff(np.concatenate((start, [len(key)])))
            group, a, b = np.repeat(np.arange(len(start)), count), [], []
            short = np.flatnonzero(np.repeat(count <= SHORT_FILE, count))

            def meant(i, j):
                to = np.flatnonzero((part[i] != part[j]) & ((low[i] == high[i]) | (own[i] != own[j])) & _fits(size[i], size[j], at[i], at[j]))
                i, j = i[to], j[to]
                return to[(NUMERATOR + DENOMINATOR) * marked.differ(i, j) <= (DENOMINATOR - NUMERATOR) * (size[i] + size[j])]

            for shift in range(1, int(count[count <= SHORT_FILE].max(initial=1))):
                left = short[short + shift < len(key)]
                left = left[group[left] == group[left + shift]]
                left = left[meant(left, left + shift)]
                a.append(node[left])
                b.append(node[left + shift])
            for g in np.flatnonzero(count > SHORT_FILE):
                for i in range(start[g], start[g] + count[g] - 1):
                    other = np.arange(i + 1, start[g] + count[g])
                    other = other[meant(np.full(len(other), i), other)]
                    a.append(np.full(len(other), node[i]))
                    b.append(node[other])
                    if sum(map(len, a[-64:])) > 100_000:
                        yield given(a, b)
                        a, b = [], []
            if a:
                yield given(a, b)

        kept, marks = np.zeros((8, 0), np.int64), []
        for batch in batches:
            marks += [m or b"" for m in batch.column(8).to_pylist()]
            kept = np.concatenate((kept, [batch.column(i).to_numpy().astype(np.int64) for i in range(8)]), axis=1)
            if kept.shape[1]:
                open_from = int(np.flatnonzero((kept[:3] != kept[:3, -1:]).any(axis=0)).max(initial=-1)) + 1
                if open_from:
                    yield from solve(kept[:, :open_from], marks[:open_from])
                kept, marks = kept[:, open_from:], marks[open_from:]
        if kept.shape[1]:
            yield from solve(kept, marks)

    return dealt.repartition(*place).sortWithinPartitions(*place, "node").mapInArrow(cross, "a long, b long")


def _told(pairs: DataFrame) -> DataFrame:
    return publish(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _similar(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int) -> DataFrame:
    """The published ``pairs`` whose sets are similar enough, compared in full; removes ``pairs``. ``distinct`` has a ``ref`` of each node."""
    import numpy as np

    wanted = publish(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(distinct.select("node", "ref"), "node"), "wanted")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as xxh

        cut = Shingles(shingle)
        for batch in batches:
            for start in range(0, batch.num_rows, HELD_ROWS):
                found = [cut.of(t.as_py()) for t in batch.column(0).slice(start, HELD_ROWS)]
                nodes = np.array([xxh(x.tobytes(), 42) for x in found], np.uint64).view(np.int64)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), held], ["node", "held"])

    named = _named(docs).withColumn("h", F.col("ref"))
    chosen = in_sketch(named, sketch_of(wanted.select(F.col("ref").alias("h")))).select("text")
    sets = chosen.mapInArrow(hold, "node long, held array<bigint>").join(wanted.select("node").hint("merge"), "node", "left_semi")
    found = publish(_compared(pairs, sets.groupBy("node").agg(F.first("held").alias("held"))), "similar")
    discard(wanted, pairs)
    return found


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` whose ``sets`` are similar enough. ``sets`` is not written: both sides read one shuffle of it by node."""
    left = sets.select(F.col("node").alias("a"), F.col("held").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("held").alias("_y"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y")).cast("long")
    union: Column = F.size("_x") + F.size("_y") - shared
    return both.where(DENOMINATOR * shared >= NUMERATOR * union).select("a", "b")


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, ref, node, component_id, root`` for every row: components of the documents with Jaccard similarity 0.8 or more.

    Null texts count as empty; all texts without words are copies of one another.
    ``component_id`` is the smallest non-null id that can be reached, ``root`` names the
    component where ids repeat, ``ref`` the row's id and text; repeated rows stay.
    """
    filled = publish(signed(docs, shingle), "signed")
    rows = publish(filled.select("doc_id", "ref", "node"), "rows")
    distinct = publish(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("ref").alias("ref")), "distinct")
    each = publish(filled.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "prefixes")
    marks = publish(filled.groupBy("node").agg(F.first("mark").alias("mark")), "marks")
    discard(filled)
    filed = each.select(F.posexplode("keys").alias("at", "key"), "node", "size")
    every = publish(_met(filed.select("key", "node", "size", F.col("at").cast("long").alias("at"))), "met")
    met = publish(_first_files(every), "met")
    discard(every)
    near = _simhash_pairs(each.select("node", "fp"))
    pairs = _told(near.unionByName(met.where("first is not null").select(F.col("first").alias("a"), F.col("node").alias("b"))))
    discard(each)
    links = _similar(pairs, docs, distinct, shingle)
    root = components(links)
    # members that are connected need no pair of theirs
    parted = publish(met.join(root, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("part")), "parted")
    discard(met)
    more = publish(links.unionByName(_similar(_told(_crossed(parted, marks)), docs, distinct, shingle)), "similar")
    discard(parted, marks, links)
    root = components(more)
    joined = publish(distinct.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(ids, "root").select("node", "component_id", "root")
    return rows.select("doc_id", "ref", "node").join(named, "node").select("doc_id", "ref", "node", "component_id", "root")


def without_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, once if its row repeats.

    Rows without an id cannot be told apart and all stay. Where an id repeats with
    different texts, each text stays or goes with its own component. Only rows that may
    go, or that repeat, leave their task.
    """
    groups = publish(near_copies(docs, shingle), "groups")
    named = groups.where(F.col("doc_id").isNotNull()).groupBy("root", "doc_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "ref")).alias("first"))
    told = named.join(least, "root").select("doc_id", "ref", "n", (F.struct("doc_id", "ref") == F.col("first")).alias("stays"))
    unsure = publish(told.where("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("ref").alias("h"), "stays"), "unsure")
    sketch = sketch_of(unsure.select("h"))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.withColumns({"_id": doc_id, "h": F.when(doc_id.isNotNull(), F.xxhash64(doc_id, text_of()))})
    seen = in_sketch(rows, sketch).join(unsure.where("not stays").hint("merge"), ["_id", "h"], "left_anti").dropDuplicates(["_id", "h"])
    return not_in_sketch(rows, sketch).select(*docs.columns).unionByName(seen.select(*docs.columns))
