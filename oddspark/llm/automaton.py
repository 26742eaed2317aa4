"""Benchmark decontamination with generalised suffix automata.

The words of the test items of one shard become the states of a suffix automaton: one
state for each set of places at which a run of words ends. Documents are streamed
through it, which gives at each word the longest run ending there that an item holds.
Runs of a window's length or more are hits, and the state says which items hold them.
Spans and documents beyond given limits are removed.

Where ten words in a row stand in no item pairwise, no window can end; a table of the
pairs of neighbouring words finds the stretches worth streaming.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddspark.llm.common import publish, text_of

#: Fixed value: what a word is, in a text whose A-Z are lower-cased; bytes from 0x80 on belong to words.
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of items in one automaton, and of an item in one piece; both bound memory, neither leaves anything out.
SHARD_WORDS, PIECE_WORDS = 200_000, 2_000
#: Bytes of a text that are cut into words at once.
BLOCK = 1 << 20

_WORDS = re.compile(WORD_BYTES)
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of stretches of a text that end between words."""
    start = 0
    while len(raw) - start > BLOCK:
        found = _BREAK.search(raw, start + BLOCK)
        end = found.end() if found else len(raw)
        yield start, raw[start:end]
        start = end
    yield start, raw[start:] if start else raw


def words_of(text: str) -> Iterator[list[bytes]]:
    for _, block in blocks(text.encode("utf-8").lower()):
        yield _WORDS.findall(block)


class Automaton:
    """Suffix automaton of many word sequences, with the items that hold each window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocab: dict[bytes, int] = {}
        self.pieces: list[tuple[list[int], int, bool]] = []
        self.items: list[str | None] = []
        self.numbers: dict[str | None, int] = {}

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter runs of ``q``, to which all ways from ``p`` upwards now lead."""
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _step(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        own = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return own

    def add(self, item: str | None, words: list[bytes], whole: bool) -> None:
        """Take in a piece of an item; ``whole``: the item is no longer than this and shorter than a window."""
        ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        if item not in self.numbers:
            self.numbers[item] = len(self.items)
            self.items.append(item)
        self.pieces.append((ids, self.numbers[item], whole))
        last = 0
        for word in ids:
            last = self._step(last, word)

    def finish(self) -> Automaton:
        """Note at the states which windows they stand for, and set up the tables of the scan."""
        import numpy as np

        span, link, length = self.window, self.link, self.length
        self.ends: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        pairs, short_pairs, single = set(), set(), set()
        for ids, item, whole in self.pieces:
            state, n = 0, 0
            for word in ids:
                state, n = self.next[state][word], n + 1
                while length[link[state]] >= span:
                    state = link[state]
                if n >= span:
                    self.ends.setdefault(state, set()).add(item)
            pairs.update(zip(ids, ids[1:]))
            if whole and n:
                self.short.setdefault(state, {}).setdefault(n, set()).add(item)
                short_pairs.update(zip(ids, ids[1:]))
                if n == 1:
                    single.add(ids[0])
        #: For each state the one that stands for its last ``span`` words, and the nearest one upwards that ends short items.
        order = sorted(range(len(link)), key=length.__getitem__)
        self.tenth, self.upward = [-1] * len(link), [-1] * len(link)
        for s in order[1:]:
            if length[s] >= span:
                self.tenth[s] = self.tenth[link[s]] if length[link[s]] >= span else s
            self.upward[s] = s if s in self.short else self.upward[link[s]] if link[s] > 0 else -1
        self.least_short = min((n for by in self.short.values() for n in by if n > 1), default=0)
        self.bits = max(10, (16 * len(pairs)).bit_length())
        self.table = np.zeros(1 << self.bits, np.uint8)
        for bit, found in ((1, pairs), (2, short_pairs)):
            if found:
                a, b = (np.array(side, np.int64) for side in zip(*found))
                np.bitwise_or.at(self.table, self._mixed(a, b), bit)
        self.single = np.zeros(len(self.vocab) + 1, bool)
        self.single[list(single)] = True
        width = len(self.vocab) + 1
        self.width, self.go = width, {s * width + w: t for s, after in enumerate(self.next) for w, t in after.items()}
        del self.next, self.pieces, self.numbers
        return self

    def _mixed(self, a, b):
        import numpy as np

        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def stretches(self, ids) -> list[tuple[int, int]]:
        """First and past-the-last word of the stretches that may hold windows."""
        import numpy as np

        if len(ids) == 0:
            return []
        found = []
        if len(ids) > 1:
            marks = self.table[self._mixed(ids[:-1], ids[1:])]
            marks[(ids[:-1] == 0) | (ids[1:] == 0)] = 0
            for bit, least in ((1, self.window - 1), (2, self.least_short - 1)):
                if least <= 0:
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (marks & bit) != 0, [0])).astype(np.int8)))
                first, past = edge[::2], edge[1::2]
                good = past - first >= least
                found += zip(first[good].tolist(), (past[good] + 1).tolist())
        if self.single.any() or self.window == 1:
            alone = np.flatnonzero(self.single[ids] if self.window > 1 else ids > 0)
            found += zip(alone.tolist(), (alone + 1).tolist())
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def scan(self, ids) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (first, length) of words, apart and in order, and the numbers of the items found."""
        go, link, length, width, span = self.go, self.link, self.length, self.width, self.window
        spans, ends, numbers = [], set(), set()
        for first, past in self.stretches(ids):
            state, run = 0, 0
            for i, word in enumerate(ids[first:past].tolist(), first):
                following = go.get(state * width + word)
                while following is None and state:
                    state = link[state]
                    run = length[state]
                    following = go.get(state * width + word)
                if following is None:
                    state = run = 0
                    continue
                state, run = following, run + 1
                if run >= span:
                    ends.add(self.tenth[state])
                    spans.append((i - run + 1, i + 1))
                up = self.upward[state]
                while up >= 0:
                    for n, items in self.short[up].items():
                        if n <= run:
                            numbers |= items
                            spans.append((i - n + 1, i + 1))
                    up = self.upward[link[up]] if link[up] > 0 else -1
        for state in ends:
            numbers |= self.ends[state]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b - a) for a, b in merged], numbers

    def ids_of(self, text: str):
        import numpy as np

        get = self.vocab.get
        parts = [np.fromiter([get(w, 0) for w in words], np.int64, len(words)) for words in words_of(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """``item, words, whole``: items cut into pieces that overlap by a window less a word, so that each window lies in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept: list[bytes] = []
                whole, n = True, 0
                for words in words_of(text):
                    kept += words
                    n += len(words)
                    while len(kept) >= PIECE_WORDS + window:
                        out.append((item, kept[: PIECE_WORDS + window - 1], False))
                        kept, whole = kept[PIECE_WORDS:], False
                if n:
                    out.append((item, kept, whole and n < window))
            columns = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.binary())), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "words", "whole"])

    plain = items.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    return plain.mapInArrow(run, "item string, words array<binary>, whole boolean")


def automata(items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[bytes]:
    """The shards' automata, built in tasks and brought to the driver one at a time; a shard's size is bounded."""
    pieces = publish(pieces_of(items, window), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_words))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("item", F.col("words"), F.monotonically_increasing_id()), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        import pickle

        made = Automaton(window)
        for item, words, whole in zip(*(table.column(c).to_pylist() for c in ("item", "words", "whole"))):
            made.add(item, words, whole)
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), pa.array([pickle.dumps(made.finish(), 5)], pa.binary())], ["shard", "made"])

    built = publish(dealt.groupBy("shard").applyInArrow(build, "shard int, made binary"), "automata")
    for shard in [r["shard"] for r in built.select("shard").collect()]:
        yield bytes(built.where(F.col("shard") == shard).first()["made"])


def _scanned(rows: DataFrame, made: bytes, carry: list[str], all_rows: bool) -> DataFrame:
    """The rows with ``_n_words, _spans, _items``; only those with hits unless ``all_rows``."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    held = rows.sparkSession.sparkContext.broadcast(made)  # one shard, bounded by SHARD_WORDS
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _opened(name, held)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("_text").to_pylist():
                ids = automaton.ids_of(text)
                at, found = automaton.scan(ids)
                counts.append(len(ids))
                spans.append([{"start": a, "length": n} for a, n in at])
                items.append([automaton.items[i] for i in found if automaton.items[i] is not None])
            columns = [
                *(batch.column(c) for c in carry), pa.array(counts, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(items, pa.list_(pa.string())),
            ]
            out = pa.RecordBatch.from_arrays(columns, [*carry, "_n_words", "_spans", "_items"])
            yield out if all_rows else out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_n_words long, _spans array<struct<start:bigint,length:bigint>>, _items array<string>"])
    return rows.mapInArrow(run, schema)


_OPEN: dict[str, Automaton] = {}


def _opened(name: str, held) -> Automaton:
    """The worker's automaton, unpacked once; a worker holds one."""
    import pickle

    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = pickle.loads(held.value)
    return _OPEN[name]


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: list[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id``, the columns to carry, ``_n_words``, ``_spans`` (start and length in words) and ``_items`` of each document.

    A window is ``window`` words in a row of an item, or a shorter item as a whole;
    items without words have none. Equal items are found each. Items without id hit
    words and are not listed. Null texts have no words. One pass over the documents for
    each shard of the items; with one shard nothing is shuffled.
    """
    carried = ["doc_id", *(c for c in carry or [] if c != "doc_id")]
    rows = docs.select(*carried, text_of().alias("_text"))
    keyed = rows.withColumns({"_k": F.xxhash64("doc_id", "_text"), "_l": F.xxhash64(F.lit(1), "doc_id", "_text")})
    made = automata(items, window, shard_words)
    one = next(made, None)
    if one is None:
        import pickle

        one = pickle.dumps(Automaton(window).finish(), 5)
    found, more = _scanned(keyed, one, [*carried, "_k", "_l"], True), None
    for other in made:
        part = publish(_scanned(keyed, other, ["_k", "_l"], False), "hits")
        more = part if more is None else more.unionByName(part)
    if more is not None:
        # one row for each different text with hits; equal rows of a shard say the same
        more = more.distinct().groupBy("_k", "_l").agg(F.flatten(F.collect_list("_spans")).alias("_more"), F.flatten(F.collect_list("_items")).alias("_others"))
        found = found.join(more, ["_k", "_l"], "left").withColumns(
            {
                "_spans": F.when(F.col("_more").isNull(), F.col("_spans")).otherwise(_apart(F.concat("_spans", "_more"))),
                "_items": F.when(F.col("_others").isNull(), F.col("_items")).otherwise(F.concat("_items", "_others")),
            }
        )
    return found.withColumn("_items", F.array_sort(F.array_distinct("_items"))).select(*carried, "_n_words", "_spans", "_items")


def _apart(spans: Column) -> Column:
    """Spans merged where they touch or overlap, in order."""
    start = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def take(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["length"], s["start"] + s["length"] - last["start"]).alias("length"))
        touching = (F.size(done) > 0) & (s["start"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"], F.lit(-1)))
        return F.when(touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, take)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document; see :func:`matches`."""
    found = matches(docs, items, window, shard_words=shard_words)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without(text: str, spans: list[tuple[int, int]], least: int, most: float, n_words: int) -> str | None:
    """The text without spans of ``least`` words or more; None if they cover more than the share ``most`` of its words.

    A span goes from the start of its first word to the end of its last one.
    """
    long = [(a, n) for a, n in spans if n >= least]
    if sum(n for _, n in long) > most * n_words:
        return None
    if not long:
        return text
    raw = text.encode("utf-8")
    kept, at, number, waiting = [], 0, 0, iter(long)
    first, n = next(waiting)
    for offset, block in blocks(raw.lower()):
        for word in _WORDS.finditer(block):
            if number == first:
                kept.append(raw[at : offset + word.start()])
            if number == first + n - 1:
                at = offset + word.end()
                first, n = next(waiting, (-1, 0))
            number += 1
    return (b"".join(kept) + raw[at:]).decode("utf-8")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """The documents' own columns, texts without hit spans of ``max_span`` words or more; beyond the coverage limit they go.

    Null texts stay null; extra columns are carried as they are.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")
    found = matches(rows, items, window, ["_row"]).select("_row", "_n_words", "_spans")
    schema = ", ".join(["_row " + found.schema["_row"].dataType.simpleString(), "_kept string, _gone boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field("text").to_pylist()
            kept = [
                t and without(t, [(s["start"], s["length"]) for s in spans], max_span, max_coverage, n)
                for t, spans, n in zip(texts, batch.column("_spans").to_pylist(), batch.column("_n_words").to_pylist())
            ]
            gone = [bool(t) and k is None for t, k in zip(texts, kept)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(kept, pa.string()), pa.array(gone, pa.bool_())], ["_row", "_kept", "_gone"])

    left = found.mapInArrow(run, schema).where(~F.col("_gone"))
    return left.select(*(F.col("_kept").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def check_sql(window: int = WINDOW) -> str:
    """The same in DuckDB: runs of words joined on their text."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
  i AS (SELECT item_id, {split} AS w FROM benchmark),
  g AS MATERIALIZED (SELECT DISTINCT item_id, least({window}, len(w)) AS n, array_to_string(w[p:p + least({window}, len(w)) - 1], ' ') AS t
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
  s AS (SELECT DISTINCT n FROM g),
  p AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n),
  h AS MATERIALIZED (SELECT p.r, p.p, p.n, g.item_id FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM p) p JOIN g ON p.n = g.n AND p.t = g.t),
  c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
  k AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(k.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN k ON d.r = k.r"""
