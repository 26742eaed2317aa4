"""Each operator against a brute-force version, over the awkward table, with clashing columns and on an empty table."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.llm import chat, covertree, fingerprints, mixing, packing, quality, simhash, suffixes, tokens, tokenscan, toxicity
from tests.llm.data import awkward_rows, docs_of, labels_of, words

ROWS = awkward_rows()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [e.ids for e in t.encode_batch(list(texts), add_special_tokens=False)]


# --- packing ------------------------------------------------------------------------


def test_first_fit_decreasing_takes_the_first_bin_with_room():
    r = np.random.default_rng(1)
    for _ in range(50):
        lengths = r.integers(1, 100, r.integers(0, 40)).tolist()
        where, offset = packing.first_fit_decreasing(lengths, 100)
        room = []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, free in enumerate(room) if free >= lengths[i]), len(room))
            if b == len(room):
                room.append(100)
            assert (where[i], offset[i]) == (b, 100 - room[b])
            room[b] -= lengths[i]


@pytest.mark.parametrize("extra", [False, True])
def test_packing(spark, extra):
    rows = [r.asDict() for r in packing.pack_documents(docs_of(spark, extra=extra)).collect()]
    expected = Counter()
    for (doc_id, text, *_), ids in zip(ROWS, encoded(r[1] or "" for r in ROWS)):
        ids = np.array([*ids, 1], "<u4")
        for s in range(0, len(ids), 2048):
            expected[doc_id, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


# --- near duplicates ------------------------------------------------------------------


def simhash_of(text):
    found = [w.lower().encode() if w.isascii() else w.encode().lower() for w in WORD.findall(text or "")]
    grams = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(ids, prints, most=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates(spark, extra):
    prints = [simhash_of(r[1]) for r in ROWS]
    expected = Counter((r[0], f"{p:016x}", g) for r, p, g in zip(ROWS, prints, groups_of([r[0] for r in ROWS], prints)))
    got = simhash.near_duplicates(docs_of(spark, extra=extra)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_links_of_large_and_split_files(spark, monkeypatch):
    """Many fingerprints around few centres: files outgrow the small way and, with a small block, are split."""
    r = np.random.default_rng(5)
    values = []
    for centre in r.integers(0, 2**63, 3):
        for _ in range(150):
            bits = r.integers(0, 64, r.integers(0, 7))
            values.append(int(centre) ^ sum({1 << int(b) for b in bits}))
    values = list({v & (2**64 - 1) for v in values})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    expected = groups_of(list(range(len(values))), values)
    for block in (4096, 40):
        monkeypatch.setattr(simhash, "FILE_BLOCK", block)
        df = spark.createDataFrame([(v,) for v in signed], "fp long")
        root = {x.node: x.root for x in simhash.components(simhash.links(df)).collect()}
        first = {}
        for i, v in enumerate(signed):
            first.setdefault(root.get(v, v), i)
        assert [first[root.get(v, v)] for v in signed] == expected


def test_chain_budgets_lose_no_pair():
    r = np.random.default_rng(2)
    for _ in range(300):
        diff = 0
        for b in r.integers(0, 64, 3):
            diff |= 1 << int(b)
        turned = np.array([((diff << 4 * i) | (diff >> (64 - 4 * i))) & (2**64 - 1) for i in range(16)], np.uint64)
        first_five = turned >> np.uint64(44) == 0
        assert (first_five & np.isin(np.arange(16), simhash._chains(turned, 3))).any()


# --- mixing -------------------------------------------------------------------------


def test_mixing_reaches_targets(spark):
    rows = [(i, words(5 + i * 7 % 90, i), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(400)] + [(1000, "x " * 9000, "en", "huge", 0)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(size.values()), {}
    while True:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > 2 * size[s]}
        if not above:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in above}
        left -= above
    taken = Counter()
    for r in got:
        assert r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s in names:
        assert abs(taken[s] - target[s]) <= max(1, size[s] / 100), s
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs_of(spark, rows).repartition(7)).collect()))


def test_mixing_awkward(spark):
    got = mixing.mix(docs_of(spark, extra=True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert {r.doc_id: r.size for r in got if r.doc_id} == {r[0]: len(WORD.findall(r[1] or "")) for r in ROWS if r[0]}
    assert all(0 <= r.taken <= 2 * r.size for r in got)


def test_schedule_is_spread(spark):
    """Every run of slots holds about the share of each source, and each block has its turn."""
    rows = [(i, words(400, i), "en", "ab"[i % 2], 0) for i in range(120)]
    per = mixing.targets(mixing.sizes(docs_of(spark, rows)))
    slots = mixing.schedule(per).orderBy("slot").collect()
    share = sum(s.source == "a" for s in slots) / len(slots)
    for at in range(0, len(slots) - 40, 40):
        assert abs(sum(s.source == "a" for s in slots[at : at + 40]) - 40 * share) <= 4
    assert [s.round for s in slots if s.source == "b"] == sorted(s.round for s in slots if s.source == "b")


# --- repeated passages ----------------------------------------------------------------


def removed(rows, width=200):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(x[i : i + width] for x in raws for i in range(len(x) - width + 1))
    for r, x in zip(rows, raws):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield r[0], len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("extra", [False, True])
def test_repeated_passages(spark, extra):
    got = suffixes.remove_repeats(docs_of(spark, extra=extra)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(removed(ROWS))


def test_merge_of_transforms():
    r = np.random.default_rng(1)
    for trial in range(12):
        base = [bytes(r.integers(97, 100, r.integers(200, 600), dtype=np.uint8)) for _ in range(5)]
        texts = [b[a : a + r.integers(100, 500)] + bytes(r.integers(97, 123, 30, dtype=np.uint8)) for b in base for a in (0, 20, 57)]
        texts += [b"a" * 450, b"ab" * 150] if trial % 3 == 0 else []
        seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
        for t, flags in zip(texts, suffixes.merge_repeats(texts)):
            assert flags.tolist() == [seen[t[i : i + 200]] > 1 for i in range(len(t) - 199)]


def test_merge_and_cut_hold_little_memory():
    r = np.random.default_rng(2)
    copies = [bytes(r.integers(97, 123, 250, dtype=np.uint8)) for _ in range(2500)]
    parts = [part + tail for part in copies for tail in (b"x" * 40, b"y" * 50)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (list(range(5000)), [7] * 5000, [i // 2 for i in range(5000)], [0] * 5000, parts)], ["doc_id", "tag", "key", "start", "part"]
    )
    tracemalloc.start()
    runs = [run for out in suffixes._merge(iter([rows])) for run in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert runs == [{"doc_id": i, "tag": 7, "start": 0, "count": 51} for i in range(5000)]
    assert peak < 60e6  # 1.5 MB of pieces
    texts = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([7] * 5000), pa.array([p.decode() for p in parts])], ["doc_id", "tag", "text"])
    cut = list(suffixes._cut(iter([texts])))
    assert [i for out in cut for i in dict.fromkeys(out.column(0).to_pylist())] == list(range(5000))
    assert max(len(set(out.column(0).to_pylist())) for out in cut) <= 512


# --- fingerprints -----------------------------------------------------------------------


def test_edit_distances():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    r = np.random.default_rng(4)
    left = [bytes(r.integers(65, 69, r.integers(0, 65), dtype=np.uint8)) for _ in range(150)]
    right = [bytes(r.integers(65, 69, r.integers(0, 65), dtype=np.uint8)) if i % 2 else a[3:40] + a[44:] for i, a in enumerate(left)]
    assert fingerprints.distances(left, right).tolist() == [slow(a, b) for a, b in zip(left, right)]


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints(spark, extra):
    got = fingerprints.chained(docs_of(spark, extra=extra)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    hashing = fingerprints.Fingerprinter()
    known = sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0])
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for a, b in zip(known, known[1:]):
        x, y = a[1] or "", b[1] or ""
        r, edited = by_id[a[0]], fingerprints.edit(x, y)
        assert (r.n_chars, r.fingerprint) == (len(x), hashing.of(x.encode()))
        if a[0] != 18:  # the row that repeats follows itself
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.edited_fingerprint == hashing.of(edited.encode())
            assert r.near_next == fingerprints.likeness([(r.fingerprint, hashing.of(y.encode()))])[0]
    assert by_id[1].fingerprint == by_id[11].fingerprint and by_id[9].near_next > 0.8
    single = fingerprints.chained(docs_of(spark, [(5, "abc def", "en", "a", 1)])).collect()
    assert [r.near_next for r in single] == [1.0]


# --- labels -------------------------------------------------------------------------------


def test_classifiers_on_awkward_rows(spark):
    docs, labels = docs_of(spark, extra=True), labels_of(spark)
    for f, modulus, rest in ((toxicity.toxicity, 5, 0), (quality.quality, 4, 2)):
        got = f(docs, labels).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
        for r in got:
            assert 0 <= r.score <= 1
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
    assert f(docs, labels_of(spark, [])).where("score <> 0.5").count() == 0
    carried = toxicity.toxicity(docs, labels, carry=True)
    assert carried.select("row.*").columns == docs.columns


def test_toxicity_learns_words_and_stems(spark):
    bad, stem = ["idiot", "scum"], "zzork"
    rows, marks = [], []
    for i in range(600):
        text, toxic = words(60, i), i % 10 == 0
        if toxic:
            text += " you " + bad[i % 2] if i % 20 else " " + " ".join(stem + c for c in "abcd")
        rows.append((i, text, "en", "a", 0))
        marks.append((i, 1, int(toxic)))
    got = toxicity.toxicity(docs_of(spark, rows), labels_of(spark, marks)).where("held_out").collect()
    assert len(got) > 60 and all(r.predicted == (r.doc_id % 10 == 0) for r in got)


def test_quality_learns_structure(spark):
    rows = [(i, words(50, i).replace(" ", "### ") if i % 3 == 0 else words(50, i), "en", "a", 0) for i in range(400)]
    got = quality.quality(docs_of(spark, rows), labels_of(spark, [(i, int(i % 3 > 0), 0) for i in range(400)])).where("held_out").collect()
    assert len(got) > 50 and all(r.predicted == (r.doc_id % 3 > 0) for r in got)


def test_pair_sum_identity():
    r = np.random.default_rng(1)
    m = quality.Machine(30, 4)
    m.weight, m.factor = r.normal(size=30), r.normal(size=(30, 4))
    ids, values = np.arange(0, 30, 3), r.normal(size=10)
    slow = m.weight[ids] @ values + sum(values[i] * values[j] * (m.factor[ids[i]] @ m.factor[ids[j]]) for i in range(10) for j in range(i))
    assert abs(m.scores(ids, values, np.zeros(10, int), 1)[0][0] - slow) < 1e-9


# --- search ---------------------------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 150)
    monkeypatch.setattr(covertree, "GROUP", 3)
    r = np.random.default_rng(3)
    centres = r.normal(0, 0.5, (5, 8))
    data = [(int(i), [float(np.float32(x)) for x in centres[i % 5] + (0 if i % 3 else 0.1) * r.normal(size=8)], 0) for i in range(700)]
    bad = [(800, None, 0), (900, [1.0] * 7 + [None], 0), (1000, [float("nan")] + [1.0] * 7, 0), (1100, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1200, [0.5, 0.5], 0), (1300, [], 0)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(data + bad, schema).withColumn("score", F.lit("extra")).withColumn("block", F.lit(1))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in covertree.nearest(df).collect())
    ints = np.floor(np.array([v for _, v, _ in data]) * 1024).astype(np.int64)
    expected = []
    for q in range(0, 700, 100):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in range(700) if c != q)[:10]
        expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == expected
    assert covertree.nearest(df.where("vec_id < 0")).collect() == []


# --- token files -----------------------------------------------------------------------------


def test_token_counts(spark):
    got = tokenscan.token_counts(docs_of(spark, extra=True)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(i)) for r, i in zip(ROWS, encoded(r[1] or "" for r in ROWS)))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_scan_stitches_blocks(spark, tmp_path, block):
    r = np.random.default_rng(block)
    expected = []
    for f in range(4):
        ids = r.integers(0, 50, 200).astype("<u2")
        ids[r.integers(0, 200, 12)] = tokenscan.END_ID
        if f == 1:
            ids[:] = 7
        if f == 2:
            ids[-1] = tokenscan.END_ID
        ids = ids[:0] if f == 3 else ids
        (tmp_path / f"{f}.u16").write_bytes(ids.tobytes())
        at = 0
        for n, end in enumerate([*np.flatnonzero(ids == tokenscan.END_ID), len(ids)]):
            if end < len(ids) or end > at:
                expected.append((f"{f}.u16", n, at, end - at, end < len(ids)))
            at = end + 1
    got = tokenscan.scan(spark, str(tmp_path), block_tokens=block).collect()
    assert sorted((x.file, x.doc_no, x.start, x.tokens, x.closed) for x in got) == sorted(expected)


# --- chat -----------------------------------------------------------------------------------


def test_chat(spark):
    logs = {
        1: [("user", "hi"), ("assistant", "yes")], 2: [("user", "hi")], 3: [("user", "hi"), ("assistant", "yes"), ("user", "more")],
        4: [("user", "hi"), ("assistant", "no")], 5: [("user", "hi"), ("assistant", "no")], 6: [(None, None)], 7: [("user", "")], None: [("system", "x")],
    }
    rows = [(c, t, r, x, "extra") for c, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(8, None, "user", "late", "e"), (8, 0, "user", "late", "e")]
    schema = "conv_id long, turn long, role string, text string, at string"
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.collapse(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {3, 4, 6, 7, 8, None} and got[4][:2] == (2, 2) and got[8][0] == 2
    assert got[3][2] == "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nmore<|end|>\n"
    assert chat.collapse(spark.createDataFrame([], schema)).collect() == []


# --- empty tables ------------------------------------------------------------------------------


def test_empty_tables(spark):
    none, labels = docs_of(spark, []), labels_of(spark, [])
    for df in (
        packing.pack_documents(none), simhash.near_duplicates(none), mixing.mix(none), suffixes.remove_repeats(none), fingerprints.chained(none),
        toxicity.toxicity(none, labels), quality.quality(none, labels), tokenscan.token_counts(none),
    ):
        assert df.collect() == []
