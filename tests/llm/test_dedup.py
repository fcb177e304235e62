"""Suffix-array and SimHash de-duplication against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almagest.llm import simhash, suffix_dedup

from .helpers import docs_of, odd_rows, prose, with_clashes


def brute_digests(rows, window):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i:i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                mark[i:i + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if mark[i] and (i == 0 or not mark[i - 1]))
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((d, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def passages():
    """Shared passages in different surroundings, copies, edits, periodic and
    low-entropy texts."""
    r = random.Random(5)
    p = [prose(i, 120) for i in range(4)]
    rows = [(i, f"{prose(100 + i, 30)} {p[i % 4]} {prose(200 + i, 30)}") for i in range(30)]
    rows += [(100 + i, rows[0][1]) for i in range(4)]
    near = list(rows[1][1])
    near[len(near) // 2] = "#"
    rows += [(200, "".join(near)), (201, p[0][:399]), (202, p[0][:400]), (203, p[0][:401]), (204, p[1] + p[1]),
             (205, "Mentpa " * 300), (206, "Mentpa " * 80), (207, "é" * 450), (208, "x" * 1000), (209, "x" * 399)]
    r.shuffle(rows)
    return rows


def test_removed_bytes_equal_brute_force(spark):
    rows = passages() + odd_rows()
    assert found(suffix_dedup.digests(spark, docs_of(spark, rows))) == brute_digests(rows, 400)


def test_small_window_and_hot_prefixes(spark, monkeypatch):
    rows = [(i, f"{prose(i, 8)} one passage that stands in very many surroundings indeed {prose(50 + i, 8)}") for i in range(40)]
    rows += [(100 + i, f"in many surroundings indeed {prose(100 + i % 3, 4)}") for i in range(9)]
    want = brute_digests(rows, 24)
    assert found(suffix_dedup.digests(spark, docs_of(spark, rows), window=24, prefix=10)) == want
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", 2)
    assert found(suffix_dedup.digests(spark, docs_of(spark, rows), window=24, prefix=10)) == want


def in_process(rows, window=400, prefix=160):
    """Anchors, contexts and sort of the texts without Spark: spans of rows,
    rows of each context batch."""
    table = pa.table({"k1": pa.array([r[0] for r in rows], pa.int64()), "k2": pa.array([0] * len(rows), pa.int64()),
                      "text": pa.array([r[1] for r in rows])})
    blocks = pa.Table.from_batches(suffix_dedup._anchors(window, prefix)(table.to_batches())).to_pandas()
    lists = [blocks[blocks.k1 == d][["pack", "ph"]].to_dict("records") for d in table.column("k1").to_pylist()]
    asked = table.append_column("blocks", pa.array(lists, pa.list_(pa.struct([("pack", pa.int64()), ("ph", pa.int64())]))))
    found_in = list(suffix_dedup._contexts(window, prefix)(asked.combine_chunks().to_batches()))
    ordered = pa.Table.from_batches(found_in).sort_by([("lead", "ascending"), ("ph", "ascending")])
    spans = Counter()
    for part in suffix_dedup._sorted_windows(window, prefix)(ordered.combine_chunks().to_batches()):
        for k, s, e in zip(*(part.column(c).to_pylist() for c in ("k1", "s", "e"))):
            spans.update((k, i) for i in range(s, e))
    return set(spans), [b.num_rows for b in found_in]


def test_parts_of_a_sort_find_what_the_whole_finds(monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(passages())]
    whole, _ = in_process(rows)
    assert whole
    monkeypatch.setattr(suffix_dedup, "SORTED", 100)
    monkeypatch.setattr(suffix_dedup, "BLOCKS", 7)
    parted, sizes = in_process(rows)
    assert parted == whole and max(sizes) <= 7
    place = np.random.default_rng(1).integers(-300, 300, 5_000)
    parts = list(suffix_dedup._by_place(place))
    assert np.array_equal(np.sort(np.concatenate(parts)), np.arange(5_000))
    assert sum(len(np.unique(place[p])) for p in parts) == len(np.unique(place)) and max(map(len, parts)) <= 100


def test_memory_of_a_task_is_bounded():
    """Anchors of 8 MB of text, and one passage in 4 000 surroundings."""
    def most(run, batches):
        tracemalloc.start()
        for _ in run(batches):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / 1e6

    text = prose(1, 1_400_000, 50_000)
    ids = pa.array([1, 2], pa.int64())
    texts = pa.RecordBatch.from_arrays([ids, ids, pa.array([text[:4_000_000], text[4_000_000:]])], names=["k1", "k2", "text"])
    assert most(suffix_dedup._anchors(400, 160), [texts]) < 100
    n, width = 4_000, 640
    body = np.random.default_rng(2).integers(97, 123, (n, width), np.uint8)
    body[:, 240:400] = body[0, 240:400]
    ids = pa.array(np.arange(n))
    group = pa.RecordBatch.from_arrays(
        [ids, ids, pa.array(np.full(n, (240 << 12) | 240)), pa.array(np.zeros(n, np.int64)),
         pa.array([b[240:264].tobytes() for b in body]), pa.array([b.tobytes() for b in body])],
        names=["k1", "k2", "pack", "ph", "lead", "body"])
    assert most(suffix_dedup._sorted_windows(400, 160), [group]) < 150


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 1500)
    long = prose(1, 1200)
    rows = [(1, long), (2, long[3000:3900]), (3, prose(2, 50) + long[2950:3600]), (4, long[:500] + long[100:700])]
    data = [(d, t.encode()) for d, t in rows]
    off = np.cumsum([0, *(len(b) for _, b in data)])
    blocks = {}
    for i, shift, part, poff in suffix_dedup._pieces(np.frombuffer(b"".join(b for _, b in data), np.uint8), off, 400):
        for r, a, b, _ in zip(*suffix_dedup.anchor_blocks(part, poff, 400, 160)):
            blocks.setdefault(int(i + r), []).extend(range(int(a) + shift, int(b) + shift + 1))
    # every window is in exactly one block, whatever the parts
    assert {r: sorted(w) for r, w in blocks.items()} == {r: list(range(len(b) - 399)) for r, (_, b) in enumerate(data) if len(b) >= 400}


def test_texts_keep_their_columns(spark):
    rows = [(1, "a" * 500), (2, "a" * 500), (3, "clean"), (4, None), (5, "é" * 300 + "tail"), (6, "é" * 300 + "end")]
    docs = with_clashes(docs_of(spark, rows))
    out = suffix_dedup.remove_repeats(spark, docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    got = {r.doc_id: (r.text, r.n_chars, r.k1) for r in out.collect()}
    assert got[1] == ("", 0, "extra") and got[3] == ("clean", 5, "extra") and got[4][0] is None
    assert got[5][0] == "tail" and got[6][0] == "end"


def test_empty_table(spark):
    empty = docs_of(spark, [])
    assert suffix_dedup.digests(spark, empty).count() == 0
    assert suffix_dedup.remove_repeats(spark, empty).count() == 0
    assert simhash.near_duplicates(spark, empty).count() == 0
    assert simhash.keep_one(spark, empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=5, max_size=5)), max_size=40))
def test_multikey_sort_orders_strings(rows):
    run = np.array([r for r, _ in rows], np.int64)
    text = np.array([list(t.encode()) for _, t in rows], np.int64).reshape(len(rows), 5)
    order, equal = suffix_dedup.multikey_sort([lambda i, d=d: text[i, d] for d in range(5)], len(rows), run)
    s = [rows[i] for i in order.tolist()]
    assert s == sorted(rows)
    assert equal.tolist() == [False, *(a == b for a, b in zip(s, s[1:]))][:len(s)]


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, most):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def near_rows():
    base = prose(3, 200).split()
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(i % 7):
            words[(i * 13 + j * 29) % 200] = f"edit{i}"
        rows.append((i, " ".join(words)))
    return rows + [(500 + i, prose(900 + i, 3 + i)) for i in range(30)] + odd_rows()


@pytest.mark.parametrize("most", [1, 2, 3])
def test_simhash_equals_brute_force(spark, most):
    rows = near_rows()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = Counter(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components(fps, [r[0] for r in rows], most)))
    out = simhash.near_duplicates(spark, with_clashes(docs_of(spark, rows)), max_bits=most)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == want


def test_shingle_hash_is_sparks(spark):
    row = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()
    assert [row[0] % 2**64] == simhash.shingle_hashes(b"A  b\nC", 3)


def test_large_bucket_search_spans_components():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([base[r.integers(0, 5, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64))
                                   ^ (np.uint64(1) << r.integers(0, 64, 400, dtype=np.uint64))]))
    table = np.bitwise_count(fp[:, None] ^ simhash.PIVOTS[None, :]).astype(np.int8)
    links = simhash._search(fp, table, 2)
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= 2 for a, b in links)
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[root(a)] = root(b)
    mine = [root(i) for i in range(len(fp))]
    brute = brute_components([int(f) for f in fp], list(range(len(fp))), 2)
    assert len(set(zip(mine, brute))) == len(set(mine)) == len(set(brute))


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    docs = with_clashes(docs_of(spark, rows))
    out = simhash.keep_one(spark, docs)
    assert out.columns == docs.columns
    fps = {}
    for r in out.collect():
        fps.setdefault((r.doc_id, r.text), 0)
        fps[r.doc_id, r.text] += 1
    assert set(fps.values()) == {1}
    groups = brute_components([brute_fingerprint(t) for _, t, *_ in rows], list(range(len(rows))), 2)
    assert out.count() == len(set(groups))
    # the least id of each group, null only where there is no other
    best = {}
    for g, (d, *_) in zip(groups, rows):
        best[g] = min(best.get(g, float("inf")), float("inf") if d is None else d)
    assert Counter(float("inf") if d is None else d for d, _ in fps) == Counter(best.values())
