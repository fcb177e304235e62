"""Spelling variants, lexicon BPE and hard negatives against brute force."""

import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almagest.llm import hard_negatives, lexicon_bpe, spelling
from almagest.llm.common import utf8

from .helpers import docs_of, odd_rows, prose, with_clashes

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# hard negatives

def vector_rows():
    r = np.random.default_rng(4)
    middle = r.standard_normal((4, 8))
    rows = [(i, [float(x) for x in middle[i % 4] + r.standard_normal(8).astype(np.float32)], i % 4) for i in range(260)]
    rows += [(300 + i, rows[i % 3][1], i % 5) for i in range(60)]  # equal vectors, ties
    rows += [(400, [1e-3] * 8, 7), (401, [2e-3] * 8, 7), (450, [0.0] * 8, 1), (500, [-1.0] * 8, 9), (501, [1.0] * 8, 9)]
    rows += [(550, None, 1), (551, [1.0, None, *[0.0] * 6], 1), (552, [float("nan")] * 8, 1), (553, [float("inf")] * 8, 1),
             (554, [1.0] * 8, None), (None, [1.0] * 8, 1), (600, [1.0, 2.0], 1), (601, [2.0, 4.0], 1), (602, [2.0, 2.0], 2),
             (650, [], 1), (651, [], 1), (652, [], 2), (100, rows[7][1], 3), (9, rows[9][1], 2), (9, rows[9][1], 2)]
    return rows


def brute_negatives(rows, is_anchor):
    good = [(i, [floor(256 * float(x)) for x in v], label) for i, v, label in rows
            if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    anchors = {}
    for i, v, label in good:
        if is_anchor(i):
            anchors[i, len(v)] = min(anchors.get((i, len(v)), (label, v)), (label, v))
    least = {}
    for (i, n), (label, v) in anchors.items():
        least[i] = min(least.get(i, (label, v, n)), (label, v, n))
    for i, (label, v, n) in least.items():
        met = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in good if j != i and len(w) == n)
        for s, j, _ in [m for m in met if m[2] == label][:5]:
            fit = [m for m in met if m[2] != label and 50 * -s <= 100 * -m[0] <= 95 * -s][:3]
            out += [(i, j, k + 1, m[1], -s, -m[0]) for k, m in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [(8192, 262_144, 512, 4096), (2, 40, 1, 7)])
def test_negatives_equal_brute_force(spark, monkeypatch, tiles):
    for name, n in zip(("ANCHOR_TILE", "ROW_TILE", "ANCHOR_BLOCK", "ROW_BLOCK"), tiles, strict=True):
        monkeypatch.setattr(hard_negatives, name, n)
    rows = vector_rows()
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4))
    got = hard_negatives.mine(spark, df.withColumns({"key": F.lit(1), "anchor_id": F.lit(2)}), F.expr("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_negatives_of_huge_numbers_and_of_nothing(spark):
    big = [(50, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [1e12, 0.0], 2), (100, [3e6, 1.0], 1), (3, [3e6, 2.0], 1), (4, [2e6, 5.0], 2)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(spark, df, F.expr("vec_id % 50 = 0")).collect()
    exact = sum(floor(256 * a) * floor(256 * b) for a, b in zip([3e6, 1.0], [2e6, 5.0], strict=True))
    assert exact > 2**53
    assert {(r.anchor_id, r.positive_id, r.negative_score) for r in got} == {(100, 3, exact)}
    assert hard_negatives.products(np.array([[2**62]]), np.array([[4], [-4], [1]])).tolist() == [[2**63 - 1, -2**63 + 1, 2**62]]
    assert hard_negatives.mine(spark, df.limit(0), F.expr("vec_id % 50 = 0")).count() == 0


@given(st.lists(st.tuples(st.integers(-2**63, 2**63 - 1), st.integers(-2**63 + 1, 2**63 - 1), st.integers(0, 1),
                          st.integers(-2**63, 2**63 - 1)), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_key_order_is_reading_order(spark, rows):
    df = spark.createDataFrame(rows, "a long, s long, k int, i long")
    key = F.when(F.col("k") == 0, hard_negatives.packed(F.col("a"), F.col("s"), 0, F.col("i"))).otherwise(
        hard_negatives.packed(F.col("a"), F.col("s"), 1, F.col("i")))
    keys = sorted(bytes(r.key) for r in df.select(key.alias("key")).collect())
    back = list(zip(*hard_negatives.unpacked(pa.array(keys, pa.binary())), strict=True))
    assert back == [(a, s, k, i) for a, s, k, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))]


def test_negatives_sort_once_and_keep_no_anchor(spark, sf_dir):
    from almagest.llm import queries
    plan = queries.op13_hard_negatives(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(anchor_id" in plan and "Sort [key" in plan and "CartesianProduct" not in plan


# spelling variants

def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    out, form = [], {}
    close = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variant_rows():
    import random
    r = random.Random(5)
    letters = "abcdeéßÀ×"
    base = ["".join(r.choice(letters) for _ in range(r.randint(6, 9))) for _ in range(25)] + ["aaaaaa", "abcabc", "éééééé"]
    rows = []
    for i in range(260):
        words = []
        for _ in range(40):
            w = list(r.choice(base))
            for _ in range(r.choice((0, 0, 0, 0, 1, 1, 2))):
                at, c = r.randrange(len(w)), r.choice(letters)
                w[at:at + r.choice((0, 1))] = r.choice(([c], []))
            words.append("".join(w).upper() if r.random() < 0.1 and "ß" not in w else "".join(w))
        rows.append((i if i % 50 else None, r.choice((" ", "1", "\n", "_")).join(words)))
    long = "x" * 3000
    return rows + odd_rows() + [(i, f"{long} {long}y z{long}") for i in range(900, 906)] + [rows[3], rows[3]]


@pytest.mark.parametrize("symbols,chunk", [(4, 4 << 20), (2, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, symbols, chunk):
    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    rows = variant_rows()
    docs = with_clashes(docs_of(spark, rows)).withColumns({"word": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    got = spelling.group_variants(spark, docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute_variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark, docs_of(spark, [])).count() == 0
    assert spelling.group_variants(spark, docs_of(spark, [(1, None), (2, "")])).count() == 0


@given(st.text(max_size=30), st.text(st.characters(codec="utf-8"), max_size=90))
@settings(max_examples=200, deadline=None)
def test_checksums_join(a, b):
    a, b = a.encode(errors="replace"), b.encode()[:64]
    got = spelling.Checksums().join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


@given(st.text("abcdeé", min_size=6, max_size=9), st.data())
@settings(max_examples=200, deadline=None)
def test_a_word_reaches_every_word_one_edit_away(word, data):
    at, c = data.draw(st.integers(0, len(word))), data.draw(st.sampled_from("abcdeéz"))
    edited = [word[:at] + c + word[at:], word[:at] + c + word[at + 1:]] + ([word[:at] + word[at + 1:]] if len(word) > 6 else [])
    keys = lambda pairs: {k for _, key in pairs for k in key.tolist()}
    reach = keys(spelling.Reduced(pa.array([word])).neighbours())
    for other in edited:
        assert reach & keys([spelling.Reduced(pa.array([other])).own()])


# lexicon BPE

def library(texts):
    tokenizer = lexicon_bpe.vocabulary(TOKENIZER).tokenizer
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encoder(words, tmp_path):
    known = lexicon_bpe.vocabulary(TOKENIZER)
    words = sorted(set(words))
    file = tmp_path / "lexicon.bin"
    file.write_bytes(lexicon_bpe.packed(lexicon_bpe.compiled(words, known.merged(words))))
    return lexicon_bpe.Encoder(TOKENIZER, lexicon_bpe.Lexicon(str(file)))


def ids_of(enc, texts):
    parts, n = enc.encode(*utf8(pa.array(texts, pa.string())))
    return [a.tolist() for a in np.split(np.concatenate([*parts, np.zeros(0, np.uint32)]), np.cumsum(n)[:-1])]


PIECES = st.sampled_from([*"ab c\n\t'strevmld10.,!", "  ", "'s", "'re", "'ll", " '", "<|endoftext|>", "<|endof", "é", "ß", "中", "　", "\xa0",
                          "²", "٣", "́", "🙂", "\x1c", "\x85", "\u0000", "don't", " ", "𐒀", "\U000e0100"])
TEXTS = st.lists(st.one_of(st.lists(PIECES, max_size=30).map("".join), st.text(st.characters(codec="utf-8"), max_size=20)), min_size=1, max_size=8)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_encoding_equals_the_library(tmp_path_factory, texts):
    words = [w.encode() for t in texts[::2] for w in regex.findall(r" ?\w+|\s", t) if len(w.encode()) <= 48]
    enc = encoder(words, tmp_path_factory.mktemp("lexicon"))
    got = ids_of(enc, texts)
    assert got == library(texts)
    known = lexicon_bpe.vocabulary(TOKENIZER)
    flat = np.array([i for ids in got for i in ids], np.int64)
    back = lexicon_bpe.decoded(flat, np.array(list(map(len, got))), known).to_pylist()
    assert back == [known.tokenizer.decode(ids, skip_special_tokens=False) for ids in got] == texts


def test_long_texts_are_cut_where_words_part(tmp_path, monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "CHUNK", 300)
    texts = [prose(1, 800), "<|endoftext|>".join([prose(2, 90)] * 3), "x" * 2000, " " * 1500 + "a", "é ü " * 400, None, ""]
    enc = encoder([b" abc"], tmp_path)
    assert ids_of(enc, texts) == library([t or "" for t in texts])
    segments, _ = enc.vocabulary.segments(*utf8(pa.array(texts[:1])))
    assert len(segments) > 5 and np.diff(segments).max() < 700


@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60))
@settings(max_examples=100, deadline=None)
def test_the_automaton_is_minimal_and_numbers_its_words(tmp_path_factory, words):
    words = sorted(words)
    edges, ends, counts = lexicon_bpe.minimal(words)
    assert counts[-1] == len(words)
    tails = set()

    def language(state):
        return frozenset({b""} if ends[state] else set()) | {bytes([b]) + t for b, to in edges[state].items() for t in language(to)}
    tails = [language(s) for s in range(len(edges))]
    assert len(set(tails)) == len(tails) and tails[-1] == frozenset(words)
    file = tmp_path_factory.mktemp("lexicon") / "l.bin"
    file.write_bytes(lexicon_bpe.packed(lexicon_bpe.compiled(words, [np.array([i]) for i in range(len(words))])))
    ask = words + [w + b"a" for w in words] + [w[:-1] for w in words] + [b"zz"]
    data, size = np.frombuffer(b"".join(ask), np.uint8), np.array(list(map(len, ask)))
    ask_n = lexicon_bpe.Lexicon(str(file)).find(data, np.cumsum(size) - size, size).tolist() if len(data) else []
    place = {w: i for i, w in enumerate(words)}
    assert all(n == place.get(w, -1) for w, n in zip(ask, ask_n, strict=True) if w)


def test_operators_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "LEXICON", 20)
    rows = odd_rows() + [(20, prose(3, 300)), (21, prose(3, 300)), (22, "a<|endoftext|>b")]
    docs = with_clashes(docs_of(spark, rows)).withColumns({"ids": F.lit(1), "word": F.lit("w"), "n": F.lit(2)})
    encoded = lexicon_bpe.encode(spark, docs, TOKENIZER)
    back = lexicon_bpe.decode(encoded, TOKENIZER).collect()
    want = sorted((str(i), np.array(ids, "<u4").tobytes(), t or "") for (i, t), ids in
                  zip(rows, library([t or "" for _, t in rows]), strict=True))
    assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in back) == want
    digests = lexicon_bpe.digests(spark, docs, TOKENIZER)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert digests.agg(F.sum("n_tokens")).first()[0] == sum(len(b) // 4 for _, b, _ in want)


def test_frequent_words_keep_to_their_number(spark):
    docs = docs_of(spark, [(i, prose(i, 200)) for i in range(20)] + [(99, None)])
    every = lexicon_bpe.frequent_words(spark, docs, TOKENIZER)
    few = lexicon_bpe.frequent_words(spark, docs, TOKENIZER, 50)
    assert 0 < len(few) <= 50 and set(few) < set(every) and every == sorted(every)
    assert lexicon_bpe.frequent_words(spark, docs_of(spark, []), TOKENIZER) == []


def test_encoding_of_nothing_and_decoding_of_anything(spark):
    assert lexicon_bpe.digests(spark, docs_of(spark, []), TOKENIZER).count() == 0
    known = lexicon_bpe.vocabulary(TOKENIZER)
    lead = known.inner[0xC3]
    ids = [[lead], [lead, known.inner[0xA9]], [50256, 60000, 2**32 - 1]]
    df = spark.createDataFrame([(i, np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)] + [(9, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.text for r in lexicon_bpe.decode(df, TOKENIZER).collect()}
    assert got == {0: "�", 1: "é", 2: "<|endoftext|>", 9: ""}


def test_negatives_and_words_need_no_order(spark):
    rows = [r for r in vector_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    seen = defaultdict(list)
    for parts in (1, 7):
        seen["n"].append(sorted(map(tuple, hard_negatives.mine(spark, df.repartition(parts), F.expr("vec_id % 50 = 0")).collect())))
    assert seen["n"][0] == seen["n"][1]
