"""Nearest neighbours, mixing, packing, edit-aware counts, line rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from almagest.llm import ann, edit_counts, line_rules, mixing, packing
from almagest.llm.bpe import Merges
from almagest.llm.common import written

from .helpers import docs_of, odd_rows, prose, with_clashes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# nearest neighbours

def vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.standard_normal(8).astype(np.float32)]) for i in range(330)]
    rows += [(400 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(600, None), (650, []), (651, [0.0] * 8), (652, [1.0, None, *[0.0] * 6]), (700, [float("nan")] * 8),
             (750, [float("inf"), *[1.0] * 7]), (None, [1.0] * 8), (800, [1.0, 2.0]), (801, [2.0, 4.0]), (3, rows[7][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def brute_nearest(rows, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            near = sorted((-float(ann.cosines(x[None], y[None])[0]), i) for i, y in good if i != q and len(y) == len(x))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


@pytest.mark.parametrize("tiles", [(32_768, 262_144), (3, 50)])
def test_nearest_equals_brute_force(spark, monkeypatch, tiles):
    monkeypatch.setattr(ann, "QUERY_TILE", tiles[0])
    monkeypatch.setattr(ann, "CANDIDATE_TILE", tiles[1])
    rows, df = vectors(spark)
    got = defaultdict(list)
    for r in ann.nearest(spark, df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {q: v for q, v in brute_nearest(rows, 5).items() if v}


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(spark, df, df.filter("vec_id = 50")).collect()] == [(50, 1, 1, pytest.approx(0.5**0.5))]
    assert ann.nearest(spark, df.limit(0), df.limit(0)).count() == 0


def test_nearest_of_extreme_vectors(spark):
    rows = [(50, [1e-170, 2e-170]), (100, [1.0, 1.5]), (1, [1e200, 1e200]), (2, [1e-170, 1e-170]), (3, [5e-324, 0.0]), (4, [-1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(spark, df, df.filter("vec_id % 50 = 0")).collect()}
    assert len(got) == 10
    assert [got[100, 1], got[100, 2]] == pytest.approx([2.5 / (3.25 * 2) ** 0.5] * 2, rel=1e-12)
    assert got[50, 100] == pytest.approx(4 / (5 * 3.25) ** 0.5, rel=1e-12) and got[50, 3] == pytest.approx(5**-0.5, rel=1e-12)
    assert got[100, 4] == pytest.approx(0.5 / (3.25 * 2) ** 0.5, rel=1e-12)


def test_training_order_of_many_files(spark, tmp_path):
    """Rows of files 99 999 and 100 000 come in the order of their numbers."""
    for n in (100_000, 99_999, 7):
        spark.createDataFrame([(n, "x")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        made = next((tmp_path / f"w{n}").glob("part-*.parquet"))
        (tmp_path / f"part-{n:05d}-abc.c000.parquet").write_bytes(made.read_bytes())
    rows = spark.read.parquet(str(tmp_path / "part-*.parquet")).orderBy(*mixing.written_order()).collect()
    assert [r.doc_id for r in rows] == [7, 99_999, 100_000]


# mixing

def mix_rows():
    rows = [(i, prose(i, 1 + i % 37), "en", f"s{i % 5}" if i % 11 else None) for i in range(400)]
    rows += [(1000 + i, prose(i, 2), "en", "tiny") for i in range(3)] + [(2000, None, None, "s0"), (2001, "", None, "empty")]
    return rows + [rows[0], rows[0]] + [(None, "no id here", None, "s1")]


def water(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_mix_reaches_targets(spark):
    rows = mix_rows()
    docs = with_clashes(docs_of(spark, rows)).drop("source").withColumn("source", docs_of(spark, rows)["source"]) if False else docs_of(spark, rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3] if len(r) > 3 else "s"] += len((r[1] or "").split())
    want = water(sizes)
    plan = mixing.plan(spark, docs).collect()
    assert len(plan) == len(rows)
    taken = Counter()
    source = {(r[0], len((r[1] or "").split())): r[3] for r in rows}
    for r in plan:
        s = source[r.doc_id, r.size]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
        assert r.taken <= 2 * r.size and r.taken == r.size * len(r.positions)
        assert all(0 <= p <= 1 for p in r.positions)
        taken[s] += r.taken
    longest = max(r.size for r in plan)
    assert all(abs(taken[s] - want[s]) <= longest for s in want)
    again = mixing.plan(spark, docs.repartition(7)).collect()
    key = lambda rows: sorted((r.doc_id or -1, r.size, r.taken, tuple(r.positions)) for r in rows)
    assert key(plan) == key(again)


def test_mix_gives_rows_in_order(spark):
    docs = with_clashes(docs_of(spark, mix_rows()))
    out = mixing.mix(spark, docs)
    assert out.columns == docs.columns
    plan = mixing.plan(spark, docs).collect()
    want, at = Counter(), defaultdict(list)
    for r in plan:
        want[r.doc_id] += len(r.positions)
        at[r.doc_id] += r.positions
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == +want
    order = [min(at[r.doc_id]) for r in rows if len(at[r.doc_id]) == 1]
    assert order == sorted(order)


def test_early_and_late_sources(spark):
    rows = [(i, prose(i, 20), "en", f"s{i % 3}") for i in range(3000)]
    plan = mixing.plan(spark, docs_of(spark, rows)).collect()
    mean = {s: np.mean([p for r in plan if r.doc_id % 3 == s for p in r.positions]) for s in range(3)}
    assert mean[0] < 0.45 < mean[1] < 0.55 < mean[2]


def test_sequences_follow_the_training_order(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH_BITS", 6)
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    rows = [(i, prose(i, 20), "en", f"s{i % 3}") for i in range(2000)]
    mixed = written(spark, mixing.mix(spark, docs_of(spark, rows)), "mixed")
    out = packing.pack(spark, mixed, TOKENIZER, window=256, order=mixing.written_order()).collect()
    plan = mixing.plan(spark, docs_of(spark, rows)).collect()
    assert len(out) == mixed.count() == sum(len(r.positions) for r in plan)
    fill, when = Counter(), {r.doc_id: r.positions[0] for r in plan if len(r.positions) == 1}
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 256
    rank = {s: i / len(fill) for i, s in enumerate(sorted(fill))}
    once = [r for r in out if r.doc_id in when]
    assert len(once) > 300 and np.corrcoef([rank[r.sequence_id] for r in once], [when[r.doc_id] for r in once])[0, 1] > 0.95
    mean = [np.mean([rank[r.sequence_id] for r in out if r.doc_id % 3 == s]) for s in range(3)]
    assert mean[0] < 0.47 < mean[1] < 0.53 < mean[2]


def test_plan_in_order(spark):
    rows = mixing.in_order(spark, mixing.plan(spark, docs_of(spark, mix_rows()))).collect()
    first = [r.positions[0] if r.positions else 2.0 for r in rows]
    assert first == sorted(first) and len(rows) == len(mix_rows())


def test_empty_mix(spark):
    assert mixing.plan(spark, docs_of(spark, [])).count() == 0
    assert mixing.mix(spark, docs_of(spark, [])).count() == 0
    assert mixing.plan(spark, docs_of(spark, [(1, None), (2, "")])).agg({"taken": "sum"}).first()[0] == 0


# packing

def test_pieces_are_whole_and_gapless(spark):
    rows = odd_rows() + [(20 + i, prose(i, 10 * i)) for i in range(60)] + [(99, prose(7, 9000)), (98, "it's <|endoftext|> A'LL 12 3")]
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 512):
            want[r[0], s, len(ids[s:s + 512]), zlib.crc32(ids[s:s + 512].tobytes()), len(ids)] += 1
    out = packing.pack(spark, with_clashes(docs_of(spark, rows)), TOKENIZER, window=512, with_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    seqs = defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for pieces in seqs.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 512
    total = sum(r.length for r in out)
    assert len(seqs) <= total / 512 * 1.03 + 1


def test_groups_do_not_share_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    out = packing.pack(spark, docs_of(spark, [(i, prose(i, 5 + i)) for i in range(100)]), TOKENIZER, window=256).collect()
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 256
    assert packing.pack(spark, docs_of(spark, []), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit_equals_plain_search(lengths):
    lengths = np.array(lengths, np.int64)
    place, offset = packing.best_fit_decreasing(lengths, 32)
    rest = []
    for r in np.argsort(-lengths, kind="stable").tolist():
        fits = [c for c in rest if c >= lengths[r]]
        if fits and lengths[r] < 32:
            rest.remove(min(fits))
            rest.append(min(fits) - lengths[r])
        else:
            rest.append(32 - lengths[r])
    fill = np.zeros(place.max(initial=-1) + 1, np.int64)
    np.add.at(fill, place, lengths)
    assert sorted((32 - fill).tolist()) == sorted(rest)
    for w in range(len(fill)):
        mine = np.flatnonzero(place == w)
        mine = mine[np.argsort(offset[mine])]
        assert (offset[mine] == np.cumsum(lengths[mine]) - lengths[mine]).all()


def test_worker_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    enc, tok = packing.WordIds(TOKENIZER, 2), Tokenizer.from_file(TOKENIZER)
    for i in range(5):
        text = prose(i, 40)
        ids, at = enc.encode(pa.array([text, ""]))
        assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2, 2] and at.tolist() == [0, len(ids) - 1, len(ids)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abeINGthé ÉßÿĀσΣİ'-,.!12|<>%\n\t\x1c\u00a0e\u0301"), max_size=60)
       .map(lambda t: t.replace("INt", "<|endoftext|>").replace("IG", "<|ENDOFTEXT|>")))
def test_words_encode_as_the_library_does(text):
    ids, _ = packing.word_ids(TOKENIZER, 2).encode(pa.array([text]))
    assert ids.tolist() == [*TOK.encode(text, add_special_tokens=False).ids, 2]


def test_plain_words_by_merges():
    words = sorted({w for i in range(40) for w in prose(i, 60, 60).split()} | {"a", "é", "the", "straße", "y" * 48, "tion" * 12})
    got = Merges(TOKENIZER).encode([w.encode() for w in words])
    assert [g.tolist() for g in got] == [TOK.encode(w, add_special_tokens=False).ids for w in words]


# edit-aware counts

TOK = Tokenizer.from_file(TOKENIZER)


def recount(text, edits):
    out, at = [], 0
    for s, e, new in edit_counts._in_order(edits, len(text)):
        out += [text[at:s], new]
        at = e
    text = b"".join([*out, text[at:]])
    return text, len(TOK.encode(text.decode(), add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text("ab c\n", max_size=60), st.lists(st.tuples(st.integers(-3, 64), st.integers(-3, 64), st.text("xy z", max_size=6)), max_size=6))
def test_tree_equals_full_recount(text, edits):
    from almagest.llm.common import word_spans

    raw = text.encode()
    edits = [(s, e, t.encode()) for s, e, t in edits]
    starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    enc = packing.word_ids(TOKENIZER, None)
    code, _ = enc.lookup(pa.array([text]), parted=False)
    tree = edit_counts.TokenTree(raw, starts, ends, enc.size[code], enc)
    new, encoded = tree.edit(edits)
    want, count = recount(raw, edits)
    assert new == want and tree.total == count
    # sums of every inner node hold
    n = tree.leaves
    assert all(tree.sums[i] == tree.sums[2 * i] + tree.sums[2 * i + 1] for i in range(1, n))


def test_edits_at_one_place_all_count():
    raw, enc = b"aaaa bbbb cccc", packing.word_ids(TOKENIZER, None)
    for edits, want in (([(5, 5, b"x "), (5, 5, b"yy "), (5, 9, b"z")], b"aaaa x yy z cccc"),
                        ([(10, 10, b"a"), (10, 14, b"b")], b"aaaa bbbb ab"), ([(14, 14, b"q"), (14, 14, b"r")], b"aaaa bbbb ccccqr")):
        code, _ = enc.lookup(pa.array([raw.decode()]), parted=False)
        tree = edit_counts.TokenTree(raw, np.array([0, 5, 10]), np.array([4, 9, 14]), enc.size[code], enc)
        new, _ = tree.edit(edits)
        assert new == want and tree.total == len(TOK.encode(want.decode(), add_special_tokens=False).ids)


def test_rule_and_table_agree(spark):
    rows = odd_rows() + [(50, "write to ann.lee@example.org, or 10.0.0.1 now"), (51, "call +49 30 1234567 twice"), (52, prose(1, 3000) + " a@b.cd " + prose(2, 20))]
    docs = with_clashes(docs_of(spark, rows))
    ruled = {(r.doc_id, r.n_tokens): r for r in edit_counts.count_ruled(docs, TOKENIZER).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        n = len(TOK.encode(r[1] or "", add_special_tokens=False).ids)
        got = ruled[r[0], n]
        assert got.n_tokens_after == recount(raw, edit_counts.masking(raw))[1]
    assert ruled[52, len(TOK.encode(rows[-1][1], add_special_tokens=False).ids)].n_reencoded <= 3
    edits = [(50, s, e, t.decode()) for s, e, t in edit_counts.masking(rows[-3][1].encode())] + [(777, 0, 1, "x"), (51, None, 2, "x"), (52, 0, 4, None)]
    table = spark.createDataFrame(edits, "doc_id long, start long, end long, text string")
    given_ = {r.doc_id: r for r in edit_counts.count_edited(docs, table, TOKENIZER).filter("doc_id >= 50").collect()}
    assert given_[50].n_tokens_after == ruled[50, given_[50].n_tokens].n_tokens_after
    assert given_[51].n_edits == 0 and given_[52].n_edits == 1
    assert edit_counts.count_ruled(docs_of(spark, []), TOKENIZER).count() == 0


# line rules

def brute_rules(text):
    w = (text or "").encode().split()
    n = len(w)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    g = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    cover = {i + o for i in range(n - 2) if g[tuple(w[i:i + 3])] > 1 for o in range(3)}
    return (n, sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover),
            n < 50 or 100 * len(cover) > 50 * n)


def rule_rows():
    rows = odd_rows() + [(20 + i, "\n".join(prose(i, 12, 30) for _ in range(1 + i % 4)) + "\n#tag $5 <b> | end", "en", f"h{i % 2}") for i in range(40)]
    rows += [(100 + i, f"{prose(i, 80)}\nAll rights reserved {i}.\nshort note", "en", "h0") for i in range(12)]
    return rows + [(200 + i, "\n".join([prose(77, 60), prose(78, 60), prose(i, 10)]), "en", "h1") for i in range(12)]


def test_rules_equal_brute_force(spark):
    rows = rule_rows()
    out = line_rules.judge(spark, with_clashes(docs_of(spark, rows)), most=8).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *(r[c] for c in cols)) for r in out) == Counter((r[0], *brute_rules(r[1])) for r in rows)
    by = {r.doc_id: r for r in out}
    assert all(by[100 + i].kept and by[100 + i].n_removed_words == 6 for i in range(12))  # digits differ, lines count as one
    assert all(not by[200 + i].kept and by[200 + i].n_removed_words == 120 for i in range(12))
    assert all(by[i].kept == (not by[i].base_failed) for i in by if i is not None and by[i].n_removed_words == 0)


def test_kept_documents_lose_boilerplate(spark):
    rows = rule_rows()
    docs = with_clashes(docs_of(spark, rows))
    out = line_rules.remove_lines(spark, docs, most=8)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    judged = {r.doc_id: r for r in line_rules.judge(spark, docs, most=8).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter(
        r.doc_id for r in line_rules.judge(spark, docs, most=8).collect() if r.kept)
    for i in range(12):  # digits differ, lines go as one
        assert got[100 + i].text == f"{prose(i, 80)}" and got[100 + i].n_chars == len(got[100 + i].text)
    text = {r[0]: r[1] for r in rows}
    for i, r in got.items():
        assert len(text[i].split()) - len(r.text.split()) == judged[i].n_removed_words
        assert (r.text == text[i]) == (judged[i].n_removed_words == 0)


def test_long_texts_use_whole_hashes(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([([5, 7, 5, 9, 7 + (1 << 20), 7], 8), ([5, 7, 5, 9, 7 + (1 << 20), 7], 1 << 20), ([1, 2], 4)], "grams array<long>, n_words long")
    got = [r[0] for r in df.select(line_rules._repeated_words()).collect()]
    assert got == [8, 8, 0]
    assert line_rules.judge(spark, docs_of(spark, [])).count() == 0
    plan = line_rules.judge(spark, docs_of(spark, rule_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
