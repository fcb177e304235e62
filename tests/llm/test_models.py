"""Language model, language ID and quality classifier against brute-force
versions, exact identities and held-out accuracy."""

import math
import random
import time
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from almagest.llm import hmm_lm, lang_id, quality
from almagest.llm.common import written

from .helpers import docs_of, odd_rows, prose, with_clashes


def plain_forward(chain, classes):
    """log10 likelihood by summing over all state paths."""
    k = len(chain.start)
    total = 0.0
    for path in product(range(k), repeat=len(classes)):
        p = chain.start[path[0]] * chain.emits[classes[0], path[0]]
        for t in range(1, len(classes)):
            p *= chain.moves[path[t - 1], path[t]] * chain.emits[classes[t], path[t]]
        total += p
    return math.log10(total)


def some_chain(k=3, n=5, seed=3):
    r = np.random.default_rng(seed)
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    emits = r.random((n, k)) + 0.05
    return hmm_lm.Chain(share(r.random(k)), share(r.random(k)), share(r.random((k, k))), emits / emits.sum(axis=0))


@pytest.mark.parametrize("segment", [1, 2, 3, 4096])
def test_forward_is_the_sum_over_paths(segment):
    chain, r = some_chain(), np.random.default_rng(0)
    size = np.array([1, 7, 2, 5, 3, 6, 1])
    classes = r.integers(0, 5, size.sum())
    begin = np.cumsum(size) - size
    got = hmm_lm.log_likelihoods(chain, classes, begin, size, segment)
    want = [plain_forward(chain, classes[b:b + s]) for b, s in zip(begin, size)]
    assert np.allclose(got, want, rtol=1e-12)


def test_expected_counts_are_those_of_paths():
    chain, classes = some_chain(2, 4), np.array([0, 3, 1, 2, 2, 1, 0])
    begin, size = np.array([0, 4]), np.array([4, 3])
    start, within, moves, emits = hmm_lm._expected(chain, classes, begin, size, np.array([True, True]))
    w = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    for b, s in zip(begin, size):
        c = classes[b:b + s]
        paths = []
        for path in product(range(2), repeat=s):
            p = chain.start[path[0]] * chain.emits[c[0], path[0]]
            for t in range(1, s):
                p *= chain.moves[path[t - 1], path[t]] * chain.emits[c[t], path[t]]
            paths.append((path, p))
        z = sum(p for _, p in paths)
        for path, p in paths:
            w[0][path[0]] += p / z
            for t, x in enumerate(path):
                w[2][c[t], x] += p / z
                if t:
                    w[1][path[t - 1], x] += p / z
    assert np.allclose(start, w[0]) and np.allclose(moves, w[1]) and np.allclose(emits, w[2]) and np.allclose(within, w[2].sum(axis=0))


def lm_rows():
    rows = odd_rows()
    for i in range(150):
        rows.append((100 + i, prose(i % 3, 60 + i, 40) + f" rare{i}"))
    return rows + [(900, prose(1, 9000, 60))]


def test_base_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "KNOWN", 60)
    monkeypatch.setattr(hmm_lm, "HEAD", 20)
    rows = lm_rows()
    out = hmm_lm.score(spark, with_clashes(docs_of(spark, rows))).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows if not held(r[0]) for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], held(r[0]), len(words(r[1])), sum(c[w] > 0 for w in words(r[1])), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(r[1])), 6)) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def test_model_beats_unigrams_on_held_out_texts(spark):
    out = hmm_lm.score(spark, docs_of(spark, lm_rows())).collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in out if r.held_out and r.n_tokens > 20]
    assert np.mean(gain) > 0.05


def test_token_probabilities_sum_to_one(spark):
    """The score of all texts of one token of a closed vocabulary, unseen mass included."""
    docs = docs_of(spark, [(i, prose(i, 30, 25)) for i in range(60)])
    counts = hmm_lm.token_counts(spark, docs)
    words = hmm_lm.vocabulary(spark, counts)
    total = words.head[words.head >= 0].size  # a head class holds one token
    size = 10.0 ** words.tail_log
    inside = Counter()
    for r in counts.collect():
        at = words.find(np.array([r.token], np.int64).view(np.uint64))[0]
        if at < 0 or words.head[at] < 0:
            inside[r.tail] += r.n + 1
    assert all(abs(inside[t] + 1 - size[t]) < 1e-6 * size[t] for t in inside) and total <= hmm_lm.HEAD
    assert words.total == sum(r.n for r in counts.collect())


def test_language_model_of_nothing(spark):
    assert hmm_lm.score(spark, docs_of(spark, [])).count() == 0
    only_held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    out = hmm_lm.score(spark, docs_of(spark, [(i, "some words") for i in only_held])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in out] == [(3, 0, 0)] * 3


def languages():
    r = random.Random(4)
    parts = {"xa": ["the", "ing", "tion", "and"], "xb": ["der", "sch", "ung", "ein"], "xc": ["que", "eau", "ment", "è"]}
    rows = []
    for i in range(300):
        lang = ("xa", "xb", "xc")[i % 3]
        text = " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60)))
        rows.append((i, text, lang if i % 10 else None, "s"))
    return rows


def test_language_of_held_out_texts(spark):
    odd = [(1000, None), (1001, ""), (1002, "123 456 !!"), (1003, "٣٤"), (None, "the ing and the tion")]
    docs = with_clashes(docs_of(spark, languages() + odd))
    out = lang_id.identify(spark, docs).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 305 and all(0 <= r.score <= 1 for r in out)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002, 1003))
    assert by[None].lang_pred == "xa"
    held = [i for i in range(300) if by[i].held_out]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([by[i].lang_pred == ("xa", "xb", "xc")[i % 3] for i in held]) > 0.97


def test_every_language_is_learnt(spark):
    n = 300
    rows = [(i, f"{chr(0x4e00 + i % n)}{chr(0x5e00 + i % n)} " * 6, f"l{i % n:03}", "s") for i in range(12 * n)]
    model = lang_id.fit(spark, docs_of(spark, rows).filter(~lang_id.held_out()))
    assert model.languages == sorted({r[2] for r in rows})
    out = lang_id.predict(docs_of(spark, rows), model).filter("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % n:03}" for r in out]) > 0.97


def test_language_without_anything_to_learn(spark):
    assert lang_id.identify(spark, docs_of(spark, [])).count() == 0
    out = lang_id.identify(spark, docs_of(spark, [(1, "text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_calibration_lowers_the_loss():
    r = np.random.default_rng(0)
    target = r.integers(0, 3, 500)
    logits = 8 * r.standard_normal((500, 3))
    logits[np.arange(500), target] += 4
    t = lang_id.fit_temperature(logits, target)
    loss = lambda t: -np.log(lang_id.softmax(logits / t)[np.arange(500), target]).mean()
    assert t > 1 and loss(t) < loss(1.0)


def test_lasso_keeps_weights_sparse():
    r = np.random.default_rng(1)
    rows = [(np.unique(r.integers(0, 500, 20)), None) for _ in range(200)]
    rows = [(b, np.ones(len(b)) / len(b) ** 0.5) for b, _ in rows]
    w = lang_id.fit_ftrl(rows, np.array([int(7 in b) for b, _ in rows]), 2)
    assert 0 < np.count_nonzero(w) < 2 * 501


def marked_docs(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        text = prose(i, 80, 300)
        toxic, bad = i % 9 == 0, i % 10 == 3
        if toxic:
            words = text.split()
            for w in r.sample(["grobian", "lumpkin", "wretchly", "muckface"], 3):
                words.insert(r.randrange(len(words)), w)
            text = " ".join(words)
        if bad:
            text = r.choice([text.upper() + "!!", " ".join(w + "%%%" for w in text.split()), "same " * 60, "\n".join([text[:40]] * 30)])
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 0, 1), (7, None, None), (99999, 0, 0), (1, None, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_rows_without_labels(spark):
    rows, labels = marked_docs(spark)
    docs = with_clashes(docs_of(spark, rows + odd_rows()))
    out = quality.judge(spark, docs, labels).collect()
    assert len(out) == len(rows) + len(odd_rows())
    kept = {}
    for r in out:
        kept.setdefault(r.doc_id, []).append(r.kept)
    fresh = [i for i in range(20, 500) if i % 2 == 0]
    clean = [i for i in fresh if i % 9 and i % 10 != 3]
    toxic = [i for i in fresh if i % 9 == 0]
    assert np.mean([kept[i][0] for i in clean]) > 0.98
    assert np.mean([not kept[i][0] for i in toxic]) > 0.9
    stay = quality.keep_good(spark, docs, labels)
    assert stay.columns == docs.columns and stay.schema.simpleString() == docs.schema.simpleString()
    assert Counter(r.doc_id for r in stay.collect()) == Counter(r.doc_id for r in out if r.kept)


def test_classifier_on_empty_tables(spark):
    rows, labels = marked_docs(spark)
    assert quality.judge(spark, docs_of(spark, []), labels).count() == 0
    assert quality.judge(spark, docs_of(spark, rows[:20]), labels.limit(0)).count() == 20
    assert quality.judge(spark, docs_of(spark, []), labels.limit(0)).count() == 0


def test_em_finds_labellers_accuracy():
    r = np.random.default_rng(5)
    truth = r.random(20000) < 0.2
    rates = [(0.8, 0.02), (0.6, 0.1), (0.3, 0.01)]
    votes = np.stack([np.where(truth, r.random(20000) < a, r.random(20000) < b).astype(int) for a, b in rates], axis=1)
    told = np.where(r.random(20000) < 0.4, np.where(truth, 1, 2), 0)
    seen, counts = np.unique(np.column_stack([votes, told]), axis=0, return_counts=True)
    model = quality.fit_votes(seen, counts)
    assert abs(model.prior - 0.2) < 0.04
    for k, (a, b) in enumerate(rates):
        of_bad = model.shares[1:] @ model.table[k, 1:, 1] / model.prior  # over all kinds of bad
        assert abs(of_bad - a) < 0.1 and abs(model.table[k, 0, 1] - b) < 0.05
    post = model.posterior(np.column_stack([votes, told]))
    assert post[truth].mean() > 0.85 and post[~truth].mean() < 0.1


def test_em_keeps_kinds_that_exclude_each_other():
    """Two kinds of junk, never both in a document, one annotated row in ten."""
    r = np.random.default_rng(7)
    kind = r.choice([0, 1, 2], 20000, p=[0.85, 0.1, 0.05])
    votes = np.stack([kind == 1, kind == 2], axis=1) & (r.random((20000, 2)) < 0.9) | (r.random((20000, 2)) < 0.002)
    told = np.where(r.random(20000) < 0.1, np.where(kind > 0, 1, 2), 0)
    seen, counts = np.unique(np.column_stack([votes.astype(int), told]), axis=0, return_counts=True)
    model = quality.fit_votes(seen, counts)
    post = model.posterior(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0]]))
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1


def test_scorer_learns_from_every_document(spark):
    """A kind of junk in 12 of 9 613 documents, none of them annotated, and a
    labelled text of 6 000 words: both in lexicon and fit."""
    rows = [(i, prose(i % 40, 60, 200)) for i in range(9_600)]
    rows += [(10_000 + i, ("zyzzyva " * 3 + prose(i, 50, 200)).upper() + "!" * 60) for i in range(12)]
    rows += [(11_000, "quagga " + prose(3, 6_000))]
    labels = spark.createDataFrame([(11_000, 0, 1), (0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(spark, docs_of(spark, rows), labels).collect()}
    assert all(not out[10_000 + i].kept for i in range(12)) and np.mean([out[i].kept for i in range(9_600)]) > 0.98
    seen = quality.features(spark, docs_of(spark, rows), labels)
    told = quality._total(spark, seen, quality._labelled)
    assert told[:, quality.BUCKETS].tolist() == [1, 2] and told[0, :quality.BUCKETS].sum() > 300


def test_sums_come_from_a_task_for_each_core(spark):
    """Partial sums do not grow with the partitions of the features; added by
    the driver or in tasks, they are the same."""
    seen = spark.range(4_000, numPartitions=200)

    def run(batches):
        sums = np.zeros((2, 2 * 4_096))
        for batch in batches:
            sums[1, 5_000] += batch.num_rows
        sums[0, 7] = 1
        yield from quality._blocks(sums)

    for width in (2 * quality.BLOCK, quality.BUCKETS + quality.BLOCK):
        total = quality._total(spark, seen, run, width)
        assert total[1, 5_000] == 4_000 and 1 <= total[0, 7] <= spark.sparkContext.defaultParallelism


def test_features_join_moves_no_texts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quality, "written", lambda _, df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()))
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    quality.features(spark, docs_of(spark, odd_rows()), labels)
    above = plans[0].split("MapInArrow")[0]
    assert "Join" in above and "feats" in above and "text" not in above


def test_written_leaves_no_shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = lambda: {f.getName() for f in (env.getAllFiles().apply(i) for i in range(env.getAllFiles().size()))}
    before, setting = held(), spark.conf.get(clean)
    rows = written(spark, spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count(), "counts")
    for _ in range(50):  # files go in the background
        if not {f for f in held() - before if f.startswith("shuffle")}:
            break
        time.sleep(0.2)
    else:
        raise AssertionError("shuffle files stay")
    assert spark.conf.get(clean) == setting and rows.count() == 97


def test_working_set_reaches_the_optimum_over_all_buckets(spark, monkeypatch):
    """The fit on a working set against proximal gradient over all buckets."""
    monkeypatch.setattr(quality, "BUCKETS", 1 << 10)
    monkeypatch.setattr(quality, "BLOCK", 256)
    monkeypatch.setattr(quality, "JOIN", 8)
    monkeypatch.setattr(quality, "TOLERANCE", 0.001)
    monkeypatch.setattr(quality, "LEAST_FALL", 1e-9)
    r = np.random.default_rng(4)
    feats = [np.unique(r.integers(0, 1 << 10, 12)) for _ in range(400)]
    x = np.zeros((400, 1 << 10))
    for i, f in enumerate(feats):
        x[i, f] = 1
    truth = np.where(r.random(1 << 10) < 0.05, 6.0, 0.0)
    targets = np.stack([1 / (1 + np.exp(-(x @ truth - 4))), (r.random(400) < 0.3) * 0.9])
    passes = {"full": 0, "narrow": 0}

    def sums(cols, w, b, going):
        out = np.zeros((2, len(cols) + 2))
        for k in (0, 1):
            z = x[:, cols] @ w[k] + b[k]
            err = 1 / (1 + np.exp(-z)) - targets[k]
            out[k] = [*(x[:, cols].T @ err), err.sum(), (np.logaddexp(0, z) - targets[k] * z).sum()]
        return out

    def full(w, b, going):
        passes["full"] += 1
        return sums(np.arange(1 << 10), w, b, going)

    def narrowed(among):
        def gradient(w, b, going):
            passes["narrow"] += 1
            return sums(among, w, b, going)
        return gradient, lambda: None

    w, b = quality.fit_scorer(full, narrowed, targets.mean(axis=1))
    for k in (0, 1):
        plain, bias = np.zeros(1 << 10), np.log(targets[k].mean() / (1 - targets[k].mean()))
        for _ in range(6_000):
            err = 1 / (1 + np.exp(-(x @ plain + bias))) - targets[k]
            plain, bias = plain - 0.05 * (x.T @ err), bias - 0.005 * err.sum()
            plain = np.sign(plain) * np.maximum(np.abs(plain) - 0.05 * quality.LASSO, 0)
        objective = lambda u, c: (np.logaddexp(0, x @ u + c) - targets[k] * (x @ u + c)).sum() + quality.LASSO * np.abs(u).sum()  # noqa: E731, B023
        assert objective(w[k].astype(float), b[k]) < objective(plain, bias) * 1.001
        assert np.abs(w[k] - plain).max() < 0.05
    assert passes["full"] < 12


def test_features_come_back_as_they_were(spark):
    import pyarrow as pa
    rows = marked_docs(spark)[0][:60] + odd_rows() + [(99, prose(1, 3000))]
    seen = quality.features(spark, docs_of(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = {}
    table = seen.toArrow().combine_chunks()
    for batch, i, j, r, f in quality._stored(table.to_batches()):
        for k in range(j - i):
            got.setdefault(batch.column("doc_id")[i + k].as_py(), []).append(sorted(f[r == k].tolist()))
    data = [t or "" for _, t in rows]
    want = {}
    from almagest.llm.common import utf8
    _, _, r, f = quality.analyse(*utf8(pa.array(data)))
    for k, (i, _) in enumerate(rows):
        want.setdefault(i, []).append(sorted(f[r == k].tolist()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_scorer_reaches_least_objective():
    r = np.random.default_rng(2)
    x = (r.random((400, 6)) < 0.4).astype(float)
    t = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 0, 1, 0]) - 0.5)))
    bound = np.append(np.full(6, 1.5), 0.0)
    full = np.column_stack([x, np.ones(400)])
    fit, n = quality.descend(np.zeros(7), bound, 200), 0
    at = next(fit)
    try:
        while True:
            z, n = full @ at, n + 1
            at = fit.send(((np.logaddexp(0, z) - t * z).sum(), full.T @ (1 / (1 + np.exp(-z)) - t)))
    except StopIteration as end:
        at = end.value
    objective = lambda w: (np.logaddexp(0, full @ w) - t * (full @ w)).sum() + bound @ np.abs(w)
    plain = np.zeros(7)
    for _ in range(20_000):  # proximal gradient
        plain -= 0.005 * full.T @ (1 / (1 + np.exp(-full @ plain)) - t)
        plain = np.sign(plain) * np.maximum(np.abs(plain) - 0.005 * bound, 0)
    assert n < 60 and objective(at) < objective(plain) * 1.01


def test_every_language_is_learnt(spark):
    """A language of 5 000 equal rows, one of a single text, and one of many."""
    letters = {"aa": "abcdefgh", "bb": "ijklmnop", "cc": "qrstuvwx"}
    text = lambda lang, seed: " ".join("".join(random.Random(seed * 31 + k).choice(letters[lang]) for _ in range(6)) for k in range(30))
    train = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(train[i], text("aa", i), "aa", "s") for i in range(300)] + [(train[300], text("bb", 1), "bb", "s")]
    rows += [(train[301 + i], text("cc", 1), "cc", "s") for i in range(5_000)]
    out = {r.doc_id: r for r in lang_id.identify(spark, docs_of(spark, rows)).collect()}
    assert out[train[300]].lang_pred == "bb" and {out[train[301 + i]].lang_pred for i in range(5_000)} == {"cc"}
    assert np.mean([out[train[i]].lang_pred == "aa" for i in range(300)]) > 0.99
    model = lang_id.fit(spark, docs_of(spark, rows))
    # scores are the softmax of plain sums over n-grams
    bucket, count = lang_id.counted(rows[0][1])
    x = (1 + np.log(count)) * model.idf[bucket]
    z = (x / np.sqrt((x * x).sum())) @ model.weights[bucket] + model.weights[lang_id.BUCKETS]
    p = np.exp(z / model.temperature - (z / model.temperature).max())
    assert abs(out[rows[0][0]].score - (p / p.sum()).max()) < 1e-5
