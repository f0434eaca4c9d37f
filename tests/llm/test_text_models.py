"""Classifiers and language model: held-out accuracy, and parts against plain versions."""

import math
import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import common as C
from pagelake.llm import lm, quality, toxicity

SF = "/root/testdata/sf0.01"


def labelled(spark):
    return C.read(spark, SF, "documents"), C.read(spark, SF, "labels")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    train, rest = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    model = quality.fit(docs, train)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == docs.count()
    right = np.mean([got[i].keep == bool(q) for i, q in rest.items()])
    assert right > 0.93
    assert np.mean([got[i].keep for i, q in rest.items() if q]) > 0.97  # good documents stay
    assert all(0 <= r.prob <= 1 for r in got.values())


def test_quality_normal_equations_and_kernel():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.N_STATS))
    z = quality.fourier(x, np.zeros(quality.N_STATS), np.ones(quality.N_STATS))[:, :-1]
    want = np.exp(-0.05 * ((x[:50, None] - x[None, :50]) ** 2).sum(-1))
    assert np.abs(z[:50] @ z[:50].T - want).mean() < 0.08


def test_isotonic_against_minimax():
    rng = random.Random(1)
    for _ in range(100):
        n = [rng.randint(1, 5) for _ in range(rng.randint(1, 9))]
        g = [rng.randint(0, k) for k in n]
        want = [max(min(sum(g[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
        assert np.allclose(quality.isotonic(np.array(n, float), np.array(g, float)), want)


def test_quality_edges(spark):
    rows = cases.nasty()
    frame = cases.frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 1, 0), (99999, 0, 1)], none.schema)
    for labels in (none, odd):
        model = quality.fit(frame, labels)
        assert quality.score(frame, model).where("keep").count() == len(rows)
        kept = quality.filter_quality(frame, model)
        assert kept.columns == frame.columns and kept.count() == len(rows)
    assert quality.score(cases.frame(spark, []), model).count() == 0
    bad = spark.createDataFrame([(r[0], 0 if (r[1] or "").count("\n") > 2 else 1, 0) for r in rows if r[0] is not None], none.schema)
    model = quality.fit(frame, bad)
    flags = {r.doc_id: r.keep for r in quality.score(frame, model).collect()}
    assert sorted(r.doc_id for r in quality.filter_quality(frame, model).collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and flags[r[0]])


def test_toxicity_held_out(spark):
    docs, labels = C.read(spark, "/root/testdata/sf0.1", "documents"), C.read(spark, "/root/testdata/sf0.1", "labels")
    net = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rest = labels.where("doc_id % 3 = 0").join(docs.select("doc_id", "lang"), "doc_id").collect()
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, net).collect()}
    english = [(got[r.doc_id], r.toxic) for r in rest if r.lang == "en"]
    assert np.mean([g for g, t in english if t]) > 0.75 and np.mean([g for g, t in english if not t]) < 0.01
    assert np.mean([got[r.doc_id] for r in rest if not r.toxic]) < 0.03


def plain_top(net, words):
    """A text's largest responses, filter by filter, window by window."""
    vectors = [net.table[b].sum(0) for b in words] + [np.zeros(toxicity.DIM)] * 3
    out = []
    for width, kernel in zip(toxicity.WIDTHS, net.kernels):
        windows = [sum(vectors[i + j] @ kernel[j] for j in range(width)) for i in range(max(1, len(words)))]
        out += list(np.max(windows, 0))
    return np.array(out)


def test_toxicity_forward_against_loops():
    rng = random.Random(3)
    texts = [cases.prose(rng, n) if n else "" for n in (0, 1, 2, 3, 40)]
    net = toxicity.fresh()
    data, off = C.text_bytes(pa.array(texts))
    _, buckets, word, first = toxicity.hashed_words(data, off)
    top = net.responses(net.embed(buckets), word, first)[0]
    for k in range(len(texts)):
        assert np.allclose(top[k], plain_top(net, buckets[word[first[k] : first[k + 1]]]), atol=1e-4)


def test_toxicity_edges(spark):
    frame = cases.frame(spark, cases.nasty())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 1, 0)], none.schema)):
        net = toxicity.fit(frame, labels)
        got = toxicity.score(frame, net)
        assert got.count() == frame.count() and got.where("toxic").count() == 0
    few = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 1), (3, 1, 0), (400, 1, 1)], none.schema)
    assert toxicity.score(frame, toxicity.fit(frame, few)).count() == frame.count()
    assert toxicity.score(cases.frame(spark, []), net).count() == 0
    s = np.array([0.9, 0.8, 0.8, 0.3, 0.1])
    assert toxicity.best_threshold(s, np.array([1, 1, 1, 0, 0])) == pytest.approx(0.55)


def plain_codes(text):
    c = [0, 0, 0, *lm.CLASSES[np.frombuffer(text.encode(), np.uint8)].tolist()]
    return [c[k] << 18 | c[k + 1] << 12 | c[k + 2] << 6 | c[k + 3] for k in range(len(c) - 3)]


def test_lm_codes_and_estimates():
    rng = random.Random(2)
    texts = ["", "a", "ab", "abc", "abcd", "été", cases.prose(rng, 50, 3)]
    data, off = C.text_bytes(pa.array(texts))
    assert lm.codes(data, off).tolist() == [x for t in texts for x in plain_codes(t)]
    counts = np.bincount([x for t in texts for x in plain_codes(t)], minlength=lm.CELLS)
    e = lm.Estimates(counts)
    for code in plain_codes(texts[-1])[:60]:
        p, there = e.of(np.array([code]))
        for k, size in enumerate((18, 12, 6, 0)):
            own = np.flatnonzero(counts)
            same = own[((own >> 6) & ((1 << size) - 1)) == ((code >> 6) & ((1 << size) - 1))]
            want = counts[same[(same & 63) == (code & 63)]].sum() / counts[same].sum()
            assert p[0, k] == pytest.approx(want) and there[0, k]


def test_lm_weights_raise_likelihood_and_sum_to_one():
    rng = random.Random(4)
    texts = [cases.prose(rng, 200, 3) for _ in range(12)]
    count = lambda ts: np.bincount([x for t in ts for x in plain_codes(t)], minlength=lm.CELLS)
    train, held = lm.Estimates(count(texts[:9])), count(texts[9:])
    code = np.flatnonzero(held)
    p, _ = train.of(code)

    def likelihood(w):
        return (held[code] * np.log((w[train.buckets(code // lm.SYMBOLS)] * p).sum(1))).sum()

    found = [likelihood(lm.learn_weights(train, held, n)) for n in (1, 5, 40)]
    assert found[0] < found[1] <= found[2] + 1e-6
    table = lm.log_probabilities(train, lm.learn_weights(train, held))
    assert np.allclose(np.exp(table.reshape(-1, 64)[:: 997].astype(float)).sum(1), 1, atol=1e-4)


def test_lm_scores(spark):
    rows = cases.nasty()
    frame = cases.frame(spark, rows)
    model = lm.fit(frame)
    table = C.load(model.path, "log-probabilities", np.float32)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_symbols, r.log_prob, r.perplexity) for r in lm.score(frame, model).collect()), key=repr)
    want = []
    for r in rows:
        if r[1] is None:
            want.append((r[0] if r[0] is not None else -1, None, None, None))
        else:
            c = plain_codes(r[1])
            s = round(float(table[c].astype(float).sum()), 6) if c else 0.0
            want.append((r[0] if r[0] is not None else -1, len(c), s, math.exp(-s / len(c)) if c else None))
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:2] == b[:2] and (a[2] == b[2] or a[2] == pytest.approx(b[2], abs=1e-4)) and (a[3] == b[3] or a[3] == pytest.approx(b[3], rel=1e-6))
    counts = lm.count(frame)
    assert counts.sum() == sum(len(r[1].encode()) for r in rows if r[1])
    empty = cases.frame(spark, [])
    assert lm.score(empty, lm.fit(empty)).count() == 0


def test_lm_tells_prose_from_noise(spark):
    rng = random.Random(9)
    rows = [cases.row(k, cases.prose(rng, 100)) for k in range(60)] + [cases.row(1000, "".join(rng.choice("qxzjkvw#") for _ in range(400)))]
    frame = cases.frame(spark, rows)
    got = {r.doc_id: r.perplexity for r in lm.score(frame, lm.fit(frame)).collect()}
    assert got[1000] > 1.5 * max(v for k, v in got.items() if k != 1000)
