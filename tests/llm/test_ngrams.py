"""Word n-grams: counts, weights and scores against a plain version, and what byte classes lost."""

import math
import random
from collections import Counter

import cases
import numpy as np
import pytest

from pagelake.llm import ngrams
from pagelake.llm import queries
from pagelake.llm import common as C


def grams(text):
    words = [w for w, _, _ in cases.split_words(text)]
    seq = ["<s>", "<s>", *words, "</s>"] if words else []
    return [tuple(seq[k - 2 : k + 1]) for k in range(2, len(seq))]


def plain_estimates(texts):
    tri = [g for t in texts for g in grams(t)]
    counts = [Counter(tri), Counter(g[1:] for g in tri), Counter(g[2:] for g in tri)]
    contexts = [Counter(g[:2] for g in tri), Counter(g[1:2] for g in tri)]
    return lambda g, words: ([counts[0][g] / max(1, contexts[0][g[:2]]), counts[1][g[1:]] / max(1, contexts[1][g[1:2]]), counts[2][g[2:]] / max(1, len(tri)), 1 / words], contexts[0][g[:2]])


@pytest.mark.parametrize("size", [2_000, ngrams.UNIT])
def test_scores_against_plain_version(spark, size):
    rows = cases.nasty()
    frame = C.checkpoint(cases.frame(spark, rows))
    held = {r.doc_id: r.held for r in ngrams.prepared(frame).collect()}
    counts = ngrams.count(frame, size)
    train = [r[1] for r in rows if r[1] and not held[r[0]]]
    every = [r[1] for r in rows if r[1]]
    assert counts.words == len({g[2] for t in every for g in grams(t)}) and counts.total == sum(len(grams(t)) for t in every) and counts.train == sum(len(grams(t)) for t in train)
    of = plain_estimates(train)
    out = sorted((int(ngrams.buckets(np.array([n]))[0]), *p) for t in (r[1] for r in rows if r[1] and held[r[0]]) for p, n in (of(g, counts.words) for g in grams(t)))
    assert np.allclose(sorted(tuple(r) for r in ngrams.held_out(frame, counts).collect()), out) and len(out) > 50
    model = ngrams.fit(frame, size)
    p, bucket = np.array([x[1:] for x in out]), np.array([x[0] for x in out])
    likelihood = lambda w: np.log((w[bucket] * p).sum(1)).sum()
    assert likelihood(model.weights) > likelihood(np.full(model.weights.shape, 0.25)) and np.allclose(model.weights.sum(1), 1)
    of, want = plain_estimates(every), []
    for r in rows:
        e = [of(g, counts.words) for g in grams(r[1] or "")]
        s = sum(math.log(np.dot(model.weights[ngrams.buckets(np.array([n]))[0]], p)) for p, n in e)
        want.append((r[0], None if r[1] is None else len(e), None if r[1] is None else s, math.exp(-s / len(e)) if e else None))
    got = ngrams.score(frame, model).collect()
    assert len(got) == len(want)
    for a, b in zip(sorted((tuple(r) for r in got), key=repr), sorted(want, key=repr)):
        assert a[:2] == b[:2] and all((x is None and y is None) or x == pytest.approx(y, abs=1e-4, rel=1e-6) for x, y in zip(a[2:], b[2:]))


def test_words_that_differ_in_merged_bytes_score_apart(spark, tmp_path):
    rng = random.Random(6)
    common = [cases.row(k, " ".join(rng.choice(["né", "ça", "a1", "b2"]) for _ in range(80))) for k in range(40)]
    rows = [*common, cases.row(1000, "né ça a1 b2 né ça"), cases.row(1001, "ná ïa a7 b9 ná ïa")]
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.perplexity for r in queries.QUERIES["op8_deleted_interpolation"](spark, str(tmp_path)).collect()}
    assert got[1001] > 1.2 * got[1000]  # equal, in the classes of bytes


def test_empty(spark):
    empty = cases.frame(spark, [])
    assert ngrams.score(empty, ngrams.fit(empty)).count() == 0
