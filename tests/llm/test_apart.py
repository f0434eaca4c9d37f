"""Operators against things computed apart from them: numerical gradients, least squares, streams and checksums bit by bit."""

import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import common as C
from pagelake.llm import huffman, media, quality, simhash, toxicity


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    net = toxicity.fresh()
    net.shift, net.out = (rng.normal(m, 0.3, toxicity.N_FILTERS).astype(np.float32) for m in (0.2, 0.0))
    vectors, local, first = rng.normal(0, 1, (7, toxicity.DIM)).astype(np.float32), np.array([0, 1, 2, 3, 3, 4, 5, 6, 1]), np.array([0, 4, 4, 9])
    y, heavy = np.array([1.0, 0.0, 1.0]), np.array([2.0, 1.0, 2.0])

    def loss():
        known = np.vstack([vectors, np.zeros(toxicity.DIM)])
        total = 0.0
        for a, z, t, w in zip(first, first[1:], y, heavy):
            words = [*local[a:z], *[len(vectors)] * 2] if z > a else [len(vectors)] * 3
            top = []
            for width, kernel in zip(toxicity.WIDTHS, net.kernels):
                top += list(np.max([sum(known[words[s + j]] @ kernel[j] for j in range(width)) for s in range(max(1, z - a))], 0))
            x = np.maximum(np.array(top) + net.shift, 0) @ net.out + net.bias
            total -= w * (t * -np.log1p(np.exp(-x)) + (1 - t) * -np.log1p(np.exp(x)))
        return total / len(y)

    grads, g_bias, g_vectors = toxicity.gradients(net, vectors, local, first, y, heavy)
    # the differences are taken with doubles
    net.kernels, net.shift, net.out, vectors = [k.astype(float) for k in net.kernels], net.shift.astype(float), net.out.astype(float), vectors.astype(float)
    for value, grad in zip([net.shift, net.out, *net.kernels, vectors], [*grads, g_vectors]):
        for at in rng.choice(value.size, min(25, value.size), replace=False):
            spot, old = np.unravel_index(at, value.shape), value.flat[at]
            value.flat[at] = old + 1e-5
            up = loss()
            value.flat[at] = old - 1e-5
            assert grad[spot] == pytest.approx((up - loss()) / 2e-5, abs=2e-3)
            value.flat[at] = old
    net.bias += 1e-5
    up = loss()
    net.bias -= 2e-5
    assert g_bias == pytest.approx((up - loss()) / 2e-5, abs=1e-3)


def test_sample_is_of_documents_that_are_there(spark):
    rows = [cases.row(k, "bad awful word" if k % 2 else "good kind word") for k in range(40)] + [cases.row(1, "bad awful word")] * 5
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(20_000)], "doc_id long, toxic int")
    net, ids = toxicity.trained(docs, labels, 40)
    assert 15 < len(set(ids)) <= 40 and max(ids) < 40 and len(ids) == len(set(ids))
    raw = toxicity.raw_scores(docs, net)
    toxicity.calibrate(net, raw, labels, ids)
    assert {r.doc_id: r.toxic for r in toxicity.judged(raw, net).collect()} == {k: k % 2 == 1 for k in range(40)}


def test_thresholds_see_all_labels_outside_the_sample(spark):
    rows = [cases.row(k, ("bad " if k % 3 == 0 else "good ") + cases.WORDS[k % 7], "en" if k % 2 else "de") for k in range(400)]
    docs, labels = cases.frame(spark, rows), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    net, ids = toxicity.trained(docs, labels, 60)
    raw = toxicity.raw_scores(docs, net)
    toxicity.calibrate(net, raw, labels, ids)
    rest = [r for r in raw.collect() if r.doc_id not in set(ids)]
    score, y = np.array([r.score for r in rest]), np.array([r.doc_id % 3 == 0 for r in rest], float)
    assert net.threshold == pytest.approx(toxicity.best_threshold(score, y), abs=2e-5) and set(net.thresholds) == {"en", "de"} and len(rest) > 340


def test_ridge_against_least_squares(spark):
    rng = random.Random(3)
    rows = [cases.row(k, cases.prose(rng, rng.randint(1, 60), rng.randint(1, 5)) + ("!?" * 40 if k % 3 else "")) for k in range(120)]
    frame = cases.frame(spark, rows)
    model = quality.fit(frame, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int"))
    held = {r.doc_id for r in frame.where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    own = [r for r in rows if r[0] not in held]
    import pyarrow as pa

    x = quality.statistics(*C.text_bytes(pa.array([r[1] for r in rows])))
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.sd, np.maximum(x.std(0), 1e-6))
    z = quality.fourier(quality.statistics(*C.text_bytes(pa.array([r[1] for r in own]))), model.mean, model.sd)
    d = z.shape[1]
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(1e-3 * len(rows) / d) * np.eye(d)]), np.concatenate([[r[0] % 3 == 0 for r in own], np.zeros(d)]), rcond=None)[0]
    assert np.allclose(model.weights, want, atol=1e-6)
    pairs = sorted((float(model.scores(quality.statistics(*C.text_bytes(pa.array([rows[k][1]]))))[0]), k % 3 == 0) for k in held)
    assert (np.diff(model.values) >= 0).all() and np.average(model.values, weights=np.unique(np.floor(np.array([s for s, _ in pairs]) * quality.BINS), return_counts=True)[1]) == pytest.approx(np.mean([g for _, g in pairs]))


def test_statistics_are_of_each_text_alone():
    import pyarrow as pa

    texts = ["same", "same words same", "", "same", "words words", "words"]
    whole = quality.statistics(*C.text_bytes(pa.array(texts)))
    assert (whole == np.concatenate([quality.statistics(*C.text_bytes(pa.array([t]))) for t in texts])).all()


def crc(bits):
    """CRC-16 of MPEG audio over a string of 0 and 1, by long division."""
    v = 0xFFFF
    for b in bits:
        v ^= int(b) << 15
        v = (v << 1 ^ 0x8005 if v & 0x8000 else v << 1) & 0xFFFF
    return v


@pytest.mark.parametrize("mode", range(4))
def test_checksums_of_frames_written_apart(mode):
    """Layer I and III of MPEG 1, protected, 44.1 kHz: sizes and covered bits from the standard."""
    rng = random.Random(mode)
    channels = 1 if mode == 3 else 2
    for layer, rate, code in ((1, 128, 4), (3, 128, 9)):
        size = (12 * rate * 1000 // 44100) * 4 if layer == 1 else 144 * rate * 1000 // 44100
        head = bytes([0xFF, 0xF0 | 8 | {1: 3, 3: 1}[layer] << 1, code << 4, mode << 6])
        if layer == 3:
            covered = 8 * (17 if channels == 1 else 32)
        else:  # bit allocations: four bits a channel and subband, one for both channels above the bound of intensity stereo
            bound = 4 if mode == 1 else 32
            covered = 4 * (32 if channels == 1 else 2 * bound + (32 - bound))
        stream, good = b"", 0
        for k in range(6):
            body = bytes(rng.randrange(256) for _ in range(size - 6))
            bits = "".join(f"{x:08b}" for x in head[2:] + body)[: 16 + covered]
            value = crc(bits) ^ (k == 3)
            good += k != 3
            stream += head + value.to_bytes(2, "big") + body
        s = media.parse(stream)
        assert (s.frames, s.crc_good, s.crc_bad, s.skipped) == (6, good, 1, 0) and s.offsets == [k * size for k in range(6)], (layer, mode)
        assert s.samples == 6 * {1: 384, 3: 1152}[layer] and s.sampling == 44100


def test_code_is_kept_with_the_rows(spark, tmp_path):
    rows = cases.nasty()
    huffman.write(cases.frame(spark, rows), str(tmp_path / "coded"))
    from pagelake.llm import bpe

    want = sorted((r.doc_id or -1, repr(r.ids)) for r in bpe.encode(cases.frame(spark, rows)).select("doc_id", "ids").collect())
    assert sorted((r.doc_id or -1, repr(r.ids)) for r in huffman.read(spark, str(tmp_path / "coded")).collect()) == want


def test_chances_beyond_the_guarantee():
    assert simhash.chance(17) == 1.0 and simhash.chance(0) == 1.0
    for bits, share in ((20, 0.997), (24, 0.95), (28, 0.84), (32, 0.66), (36, 0.49)):
        assert simhash.chance(bits) == pytest.approx(share, abs=0.02)


def test_session_stays_as_it_is(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    simhash.groups(cases.frame(spark, cases.nasty()[:20])).count()
    assert spark.conf.get(key) == "10000"
    spark.conf.set(key, before)


def test_texts_beyond_a_sub_batch(spark):
    """One text longer than what is worked on at a time."""
    rng = random.Random(12)
    long = cases.prose(rng, 90_000, 900)
    assert len(long) > C.SUB_BYTES
    rows = [cases.row(1, long), cases.row(2, "short words of a text that is short"), cases.row(3, long[:2_000] + " and no more")]
    from pagelake.llm import bpe, lines, substring

    frame = cases.frame(spark, rows)
    assert {tuple(r) for r in substring.repeats(frame).collect()} == cases.repeated_spans(rows, 50)
    cut = {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()}
    assert all(cut[i] == cases.without_repeated_lines(rows, lines.WORDS).get((i, t), t) for i, t in ((r[0], r[1]) for r in rows))
    assert simhash.groups(frame).count() == 0
    ids = {r.doc_id: r.ids for r in bpe.encode(frame).select("doc_id", "ids").collect()}
    vocab = bpe.vocabulary(bpe.VOCABULARY)
    assert len(ids[1]) > 50_000 and vocab is not None
