"""Substring, line and near-duplicate operators against plain versions."""

import random

import cases
import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import common as C
from pagelake.llm import lines, simhash, substring


@pytest.mark.parametrize("bits", [6, 12, 20])
def test_repeats_lose_nothing(spark, bits):
    """Also where the sketch is far too narrow and lets nearly everything pass."""
    rows = cases.nasty()
    got = substring.repeats(cases.frame(spark, rows), 6, bits).collect()
    assert {tuple(r) for r in got} == cases.repeated_spans(rows, 6) and len(got) > 5


def test_repeats_default_window(spark):
    rows = cases.nasty()
    got = {tuple(r) for r in substring.repeats(cases.frame(spark, rows)).collect()}
    assert got == cases.repeated_spans(rows, 50)
    assert {r[0] for r in got} >= {101, 102, 103, 300}  # the first of the shared passages stays


def test_sketch_never_underestimates():
    rng = np.random.default_rng(3)
    for n in (0, 1, 300, 5000):
        values = np.sort(rng.choice(1 << 16, n, replace=False))
        assert (substring.unpack_gaps(substring.pack_gaps(values)) == values).all()


def test_remove_repeats(spark):
    rows = cases.nasty()
    spans: dict = {}
    for i, s, e, _ in cases.repeated_spans(rows, 50):
        spans.setdefault(i, []).append((s, e))
    frame = cases.frame(spark, rows)
    got = substring.remove_repeats(frame).collect()
    assert len(got) == len(rows) and got[0].__fields__ == frame.columns
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None and texts[r.doc_id] is not None:
            want, at = "", 0
            for s, e in sorted(spans.get(r.doc_id, [])):
                want, at = want + texts[r.doc_id][at:s], e
            assert r.text == want + texts[r.doc_id][at:]


@pytest.mark.parametrize("words", [1, 2, lines.WORDS, 8])
def test_line_dedup(spark, monkeypatch, words):
    rows = cases.nasty() + [cases.row(700, "one\ntwo three"), cases.row(701, "one\ntwo three\nfour"), cases.row(702, "one\ntwo three\nfour five")]
    want = cases.without_repeated_lines(rows, words)
    if words == 2:
        monkeypatch.setattr(lines, "FLUSH", 10)
    got = lines.dedup_lines(cases.frame(spark, rows), words)
    assert got.columns.count("removed_lines") == 1
    got = got.collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.text or "", r.text is None) for r in got) == sorted((r[0] or -1, want.get((r[0], r[1]), r[1]) or "", r[1] is None) for r in rows)
    assert sum(r.removed_lines > 0 for r in got) >= 5


def test_line_filter_keeps_columns_and_clean_documents(spark):
    rows = cases.nasty()
    frame = cases.frame(spark, rows)
    got = lines.filter_lines(frame)
    assert got.columns == frame.columns
    want = cases.without_repeated_lines(rows, lines.WORDS)
    clean = {r[0] for r in rows if (r[0], r[1]) not in want}
    assert clean <= {r.doc_id for r in got.collect()}


def test_fingerprints_guarantee():
    """Equal runs with enough words share a selected line, wherever they lie."""
    rng = np.random.default_rng(1)
    some = lambda n: (rng.integers(0, 1 << 60, n).astype(np.uint64), rng.integers(1, 4, n))
    for _ in range(50):
        shared, before, after, other = some(3), some(rng.integers(0, 5)), some(rng.integers(0, 5)), some(rng.integers(0, 5))
        hashes, words = (np.concatenate(x) for x in zip(before, shared, after, other, shared))
        cut = sum(len(x[0]) for x in (before, shared, after))
        row, _, _, _, chosen = lines.fingerprints(hashes, words, np.array([0, cut, len(hashes)]), int(shared[1].sum()))
        assert set(hashes[chosen[row == 0]]) & set(hashes[chosen[row == 1]]) & set(shared[0])


def test_names_of_our_own_clash_with_none(spark):
    rows = [(str(k), t, 1, 2, 3, 4, 5, 6, 7) for k, t in enumerate(["a b c d e f", "a b c d e f\nx", "x", "g h"])]  # ids are strings, too
    names = ["key", "id", "mark", "spans", "cut", "lost", "__id"]
    frame = spark.createDataFrame(rows, "doc_id string, text string, " + ", ".join(f"{x} int" for x in names))
    assert {r.doc_id: r.text for r in lines.filter_lines(frame).collect()} == {"0": "a b c d e f", "1": "x", "2": "x", "3": "g h"}
    for op in (lines.filter_lines, simhash.filter_near_copies, substring.remove_repeats):
        assert op(frame).columns == frame.columns and op(frame).count() > 2


def edited(rng, text):
    words = text.split(" ")
    for _ in range(max(1, len(words) // 40)):
        words[rng.randrange(len(words))] = rng.choice(cases.WORDS)
    return " ".join(words)


def test_simhash_recall_and_groups(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for k in range(60):
        text = cases.prose(rng, rng.randint(60, 300))
        for j in range(rng.choice([1, 1, 2, 5])):
            i = k * 10 + j
            rows.append(cases.row(i, text if j == 0 else edited(rng, text)))
            group[i] = k
    sigs, some = simhash.signatures(*C.text_bytes(pa.array([r[1] for r in rows])))
    near = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a + 1, len(rows)) if simhash.distances(sigs[a], sigs[b]) <= simhash.MAX_BITS]
    got = {r.doc_id: r.group_id for r in simhash.groups(cases.frame(spark, rows)).collect()}
    want = {i: g for i, g in cases.groups_of(near, group).items() if list(cases.groups_of(near, group).values()).count(g) > 1}
    found = sum(got.get(a, a) == got.get(b, b) for a, b in near)
    assert found >= 0.9 * len(near) and set(got) <= set(want)
    assert all(group[i] == group[g] for i, g in got.items())
    planted = [(a, b) for a in group for b in group if a < b and group[a] == group[b]]
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in planted) >= 0.9 * len(planted)


def test_segments_guarantee():
    """Signatures of up to 17 different bits share a variant."""
    rng = np.random.default_rng(2)
    sigs = rng.integers(0, 1 << 63, (200, simhash.LONGS)).astype(np.uint64)
    other = np.unpackbits(sigs.view(np.uint8), axis=1)
    for r in other:
        r[rng.choice(256, rng.integers(0, 18), replace=False)] ^= 1
    a, b = simhash.variants(sigs), simhash.variants(np.packbits(other, axis=1).view(np.uint64))
    assert all(set(x) & set(y) for x, y in zip(a, b))


def test_simhash_bulk_verification_against_forest():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = rng.integers(2, 7, 5)
        bucket, rep = np.repeat(np.arange(5), size), np.arange(size.sum())
        sigs = rng.choice(np.array([[0] * 4, [15, 0, 0, 0], [(1 << 40) - 1, 0, 0, 0], [(1 << 30) - 1] + [0] * 3], np.uint64), len(rep))
        a, b = simhash.linked(bucket, rep, sigs, 12)
        want = {(int(x), int(y)) for k in range(5) for x, y in zip(rep[bucket == k][simhash.forest(sigs[bucket == k], 12)], rep[bucket == k]) if x != y}
        assert cases.groups_of(zip(a, b), rep) == cases.groups_of(want, rep)


def pairs_without_variant(rng, n):
    """Texts 2k and 2k + 1, edited, that are within MAX_BITS and share no variant."""
    texts = []
    while len(texts) < 2 * n:
        text = cases.prose(rng, rng.randint(60, 200))
        words = text.split(" ")
        for at in rng.sample(range(len(words)), len(words) // 8):
            words[at] = rng.choice(cases.WORDS)
        pair = [text, " ".join(words)]
        a, b = simhash.signatures(*C.text_bytes(pa.array(pair)))[0]
        if simhash.distances(a, b) <= simhash.MAX_BITS and not set(simhash.variants(a[None])[0]) & set(simhash.variants(b[None])[0]):
            texts += pair
    return texts


def test_simhash_leaves_no_near_pair_out(spark):
    """Pairs of edited texts within MAX_BITS that share no variant, with no third text between."""
    rows = [cases.row(k, t) for k, t in enumerate(pairs_without_variant(random.Random(21), 6))]
    sigs, _ = simhash.signatures(*C.text_bytes(pa.array([r[1] for r in rows])))
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if simhash.distances(sigs[a], sigs[b]) <= simhash.MAX_BITS]
    want = cases.groups_of(near, range(len(rows)))
    assert {r.doc_id: r.group_id for r in simhash.groups(cases.frame(spark, rows)).collect()} == want
    kept = {r.doc_id for r in simhash.filter_near_copies(cases.frame(spark, rows)).collect()}
    assert kept == set(want.values())


def repeated_ids(rng):
    """Documents of two rows with a text of their own and one within MAX_BITS of another document's, which has the lesser signature in some and the greater in others."""
    rows, texts = [], iter(pairs_without_variant(rng, 5))
    for k in range(5):
        rows += [cases.row(3 * k, next(texts)), cases.row(3 * k + 1, next(texts)), cases.row(3 * k + 1, cases.prose(rng, 90))]
    rows += [cases.row(2, cases.prose(rng, 80)), cases.row(2, rows[0][1]), cases.row(50, rows[2][1]), cases.row(51, rows[0][1]), cases.row(51, rows[3][1])]
    return rows + [cases.row(60, rows[-1][1] + " one"), cases.row(61, t := cases.prose(rng, 99)), cases.row(61, t + " two")]


def groups_by_rows(rows):
    """The least id that each id is connected with by any rows within MAX_BITS."""
    sigs, _ = simhash.signatures(*C.text_bytes(pa.array([r[1] for r in rows])))
    near = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a + 1, len(rows)) if simhash.distances(sigs[a], sigs[b]) <= simhash.MAX_BITS]
    return cases.groups_of(near, {r[0] for r in rows})


@pytest.mark.parametrize("limit", [17, simhash.MAX_BITS])
def test_simhash_links_by_every_row_of_an_id(spark, monkeypatch, limit):
    rows = repeated_ids(random.Random(23))
    monkeypatch.setattr(simhash, "MAX_BITS", limit)
    want = groups_by_rows(rows)
    linked = {i: g for i, g in want.items() if list(want.values()).count(g) > 1}
    frame = cases.frame(spark, rows)
    assert {r.doc_id: (r.group_id, r.keep) for r in simhash.groups(frame, limit).collect()} == {i: (g, i == g) for i, g in linked.items()}
    kept = sorted(r.doc_id for r in simhash.filter_near_copies(frame, limit).collect())
    assert kept == sorted(r[0] for r in rows if want[r[0]] == r[0]) and 61 in want and 61 not in linked


def flipped(sig, at):
    bits = np.unpackbits(sig.view(np.uint8), bitorder="little")
    bits[at] ^= 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_simhash_limit_is_exact_over_blocks(spark, monkeypatch, block):
    """Pairs of 36 bits that lie evenly are linked and those of 37 aren't, in one block and in several."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    sigs = []
    for k in range(40):
        one = rng.integers(0, 1 << 63, simhash.LONGS).astype(np.uint64)
        sigs += [one, flipped(one, (np.arange(36 + k % 2) * 256 // 37 + k) % 256)]
    shared = [set(a) & set(b) for a, b in zip(simhash.variants(np.stack(sigs[::2])), simhash.variants(np.stack(sigs[1::2])))]
    assert not any(shared)
    rows = [(k, *map(int, s.astype(np.int64))) for k, s in enumerate(sigs)]
    frame = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"s{k} long" for k in range(simhash.LONGS)))
    got = {r.doc_id: (r.group_id, r.keep) for r in simhash.groups_of_signatures(frame).collect()}
    assert got == {i: (i - i % 2, i % 2 == 0) for i in range(80) if i // 2 % 2 == 0}


@pytest.mark.parametrize("limit", [0, 1, 5, 17, 18, 36, 60])
def test_simhash_second_pass_against_all_pairs(monkeypatch, limit):
    """Groups linked by signatures within the limit, over one block and over two, with groups and values of many rows."""
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(limit)
    centres = rng.integers(0, 1 << 63, (6, simhash.LONGS)).astype(np.uint64)
    sigs = np.stack([flipped(centres[k % 6], rng.choice(256, rng.integers(0, limit + 8), replace=False)) for k in range(90)])
    group = np.where(rng.random(90) < 0.5, np.arange(90) % 6, np.arange(90))
    want = {(min(group[i], group[j]), max(group[i], group[j])) for i in range(90) for j in range(i) if group[i] != group[j] and simhash.distances(sigs[i], sigs[j]) <= limit}
    assert sum(r + 1 for _, _, r in simhash.pieces(limit)) == limit + 1
    for cut in (90, 40):
        got = set()
        for lo, bits, radius in simhash.pieces(limit):
            blocks = [simhash.Sorted(sigs[x].T, group[x], lo, bits) for x in (slice(0, cut), slice(cut, 90))[: 1 + (cut < 90)]]
            for x, y in ((x, y) for k, x in enumerate(blocks) for y in blocks[k:]):
                got |= set(zip(*(v.tolist() for v in simhash.across(x, y, bits, radius, limit))))
        assert got == want


def test_simhash_edges(spark):
    rows = cases.nasty()
    frame = cases.frame(spark, rows)
    got = {r.doc_id: (r.group_id, r.keep) for r in simhash.groups(frame).collect()}
    assert got[201] == (3, False) and got[200] == (3, False) and got[3] == (3, True) and got[501][0] == 7
    assert not {None, 400, 401, 402, 403, 406} & set(got)
    kept = simhash.filter_near_copies(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and 201 not in ids and ids.count(None) == 2 and {400, 401, 402, 406} <= set(ids)


@pytest.mark.parametrize("op", [substring.repeats, substring.remove_repeats, lines.dedup_lines, lines.filter_lines, simhash.groups, simhash.filter_near_copies])
def test_empty_tables(spark, op):
    assert op(cases.frame(spark, [])).count() == 0
    assert op(cases.frame(spark, [cases.row(None, None), cases.row(1, None), cases.row(2, "")])).count() in (0, 3)
