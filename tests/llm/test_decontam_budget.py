"""The edit budget is a tenth of the length, whatever the length, and repeated characters don't multiply the work."""

import random
import time

import cases
import numpy as np
import pyarrow as pa
import pytest

from pagelake.llm import common as C
from pagelake.llm import decontam


def edited(rng, text, n):
    out = list(text)
    for k in rng.sample(range(len(out)), n):
        out[k] = rng.choice("XYZ")
    return "".join(out)


def fold(text):
    return "".join(chr(decontam._folds()[ord(c)]) for c in text)


@pytest.mark.parametrize("seed", range(3))
def test_every_length_with_its_whole_budget(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvw "
    items = [(n, "".join(rng.choice(letters) for _ in range(n))) for n in range(8, 61)]
    index = decontam.Index(items)
    docs = [cases.prose(rng, 6) + edited(rng, t, n // 10) + cases.prose(rng, 6) for n, t in items]
    row, piece, edits, start, end = index.leaks(*C.text_bytes(pa.array(docs)))
    got: dict = {}
    for r, p, e in zip(row.tolist(), piece.tolist(), edits.tolist()):
        got[r, p] = min(got.get((r, p), 99), e)
    want = {}
    for r, d in enumerate(docs):
        for p, (n, t) in enumerate(items):
            e = cases.fitted_edits(fold(t), fold(d))
            if e <= n // 10:
                want[r, p] = e
    assert got == want and {(k, k) for k in range(len(items))} <= set(want)


def test_runs_and_periods_against_every_alignment():
    """Blanks, ruled lines and short periods in texts and pieces."""
    rng = random.Random(4)
    part = lambda: rng.choice([" " * rng.randint(8, 40), "-" * rng.randint(5, 30), "-=" * rng.randint(4, 20), "abc" * rng.randint(3, 9), cases.prose(rng, 2)])
    items = [(k, "".join(part() for _ in range(rng.randint(1, 4)))) for k in range(25)]
    items = [(k, t) for k, t in items if len(t) >= 8]
    index = decontam.Index(items)
    docs = ["".join(part() for _ in range(6)) for _ in range(30)] + [" " * 300, "-=" * 150]
    row, piece, edits, *_ = index.leaks(*C.text_bytes(pa.array(docs)))
    got: dict = {}
    for r, p, e in zip(row.tolist(), piece.tolist(), edits.tolist()):
        got[r, p] = min(got.get((r, p), 99), e)
    want = {}
    for r, d in enumerate(docs):
        for p, code in enumerate(index.codes):
            e = cases.fitted_edits("".join(map(chr, code)), fold(d))
            if e <= len(code) // 10:
                want[r, p] = e
    assert got == want and len(want) > 20


def test_a_megabyte_of_blanks_against_indented_items():
    rng = random.Random(5)
    items = [(k, "".join("        " + cases.prose(rng, 3) for _ in range(4))) for k in range(500)]
    index = decontam.Index(items)
    began = time.perf_counter()
    row, *_ = index.leaks(*C.text_bytes(pa.array([" " * 1_000_000, items[7][1], "x" * 300_000 + items[9][1]])))
    assert {1, 2} == set(row.tolist()) and time.perf_counter() - began < 30


def test_stretches_find_what_one_search_finds(monkeypatch):
    rng = random.Random(6)
    items = [(k, cases.prose(rng, rng.randint(2, 30))) for k in range(12)]
    docs = [" ".join(edited(rng, items[rng.randrange(12)][1], rng.randint(0, 3)) + " " + cases.prose(rng, 40) for _ in range(25)) for _ in range(3)]
    index = decontam.Index(items)
    whole = [x.tolist() for x in index.leaks(*C.text_bytes(pa.array(docs)))]
    monkeypatch.setattr(decontam, "STRETCH", 2520)
    monkeypatch.setattr(decontam, "AT_ONCE", 50)
    parts = [x.tolist() for x in index.leaks(*C.text_bytes(pa.array(docs)))]
    assert set(zip(*whole)) == set(zip(*parts)) and len(whole[0]) > 50


def test_index_in_files_and_in_parts(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    items = [(k, cases.prose(rng, rng.randint(1, 40))) for k in range(40)] + [(None, "an item without a number"), (3, "tiny text")]
    index = decontam.Index(items)
    index.save(str(tmp_path), "i")
    again = decontam.Index.load(str(tmp_path), "i")
    texts = C.text_bytes(pa.array([t for _, t in items]))
    assert all((a == b).all() for a, b in zip(index.leaks(*texts), again.leaks(*texts))) and again.owner == index.owner
    bench = spark.createDataFrame(items, "item_id string, text string")  # numbers as strings
    docs = spark.createDataFrame([(str(100 + k), t, "x") for k, (_, t) in enumerate(items)], "doc_id string, text string, found string")
    one = {tuple(r) for r in decontam.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontam, "PART_BYTES", 500)
    assert {tuple(r) for r in decontam.leaks(docs, bench).collect()} == one and len(one) >= sum(len(t) >= 8 for _, t in items)
    assert decontam.filter_leaks(docs, bench).count() == 0
