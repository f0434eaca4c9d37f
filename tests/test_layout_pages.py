"""Steps of the layout that take whole pages in Arrow batches, against the same told pair by pair."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from pagelake import queries as core
from pagelake.operators import layout
from pagelake.schema import REGIONS


def drawn(rng, pages, most):
    """Regions that overlap a lot, with missing and odd values, and numbers that occur twice."""
    rows = []
    for p in range(pages):
        for k in range(rng.randint(0, most)):
            x, y = rng.randint(0, 120), rng.randint(0, 120)
            label = rng.choice(["text", "text", "photo", "doc_title", "paragraph_title", None])
            box = [None if rng.random() < 0.02 else v for v in (x, y, x + rng.randint(-5, 90), y + rng.randint(-5, 90))]
            rows.append((None if p == 1 else p, k - (rng.random() < 0.05), label, *box, rng.choice(["", "t", None]), rng.choice([None, float("nan"), 0.2, 0.5, 0.5, 0.9])))
    rng.shuffle(rows)
    return rows


def one_by_one(pairs):
    gone = set()
    for page, i, j, victim in sorted((r.page_id, r.i, r.j, r.victim) for r in pairs if r.victim):
        if not {(page, i), (page, j)} & gone:
            gone.add((page, i if victim == "i" else j))
    return gone


def test_dedup_pair_by_pair(spark, monkeypatch):
    rows = drawn(random.Random(7), 40, 30)
    regions = spark.createDataFrame(rows, REGIONS).repartition(3)
    gone = one_by_one(layout.overlap_pairs(regions).collect())
    want = sorted(repr(r) for r in rows if r[:2] not in gone)
    assert 0 < len(want) < len(rows) and sum(r[:2] in gone for r in rows) > len(gone)
    assert sorted(repr(tuple(r)) for r in layout.dedup(regions).collect()) == want
    # a few pairs at a time, and batches that end within pages
    monkeypatch.setattr(layout, "PAIRS", 7)
    ordered = regions.withColumn("__pos", F.row_number().over(layout.page().orderBy("region_idx"))).orderBy("page_id", "region_idx", "__pos").toArrow()
    parts = list(layout._whole_pages(iter(ordered.to_batches(max_chunksize=5))))
    assert len(parts) > 20 and repr([r for part in parts for r in part.to_pylist()]) == repr(ordered.to_pylist())
    kept = [r for part in parts for r in part.filter(pa.array(layout._kept(part))).drop_columns(["__pos"]).to_pylist()]
    assert sorted(repr(tuple(r.values())) for r in kept) == want


def test_dedup_takes_pages_once(spark, sf_dir):
    plan = core.QUERIES["layout_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan and plan.count("FileScan") == 1


def test_rescue_and_overlaps_in_one_pass(spark):
    rows = [r for r in drawn(random.Random(8), 40, 30) if r[0] is not None and r[1] is not None]
    rows = [(*r[:8], random.Random(k).choice([0.1, 0.2, 0.3, 0.4, 0.6, float("nan"), None])) for k, r in enumerate({r[:2]: r for r in rows}.values())]
    regions = spark.createDataFrame(rows, REGIONS).repartition(3)
    sure = lambda r: r[8] is not None and not r[8] < 0.5
    whole = lambda r: None not in r[3:7]
    side = lambda a, b: max(0, b - a)
    want = []
    for p in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == p), key=lambda r: r[1])
        late = []
        for r in own:
            if r[8] is None or sure(r) or r[8] < 0.15 or not whole(r) or (area := side(r[3], r[5]) * side(r[4], r[6])) < 500:
                continue
            covered = sum(side(max(r[3], a[3]), min(r[5], a[5])) * side(max(r[4], a[4]), min(r[6], a[6])) for a in own if sure(a) and whole(a))
            late += [r] * (covered / area < 0.3)
        want += [(p, k, *r[2:]) for k, r in enumerate([r for r in own if sure(r)] + late)]
    got = layout.rescue(regions)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and any(not sure(r) for r in want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    both = layout.renumbered(layout.dedup(got), "region_idx")
    at_once = layout._by_page(*layout._rescue(regions), layout._deduped, layout._renumbered)
    assert sorted(map(repr, map(tuple, at_once.collect()))) == sorted(map(repr, map(tuple, both.collect())))
