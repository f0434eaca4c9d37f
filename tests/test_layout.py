"""Layout, detection and recognition on small pages."""

import random

import pytest

from pagelake.functions import text as T
from pagelake.operators import detect, formats, layout, recognize
from pagelake.schema import LINES, PAGES, REGIONS


def regions(spark, *boxes, labels=None, confidences=None, texts=None):
    rows = [(1, k, (labels or {}).get(k, "text"), *b, (texts or {}).get(k, ""), (confidences or {}).get(k, 0.9)) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, REGIONS)


def ids(frame):
    return [r.region_idx for r in frame.orderBy("region_idx").collect()]


def test_confidence_is_inclusive(spark):
    r = regions(spark, (0, 0, 200, 100), (0, 100, 200, 200), (0, 200, 200, 300), confidences={0: 0.8, 1: 0.3, 2: 0.5})
    assert ids(layout.confident(r)) == [0, 2]


@pytest.mark.parametrize("box,kept", [((300, 300, 500, 400), 2), ((10, 10, 190, 190), 1), ((0, 300, 10, 305), 1)])
def test_rescue(spark, box, kept):
    assert layout.rescue(regions(spark, (0, 0, 200, 200), box, confidences={1: 0.3})).count() == kept


@pytest.mark.parametrize("order", [0, 1])
def test_dedup_keeps_the_surer(spark, order):
    boxes = [(0, 0, 200, 200), (5, 5, 195, 195)]
    r = regions(spark, *(boxes if order == 0 else boxes[::-1]), confidences={order: 0.9, 1 - order: 0.4})
    assert [x.confidence for x in layout.dedup(r).collect()] == [0.9]


def test_dedup_keeps_titles_and_strangers(spark):
    r = regions(spark, (0, 0, 200, 80), (5, 5, 195, 75), labels={0: "paragraph_title"}, confidences={0: 0.8, 1: 0.95})
    assert [x.label for x in layout.dedup(r).collect()] == ["paragraph_title"]
    assert layout.dedup(regions(spark, (0, 0, 100, 100), (200, 200, 300, 300))).count() == 2


def test_reading_order_of_two_columns(spark):
    boxes = [b for k in range(4) for b in ((250, 100 * k, 450, 100 * k + 90), (0, 100 * k, 200, 100 * k + 90))]
    got = layout.reading_order(regions(spark, *boxes)).orderBy("position").collect()
    assert [(r.x0, r.y0) for r in got] == [(0, 100 * k) for k in range(4)] + [(250, 100 * k) for k in range(4)]


def test_reading_order_of_one_column_and_none(spark):
    got = layout.reading_order(regions(spark, *[(0, 100 * k, 800, 100 * k + 90) for k in (3, 1, 0, 2)])).orderBy("position").collect()
    assert [r.y0 for r in got] == [0, 100, 200, 300]
    assert layout.reading_order(regions(spark).limit(0)).count() == 0
    assert layout.reading_order(regions(spark, (0, 5, 9, 9))).first().position == 0


def merged(spark, *boxes, **more):
    r = regions(spark, *boxes, **more)
    return layout.merge_adjacent(r.withColumn("position", r.region_idx)).orderBy("region_idx").collect()


def test_merge(spark):
    both = merged(spark, (0, 0, 200, 100), (0, 110, 200, 200), texts={0: "Hello", 1: "world"})
    assert [(r.text, r.y1) for r in both] == [("Hello\nworld", 200)]
    assert len(merged(spark, (0, 0, 200, 50), (0, 60, 200, 150), labels={0: "paragraph_title"})) == 2
    assert len(merged(spark, (0, 0, 200, 100), (0, 200, 200, 300))) == 2
    tall = merged(spark, *[(0, 85 * k, 200, 85 * k + 80) for k in range(10)])
    assert len(tall) == 2 and all(r.y1 - r.y0 <= 600 for r in tall)


def test_gaps_are_filled(spark):
    boxes = [(0, 0, 200, 100), (0, 500, 200, 600), (0, 620, 200, 700), (300, 0, 500, 700)]
    pages = spark.createDataFrame([(1, "p", 600, 2000)], PAGES)
    gaps = layout.column_gaps(regions(spark, *boxes), pages).collect()
    assert (0, 100, 200, 500) in [(g.x0, g.y0, g.x1, g.y1) for g in gaps]


def test_process_drops_text_without_lines(spark):
    r = regions(spark, (0, 0, 500, 200), (0, 300, 500, 500), confidences={1: 0.05}, texts={0: "kept", 1: "removed"})
    pages = spark.createDataFrame([(1, "p", 600, 600)], PAGES)
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, "x", 1.0)], LINES)
    assert [x.text for x in layout.process(r, pages, lines).collect()] == ["kept"]
    assert layout.process(r, pages, lines.limit(0)).count() == 0
    assert layout.process(r, pages, enabled=False).count() == 2


def test_suppression_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(p, k, float(x), float(y), float(x + rng.randint(5, 60)), float(y + rng.randint(5, 60)), rng.randint(0, 20) / 20, rng.randint(0, 2)) for p in range(6) for k in range(30) for x, y in [(rng.randint(0, 90), rng.randint(0, 90))]]
    frame = spark.createDataFrame(rows, "page_id long, anchor_idx int, x0 double, y0 double, x1 double, y1 double, score double, class_id int")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        i = max(0, w) * max(0, h)
        return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)

    for by_class in (True, False):
        kept = []
        for r in sorted(rows, key=lambda r: (r[0], -r[6], r[1])):
            if all(k[0] != r[0] or (by_class and k[7] != r[7]) or iou(k, r) <= 0.2 for k in kept):
                kept.append(r)
        got = {(r.page_id, r.anchor_idx) for r in detect.suppress(frame, 0.2, 100, by_class).collect()}
        assert got == {k[:2] for k in kept}


def test_letterbox_and_corners(spark):
    pages = spark.createDataFrame([(1, 640, 640), (2, 500, 1000), (3, 1000, 500)], "page_id long, width int, height int")
    for r in detect.letterbox(pages, 640).collect():
        assert (r.pad_left + r.new_w + r.pad_right, r.pad_top + r.new_h + r.pad_bottom) == (640, 640)
    raw = spark.createDataFrame([(1, 0, 50.0, 50.0, 20.0, 30.0, [0.1])], "page_id long, anchor_idx int, cx double, cy double, w double, h double, scores array<double>")
    assert tuple(detect.to_corners(raw).select("x0", "y0", "x1", "y1").first()) == (40, 35, 60, 65)


def test_fallback_threshold_is_strict(spark):
    rows = [(1, 0, k, 0, 0, 9, 9, "old", c) for k, c in enumerate((0.30, 0.70, 0.95))]
    lines = spark.createDataFrame(rows, LINES)
    got = recognize.with_fallback(lines, lambda r: recognize.recognized(r.withColumn("content", r.text), _Stub), whole=True).orderBy("line_idx").collect()
    assert [(r.text, r.confidence) for r in got] == [("NEW", 1.0), ("old", 0.70), ("old", 0.95)]


class _Stub:
    def recognize(self, contents, boxes):
        return [("NEW", 0.5) for _ in contents]


class _Broken:
    def recognize(self, contents, boxes):
        raise OSError("no model")


def test_errors_leave_empty_text(spark):
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, "old", 0.3)], LINES)
    got = recognize.recognized(lines.withColumn("content", lines.text), _Broken).first()
    assert (got.text, got.confidence) == ("", 0.0)


def test_routes(spark):
    r = regions(spark, (0, 0, 9, 9), (0, 0, 9, 9))
    lines = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, "x", 1.0)], LINES)
    get = lambda **k: [x.route for x in recognize.routes(r, lines, **k).orderBy("region_idx").collect()]
    assert get() == ["lines", "region"] and get(by_region=False) == ["lines", "none"] and get(mode="region") == ["region", "region"]
    with pytest.raises(ValueError):
        get(mode="word")


def test_repetition(spark):
    cases = [("The quick brown fox " * 10, True), ("Hello world this is normal text.", False), ("", False)]
    rows = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", T.repeats_itself(rows.t).alias("got")).collect())
    cut = spark.createDataFrame([("Hello world " * 5,), ("Unique text here.",)], "t string")
    assert [r.x for r in cut.select(T.without_repetition(cut.t).alias("x")).collect()] == ["Hello world", "Unique text here."]


def test_formats(spark):
    pages = spark.createDataFrame([(1, "p", 200, 100), (2, "q", 5, 5)], PAGES)
    r = regions(spark, (0, 0, 200, 100), (0, 0, 1, 1), (0, 0, 1, 1), labels={0: "article"}, texts={0: "First paragraph.", 2: "Second paragraph."})
    lines = spark.createDataFrame([(1, 0, 0, 10, 20, 190, 50, "A & B < C", 0.95)], LINES)
    texts = {x.page_id: x.text for x in formats.page_texts(r, pages).collect()}
    assert texts == {1: "First paragraph.\n\nSecond paragraph.", 2: ""}
    import json

    nested = formats.nested_pages(pages, r, lines)
    for indent in (None, 2):
        found = {x.page_id: json.loads(x.json) for x in formats.as_json(nested, indent).collect()}
        first = found[1]["regions"][0]
        assert first["lines"].pop() == {"text": "A & B < C", "confidence": 0.95, "bbox": {"x0": 10, "y0": 20, "x1": 190, "y1": 50}}
        assert found[2] == {"width": 5, "height": 5, "regions": []}
    hocr = {x.page_id: x.hocr for x in formats.as_hocr(pages, r, lines).collect()}
    assert "A &amp; B &lt; C" in hocr[1] and "bbox 10 20 190 50" in hocr[1] and hocr[2].count("ocr_carea") == 0
    assert formats.flat_regions(nested).count() == 3 and formats.flat_lines(nested).count() == 1
