"""Layout post-processing of regions (page_id, region_idx, label, x0, y0, x1, y1 int, text, confidence double).

All of it groups by page: with the regions partitioned by page_id, one exchange serves the whole chain.
Only the choice of what to drop among overlapping regions and the merging of neighbours need the
regions one after another: the first is a fold over a page's pairs in Arrow batches, the second over its array, within the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import area, box, intersection
from ..sources.shared import settled

OCR_LABELS = ("text", "paragraph_title", "doc_title", "figure_title")
TITLES = ("doc_title", "paragraph_title")
BOX = ("x0", "y0", "x1", "y1")


def page():
    return W.partitionBy("page_id")


def renumbered(regions: DataFrame, *order: Column | str) -> DataFrame:
    """region_idx counted anew from 0, in the given order."""
    return regions.withColumn("region_idx", (F.row_number().over(page().orderBy(*order)) - 1).cast("int"))


def confident(regions: DataFrame, threshold: float = 0.5) -> DataFrame:
    return regions.where(F.col("confidence") >= threshold)


def rescue(regions: DataFrame, threshold: float = 0.5, floor: float = 0.15, least_area: int = 500, most_overlap: float = 0.3) -> DataFrame:
    """The confident regions, then those of at least ``floor`` and ``least_area`` that the confident ones hardly cover; numbered anew."""
    return _by_page(*_rescue(regions, threshold, floor, least_area, most_overlap))


def _rescue(regions: DataFrame, threshold: float = 0.5, floor: float = 0.15, least_area: int = 500, most_overlap: float = 0.3) -> tuple[DataFrame, Callable[[pa.Table], pa.Table]]:
    """What the step of rescue starts from, and the step."""
    return regions.where(F.col("confidence") >= min(floor, threshold)), lambda pages: _rescued(pages, threshold, least_area, most_overlap)


def overlap_pairs(regions: DataFrame) -> DataFrame:
    """Overlapping pairs i < j of a page, and which of them goes: 'i', 'j' or null for neither."""
    cols = ("region_idx", "label", "confidence", *BOX)
    a = regions.select("page_id", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = regions.select(F.col("page_id").alias("b_page"), *[F.col(c).alias(f"b_{c}") for c in cols])
    meets = (F.col("a_x0") < F.col("b_x1")) & (F.col("a_x1") > F.col("b_x0")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("a_y1") > F.col("b_y0"))
    pairs = a.join(b, (F.col("page_id") == F.col("b_page")) & (F.col("a_region_idx") < F.col("b_region_idx")) & meets)
    pairs = pairs.withColumn("inter", intersection(box("a_"), box("b_"))).withColumn("ai", area(box("a_"))).withColumn("aj", area(box("b_")))
    small, large = F.least("ai", "aj"), F.greatest("ai", "aj")
    c = F.try_divide("inter", small)
    ti, tj = F.col("a_label").isin(*TITLES), F.col("b_label").isin(*TITLES)
    same = F.col("a_label") == F.col("b_label")
    victim = (
        F.when((F.col("inter") <= 0) | (small <= 0), F.lit(None))
        .when((c > 0.8) & ti & ~tj, "j")
        .when((c > 0.8) & tj & ~ti, "i")
        .when(same & (c > 0.8), F.when(F.col("a_confidence") >= F.col("b_confidence"), "j").otherwise("i"))
        .when(same & (c > 0.7), F.when(F.col("ai") >= F.col("aj"), "j").otherwise("i"))
        .when((F.try_divide("inter", "aj") > 0.5) & (F.col("aj") < F.col("ai")), "j")
        .when((F.try_divide("inter", "ai") > 0.5) & (F.col("ai") < F.col("aj")), "i")
        .when((F.try_divide(large, small) > 3) & (c > 0.3), F.when(F.col("ai") < F.col("aj"), "i").otherwise("j"))
    )
    return pairs.select("page_id", F.col("a_region_idx").alias("i"), F.col("b_region_idx").alias("j"), "inter", victim.alias("victim"))


#: Pairs that are looked at together; a region with more than these behind it on its page is looked at alone.
PAIRS = 1 << 19


def _victims(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """overlap_pairs in numpy, of rows with an area: 1 where the first of the pair goes, 2 where the second does, else 0."""
    inter = np.maximum(0, np.minimum(a["x1"][i], a["x1"][j]) - np.maximum(a["x0"][i], a["x0"][j])) * np.maximum(0, np.minimum(a["y1"][i], a["y1"][j]) - np.maximum(a["y0"][i], a["y0"][j]))
    out = np.zeros(len(i), np.int8)
    met = np.flatnonzero(inter > 0)
    i, j, inter = i[met], j[met], inter[met]
    ai, aj, li, lj, ci, cj = (a[k][x] for k in ("area", "label", "confidence") for x in (i, j))
    c, large = inter / np.minimum(ai, aj), np.maximum(ai, aj) / np.minimum(ai, aj)
    titles = a["title"][i] - a["title"][j]
    titles[(li < 0) | (lj < 0)] = 0
    same = (li == lj) & (li >= 0)
    # NaN counts as the greatest, and where a confidence is missing, the first goes
    surer = ((ci >= cj) | np.isnan(ci)) & a["sure"][i] & a["sure"][j]
    out[met] = np.select(
        [(c > 0.8) & (titles > 0), (c > 0.8) & (titles < 0), same & (c > 0.8), same & (c > 0.7), (inter / aj > 0.5) & (aj < ai), (inter / ai > 0.5) & (ai < aj), (large > 3) & (c > 0.3)],
        [2, 1, np.where(surer, 2, 1), np.where(ai >= aj, 2, 1), 2, 1, np.where(ai < aj, 1, 2)],
    )
    return out


def _kept(pages: pa.Table) -> np.ndarray:
    """Which rows of whole pages stay; the rows are in the order of page and region_idx, __pos is 1 at a page's first."""
    whole = {c: pages[c].combine_chunks() for c in ("page_id", "region_idx", "label", "confidence", *BOX)}
    number = lambda c: whole[c].fill_null(0).to_numpy(zero_copy_only=False)
    there = lambda c: whole[c].is_valid().to_numpy(zero_copy_only=False)
    a = {c: number(c).astype(np.int64) for c in ("region_idx", *BOX)} | {"confidence": number("confidence").astype(float), "sure": there("confidence")}
    a["area"] = np.maximum(0, a["x1"] - a["x0"]) * np.maximum(0, a["y1"] - a["y0"])
    coded = whole["label"].dictionary_encode()
    a["label"] = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    a["title"] = np.array([x in TITLES for x in coded.dictionary.to_pylist()] + [False], np.int8)[a["label"]]
    page = np.cumsum(pages["__pos"].to_numpy() == 1)
    # equal numbers of a page go together
    key = np.cumsum(np.diff(page, prepend=-1).astype(bool) | np.diff(a["region_idx"], prepend=0).astype(bool)) - 1
    rows = np.flatnonzero(np.logical_and.reduce([there(c) for c in ("page_id", "region_idx", *BOX)]) & (a["area"] > 0))
    a, own = {c: x[rows] for c, x in a.items()}, key[rows]
    after = np.searchsorted(own, own, "right")  # the first row behind it with another number
    n = np.maximum(0, np.searchsorted(page[rows], page[rows], "right") - after)
    upto, twice = np.cumsum(n), len(np.unique(own)) < len(own)
    gone, start = np.zeros(len(key), bool), 0
    while start < len(rows):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        end = int(np.searchsorted(own, own[end - 1], "right"))
        which = np.arange(start, end)[~gone[own[start:end]]]
        i = np.repeat(which, n[which])
        j = np.arange(len(i)) + np.repeat(after[which] - (np.cumsum(n[which]) - n[which]), n[which])
        alive = ~gone[own[j]]
        i, j = i[alive], j[alive]
        victim = _victims(a, i, j)
        hit = np.flatnonzero(victim)
        one, two = own[i[hit]], own[j[hit]]
        lost = np.where(victim[hit] == 1, one, two)
        if twice:
            order = np.lexsort((lost, two, one))
            one, two, lost = one[order], two[order], lost[order]
        done = gone[: own[-1] + 1].tolist()
        for p, q, v in zip(one.tolist(), two.tolist(), lost.tolist()):
            if not (done[p] or done[q]):
                done[v] = True
        gone[: len(done)] = done
        start = end
    return ~gone[key]


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows as they come, cut only before a page's first row."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("__pos").to_numpy() == 1)
        if len(begins):
            held.append(batch[: begins[-1]])
            if sum(x.num_rows for x in held):
                yield pa.Table.from_batches(held)
            held = []
        held.append(batch[begins[-1] if len(begins) else 0 :])
    if held:
        yield pa.Table.from_batches(held)


def _placed(pages: pa.Table, page: np.ndarray) -> pa.Table:
    """The rows with __pos from 1 on each page."""
    pos = np.arange(len(page)) - np.searchsorted(page, page) + 1
    return pages.set_column(pages.column_names.index("__pos"), "__pos", pa.array(pos.astype(np.int32)))


def _renumbered(pages: pa.Table) -> pa.Table:
    """region_idx counted from 0 as __pos is from 1."""
    return pages.set_column(pages.column_names.index("region_idx"), "region_idx", pa.array(pages["__pos"].to_numpy() - 1, pa.int32()))


def _deduped(pages: pa.Table) -> pa.Table:
    kept = _kept(pages)
    return _placed(pages.filter(pa.array(kept)), np.cumsum(pages["__pos"].to_numpy() == 1)[kept])


def _rescued(pages: pa.Table, threshold: float, least_area: int, most_overlap: float) -> pa.Table:
    """Of regions of a confidence of at least the floor; the areas that confident ones cover are summed by region_idx."""
    whole = {c: pages[c].combine_chunks() for c in ("page_id", "region_idx", *BOX)}
    x0, y0, x1, y1 = (whole[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in BOX)
    there = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in whole.items()}
    confidence, page = pages["confidence"].to_numpy(), np.cumsum(pages["__pos"].to_numpy() == 1)
    number = whole["region_idx"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    boxed = np.logical_and.reduce([there[c] for c in BOX])
    # a side with a missing end is none
    area = np.where(there["x0"] & there["x1"], np.maximum(0, x1 - x0), 0) * np.where(there["y0"] & there["y1"], np.maximum(0, y1 - y0), 0)
    sure = (confidence >= threshold) | np.isnan(confidence)
    weak = np.flatnonzero(~sure & (area >= least_area))
    over, some = np.flatnonzero(sure & boxed & there["page_id"]), weak[(boxed & there["page_id"] & there["region_idx"])[weak]]
    key = np.cumsum(np.diff(page, prepend=-1).astype(bool) | np.diff(number, prepend=0).astype(bool) | np.diff(there["region_idx"].astype(int), prepend=0).astype(bool)) - 1
    low = np.searchsorted(page[over], page[some])
    n = np.searchsorted(page[over], page[some], "right") - low
    upto, covered, start = np.cumsum(n), np.zeros(len(page), np.int64), 0
    while start < len(some):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        m = n[start:end]
        i, j = np.repeat(some[start:end], m), over[np.arange(m.sum()) + np.repeat(low[start:end] - (np.cumsum(m) - m), m)]
        inter = np.maximum(0, np.minimum(x1[i], x1[j]) - np.maximum(x0[i], x0[j])) * np.maximum(0, np.minimum(y1[i], y1[j]) - np.maximum(y0[i], y0[j]))
        np.add.at(covered, key[i], inter)
        start = end
    saved = weak[np.where(there["region_idx"][weak], covered[key[weak]], 0) / area[weak] < most_overlap]
    rows = np.concatenate([np.flatnonzero(sure), saved])
    rows = rows[np.lexsort((rows, ~sure[rows], page[rows]))]
    return _renumbered(_placed(pages.take(pa.array(rows)), page[rows]))


def _by_page(regions: DataFrame, *steps: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Steps over tables of whole pages, whose rows are in the order of page and region_idx, with __pos from 1 on each page."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pages in _whole_pages(batches):
            for step in steps:
                pages = step(pages)
            yield from pages.drop_columns(["__pos"]).to_batches()

    # the window brings pages together and leaves them in order, without an exchange of its own where they are together already
    return regions.withColumn("__pos", F.row_number().over(page().orderBy("region_idx"))).mapInArrow(fold, regions.schema)


def dedup(regions: DataFrame) -> DataFrame:
    """Overlaps resolved pair by pair, in the order of (i, j); a pair with a region already gone is passed over.

    Pages are folded over as they come from one exchange, in Arrow batches; of a page's pairs about ``PAIRS`` are held at a time.
    """
    return _by_page(regions, _deduped)


def raw_columns(regions: DataFrame) -> DataFrame:
    """Columns of text: runs of the middles of narrow regions without a gap of over 0.3 median widths."""
    wide = regions.select("page_id", "region_idx", "x0", "x1", (F.col("x1") - F.col("x0")).alias("w"))
    wide = wide.withColumn("median_w", F.expr("double(median(w) over (partition by page_id))"))
    narrow = wide.where(F.col("w") <= F.col("median_w") * F.lit(1.3)).withColumn("mid", (F.col("x0") + F.col("x1")) / 2.0)
    narrow = narrow.withColumn("n", F.count("*").over(page())).where("n >= 3")
    order = page().orderBy("mid", "region_idx")
    apart = (F.col("mid") - F.lag("mid").over(order) > F.col("median_w") * F.lit(0.3)).cast("int")
    runs = narrow.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("apart").over(order))
    return runs.groupBy("page_id", "run").agg(
        F.avg("mid").alias("center"), F.min("x0").cast("double").alias("cl"), F.max("x1").cast("double").alias("cr"), F.first("median_w").alias("median_w")
    ).withColumn("run", F.col("run").cast("int"))


def columns(regions: DataFrame) -> DataFrame:
    """The columns of at least 0.4 median widths; a narrower one widens the one to its left, or goes if there is none."""
    raw = raw_columns(regions)
    own = F.col("cr") - F.col("cl") >= F.col("median_w") * F.lit(0.4)
    kept = raw.withColumn("own", own.cast("int")).withColumn("col_idx", F.sum("own").over(page().orderBy("run")) - 1).where("col_idx >= 0")
    out = kept.groupBy("page_id", "col_idx").agg(
        F.min_by("center", "run").alias("center"), F.min_by("cl", "run").alias("cl"), F.max("cr").alias("cr"), F.first("median_w").alias("median_w")
    )
    return out.withColumn("col_idx", F.col("col_idx").cast("int"))


def column_gaps(regions: DataFrame, pages: DataFrame, least: int = 80) -> DataFrame:
    """Boxes (page_id, col_idx, gap_no, x0, y0, x1, y1) for the tall stretches of a column that no region of it covers."""
    cols = columns(regions).withColumn("n_cols", F.count("*").over(page())).where("n_cols >= 2")
    own = regions.withColumn("n", F.count("*").over(page())).where("n >= 3").select("page_id", "region_idx", "x0", "x1", "y0", "y1")
    overlap = F.least(F.col("x1").cast("double"), F.col("cr")) - F.greatest(F.col("x0").cast("double"), F.col("cl"))
    width = F.col("cr") - F.col("cl")
    fits = (F.col("x1") - F.col("x0") <= F.col("median_w") * F.lit(1.3)) & (width > 0) & (overlap > width * F.lit(0.3))
    held = own.join(cols, "page_id").where(fits)
    column = W.partitionBy("page_id", "col_idx")
    held = held.withColumn("top", F.min("y0").over(column)).withColumn("bot", F.max("y1").over(column)).withColumn("covered", F.sum(F.col("y1") - F.col("y0")).over(column))
    span = F.col("bot") - F.col("top")
    held = held.where(F.when(span > 0, F.try_divide("covered", span)).otherwise(F.lit(1.0)) <= 0.85)
    before = column.orderBy("y0", "y1", "x0", "x1", "region_idx").rowsBetween(W.unboundedPreceding, -1)
    held = held.withColumn("prev", F.coalesce(F.greatest(F.max("y1").over(before), F.col("top")), F.col("top"))).withColumn("pos", F.row_number().over(column.orderBy("y0", "y1", "x0", "x1", "region_idx")))
    x = [F.col("cl").cast("int").alias("x0"), F.col("cr").cast("int").alias("x1")]
    inner = held.where(F.col("y0") - F.col("prev") >= least).select("page_id", "col_idx", F.col("pos").alias("gap_no"), x[0], F.col("prev").alias("y0"), x[1], F.col("y0").alias("y1"))
    tails = held.groupBy("page_id", "col_idx").agg(F.first("cl").alias("cl"), F.first("cr").alias("cr"), F.first("top").alias("top"), F.first("bot").alias("bot"))
    end = F.least((F.col("height") - 20).cast("double"), F.col("bot") + (F.col("bot") - F.col("top")) * F.lit(0.15))
    tails = tails.join(pages.select("page_id", "height"), "page_id").withColumn("end", end).where(F.col("end") - F.col("bot") >= least)
    tail = tails.select("page_id", "col_idx", F.lit(1 << 30).alias("gap_no"), x[0], F.col("bot").alias("y0"), x[1], F.col("end").cast("int").alias("y1"))
    return inner.unionByName(tail)


def fill_gaps(regions: DataFrame, pages: DataFrame, least: int = 80) -> DataFrame:
    """The regions, then a text region of no confidence for every gap; numbered anew."""
    gaps = column_gaps(regions, pages, least)
    at = W.partitionBy("page_id").orderBy("col_idx", "gap_no")
    new = gaps.select("page_id", F.row_number().over(at).alias("region_idx"), F.lit("text").alias("label"), *BOX, F.lit("").alias("text"), F.lit(0.0).alias("confidence"), F.lit(1).alias("__after"))
    both = regions.withColumn("__after", F.lit(0)).unionByName(new, allowMissingColumns=True)
    return renumbered(both, "__after", "region_idx").drop("__after")


def reading_order(regions: DataFrame) -> DataFrame:
    """``position`` from 0: banners first, then column by column; in a column what reaches into others first, then from the top."""
    cols = columns(regions).withColumn("n_cols", F.count("*").over(page()))
    keyed = regions.withColumn("n", F.count("*").over(page()))
    both = keyed.select("page_id", "region_idx", "x0", "x1").join(cols, "page_id")
    width = F.col("cr") - F.col("cl")
    hit = (width > 0) & (F.least(F.col("x1").cast("double"), F.col("cr")) - F.greatest(F.col("x0").cast("double"), F.col("cl")) > width * F.lit(0.2))
    far = F.abs(F.col("center") - (F.col("x0") + F.col("x1")) / 2.0)
    place = both.groupBy("page_id", "region_idx").agg(
        F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("col_idx"))).alias("low"), F.max(F.when(hit, F.col("col_idx"))).alias("high"),
        F.min_by("col_idx", F.struct(far.alias("far"), "col_idx")).alias("near"), F.first("n_cols").alias("n_cols"),
    )
    out = keyed.join(place, ["page_id", "region_idx"], "left")
    multi = F.coalesce(F.col("hits") > 1, F.lit(False))
    banner = multi & (F.col("high") - F.col("low") + 1 >= F.col("n_cols") - 1)
    column = F.coalesce("low", "near", F.lit(0))
    order = page().orderBy(F.when(banner, 0).otherwise(1), F.when(banner, 0).otherwise(column), F.when(multi, 0).otherwise(1), F.when(F.col("n") > 1, F.col("y0")).otherwise(0), "region_idx")
    return out.withColumn("position", (F.row_number().over(order) - 1).cast("int")).select(*regions.columns, "position")


_ITEM = f"struct<label:string,{','.join(f'{c}:int' for c in BOX)},text:string,confidence:double,members:array<int>>"
_MERGED = """
named_struct('label', s.cur.label, 'x0', least(s.cur.x0, r.x0), 'y0', s.cur.y0, 'x1', greatest(s.cur.x1, r.x1), 'y1', greatest(s.cur.y1, r.y1),
  'text', if(s.cur.text <> '' or r.text <> '', regexp_replace(concat(s.cur.text, '\\n', r.text), {strip}, ''), ''),
  'confidence', greatest(s.cur.confidence, r.confidence), 'members', concat(s.cur.members, r.members))"""
_FITS = """
s.cur is not null and least(s.cur.x1 - s.cur.x0, r.x1 - r.x0) > 0
and greatest(0, least(s.cur.x1, r.x1) - greatest(s.cur.x0, r.x0)) / double(least(s.cur.x1 - s.cur.x0, r.x1 - r.x0)) >= {overlap}D
and r.y0 - s.cur.y1 between 0 and {gap} and greatest(s.cur.y1, r.y1) - s.cur.y0 <= {height}"""


def merge_adjacent(regions: DataFrame, overlap: float = 0.5, gap: int = 30, height: int = 600) -> DataFrame:
    """Neighbours in reading order (``position``) that lie below one another become one; titles stay alone.

    A merged region keeps the first one's label, the union of the boxes from the first one's top, the trimmed texts line by line, the highest
    confidence, and ``members``, the region_idx of what it holds.
    """
    item = F.struct("position", "label", *BOX, F.coalesce("text", F.lit("")).alias("text"), "confidence", F.array("region_idx").alias("members"))
    listed = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    fields = ("label", *BOX, "text", "confidence", "members")
    plain = "named_struct(" + ", ".join(f"'{f}', r.{f}" for f in fields) + ")"
    strip = r"'(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$'"
    flushed = "if(s.cur is null, s.done, array_append(s.done, s.cur))"
    titles = ", ".join(f"'{t}'" for t in TITLES)
    fold = f"""aggregate(items, named_struct('done', cast(array() as array<{_ITEM}>), 'cur', cast(null as {_ITEM})),
      (s, r) -> case when r.label in ({titles}) then named_struct('done', array_append({flushed}, {plain}), 'cur', cast(null as {_ITEM}))
                     when {_FITS.format(overlap=overlap, gap=gap, height=height)} then named_struct('done', s.done, 'cur', {_MERGED.format(strip=strip)})
                     else named_struct('done', {flushed}, 'cur', {plain}) end,
      s -> {flushed})"""
    out = listed.select("page_id", F.posexplode(F.expr(fold)).alias("region_idx", "m"))
    return out.select("page_id", "region_idx", "m.*")


def drop_empty(regions: DataFrame, lines: DataFrame, labels: tuple[str, ...] = OCR_LABELS) -> DataFrame:
    """The regions without those of text labels that hold no line."""
    with_lines = lines.select("page_id", "region_idx", F.lit(True).alias("has")).distinct()
    return regions.join(with_lines, ["page_id", "region_idx"], "left").where(~F.col("label").isin(*labels) | F.col("has").isNotNull()).drop("has")


def process(regions: DataFrame, pages: DataFrame, lines: DataFrame | None = None, enabled: bool = True, keep_empty: bool = False) -> DataFrame:
    """All steps: confidence and rescue, overlaps, gaps, reading order, merging, and (with lines) dropping empty text regions.

    ``sources`` of the result are the region_idx, in reading order, of the regions that it holds. With lines, those of a merged region are all its members' lines.
    """
    if not enabled:
        return regions
    base = regions.withColumn("source", F.col("region_idx"))
    # each step reads its input several times over: without these cuts the plan would grow with the product
    kept = settled(_by_page(*_rescue(base), _deduped, _renumbered))
    ordered = reading_order(settled(fill_gaps(kept, pages)))
    if lines is not None and not keep_empty:
        ordered = settled(ordered)
    # members come in reading order, so that of sources they are the merged region's sources
    merged = merge_adjacent(ordered.withColumn("region_idx", F.col("source")))
    out = merged.withColumn("sources", F.array_compact("members")).drop("members")
    if lines is not None and not keep_empty:
        n = lines.groupBy("page_id", F.col("region_idx").alias("source")).count()
        held = out.select("page_id", "region_idx", F.explode("sources").alias("source")).join(n, ["page_id", "source"], "left_semi").select("page_id", "region_idx").distinct()
        out = drop_empty(out, held)
    return renumbered(out, "region_idx")
