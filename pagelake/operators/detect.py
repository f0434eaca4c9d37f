"""Detection post-processing: letterbox geometry, class choice, suppression, tiling and mapping back to the page.

Tables: raw detections (page_id, anchor_idx, cx, cy, w, h, scores); boxes (page_id, det_idx, x0, y0,
x1, y1 double, score, class_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import IOU, box, corners

LABELS = ("article", "author", "cartoon_or_advertisement", "headline", "image_caption", "masthead", "newspaper_header", "page_number", "photograph", "table")
TEXT_BEARING = ("article", "headline", "author", "image_caption")
SIDE = 1280


def letterbox(pages: DataFrame, side: int = SIDE) -> DataFrame:
    """The scale (never above one), resized dimensions and padding that fit each page into a square."""
    r = F.least(F.lit(float(side)) / F.col("height"), F.lit(float(side)) / F.col("width"), F.lit(1.0))
    out = pages.withColumn("ratio", r)
    out = out.withColumn("new_w", F.bround(F.col("width") * F.col("ratio")).cast("int")).withColumn("new_h", F.bround(F.col("height") * F.col("ratio")).cast("int"))
    dw, dh = (F.lit(side) - F.col("new_w")) / 2.0, (F.lit(side) - F.col("new_h")) / 2.0
    edge = lambda d, e: F.bround(d + F.lit(e)).cast("int")
    return out.select("page_id", "ratio", "new_w", "new_h", edge(dw, -0.1).alias("pad_left"), edge(dw, 0.1).alias("pad_right"), edge(dh, -0.1).alias("pad_top"), edge(dh, 0.1).alias("pad_bottom"))


def to_corners(raw: DataFrame) -> DataFrame:
    """Centre and size as corners; the other columns stay."""
    b = corners(*(F.col(c) for c in ("cx", "cy", "w", "h")))
    return raw.select("page_id", "anchor_idx", *[v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b)], *[c for c in raw.columns if c not in ("page_id", "anchor_idx", "cx", "cy", "w", "h")])


def best_class(boxes: DataFrame, threshold: float = 0.25) -> DataFrame:
    """The first class of the highest score, where that is above the threshold."""
    top = boxes.withColumn("score", F.array_max("scores"))
    return top.where(F.col("score") > F.lit(threshold)).withColumn("class_id", (F.array_position("scores", F.col("score")) - 1).cast("int")).drop("scores")


def top_k(boxes: DataFrame, k: int = 30_000) -> DataFrame:
    """Each page's k best boxes, ranked by score, then anchor."""
    w = W.partitionBy("page_id").orderBy(F.desc("score"), "anchor_idx")
    return boxes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def suppress(boxes: DataFrame, iou: float = 0.45, most: int = 300, by_class: bool = True, key: str = "anchor_idx") -> DataFrame:
    """Greedy suppression: in order of score (then key), a box goes if it overlaps a kept one by more than ``iou``.

    The classes of a page don't suppress each other if ``by_class``; at most ``most`` of a page's boxes stay.
    """
    groups = ["page_id", "class_id"] if by_class else ["page_id"]
    item = F.struct((-F.col("score")).alias("order"), F.col(key).alias("key"), "x0", "y0", "x1", "y1")
    listed = boxes.groupBy(*groups).agg(F.array_sort(F.collect_list(item)).alias("boxes"))
    overlaps = IOU.format(a="k", b="b") + f" > {iou}D"
    kept = f"aggregate(boxes, cast(array() as {listed.schema['boxes'].dataType.simpleString()}), (acc, b) -> if(exists(acc, k -> coalesce({overlaps}, false)), acc, array_append(acc, b)))"
    rows = listed.select(*groups, F.explode(F.expr(kept)).alias("b")).select(*groups, F.col("b.key").alias(key), *[f"b.{c}" for c in ("x0", "y0", "x1", "y1")], (-F.col("b.order")).alias("score"))
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def to_page(boxes: DataFrame, pages: DataFrame, side: int = SIDE) -> DataFrame:
    """Boxes of the letterboxed square in page pixels, clamped to the page; empty ones go."""
    wide = F.col("width") > F.col("height")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    ratio_w = F.when(wide, F.lit(float(side))).otherwise(w / h * side)
    ratio_h = F.when(wide, w / h * side).otherwise(F.lit(float(side)))
    shift_w = F.when(wide, F.lit(0.0)).otherwise(side * ((1 - w / h) / 2))
    shift_h = F.when(wide, side * ((1 - h / w) / 2)).otherwise(F.lit(0.0))
    back = lambda c, shift, dim, ratio: (F.bround(F.col(c)) - shift) * dim / ratio
    out = boxes.join(pages, "page_id").select(
        *boxes.columns[: boxes.columns.index("x0")],
        F.greatest(F.lit(0), F.floor(back("x0", shift_w, w, ratio_w)).cast("int")).alias("x0"),
        F.greatest(F.lit(0), F.floor(back("y0", shift_h, h, ratio_h)).cast("int")).alias("y0"),
        F.least(F.col("width"), F.ceil(back("x1", shift_w, w, ratio_w)).cast("int")).alias("x1"),
        F.least(F.col("height"), F.ceil(back("y1", shift_h, h, ratio_h)).cast("int")).alias("y1"),
        *boxes.columns[boxes.columns.index("y1") + 1 :],
    )
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def labelled(boxes: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    names = F.create_map(*[x for k, v in enumerate(labels) for x in (F.lit(k), F.lit(v))])
    return boxes.withColumn("label", F.coalesce(F.try_element_at(names, F.col("class_id")), F.lit("unknown")))


def line_candidates(regions: DataFrame, labels: tuple[str, ...] = TEXT_BEARING) -> DataFrame:
    return regions.where(F.col("label").isin(*labels))


def chunks(regions: DataFrame) -> DataFrame:
    """Windows over regions more than twice as tall as wide: two widths high, one and a half apart, and the rest; else the whole region."""
    out = regions.withColumn("rw", F.col("x1") - F.col("x0")).withColumn("rh", F.col("y1") - F.col("y0")).withColumn("stride", F.floor(F.col("rw") * 1.5).cast("int"))
    full = F.floor((F.col("rh") - 2 * F.col("rw")) / F.col("stride")).cast("int") + 1
    n = F.when(F.col("rh") <= 2 * F.col("rw"), F.lit(0)).otherwise(full)
    out = out.withColumn("n", n).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.col("n"))))
    top = F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("chunk_idx") * F.col("stride"))
    bottom = F.when(F.col("chunk_idx") == F.col("n"), F.col("rh")).otherwise(F.col("chunk_idx") * F.col("stride") + 2 * F.col("rw"))
    return out.select("page_id", "region_idx", "chunk_idx", top.alias("top"), bottom.alias("bottom"), "rw", "rh")


def project_lines(lines: DataFrame, windows: DataFrame, side: int = SIDE) -> DataFrame:
    """Line boxes of a letterboxed chunk in the chunk's pixels: the whole width, and the vertical extent mapped back."""
    out = lines.join(windows, ["page_id", "region_idx", "chunk_idx"])
    w, h = F.col("rw").cast("double"), (F.col("bottom") - F.col("top")).cast("double")
    wide = w > h
    ratio = F.when(wide, h / w * side).otherwise(F.lit(float(side)))
    shift = F.when(wide, side * ((1 - h / w) / 2)).otherwise(F.lit(0.0))
    back = lambda c: (F.bround(F.col(c)) - shift) * h / ratio
    return out.select(
        "page_id", "region_idx", "chunk_idx", "line_no", F.lit(0).alias("x0"), F.floor(back("ly0")).cast("int").alias("y0"), F.col("rw").alias("x1"), F.ceil(back("ly1")).cast("int").alias("y1"), "score"
    )


def stitch_lines(lines: DataFrame, regions: DataFrame, iou: float = 0.15) -> DataFrame:
    """Lines of all chunks in their region's pixels, the overlapping ones suppressed, numbered from the top."""
    size = regions.select("page_id", "region_idx", F.floor((F.col("x1") - F.col("x0")) * 1.5).cast("int").alias("stride"))
    placed = lines.join(size, ["page_id", "region_idx"])
    shift = F.col("chunk_idx") * F.col("stride")
    key = F.col("chunk_idx").cast("long") * (1 << 32) + F.col("line_no")
    moved = placed.select(F.struct("page_id", "region_idx").alias("page_id"), key.alias("anchor_idx"), F.col("x0").cast("double"), (F.col("y0") + shift).cast("double").alias("y0"), F.col("x1").cast("double"), (F.col("y1") + shift).cast("double").alias("y1"), "score")
    kept = suppress(moved, iou, 1 << 30, by_class=False)
    number = F.row_number().over(W.partitionBy("page_id").orderBy("y0", F.desc("score"), "anchor_idx")) - 1
    out = kept.withColumn("line_idx", number)
    return out.select("page_id.page_id", "page_id.region_idx", F.col("line_idx").cast("int").alias("line_idx"), *[F.bround(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")], "score")


def lines_to_page(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines clamped to their region and moved to its place on the page; empty ones go."""
    r = regions.select("page_id", "region_idx", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    out = lines.join(r, ["page_id", "region_idx"])
    x0, y0 = F.greatest(F.lit(0), F.col("x0")), F.greatest(F.lit(0), F.col("y0"))
    x1, y1 = F.least(F.col("rx1") - F.col("rx0"), F.col("x1")), F.least(F.col("ry1") - F.col("ry0"), F.col("y1"))
    out = out.where((x1 > x0) & (y1 > y0))
    return out.select("page_id", "region_idx", "line_idx", (F.col("rx0") + x0).alias("x0"), (F.col("ry0") + y0).alias("y0"), (F.col("rx0") + x1).alias("x1"), (F.col("ry0") + y1).alias("y1"))


def clamped(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Another detector's boxes: coordinates truncated, clamped to the page, empty ones dropped; no label is ``unknown``, no score 0."""
    x0, y0, x1, y1 = (c.cast("int") for c in box())
    out = boxes.join(pages, "page_id").select(
        "page_id", "det_idx", F.coalesce("label", F.lit("unknown")).alias("label"), F.greatest(F.lit(0), x0).alias("x0"), F.greatest(F.lit(0), y0).alias("y0"),
        F.least(F.col("width"), x1).alias("x1"), F.least(F.col("height"), y1).alias("y1"), F.coalesce("score", F.lit(0.0)).alias("confidence"),
    )
    return out.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
