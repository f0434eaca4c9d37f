"""Detectors: pages (page_id, content) -> pages with width and height, regions, lines."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import detect
from .sources import images
from .sources.files import find_model
from .sources.shared import settled

#: Confidence, overlap and number of boxes kept, for regions of a page and for lines of a chunk.
LAYOUT = dict(confidence=0.01, iou=0.1, most=2000, by_class=False)
LINE = dict(confidence=0.2, iou=0.15, most=200, by_class=True)
FILES = ("layout_model_new.onnx", "line_model_new.onnx")
_open: dict[str, Any] = {}


def onnx_session(path: str):
    if path not in _open:
        _open[path] = importlib.import_module("onnxruntime").InferenceSession(path)
    return _open[path]


def raw_boxes(rows: DataFrame, path: str, confidence: float, session: Callable[[str], Any] = onnx_session, side: int = detect.SIDE) -> DataFrame:
    """page_id (of any type), anchor_idx, cx, cy, w, h, scores of each box of a model's output whose best score is above ``confidence``."""
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        model = session(path)
        name = model.get_inputs()[0].name
        for b in batches:
            for k, content in enumerate(b.column(b.schema.get_field_index("content")).to_pylist()):
                try:
                    pixels = images.decode(content)
                except Exception:  # noqa: BLE001  a page that can't be read mustn't end the job
                    continue
                found = np.asarray(model.run(None, {name: images.letterboxed(pixels, side)})[0][0], np.float32).T
                at = np.flatnonzero(found[:, 4:].max(1) > confidence) if len(found) else np.zeros(0, int)
                box, scores = found[at].astype(float)[:, :4], found[at, 4:].astype(float)
                ids = b.column(b.schema.get_field_index("page_id")).take(pa.array([k] * len(at), pa.int64()))
                yield pa.record_batch([ids, pa.array(at.astype(np.int32)), *[pa.array(box[:, c]) for c in range(4)], pa.array(list(scores), pa.list_(pa.float64()))], ["page_id", "anchor_idx", "cx", "cy", "w", "h", "scores"])

    return rows.select("page_id", "content").mapInArrow(run, f"page_id {kind}, anchor_idx int, cx double, cy double, w double, h double, scores array<double>")


def kept_boxes(raw: DataFrame, confidence: float, iou: float, most: int, by_class: bool) -> DataFrame:
    """The boxes that stay after suppression, with class and rank."""
    best = detect.top_k(detect.best_class(detect.to_corners(raw), confidence)).drop("rank")
    kept = detect.suppress(best, iou, most, by_class).select("page_id", "anchor_idx", "rank")
    return best.join(kept, ["page_id", "anchor_idx"])


@dataclass
class Yolo:
    """Two ONNX models of one kind: regions of the letterboxed page, then lines of the text-bearing regions' chunks."""

    layout_model: str
    line_model: str | None = None
    session: Callable[[str], Any] = onnx_session

    def __call__(self, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        pages = settled(images.decoded(pages)).where("width is not null")
        size = pages.select("page_id", "width", "height")
        boxes = kept_boxes(settled(raw_boxes(pages, self.layout_model, LAYOUT["confidence"], self.session)), **LAYOUT)
        placed = detect.labelled(detect.to_page(boxes, size))
        number = F.expr("cast(row_number() over (partition by page_id order by rank) - 1 as int)")
        # a region that was kept is certain: its score isn't shown
        regions = settled(placed.select("page_id", number.alias("region_idx"), "label", "x0", "y0", "x1", "y1", F.lit("").alias("text"), F.lit(1.0).alias("confidence")))
        return pages, regions, self.lines(pages, regions) if self.line_model else None

    def lines(self, pages: DataFrame, regions: DataFrame) -> DataFrame:
        windows = detect.chunks(detect.line_candidates(regions))
        at = regions.select("page_id", "region_idx", F.col("x0").alias("left"), F.col("y0").alias("above"))
        spots = windows.join(at, ["page_id", "region_idx"]).select(
            "page_id", "region_idx", "chunk_idx", F.col("left").alias("x0"), (F.col("above") + F.col("top")).alias("y0"), (F.col("left") + F.col("rw")).alias("x1"), (F.col("above") + F.col("bottom")).alias("y1")
        )
        parts = images.crops(spots, pages).select(F.struct("page_id", "region_idx", "chunk_idx").alias("page_id"), "content")
        boxes = kept_boxes(settled(raw_boxes(parts, self.line_model, LINE["confidence"], self.session)), **LINE)
        number = F.expr("cast(row_number() over (partition by page_id order by y0, rank) - 1 as int)")
        lines = boxes.withColumn("line_no", number).select("page_id.*", "line_no", F.col("y0").alias("ly0"), F.col("y1").alias("ly1"), "score")
        stitched = detect.stitch_lines(detect.project_lines(lines, windows), regions)
        return settled(detect.lines_to_page(stitched, regions).withColumn("text", F.lit("")).withColumn("confidence", F.lit(0.0)))


def yolo(model_dir: str | None = None, layout_model: str | None = None, line_model: str | None = None, skip_lines: bool = False) -> Yolo:
    importlib.import_module("onnxruntime")
    layout = str(find_model(FILES[0], layout_model, model_dir))
    return Yolo(layout, None if skip_lines else str(find_model(FILES[1], line_model, model_dir)))


@dataclass
class Boxes:
    """A detector that gives a page's boxes: ``factory`` makes it in a worker, ``detect(content)`` gives dicts of coordinate, label and score."""

    factory: Callable[[], Any]

    def __call__(self, pages: DataFrame) -> tuple[DataFrame, DataFrame, None]:
        pages = settled(images.decoded(pages)).where("width is not null")
        factory = self.factory

        def run(batches):
            model = factory()
            for b in batches:
                for page, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    found = model.detect(content)
                    spots = [[float(x) for x in f.get("coordinate", (0, 0, 0, 0))] for f in found]
                    yield pa.record_batch(
                        [pa.array([page] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([f.get("label") for f in found], pa.string()), *[pa.array([s[k] for s in spots], pa.float64()) for k in range(4)], pa.array([f.get("score") for f in found], pa.float64())],
                        ["page_id", "det_idx", "label", "x0", "y0", "x1", "y1", "score"],
                    )

        boxes = pages.select(F.col("page_id").cast("long"), "content").mapInArrow(run, "page_id long, det_idx int, label string, x0 double, y0 double, x1 double, y1 double, score double")
        held = detect.clamped(settled(boxes), pages.select("page_id", "width", "height"))
        number = F.expr("cast(row_number() over (partition by page_id order by det_idx) - 1 as int)")
        return pages, held.select("page_id", number.alias("region_idx"), "label", "x0", "y0", "x1", "y1", F.lit("").alias("text"), "confidence"), None


class _Paddlex:
    def __init__(self, model_name: str):
        os.environ["PADDLE_PDX_DISABLE_MODEL_SOURCE_CHECK"] = "True"
        self.model = importlib.import_module("paddlex").create_model(model_name)

    def detect(self, content: bytes) -> list[dict]:
        from .readers import as_file

        with as_file(content) as path:
            return [box for result in self.model.predict(path) for box in result.get("boxes", [])]


def paddlex(model_name: str = "PP-DocLayout_plus-L") -> Boxes:
    importlib.import_module("paddlex")
    return Boxes(lambda: _Paddlex(model_name))
