"""Output: pages (page_id, width, height), regions and lines as text, JSON or hOCR, one row a page."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box
from ..functions.text import html_escape


def page_texts(regions: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """page_id, text: the region texts that aren't empty, with a blank line between; pages without any have ''."""
    texts = regions.where("text <> ''").groupBy("page_id").agg(F.expr("listagg(text, '\\n\\n') within group (order by region_idx)").alias("text"))
    if pages is None:
        return texts
    return pages.select("page_id").join(texts, "page_id", "left").select("page_id", F.coalesce("text", F.lit("")).alias("text"))


def nested_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """The regions with ``lines``, an array of (line_idx, text, confidence, x0, y0, x1, y1); empty without lines."""
    item = F.struct("line_idx", F.coalesce("text", F.lit("")).alias("text"), "confidence", *box())
    held = lines.groupBy("page_id", "region_idx").agg(F.array_sort(F.collect_list(item)).alias("lines"))
    out = regions.join(held, ["page_id", "region_idx"], "left")
    return out.withColumn("lines", F.coalesce("lines", F.array().cast(held.schema["lines"].dataType)))


def nested_pages(pages: DataFrame, regions: DataFrame, lines: DataFrame) -> DataFrame:
    """The pages with ``regions``, an array of (region_idx, label, x0, y0, x1, y1, text, confidence, lines)."""
    item = F.struct("region_idx", "label", *box(), F.coalesce("text", F.lit("")).alias("text"), "confidence", "lines")
    held = nested_lines(regions, lines).groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("regions"))
    out = pages.join(held, "page_id", "left")
    return out.withColumn("regions", F.coalesce("regions", F.array().cast(held.schema["regions"].dataType)))


def flat_regions(nested: DataFrame) -> DataFrame:
    return nested.select("page_id", F.explode("regions").alias("r")).select("page_id", "r.region_idx", "r.label", "r.x0", "r.y0", "r.x1", "r.y1", "r.text", "r.confidence")


def flat_lines(nested: DataFrame) -> DataFrame:
    rows = nested.select("page_id", F.explode("regions").alias("r")).select("page_id", "r.region_idx", F.explode("r.lines").alias("l"))
    return rows.select("page_id", "region_idx", "l.*")


_BOX = "named_struct('x0', {v}.x0, 'y0', {v}.y0, 'x1', {v}.x1, 'y1', {v}.y1)"
_LINE = f"named_struct('text', l.text, 'confidence', l.confidence, 'bbox', {_BOX.format(v='l')})"
_REGION = f"named_struct('label', r.label, 'bbox', {_BOX.format(v='r')}, 'text', r.text, 'confidence', r.confidence, 'lines', transform(r.lines, l -> {_LINE}))"


def as_json(nested: DataFrame, indent: int | None = 2) -> DataFrame:
    """page_id, json. Compact and within the JVM without ``indent``; with it, laid out and all beyond ASCII escaped, as Python's json does by default."""
    out = nested.select("page_id", F.expr(f"to_json(named_struct('width', width, 'height', height, 'regions', transform(regions, r -> {_REGION})))").alias("json"))
    if indent is None:
        return out

    @F.arrow_udf("string")
    def laid_out(text: pa.Array) -> pa.Array:
        return pa.array([json.dumps(json.loads(x), indent=indent) for x in text.to_pylist()], pa.string())

    return out.withColumn("json", laid_out("json"))


#: Declaration, document type, and what opens the body: fixed by the format.
HOCR_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">',
    '<html xmlns="http://www.w3.org/1999/xhtml">',
    "<head><title>OCR Output</title></head>",
    "<body>",
)


def _opening(indent: int, tag: str, kind: str, ident: Column | None, bbox: Column) -> Column:
    """An indented start tag of an ocr_ class, with an id unless it is None, and the box as title."""
    name = [] if ident is None else [F.lit('id="'), ident, F.lit('" ')]
    return F.concat(F.lit(f'{" " * indent}<{tag} class="ocr_{kind}" '), *name, F.lit('title="'), bbox, F.lit('">'))


def as_hocr(pages: DataFrame, regions: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, hocr: a page, its regions as areas, their lines (empty ones too) with escaped text; labels and region texts aren't shown."""
    bbox = F.concat_ws(" ", F.lit("bbox"), *box())
    ident = F.concat_ws("_", F.lit("line"), "region_idx", "line_idx")
    span = F.concat(_opening(6, "span", "line", ident, bbox), html_escape(F.coalesce("text", F.lit(""))), F.lit("</span>"))
    spans = lines.select("page_id", "region_idx", "line_idx", span.alias("span")).groupBy("page_id", "region_idx").agg(F.expr("listagg(span, '\\n') within group (order by line_idx)").alias("spans"))
    area = F.concat_ws("\n", _opening(4, "div", "carea", F.concat_ws("_", F.lit("block"), "region_idx"), bbox), "spans", F.lit(" " * 4 + "</div>"))
    areas = regions.join(spans, ["page_id", "region_idx"], "left").select("page_id", "region_idx", area.alias("area"))
    body = areas.groupBy("page_id").agg(F.expr("listagg(area, '\\n') within group (order by region_idx)").alias("body"))
    page = _opening(2, "div", "page", None, F.concat_ws(" ", F.lit("bbox 0 0"), "width", "height"))
    closing = [F.lit(x) for x in ("  </div>", "</body>", "</html>")]
    return pages.join(body, "page_id", "left").select("page_id", F.concat_ws("\n", *[F.lit(x) for x in HOCR_HEAD], page, "body", *closing).alias("hocr"))
