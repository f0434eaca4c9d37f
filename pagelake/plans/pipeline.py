"""From images, or detected regions and lines, to one result a page."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import clean, formats, layout, recognize, spell
from ..readers import Reader
from ..sources import images
from ..sources.shared import settled
from .registry import detectors, formatters, recognizers

formatters.register("text", lambda pages, regions, lines: formats.page_texts(regions, pages).withColumnRenamed("text", "result"))
formatters.register("json", lambda pages, regions, lines: formats.as_json(formats.nested_pages(pages, regions, lines)).withColumnRenamed("json", "result"))
formatters.register("hocr", lambda pages, regions, lines: formats.as_hocr(pages, regions, lines).withColumnRenamed("hocr", "result"))


@dataclass
class Pipeline:
    """Detection, layout, recognition, fallback, cleaning, spelling and output; any stage can be left out.

    ``detector``: pages (with content) -> (pages, regions, lines) or (regions, lines); without one, ``run`` takes regions and lines.
    ``recognizer`` and ``fallback``: a ``Reader``, or a function lines -> lines with text and confidence. All of them may be names in their registries;
    ``recognizer_model``, ``recognizer_mode`` ('line' or 'region'), ``device`` and ``model_cache_dir`` go to those components that take them.

    A reader in region mode, or one that reads nothing but regions, reads each region; otherwise lines are read, and regions without lines where the
    reader can read regions, too. Fallback and cleaning follow readings of lines only; regions without lines keep their texts.
    """

    detector: Callable | str | None = None
    recognizer: Reader | Callable | str | None = None
    output: str | Callable = "text"
    recognizer_model: str | None = None
    model_cache_dir: str | None = None
    layout_processing: bool = True
    text_cleaning: bool = True
    spell_check: bool | None = None
    device: str | None = None
    fallback: Reader | Callable | str | None = None
    fallback_threshold: float = 70.0
    fallback_reads_regions: bool = False
    skip_lines: bool = False
    recognizer_mode: str | None = None
    dictionary: DataFrame | None = None
    max_edit_distance: int = 2
    keep_empty: bool = False

    def __post_init__(self):
        if isinstance(self.detector, str):
            self.detector = detectors.get(self.detector)(model_dir=self.model_cache_dir, skip_lines=self.skip_lines)
        if isinstance(self.recognizer, str):
            self.recognizer = recognizers.get(self.recognizer)(self.recognizer_model, mode=self.recognizer_mode, device=self.device, model_cache_dir=self.model_cache_dir)
        if isinstance(self.fallback, str):
            self.fallback = recognizers.get(self.fallback)(device=self.device)
        if isinstance(self.output, str):
            self.output = formatters.get(self.output)

    def run(self, pages: DataFrame, regions: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """page_id, result."""
        if self.spell_check and self.dictionary is None:
            raise ValueError("spelling needs a dictionary")
        if self.detector is not None:
            found = self.detector(pages)
            pages, regions, lines = found if len(found) == 3 else (pages, *found)
        if regions is None:
            raise ValueError("there is no detector, so regions must be given")
        given = lines if not self.skip_lines else None
        lines = given if given is not None else regions.select("page_id", "region_idx", F.lit(0).alias("line_idx"), "x0", "y0", "x1", "y1", F.lit("").alias("text"), F.lit(0.0).alias("confidence")).limit(0)
        if self.layout_processing:
            moved = layout.process(regions, pages, given, keep_empty=self.keep_empty)
            lines = moved_lines(moved, lines)
            regions = moved.drop("sources")
        pages, regions, lines = self.read(pages, regions, lines)
        if self.text_cleaning and not (isinstance(self.recognizer, Reader) and not self.recognizer.lines):
            regions = with_texts(regions, clean.clean(lines))
        if self.dictionary is not None and self.spell_check is not False:
            regions = spell.check(regions, self.dictionary, self.max_edit_distance)
        return self.output(pages.select("page_id", "width", "height"), regions, lines)

    def read(self, pages: DataFrame, regions: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Recognition and fallback. What a reader has read is kept, so that nothing is read twice."""
        reader, by_line = self.recognizer, True
        if isinstance(reader, Reader):
            by_line = reader.lines and reader.mode == "line"
            way = recognize.routes(regions, lines, "line" if by_line else "region", reader.regions)
            whole = regions.join(way.where("route = 'region'"), ["page_id", "region_idx"], "left_semi")
            if not by_line or reader.regions:
                read = settled(read_by(reader, whole, pages, True))
                regions = with_texts(regions, read, ("text", "confidence"))
            if by_line:
                lines = settled(read_by(reader, lines, pages))
        elif reader is not None:
            lines = reader(lines)
        if self.fallback is not None and by_line:
            again, whole = self.fallback, self.fallback_reads_regions
            if isinstance(again, Reader):
                again, whole = (lambda rows: read_by(self.fallback, rows, pages, not self.fallback.lines)), not self.fallback.lines
            lines = recognize.with_fallback(lines, again, self.fallback_threshold, whole)
            if isinstance(self.fallback, Reader):
                lines = settled(lines)
        if by_line and (reader is not None or self.fallback is not None):
            regions = with_texts(regions, recognize.texts_of_lines(lines))
        return pages, regions, lines


def read_by(reader: Reader, rows: DataFrame, pages: DataFrame, regions: bool = False) -> DataFrame:
    """The rows read by the reader from their parts of the pages' images."""
    cut = images.crops(rows, pages) if "content" in pages.columns else rows.withColumn("content", F.lit(None).cast("binary"))
    return recognize.recognized(cut, reader.factory, regions=regions).select(*rows.columns)


def with_texts(regions: DataFrame, texts: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """The regions with the texts (and other columns) given; those without one keep theirs."""
    new = texts.select("page_id", "region_idx", *[F.col(c).alias(f"__{c}") for c in columns])
    out = regions.join(new, ["page_id", "region_idx"], "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in regions.columns])


def moved_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines under the regions that took in theirs (``sources``), numbered on in the order of these."""
    to = regions.select("page_id", F.col("region_idx").alias("__to"), F.posexplode("sources").alias("__nth", "region_idx"))
    both = lines.join(to, ["page_id", "region_idx"])
    number = F.row_number().over(W.partitionBy("page_id", "__to").orderBy("__nth", "line_idx")) - 1
    both = both.withColumn("line_idx", number.cast("int")).withColumn("region_idx", F.col("__to"))
    return both.select(*lines.columns)
