"""Command line: ``python -m pagelake.plans.cli IMAGES... --detector NAME --recognizer NAME``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import files
from ..sources.dictionary import read_dictionary
from .pipeline import Pipeline
from .registry import detectors, formatters, recognizers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("pagelake", description="Text from page images.")
    p.add_argument("images", nargs="+")
    p.add_argument("-d", "--detector", default="as_yolo", choices=detectors.list())
    p.add_argument("-b", "--backend", "--recognizer", dest="recognizer", default="tesseract", choices=recognizers.list())
    p.add_argument("-o", "--output", default="text", choices=formatters.list())
    p.add_argument("-m", "--model", help="model of the recogniser: a name, a file or a folder")
    p.add_argument("--model-dir", help="folder of the detector's models")
    p.add_argument("--mode", default="region", choices=("line", "region"))
    p.add_argument("--device")
    p.add_argument("--outdir")
    p.add_argument("--no-layout-processing", action="store_true", help="leave regions as they were detected")
    p.add_argument("--no-text-cleaning", "--no-clean", action="store_true", help="leave line breaks and hyphens")
    p.add_argument("--spell-check", action="store_true", help="correct spelling, by the dictionary")
    p.add_argument("--dictionary", help="file of terms and counts")
    p.add_argument("--max-edit-distance", type=int, default=2)
    p.add_argument("--fallback", choices=recognizers.list())
    p.add_argument("--fallback-threshold", type=float, default=70.0)
    p.add_argument("--skip-lines", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if missing := [x for x in a.images if not Path(x).exists()]:
        print("no such file: " + ", ".join(missing), file=sys.stderr)
        return 2
    if a.spell_check and not a.dictionary:
        print("--spell-check needs --dictionary", file=sys.stderr)
        return 2
    options = dict(recognizer_model=a.model, recognizer_mode=a.mode, model_cache_dir=a.model_dir, device=a.device, fallback=a.fallback, fallback_threshold=a.fallback_threshold)
    plan = Pipeline(a.detector, a.recognizer, a.output, layout_processing=not a.no_layout_processing, text_cleaning=not a.no_text_cleaning, spell_check=a.spell_check, skip_lines=a.skip_lines, max_edit_distance=a.max_edit_distance, **options)
    spark = SparkSession.builder.appName("pagelake").getOrCreate()
    plan.dictionary = read_dictionary(spark, a.dictionary) if a.dictionary else None
    pages = files.read_images(spark, a.images).withColumnRenamed("ord", "page_id")
    done = plan.run(pages).join(pages.select("page_id", "path"), "page_id")
    if a.outdir:
        files.write_pages(done, a.outdir, a.output)
    else:
        for row in done.orderBy("page_id").toLocalIterator():
            print(row.result)
    return 0


if __name__ == "__main__":
    sys.exit(main())
