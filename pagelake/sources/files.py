"""Image files in, text files out, and where models are looked for."""

from __future__ import annotations

import os
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..readers import Service

#: Endings of file names, by output.
SUFFIX = dict(hocr="hocr", json="json", text="txt")


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """ord (the place in ``paths``), path, content; files that aren't there raise when the scan is planned."""
    order = spark.createDataFrame([(k, qualified(spark, p)) for k, p in enumerate(paths)], "ord int, path string")
    files = spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "content")
    return files.join(order, "path").select("ord", "path", "content")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as the file source names it: with its file system, and absolute."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return at.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()


def image_rows(spark: SparkSession, images: list[bytes]) -> DataFrame:
    """Images already in memory: ord, path (null), content."""
    return spark.createDataFrame([(k, None, bytearray(x)) for k, x in enumerate(images)], "ord int, path string, content binary")


def output_name(path: str, output: str) -> str:
    return PurePosixPath(path).stem + "." + SUFFIX.get(output, SUFFIX["text"])


def write_pages(pages: DataFrame, folder: str, output: str, column: str = "result") -> int:
    """One file for every row, named after its path; existing ones are overwritten. How many were written."""

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        system.create_dir(base)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_output_stream(f"{base}/{output_name(path, output)}") as out:
                    out.write((text or "").encode())
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return pages.select("path", column).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def find_model(name: str, explicit: str | None = None, model_dir: str | None = None, cache: str = "~/.cache/pagelake/models") -> Path:
    """The model file: the explicit path, else in ``model_dir``, else in the cache."""
    places = [Path(explicit)] if explicit else [Path(p).expanduser() / name for p in (model_dir, cache) if p]
    for p in places:
        if p.exists():
            return p
    raise FileNotFoundError(f"{name} is in none of: " + ", ".join(map(str, places)))


ModelService = Service
