"""Recognition: which lines and regions go to which recogniser, and what becomes of low confidences.

A recogniser is an object with ``recognize(contents, boxes)``: an Arrow batch's worth of crops and boxes in, (text, confidence)
pairs out; one that reads whole regions has ``recognize_regions`` as well. It is made once in every Python worker, by its factory.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import repeats_itself, without_repetition


class Recognizer(Protocol):
    def recognize(self, contents: Iterable, boxes: Iterable[tuple[int, int, int, int]]) -> list[tuple[str, float]]: ...


class RegionRecognizer(Protocol):
    def recognize_regions(self, contents: Iterable, boxes: Iterable[tuple[int, int, int, int]]) -> list[tuple[str, float]]: ...


#: A worker's recognisers by plan; the oldest goes when there are more than KEPT.
_made: dict[str, Recognizer] = {}
KEPT = 4


def _made_for(key: str, factory: Callable[[], Recognizer]) -> Recognizer:
    if key not in _made:
        while len(_made) >= KEPT:
            _made.pop(next(iter(_made)))
        _made[key] = factory()
    return _made[key]


def _read(read: Callable, contents: list, boxes: list) -> list[tuple[str, float]]:
    """The batch's readings; where the batch fails, each item's own, and '' and 0 for those that fail by themselves."""
    try:
        found = [(t or "", float(c or 0.0)) for t, c in read(contents, boxes)]
        if len(found) == len(contents):
            return found
    except Exception:  # noqa: BLE001  an item that can't be read mustn't end the job
        pass
    return [("", 0.0)] if len(contents) == 1 else [_read(read, [x], [b])[0] for x, b in zip(contents, boxes)]


def recognized(rows: DataFrame, factory: Callable[[], Recognizer], content: str = "content", regions: bool = False) -> DataFrame:
    """The rows with text and confidence from the recogniser; an item with an error, or a recogniser that can't be made, leaves '' and 0."""
    keep = [c for c in rows.columns if c not in (content, "text", "confidence")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", text string, confidence double"
    key = uuid.uuid4().hex

    def run(batches):
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            try:
                made = _made_for(key, factory)
                read = made.recognize_regions if regions and hasattr(made, "recognize_regions") else made.recognize
                found = _read(read, cols[content].to_pylist(), list(zip(*(cols[c].to_pylist() for c in ("x0", "y0", "x1", "y1"))))) if b.num_rows else []
            except Exception:  # noqa: BLE001
                found = [("", 0.0)] * b.num_rows
            yield pa.record_batch([*[cols[c] for c in keep], pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.float64())], [*keep, "text", "confidence"])

    return rows.mapInArrow(run, schema)


def routes(regions: DataFrame, lines: DataFrame, mode: str = "line", by_region: bool = True) -> DataFrame:
    """page_id, region_idx, route: 'lines', 'region', or 'none' for a region without lines where the recogniser reads only lines."""
    modes = {"line", "region"}
    if mode not in modes:
        raise ValueError(f"no mode {mode!r}; there are {sorted(modes)}")
    if mode == "region":
        return regions.select("page_id", "region_idx", F.lit("region").alias("route"))
    n = lines.groupBy("page_id", "region_idx").count()
    route = F.when(F.col("count") > 0, "lines").otherwise("region" if by_region else "none")
    return regions.join(n, ["page_id", "region_idx"], "left").select("page_id", "region_idx", route.alias("route"))


def texts_of_lines(lines: DataFrame) -> DataFrame:
    """page_id, region_idx, text: the line texts that aren't empty, joined by spaces."""
    joined = F.expr("listagg(nullif(text, ''), ' ') within group (order by line_idx)")
    return lines.groupBy("page_id", "region_idx").agg(F.coalesce(joined, F.lit("")).alias("text"))


def doubtful(lines: DataFrame, threshold: float = 70.0) -> DataFrame:
    """Lines whose confidence, in percent, is below the threshold."""
    return lines.where(F.col("confidence") * 100 < threshold)


def with_fallback(lines: DataFrame, fallback: Callable[[DataFrame], DataFrame], threshold: float = 70.0, whole: bool = False) -> DataFrame:
    """Doubtful lines read anew by ``fallback``; one that reads whole regions gives confidence 1."""
    again = fallback(doubtful(lines, threshold))
    if whole:
        again = again.withColumn("confidence", F.lit(1.0))
    sure = lines.where(~(F.col("confidence") * 100 < threshold))
    return sure.unionByName(again.select(*lines.columns))


def tidy(rows: DataFrame) -> DataFrame:
    """Texts that repeat themselves cut to what they repeat."""
    return rows.withColumn("text", F.when(repeats_itself(F.col("text")), without_repetition(F.col("text"))).otherwise(F.col("text")))
