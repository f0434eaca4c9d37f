"""Box arithmetic. Areas are BIGINT; a box with its right edge left of its left edge has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))  # type: ignore[return-value]


def side(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), high - low).cast("bigint")


def area(b: Box) -> Column:
    return side(b[0], b[2]) * side(b[1], b[3])


def intersection(a: Box, b: Box) -> Column:
    return side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))


def corners(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """A box given by centre and size."""
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


#: SQL of the overlap over union of two structs of doubles with x0, y0, x1, y1, for use inside lambdas.
IOU = (
    "(greatest(0D, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0D, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
    " / nullif(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0)"
    " - (greatest(0D, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0D, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))), 0D)"
)
