"""Paragraphs from text lines (page_id, region_idx, line_idx, x0, y0, x1, y1, text): windows over a region's lines, no Python.

What stands before a line is nothing (a word goes on), a space (a sentence goes on) or a blank line (a new paragraph).
Blank lines leave no text but still count as geometric neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import joins_hyphen, starts_digit, starts_lower, starts_upper, stripped

#: What ends a sentence.
ENDS = (".", "!", "?", ":", ";")


def region():
    return W.partitionBy("page_id", "region_idx")


def order():
    return region().orderBy("line_idx")


def median_heights(lines: DataFrame) -> DataFrame:
    """Each region's median line height, 0 without a line of any height."""
    return lines.groupBy("page_id", "region_idx").agg(F.coalesce(F.expr("double(median(case when y1 > y0 then y1 - y0 end))"), F.lit(0.0)).alias("median_height"))


def glue(lines: DataFrame) -> DataFrame:
    """The lines with t (trimmed text), geometric break, dehyphenation, continuation, and glue: what joins a line to the text before it."""
    out = lines.withColumn("t", stripped(F.coalesce("text", F.lit(""))))
    out = out.withColumn("mh", F.coalesce(F.expr("double(median(case when y1 > y0 then y1 - y0 end) over (partition by page_id, region_idx))"), F.lit(0.0)))
    out = out.withColumn("pw", F.max("x1").over(region()))
    out = out.withColumn("pt", F.last(F.nullif("t", F.lit("")), ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, -1)))
    gap, shift = F.col("y0") - F.lag("y1").over(order()), F.col("x0") - F.lag("x0").over(order())
    ended = F.right(F.lag("t").over(order()), F.lit(1)).isin(*ENDS) & starts_upper(F.col("t"))
    short = (F.lag("x1").over(order()) - F.lag("x0").over(order())) < F.lit(0.85) * F.col("pw")
    broken = ((F.col("mh") > 0) & (gap > F.lit(1.5) * F.col("mh"))) | ((F.col("pw") > 0) & (F.abs(shift) > F.lit(0.15) * F.col("pw"))) | ((F.col("mh") > 0) & (shift > F.col("mh")))
    broken = F.coalesce(broken, F.lit(False)) | ((F.col("pw") > 0) & ended & short)
    out = out.withColumn("broken", F.coalesce(broken, F.lit(False)))
    out = out.withColumn("dehyphenated", F.coalesce(joins_hyphen(F.col("pt"), F.col("t")), F.lit(False)))
    goes_on = ~F.right("pt", F.lit(1)).isin(*ENDS) & (starts_lower(F.col("t")) | starts_digit(F.col("t")))
    out = out.withColumn("continued", F.coalesce(goes_on, F.lit(False)))
    joint = F.when(F.col("pt").isNull(), "").when(F.col("dehyphenated"), "").when(F.col("continued") & ~F.col("broken"), " ").otherwise("\n\n")
    return out.withColumn("glue", F.when(F.col("t") != "", joint))


def pieces(lines: DataFrame) -> DataFrame:
    """Every line that isn't blank with its glue and its text, less the hyphen that the next line takes away."""
    out = glue(lines)
    next_joins = F.first(F.when(F.col("t") != "", F.col("dehyphenated")), ignorenulls=True).over(order().rowsBetween(1, W.unboundedFollowing))
    piece = F.when(next_joins, F.left("t", F.length("t") - 1)).otherwise(F.col("t"))
    return out.withColumn("piece", piece).where("t <> ''").select("page_id", "region_idx", "line_idx", "glue", "piece")


def clean(lines: DataFrame) -> DataFrame:
    """page_id, region_idx, text of every region with a line that isn't blank."""
    return pieces(lines).groupBy("page_id", "region_idx").agg(F.expr("listagg(concat(glue, piece), '') within group (order by line_idx)").alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """page_id, region_idx, para_idx, text."""
    opened = pieces(lines).withColumn("para_idx", F.sum((F.col("glue") == "\n\n").cast("int")).over(order()).cast("int"))
    joined = F.expr("listagg(concat(if(glue = '\\n\\n', '', glue), piece), '') within group (order by line_idx)").alias("text")
    return opened.groupBy("page_id", "region_idx", "para_idx").agg(joined)
