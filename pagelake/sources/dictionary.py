"""Frequency dictionaries: from a file of terms and counts, or from a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_dictionary(spark: SparkSession, path: str, term: int = 0, count: int = 1) -> DataFrame:
    """term, count from lines of white-space separated fields; lines without a whole count are passed over, of equal terms the counts add up."""
    fields = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    rows = fields.select(F.get("f", F.lit(term)).alias("term"), F.expr(f"try_cast(get(f, {count}) as bigint)").alias("count"))
    return rows.where("term <> '' and count is not null").groupBy("term").agg(F.sum("count").alias("count"))


def corpus_dictionary(docs: DataFrame, least: int = 5, text: str = "text") -> DataFrame:
    """The corpus's words of small ASCII letters that occur ``least`` times, with their counts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("count")).where(F.col("count") >= least)
