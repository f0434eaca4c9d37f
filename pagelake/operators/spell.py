"""Spelling: tokens of region texts against a dictionary (term, count), by symmetric deletion.

Distinct unknown words are looked up once, however often they occur: words and terms meet in an equi-join
on what is left of them with up to ``distance`` characters deleted, and only such pairs are measured, by
optimal string alignment (transpositions count once).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import like_original

#: What isn't an ASCII letter or digit, from the start on and up to the end.
LEADING, TRAILING = r"^\P{Alnum}*", r"\P{Alnum}*\z"


def tokens(regions: DataFrame) -> DataFrame:
    """The texts cut at single spaces; what lies between two spaces is an empty token."""
    return regions.where("text <> ''").select("page_id", "region_idx", F.posexplode(F.split("text", " ")).alias("token_idx", "token"))


def affixes(toks: DataFrame) -> DataFrame:
    """Tokens with what leads and trails the word."""
    out = toks.withColumn("lead", F.regexp_extract("token", LEADING, 0))
    rest = F.substr("token", F.length("lead") + 1)
    trail = F.regexp_extract(rest, TRAILING, 0)
    return out.withColumn("word", F.left(rest, F.length(rest) - F.length(trail))).withColumn("trail", trail)


def eligible(toks: DataFrame) -> DataFrame:
    """Whether the word is looked up: three characters at least, no number, no capital inside."""
    return toks.withColumn("eligible", (F.length("word") > 2) & ~F.col("word").rlike(r"^\p{Nd}+$") & ~F.col("word").rlike("[a-z][A-Z]"))


def unknown(toks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The distinct eligible words, in small letters, that the dictionary lacks."""
    words = toks.where("eligible").select(F.lower("word").alias("word")).distinct()
    return words.join(dictionary.select(F.col("term").alias("word")), "word", "left_anti")


def deletions(words: DataFrame, column: str, distance: int) -> DataFrame:
    """Every word with itself and with up to ``distance`` of its characters deleted."""
    out = words.withColumn("rest", F.col(column))
    shorter = "transform(sequence(1, length(rest)), i -> concat(left(rest, i - 1), substring(rest, i + 1)))"
    for _ in range(distance):
        out = out.withColumn("rest", F.explode(F.expr(f"array_union(array(rest), if(length(rest) > 0, {shorter}, array()))"))).distinct()
    return out


def _distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Optimal string alignment distances, up to ``most``, of pairs whose lengths differ by at most that: bands of the table, all pairs at once."""
    n, m = (np.array([len(x) for x in s]) for s in (a, b))
    height = int(n.max(initial=0))
    codes = [np.full((len(a), height + most + 2), -1 - k, np.int32) for k in range(2)]
    for s, code in zip((a, b), codes):
        for r, x in enumerate(s):
            code[r, : len(x)] = np.frombuffer(x.encode("utf-32-le"), np.int32)
    one, two = codes
    width, far = 2 * most + 1, most + 1
    # row i of the table on the diagonals from -most to most: column k is place i + k - most of b
    last = np.where(np.arange(width) >= most, np.arange(width) - most, far) + np.zeros((len(a), 1), np.int32)
    before, found = np.full_like(last, far), np.full(len(a), far)
    done = n == 0
    found[done] = last[done, (m + most)[done]]
    for i in range(1, height + 1):
        row = np.full_like(last, far)
        for k in range(max(0, most - i), width):
            j = i + k - most
            if j == 0:
                row[:, k] = i
                continue
            d = last[:, k] + (one[:, i - 1] != two[:, j - 1])
            if k + 1 < width:
                d = np.minimum(d, last[:, k + 1] + 1)
            if k:
                d = np.minimum(d, row[:, k - 1] + 1)
            if i > 1 and j > 1:
                swap = (one[:, i - 1] == two[:, j - 2]) & (one[:, i - 2] == two[:, j - 1])
                d = np.where(swap, np.minimum(d, before[:, k] + 1), d)
            row[:, k] = d
        before, last = last, row
        done = n == i
        found[done] = row[done, (m - i + most)[done]]
    return found


def _osa(a: str, b: str, most: int) -> int:
    return most + 1 if abs(len(a) - len(b)) > most else int(_distances([a], [b], most)[0])


def nearest(words: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """word, term, distance: the closest term within ``distance``, of several the most frequent, of these the first by name.

    Edits are counted by the built-in Levenshtein distance; only pairs that swapped neighbours could bring within reach are aligned in Python.
    A swap spares one edit. So 2 edits are fewer, and the most are few enough, only where all are swaps: then both have the same characters.
    """

    @F.arrow_udf("int")
    def swapped(a: pa.Array, b: pa.Array) -> pa.Array:
        some = np.flatnonzero(np.asarray(a.is_valid()))
        out, pick = np.full(len(a), distance + 1), pa.array(some)
        left, right = a.take(pick).to_pylist(), b.take(pick).to_pylist()
        order = np.argsort([len(x) for x in left], kind="stable") if len(some) else some
        for k in range(0, len(order), 2048):
            which = order[k : k + 2048]
            out[some[which]] = _distances([left[j] for j in which], [right[j] for j in which], distance)
        return pa.array(out, pa.int32())

    swapped = swapped.asNondeterministic()  # else the last filter takes it below distinct, and pairs are aligned again and again
    # by hash: equal hashes of different rests are only more pairs to measure
    hashed = F.xxhash64("rest").alias("rest")
    left = deletions(words.select("word"), "word", distance).select("word", hashed)
    right = deletions(dictionary.select("term", "count"), "term", distance).select("term", "count", hashed)
    # hundreds of rows a word, which Spark takes for as small as the words' files: without the hint the driver would gather them for a broadcast
    pairs = left.hint("merge").join(right, "rest").where(F.abs(F.length("word") - F.length("term")) <= distance).select("word", "term", "count").distinct()
    edits = F.levenshtein("word", "term", 2 * distance)
    same = F.array_sort(F.split("word", "")) == F.array_sort(F.split("term", ""))
    open_ = F.when(F.col("edits").isin(2, max(2, 2 * distance)), same).otherwise(F.col("edits").between(3, 2 * distance))
    near = pairs.withColumn("edits", edits).withColumn("open", open_).where((F.col("edits").between(0, distance)) | F.col("open"))
    near = near.withColumn("swaps", swapped(F.when(F.col("open"), F.col("word")), F.when(F.col("open"), F.col("term"))))
    near = near.withColumn("distance", F.when(F.col("open"), F.col("swaps")).otherwise(F.col("edits"))).where(F.col("distance").between(0, distance))
    rank = F.row_number().over(W.partitionBy("word").orderBy("distance", F.desc("count"), "term"))
    return near.withColumn("rank", rank).where("rank = 1").select("word", "term", "distance")


def corrected(regions: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """All tokens with ``corrected``, which is the token where there is nothing to correct."""
    toks = eligible(affixes(tokens(regions)))
    found = nearest(unknown(toks, dictionary), dictionary, distance).select(F.col("word").alias("__word"), "term")
    joined = toks.join(found, F.col("eligible") & (F.lower("word") == F.col("__word")), "left")
    new = F.concat("lead", like_original(F.col("word"), F.col("term")), "trail")
    return joined.withColumn("corrected", F.coalesce(new, F.col("token"))).select("page_id", "region_idx", "token_idx", "token", "corrected")


def corrections(regions: DataFrame, dictionary: DataFrame, distance: int = 2) -> DataFrame:
    """The log: every token that was changed."""
    return corrected(regions, dictionary, distance).where("token <> corrected").select("page_id", "region_idx", "token_idx", F.col("token").alias("original"), "corrected")


def check(regions: DataFrame, dictionary: DataFrame, distance: int = 2, enabled: bool = True) -> DataFrame:
    """The regions with corrected texts."""
    if not enabled:
        return regions
    texts = corrected(regions, dictionary, distance).groupBy("page_id", "region_idx").agg(F.expr("listagg(corrected, ' ') within group (order by token_idx)").alias("__text"))
    out = regions.join(texts, ["page_id", "region_idx"], "left")
    return out.select(*[F.coalesce("__text", "text").alias(c) if c == "text" else F.col(c) for c in regions.columns])
