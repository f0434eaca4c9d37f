"""Line dedup by winnowing: runs of lines that occurred earlier are deleted.

Lines are trimmed of ASCII white space; blank ones are passed over. A window is the least number of consecutive
lines that hold ``WORDS`` words: one line of as many, or a few short ones. Of each window the least line hash is
selected as a fingerprint, so any two equal runs of lines with WORDS words, single lines too, share one. Positions are
joined by fingerprint and by the window that it was selected from, both at once: a frequent short line between ever
different ones is the fingerprint of many windows, which so don't meet in one task. A match's extension
in both directions is the union of the matching windows. A line is deleted where it lies in a window whose first
occurrence, by doc_id and position, is another. One document's own repeats count. All earlier occurrences are
partners; groups are handled by their first occurrence, never by pairs. Short lines of fewer words stay
unless they lie in such a run; with one word for WORDS every repeated line goes.

A task sends only the first occurrence of each window among its rows (FLUSH windows at a time) to be compared: later
ones of its own are known to be repeats. A line that a third of all documents hold thus sends a row for each task.

Defined results: null ids and null or empty texts stay as they are; doc_id is a whole number (or a string of one); rows
of equal doc_id and text are one document and keep all or lose all the same lines; of equal windows the first by doc_id, the
text's hash and position stays; blank lines stay; a text of fewer than WORDS words loses nothing; very long texts are read whole,
their windows are rows like any other's; extra columns pass through whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WORDS, FLUSH = 5, 1 << 20
BLANK = " \t\r\v\f"


def line_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and numbers of words of the lines that aren't blank, and each row's first among them."""
    start, end, first = C.words(data, off)
    breaks = np.flatnonzero(data == 10)
    # the line that a word is in: newlines before it and borders of rows before it
    line = np.searchsorted(breaks, start) + np.repeat(np.arange(len(off) - 1), np.diff(first))
    if not len(line):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    opens = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    edges = np.append(opens, len(line))
    return C.hash_ranges(data, start[opens], end[edges[1:] - 1]), np.diff(edges), np.searchsorted(opens, first)


def fingerprints(hashes: np.ndarray, words: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of ``least`` words: its row, first line, number of lines, hash, and the line selected as its fingerprint."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least)
    at = np.flatnonzero(end <= first[1:][row])
    size = end[at] - at
    if not len(at):
        return at, at, at, np.zeros(0, np.uint64), at
    chosen = at.copy()
    for k in range(1, int(size.max())):
        more = np.flatnonzero(size > k)
        lower = more[hashes[at[more] + k] < hashes[chosen[more]]]
        chosen[lower] = at[lower] + k
    return row[at], at, size, C.range_hash(C.prefix_hash(hashes), at, at + size), chosen


def _select(least):
    names = ["fp", "run", "doc_id", "text_hash", "at", "later"]

    def firsts(parts):
        """Each window's first place; of the other places only that they come later, as rows that meet no other."""
        fp, run, doc, text, at = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((at, text, doc, run))
        fp, run, doc, text, at = (x[order] for x in (fp, run, doc, text, at))
        new = np.ones(len(run), bool)
        new[1:] = run[1:] != run[:-1]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[head]) | (text != text[head]) | (at != at[head])
        keep = new | later
        lone = C.mix(C.mix(text.view(np.uint64)) + at.view(np.uint64) * C.MIX1).view(np.int64)
        return pa.record_batch([pa.array(x[keep]) for x in (np.where(later, lone, fp), run, doc, text, at, later)], names)

    def select(batches):
        parts, n = [], 0
        for b in C.sub_batches(batches):
            hashes, words, first = line_hashes(*C.text_bytes(C.column(b, "text")))
            row, at, size, run, chosen = fingerprints(hashes, words, first, least)
            if len(at):
                ids, text = (C.column(b, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
                parts.append((hashes[chosen].view(np.int64), run.view(np.int64), ids[row], text[row], (at - first[row]) << 8 | size))
                n += len(at)
            if n >= FLUSH:
                yield firsts(parts)
                parts, n = [], 0
        if n:
            yield firsts(parts)

    return select


def later_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """doc_id, text_hash and spans (first non-blank line << 8 | number of lines) of the windows that occurred earlier."""
    if not 0 < least < 256:
        raise ValueError("a window is of 1 to 255 words")
    keyed = C.texts(docs.where("doc_id is not null and text <> ''")).withColumn("text_hash", F.xxhash64("text"))
    chosen = keyed.mapInArrow(C.tidy(_select(least)), "fp long, run long, doc_id long, text_hash long, at long, later boolean")
    place = F.struct("doc_id", "text_hash", "at")
    later = chosen.withColumn("first", F.min(place).over(W.partitionBy("fp", "run"))).where(F.col("later") | (F.col("first") != place))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("spans"))


def delete_lines(text: str, spans: list[int]) -> str:
    out, k, gone = [], 0, {(s >> 8) + j for s in spans for j in range(s & 255)}
    for line in text.split("\n"):
        if line.strip(BLANK):
            if k not in gone:
                out.append(line)
            k += 1
        else:
            out.append(line)
    return "\n".join(out)


def _cut(docs: DataFrame, least: int) -> tuple[DataFrame, str]:
    """Every document, its repeated runs deleted, and the name of a column with the number of lines lost."""
    key, own, mark, spans, cut_, lost = (C.unused(docs, x) for x in ("key", "id", "mark", "spans", "cut", "lost"))
    gone = later_runs(docs, least).select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark), F.col("spans").alias(spans))

    @F.arrow_udf("struct<text string, removed int>")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text, spans):
            if s.is_valid:
                old = t.as_py()
                new = delete_lines(old, s.as_py())
                out.append({"text": new, "removed": full_lines(old) - full_lines(new)})
            else:
                out.append(None)
        C.release()
        return pa.array(out, pa.struct([("text", pa.string()), ("removed", pa.int32())]))

    keyed = docs.withColumn(key, F.xxhash64("text"))
    both = keyed.join(gone.hint("shuffle_hash"), (F.col(own) == F.col("doc_id").cast("long")) & (F.col(mark) == F.col(key)), "left")
    both = both.withColumn(cut_, cut(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans)))
    kept = [F.coalesce(f"{cut_}.text", "text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*kept, F.coalesce(f"{cut_}.removed", F.lit(0)).alias(lost)), lost


def dedup_lines(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """Every document, its repeated runs deleted, with ``removed_lines`` (in place of a column of that name); all other columns as they were."""
    out, lost = _cut(docs, least)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "removed_lines"], F.col(lost).alias("removed_lines"))


def full_lines(text: str) -> int:
    return sum(bool(x.strip(BLANK)) for x in text.split("\n"))


def filter_lines(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """The documents without their repeated runs; one that has lost its every line goes. The columns stay; n_chars follows the text."""
    out, lost = _cut(docs, least)
    out = out.where(~((F.col(lost) > 0) & (F.trim(F.translate("text", "\n\t\r\v\f", "     ")) == "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(C.read(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


#: DuckDB SQL for op10: least runs of non-blank lines with five words that occurred earlier, by doc_id and position, go.
SQL = r"""
WITH raw AS (SELECT doc_id, text, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
             FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
full_lines AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
seq AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[^\t\x0B\f\r ]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM full_lines WHERE t <> ''),
win AS (SELECT doc_id, q, list(t) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS ts,
               CASE WHEN n >= 5 THEN 1 WHEN n + lead(n, 1) OVER w >= 5 THEN 2 WHEN n + lead(n, 1) OVER w + lead(n, 2) OVER w >= 5 THEN 3
                    WHEN n + lead(n, 1) OVER w + lead(n, 2) OVER w + lead(n, 3) OVER w >= 5 THEN 4 WHEN lead(n, 4) OVER w >= 1 THEN 5 END AS size
        FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY q)),
grp AS (SELECT doc_id, q, size, first_value(doc_id) OVER g AS fd, first_value(q) OVER g AS fq FROM win WHERE size IS NOT NULL
        WINDOW g AS (PARTITION BY array_to_string(ts[1:size], chr(10)) ORDER BY doc_id, q)),
gone AS (SELECT DISTINCT doc_id, q + k AS q FROM grp, range(5) r(k) WHERE k < size AND (doc_id <> fd OR q <> fq)),
cut AS (SELECT s.doc_id, s.i FROM seq s JOIN gone g ON s.doc_id = g.doc_id AND s.q = g.q),
left_over AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text FROM raw r LEFT JOIN cut c ON r.doc_id = c.doc_id AND r.i = c.i
              WHERE c.i IS NULL GROUP BY r.doc_id),
lost AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text, coalesce(n, 0) AS removed_lines
FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""


def every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op10 with runs of one line: each line that occurred earlier goes, however short its document."""
    return dedup_lines(C.read(spark, sf_dir, "documents"), 1).select("doc_id", "text", "removed_lines")


#: DuckDB SQL for every_line: non-blank lines that occurred earlier, by doc_id and position, go.
EVERY_SQL = r"""
WITH raw AS (SELECT doc_id, text, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
             FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
full_lines AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
cut AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM full_lines WHERE t <> '') WHERE k > 1),
left_over AS (SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text FROM raw r LEFT JOIN cut c ON r.doc_id = c.doc_id AND r.i = c.i
              WHERE c.i IS NULL GROUP BY r.doc_id),
lost AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text, coalesce(n, 0) AS removed_lines
FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
