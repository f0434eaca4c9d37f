"""Pages, regions, lines and detections derived from the driver's tables by integer arithmetic.

Each definition is one SQL text that Spark and DuckDB both run, so that an operator and its twin
start from the same rows; only the wrapping of documents into lines, which needs a generator, is written for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGIONS = """
SELECT CAST(user_id AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS region_idx,
  CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'article' WHEN 'signup' THEN 'paragraph_title' WHEN 'purchase' THEN 'doc_title' ELSE 'photograph' END AS label,
  CAST((event_id % 5) * 220 + (event_id * 7) % 15 AS INT) AS x0, CAST((event_id * 7919) % 1400 AS INT) AS y0,
  CAST((event_id % 5) * 220 + (event_id * 7) % 15 + CASE WHEN event_id % 17 = 0 THEN 640 ELSE 190 END AS INT) AS x1,
  CAST((event_id * 7919) % 1400 + 40 + (event_id * 31) % 160 AS INT) AS y1,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('region ', CAST(event_id AS STRING)) END AS text,
  CAST((event_id * 37) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM events"""

#: Up to three short lines in each region of REGIONS.
REGION_LINES = f"""
SELECT r.page_id, r.region_idx, k.line_idx, r.x0 AS x0, CAST(r.y0 + 12 * k.line_idx AS INT) AS y0, r.x1 AS x1, CAST(r.y0 + 12 * k.line_idx + 10 AS INT) AS y1,
  CASE WHEN (r.region_idx + k.line_idx) % 7 = 3 THEN '' ELSE concat('line <', CAST(r.region_idx AS STRING), '> & ', CAST(k.line_idx AS STRING)) END AS text,
  CAST((r.region_idx * 13 + k.line_idx * 29) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM ({REGIONS}) r JOIN (SELECT CAST(0 AS INT) AS line_idx UNION ALL SELECT CAST(1 AS INT) UNION ALL SELECT CAST(2 AS INT)) k ON k.line_idx < r.region_idx % 4"""

PAGES = """
SELECT CAST(user_id AS BIGINT) AS page_id, CAST(900 + (user_id * 37) % 1200 AS INT) AS width, CAST(1100 + (user_id * 53) % 900 AS INT) AS height
FROM events GROUP BY user_id"""

DETECTIONS = """
SELECT CAST(vec_id / 50 - (vec_id / 50) % 1 AS BIGINT) AS page_id, CAST(vec_id % 50 AS INT) AS anchor_idx,
  CAST(60 + (vec_id * 131) % 1100 AS DOUBLE) AS cx, CAST(50 + (vec_id * 89) % 1150 AS DOUBLE) AS cy,
  CAST(80 + (vec_id * 17) % 300 AS DOUBLE) AS w, CAST(40 + (vec_id * 23) % 260 AS DOUBLE) AS h, {scores} AS scores
FROM embeddings"""
DETECTIONS_SPARK = DETECTIONS.format(scores="transform(slice(embedding, 1, 10), x -> CAST(x AS DOUBLE))").replace("vec_id / 50 - (vec_id / 50) % 1", "vec_id div 50")
DETECTIONS_DUCK = DETECTIONS.format(scores="list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))").replace("vec_id / 50 - (vec_id / 50) % 1", "vec_id // 50")

_LINE = """
SELECT page_id, CAST(k {div} 30 AS INT) AS region_idx, CAST(k % 30 AS INT) AS line_idx, CAST(20 * CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END AS INT) AS x0,
  CAST(22 * (k % 30) + 60 * ((k % 30) {div} 9) AS INT) AS y0, CAST(20 * CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END + 9 * length(t) AS INT) AS x1,
  CAST(22 * (k % 30) + 60 * ((k % 30) {div} 9) + 20 AS INT) AS y1, t AS text, CAST((page_id * 31 + k * 17) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM ({rows}) c"""
#: Documents as pages: their text cut every forty characters, with a hyphen inside words, thirty lines a region.
LINES_SPARK = _LINE.format(
    div="div",
    rows=r"""SELECT page_id, CAST(k AS BIGINT) AS k, t FROM (SELECT CAST(doc_id AS BIGINT) AS page_id, regexp_extract_all(translate(text, chr(10), ' '), '(?s).{{1,40}}', 0) AS cut FROM documents WHERE text <> '') d
LATERAL VIEW posexplode(transform(cut, (x, i) -> if(i + 1 < size(cut) AND regexp_like(x, '[A-Za-z]\\z') AND regexp_like(get(cut, i + 1), '^[A-Za-z]'), concat(x, '-'), x))) e AS k, t""",
)
LINES_DUCK = _LINE.format(
    div="//",
    rows="""SELECT page_id, k, CASE WHEN regexp_matches(substr(t, k * 40 + 40, 1), '[A-Za-z]') AND regexp_matches(substr(t, k * 40 + 41, 1), '[A-Za-z]') THEN concat(substr(t, k * 40 + 1, 40), '-') ELSE substr(t, k * 40 + 1, 40) END AS t
FROM (SELECT page_id, t, unnest(range((length(t) - 1) // 40 + 1)) AS k FROM (SELECT CAST(doc_id AS BIGINT) AS page_id, replace(text, chr(10), ' ') AS t FROM documents WHERE text <> '') d) w""",
)

#: Conversations as pages, their turns as regions.
TURNS = "SELECT CAST(conv_id AS BIGINT) AS page_id, CAST(turn AS INT) AS region_idx, text FROM conversations"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The SQL's rows over the driver's tables."""
    return spark.sql(sql.replace("FROM events", "FROM {events}").replace("FROM embeddings", "FROM {embeddings}").replace("FROM documents", "FROM {documents}").replace("FROM conversations", "FROM {conversations}"), **{t: table(spark, sf_dir, t) for t in tables})


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, REGIONS, "events")


def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, REGION_LINES, "events")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAGES, "events")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, DETECTIONS_SPARK, "embeddings")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LINES_SPARK, "documents")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, TURNS, "conversations")
