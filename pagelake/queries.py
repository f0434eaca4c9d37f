"""Registered queries: every operator over the driver's tables, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.geometry import area, box, intersection
from .operators import clean, detect, formats, layout, recognize, spell
from .plans.pipeline import Pipeline
from .sources import fixtures as X
from .sources.dictionary import corpus_dictionary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_DUCK = {
    "regions": X.REGIONS.replace("STRING", "VARCHAR"),
    "region_lines": X.REGION_LINES.replace("STRING", "VARCHAR"),
    "pages_": X.PAGES,
    "detections": X.DETECTIONS_DUCK,
    "lines": X.LINES_DUCK,
    "turns": X.TURNS,
}


def query(sql: str | None = None, *needs: str, recursive: bool = False):
    """Registers the function under its name; ``needs`` are the derived tables that the SQL starts from, {name} parts of it that are shared."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = ", ".join(f"{n} AS ({_DUCK[n]})" for n in needs)
            ORACLE_SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if head and sql.lstrip().startswith('>') else ' '}{sql.lstrip().removeprefix('>')}" if head else sql)
        return f

    return register


# geometry and detections

LETTERBOX = """>lb AS (SELECT page_id, width, height, least(1280.0::DOUBLE / height, 1280.0::DOUBLE / width, 1.0::DOUBLE) AS ratio FROM pages_),
lc AS (SELECT page_id, ratio, CAST(round_even(width * ratio, 0) AS INT) AS new_w, CAST(round_even(height * ratio, 0) AS INT) AS new_h FROM lb)
SELECT page_id, ratio, new_w, new_h, CAST(round_even((1280 - new_w) / 2.0::DOUBLE - 0.1::DOUBLE, 0) AS INT) AS pad_left, CAST(round_even((1280 - new_w) / 2.0::DOUBLE + 0.1::DOUBLE, 0) AS INT) AS pad_right,
  CAST(round_even((1280 - new_h) / 2.0::DOUBLE - 0.1::DOUBLE, 0) AS INT) AS pad_top, CAST(round_even((1280 - new_h) / 2.0::DOUBLE + 0.1::DOUBLE, 0) AS INT) AS pad_bottom FROM lc"""
CORNERS = "SELECT page_id, anchor_idx, cx - w / 2 AS x0, cy - h / 2 AS y0, cx + w / 2 AS x1, cy + h / 2 AS y1, scores FROM detections"
ARGMAX = f"""SELECT page_id, anchor_idx, x0, y0, x1, y1, list_max(scores) AS score, CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS class_id
FROM ({CORNERS}) c WHERE list_max(scores) > 0.15::DOUBLE"""
_IOU = (
    "(greatest(0::DOUBLE, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0::DOUBLE, least(k.y1, b.y1) - greatest(k.y0, b.y0))) / nullif((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)"
    " - (greatest(0::DOUBLE, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0::DOUBLE, least(k.y1, b.y1) - greatest(k.y0, b.y0))), 0)"
)


def _nms_sql(groups: str, iou: str, source: str = ARGMAX, key: str = "anchor_idx") -> str:
    """Suppression as a recursive query: the n-th best box of each group against those kept so far."""
    on = " AND ".join(f"o.{g} = s.{g}" for g in groups.split(", "))
    kept_type = "STRUCT(key BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, score DOUBLE)[]"
    return f"""boxes AS ({source}), ordered AS (SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY score DESC, {key}) AS n FROM boxes),
steps AS (SELECT {groups}, 0::BIGINT AS n, []::{kept_type} AS kept FROM (SELECT DISTINCT {groups} FROM boxes) g
  UNION ALL SELECT {", ".join("s." + g for g in groups.split(", "))}, o.n, CASE WHEN len(list_filter(s.kept, lambda k: coalesce((greatest(0::DOUBLE, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0::DOUBLE, least(k.y1, o.y1) - greatest(k.y0, o.y0)))
    / nullif((k.x1 - k.x0) * (k.y1 - k.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - (greatest(0::DOUBLE, least(k.x1, o.x1) - greatest(k.x0, o.x0)) * greatest(0::DOUBLE, least(k.y1, o.y1) - greatest(k.y0, o.y0))), 0) > {iou}::DOUBLE, false))) > 0 THEN s.kept
    ELSE list_append(s.kept, {{'key': o.{key}::BIGINT, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'score': o.score}}) END
  FROM steps s JOIN ordered o ON {on} AND o.n = s.n + 1),
last AS (SELECT {groups}, max_by(kept, n) AS kept FROM steps GROUP BY {groups}), flat AS (SELECT {groups}, unnest(kept) AS b FROM last)"""


@query(LETTERBOX, "pages_")
def letterbox_params(spark, d):
    return detect.letterbox(X.pages(spark, d))


@query(CORNERS, "detections")
def xywh_to_xyxy(spark, d):
    return detect.to_corners(X.detections(spark, d))


def _boxes(spark, d):
    return detect.best_class(detect.to_corners(X.detections(spark, d)), 0.15)


@query(ARGMAX, "detections")
def det_argmax(spark, d):
    return _boxes(spark, d)


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, anchor_idx) AS INT) AS rank FROM ({ARGMAX}) a) r WHERE rank <= 10", "detections")
def det_topk(spark, d):
    return detect.top_k(_boxes(spark, d), 10)


@query(">" + _nms_sql("page_id", "0.1") + " SELECT * FROM (SELECT page_id, CAST(b.key AS INT) AS anchor_idx, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.score AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY b.score DESC, b.key) AS INT) AS rank FROM flat) r WHERE rank <= 2000", "detections", recursive=True)
def nms_agnostic(spark, d):
    return detect.suppress(_boxes(spark, d), 0.1, 2000, by_class=False)


@query(">" + _nms_sql("page_id, class_id", "0.15") + " SELECT * FROM (SELECT page_id, class_id, CAST(b.key AS INT) AS anchor_idx, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.score AS score, CAST(row_number() OVER (PARTITION BY page_id ORDER BY b.score DESC, b.key) AS INT) AS rank FROM flat) r WHERE rank <= 20", "detections", recursive=True)
def nms_classwise(spark, d):
    return detect.suppress(_boxes(spark, d), 0.15, 20, by_class=True)


_BACK = """>b AS (SELECT c.page_id, anchor_idx, score, class_id, x0, y0, x1, y1, width, height, width::DOUBLE AS w, height::DOUBLE AS h FROM ({argmax}) c JOIN pages_ p ON c.page_id = p.page_id),
g AS (SELECT *, CASE WHEN w > h THEN 1280.0::DOUBLE ELSE w / h * 1280 END AS rw, CASE WHEN w > h THEN w / h * 1280 ELSE 1280.0::DOUBLE END AS rh,
  CASE WHEN w > h THEN 0.0::DOUBLE ELSE 1280 * ((1 - w / h) / 2) END AS sw, CASE WHEN w > h THEN 1280 * ((1 - h / w) / 2) ELSE 0.0::DOUBLE END AS sh FROM b),
o AS (SELECT page_id, anchor_idx, greatest(0, CAST(floor((CAST(round_even(x0, 0) AS DOUBLE) - sw) * w / rw) AS INT)) AS x0, greatest(0, CAST(floor((CAST(round_even(y0, 0) AS DOUBLE) - sh) * h / rh) AS INT)) AS y0,
  least(width, CAST(ceil((CAST(round_even(x1, 0) AS DOUBLE) - sw) * w / rw) AS INT)) AS x1, least(height, CAST(ceil((CAST(round_even(y1, 0) AS DOUBLE) - sh) * h / rh) AS INT)) AS y1, score, class_id FROM g)
SELECT * FROM o WHERE x1 > x0 AND y1 > y0""".replace("{argmax}", ARGMAX)


@query(_BACK, "detections", "pages_")
def unletterbox(spark, d):
    return detect.to_page(_boxes(spark, d), X.pages(spark, d))


_LABELS = "[" + ", ".join(f"'{x}'" for x in detect.LABELS) + "]"


@query(f"SELECT page_id, anchor_idx, class_id + anchor_idx % 3 AS class_id, coalesce(({_LABELS})[class_id + anchor_idx % 3 + 1], 'unknown') AS label FROM ({ARGMAX}) a", "detections")
def det_label(spark, d):
    shifted = _boxes(spark, d).withColumn("class_id", F.col("class_id") + F.col("anchor_idx") % 3)
    return detect.labelled(shifted).select("page_id", "anchor_idx", "class_id", "label")


@query("SELECT * FROM regions WHERE label IN ('article', 'headline', 'author', 'image_caption')", "regions")
def line_candidates(spark, d):
    return detect.line_candidates(X.regions(spark, d))


# regions narrowed to a fifth, so that many are tall
_NARROW = "narrow AS (SELECT page_id, region_idx, label, x0, y0, CAST(x0 + 30 + region_idx % 60 AS INT) AS x1, y1 FROM regions)"
_CHUNKS = """sized AS (SELECT *, x1 - x0 AS rw, y1 - y0 AS rh, CAST(floor((x1 - x0) * 1.5::DOUBLE) AS INT) AS stride FROM narrow),
counted AS (SELECT *, CASE WHEN rh <= 2 * rw THEN 0 ELSE CAST(floor((rh - 2 * rw)::DOUBLE / stride) AS INT) + 1 END AS n FROM sized),
win AS (SELECT page_id, region_idx, CAST(c AS INT) AS chunk_idx, CASE WHEN n = 0 THEN 0 ELSE CAST(c AS INT) * stride END AS top, CASE WHEN c = n THEN rh ELSE CAST(c AS INT) * stride + 2 * rw END AS bottom, rw, rh
  FROM (SELECT *, unnest(range(n + 1)) AS c FROM counted) u)"""


def _narrow(spark, d):
    return X.regions(spark, d).withColumn("x1", (F.col("x0") + 30 + F.col("region_idx") % 60).cast("int"))


@query(f">{_NARROW}, {_CHUNKS} SELECT * FROM win", "regions")
def chunk_windows(spark, d):
    return detect.chunks(_narrow(spark, d))


_LINE_BOXES = "boxes_in AS (SELECT page_id, region_idx, chunk_idx, k AS line_no, CAST(k * 97 + (region_idx * 13) % 40 AS DOUBLE) + 0.5 AS ly0, CAST(k * 97 + (region_idx * 13) % 40 + 60 AS DOUBLE) + 0.5 AS ly1, CAST((region_idx * 7 + chunk_idx * 11 + k * 29) % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS score FROM win, {ks})"


def _chunk_lines(spark, d):
    """Three line boxes in every chunk's square."""
    win = detect.chunks(_narrow(spark, d))
    k = win.withColumn("line_no", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    y = (F.col("line_no") * 97 + (F.col("region_idx") * 13) % 40).cast("double") + 0.5
    raw = k.select("page_id", "region_idx", "chunk_idx", "line_no", y.alias("ly0"), (y + 60).alias("ly1"), (((F.col("region_idx") * 7 + F.col("chunk_idx") * 11 + F.col("line_no") * 29) % 97).cast("double") / 97).alias("score"))
    return detect.project_lines(raw, win)


_PROJECT = (
    f"{_NARROW}, {_CHUNKS}, {_LINE_BOXES.format(ks='(SELECT CAST(range AS INT) AS k FROM range(3)) ks')}, "
    + """fit AS (SELECT b.*, rw, (bottom - top)::DOUBLE AS h, rw::DOUBLE AS w FROM boxes_in b JOIN win USING (page_id, region_idx, chunk_idx)),
proj AS (SELECT page_id, region_idx, chunk_idx, line_no, 0 AS x0, CAST(floor((CAST(round_even(ly0, 0) AS DOUBLE) - CASE WHEN w > h THEN 1280 * ((1 - h / w) / 2) ELSE 0.0::DOUBLE END) * h / CASE WHEN w > h THEN h / w * 1280 ELSE 1280.0::DOUBLE END) AS INT) AS y0, rw AS x1,
  CAST(ceil((CAST(round_even(ly1, 0) AS DOUBLE) - CASE WHEN w > h THEN 1280 * ((1 - h / w) / 2) ELSE 0.0::DOUBLE END) * h / CASE WHEN w > h THEN h / w * 1280 ELSE 1280.0::DOUBLE END) AS INT) AS y1, score FROM fit)"""
)


@query(f">{_PROJECT} SELECT * FROM proj", "regions")
def line_project(spark, d):
    return _chunk_lines(spark, d)


_STITCH_SOURCE = "SELECT p.page_id, p.region_idx, chunk_idx * 100000 + line_no AS anchor_idx, p.x0::DOUBLE AS x0, (p.y0 + chunk_idx * CAST(floor((n.x1 - n.x0) * 1.5::DOUBLE) AS INT))::DOUBLE AS y0, p.x1::DOUBLE AS x1, (p.y1 + chunk_idx * CAST(floor((n.x1 - n.x0) * 1.5::DOUBLE) AS INT))::DOUBLE AS y1, score FROM proj p JOIN narrow n USING (page_id, region_idx)"
_STITCH = (
    f"{_PROJECT}, {_nms_sql('page_id, region_idx', '0.15', _STITCH_SOURCE)}, "
    "stitched AS (SELECT page_id, region_idx, CAST(row_number() OVER (PARTITION BY page_id, region_idx ORDER BY b.y0, b.score DESC, b.key) - 1 AS INT) AS line_idx, CAST(round_even(b.x0, 0) AS INT) AS x0, CAST(round_even(b.y0, 0) AS INT) AS y0, CAST(round_even(b.x1, 0) AS INT) AS x1, CAST(round_even(b.y1, 0) AS INT) AS y1, b.score AS score FROM flat)"
)


@query(f">{_STITCH} SELECT * FROM stitched", "regions", recursive=True)
def line_stitch(spark, d):
    return detect.stitch_lines(_chunk_lines(spark, d), _narrow(spark, d))


@query(
    f""">{_STITCH}, cl AS (SELECT s.page_id, s.region_idx, line_idx, greatest(0, s.x0) AS x0, greatest(0, s.y0) AS y0, least(n.x1 - n.x0, s.x1) AS x1, least(n.y1 - n.y0, s.y1) AS y1, n.x0 AS rx, n.y0 AS ry FROM stitched s JOIN narrow n USING (page_id, region_idx))
SELECT page_id, region_idx, line_idx, rx + x0 AS x0, ry + y0 AS y0, rx + x1 AS x1, ry + y1 AS y1 FROM cl WHERE x1 > x0 AND y1 > y0""",
    "regions",
    recursive=True,
)
def line_to_page(spark, d):
    return detect.lines_to_page(detect.stitch_lines(_chunk_lines(spark, d), _narrow(spark, d)), _narrow(spark, d))


@query(
    """SELECT r.page_id, r.region_idx, coalesce(list({'line_idx': l.line_idx, 'text': l.text, 'confidence': l.confidence, 'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1} ORDER BY l.line_idx) FILTER (WHERE l.line_idx IS NOT NULL), []) AS lines
FROM regions r LEFT JOIN region_lines l ON r.page_id = l.page_id AND r.region_idx = l.region_idx GROUP BY r.page_id, r.region_idx""",
    "regions", "region_lines",
)
def nest_lines(spark, d):
    return formats.nested_lines(X.regions(spark, d), X.region_lines(spark, d)).select("page_id", "region_idx", "lines")


@query(
    """>a AS (SELECT c.page_id, anchor_idx AS det_idx, CASE WHEN anchor_idx % 5 = 0 THEN 'unknown' ELSE 'text' END AS label, greatest(0, CAST(trunc(x0 * 1.3::DOUBLE - 90.7::DOUBLE) AS INT)) AS x0, greatest(0, CAST(trunc(y0 * 1.3::DOUBLE - 90.7::DOUBLE) AS INT)) AS y0,
  least(width, CAST(trunc(x1 * 1.3::DOUBLE - 90.7::DOUBLE) AS INT)) AS x1, least(height, CAST(trunc(y1 * 1.3::DOUBLE - 90.7::DOUBLE) AS INT)) AS y1, CASE WHEN anchor_idx % 7 = 0 THEN 0.0::DOUBLE ELSE score END AS confidence FROM ("""
    + ARGMAX + """) c JOIN pages_ p ON p.page_id = c.page_id) SELECT * FROM a WHERE x1 > x0 AND y1 > y0""",
    "detections", "pages_",
)
def det_clamp(spark, d):
    moved = [(F.col(c) * F.lit(1.3) - F.lit(90.7)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    label = F.when(F.col("anchor_idx") % 5 != 0, "text").alias("label")
    boxes = _boxes(spark, d).select("page_id", F.col("anchor_idx").alias("det_idx"), label, *moved, F.when(F.col("anchor_idx") % 7 != 0, F.col("score")).alias("score"))
    return detect.clamped(boxes, X.pages(spark, d))


# layout

_AREA = "greatest(0, {p}x1 - {p}x0)::BIGINT * greatest(0, {p}y1 - {p}y0)::BIGINT"
_INTER = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))::BIGINT * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))::BIGINT"


@query("SELECT * FROM regions WHERE confidence >= 0.5::DOUBLE", "regions")
def layout_filter(spark, d):
    return layout.confident(X.regions(spark, d))


@query(f"SELECT page_id, region_idx, {_AREA.format(p='')} AS area FROM regions", "regions")
def box_area(spark, d):
    return X.regions(spark, d).select("page_id", "region_idx", area(box()).alias("area"))


@query(f"SELECT * FROM (SELECT a.page_id, a.region_idx AS i, b.region_idx AS j, {_INTER.format(a='a', b='b')} AS inter FROM regions a JOIN regions b ON a.page_id = b.page_id AND a.region_idx < b.region_idx) p WHERE inter > 0", "regions")
def box_intersection(spark, d):
    r = X.regions(spark, d)
    a, b = (r.select("page_id", *[F.col(c).alias(f"{p}{c}") for c in ("region_idx", *layout.BOX)]) for p in ("a_", "b_"))
    inter = intersection(box("a_"), box("b_")).alias("inter")
    return a.join(b, "page_id").where("a_region_idx < b_region_idx").select("page_id", F.col("a_region_idx").alias("i"), F.col("b_region_idx").alias("j"), inter).where("inter > 0")


_RESCUE = f"""acc AS (SELECT * FROM regions WHERE confidence >= 0.5::DOUBLE),
weak AS (SELECT * FROM regions WHERE confidence >= 0.15::DOUBLE AND confidence < 0.5::DOUBLE AND {_AREA.format(p='')} >= 500),
over AS (SELECT w.page_id, w.region_idx, coalesce(sum({_INTER.format(a='w', b='a')}), 0) AS covered FROM weak w LEFT JOIN acc a ON a.page_id = w.page_id GROUP BY 1, 2),
saved AS (SELECT w.* FROM weak w JOIN over o USING (page_id, region_idx) WHERE o.covered::DOUBLE / ({_AREA.format(p='w.')}) < 0.3::DOUBLE),
both_ AS (SELECT *, 0 AS late FROM acc UNION ALL SELECT *, 1 FROM saved),
rescued AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY late, region_idx) - 1 AS INT) AS region_idx, label, x0, y0, x1, y1, text, confidence FROM both_)"""


@query(f">{_RESCUE} SELECT * FROM rescued", "regions")
def layout_rescue(spark, d):
    return layout.rescue(X.regions(spark, d))


def _pairs_sql(source: str) -> str:
    return f"""pr AS (SELECT a.page_id, a.region_idx AS i, b.region_idx AS j, {_INTER.format(a='a', b='b')} AS inter, {_AREA.format(p='a.')} AS ai, {_AREA.format(p='b.')} AS aj, a.label AS li, b.label AS lj, a.confidence AS ci, b.confidence AS cj
  FROM {source} a JOIN {source} b ON a.page_id = b.page_id AND a.region_idx < b.region_idx),
pc AS (SELECT *, inter::DOUBLE / nullif(least(ai, aj), 0) AS c, li IN ('doc_title', 'paragraph_title') AS ti, lj IN ('doc_title', 'paragraph_title') AS tj FROM pr WHERE inter > 0),
pv AS (SELECT page_id, i, j, inter, CASE WHEN c > 0.8::DOUBLE AND ti AND NOT tj THEN 'j' WHEN c > 0.8::DOUBLE AND tj AND NOT ti THEN 'i'
  WHEN li = lj AND c > 0.8::DOUBLE THEN CASE WHEN ci >= cj THEN 'j' ELSE 'i' END WHEN li = lj AND c > 0.7::DOUBLE THEN CASE WHEN ai >= aj THEN 'j' ELSE 'i' END
  WHEN inter::DOUBLE / aj > 0.5 AND aj < ai THEN 'j' WHEN inter::DOUBLE / ai > 0.5 AND ai < aj THEN 'i'
  WHEN greatest(ai, aj)::DOUBLE / least(ai, aj) > 3 AND c > 0.3::DOUBLE THEN CASE WHEN ai < aj THEN 'i' ELSE 'j' END END AS victim FROM pc)"""


@query(f">{_pairs_sql('regions')} SELECT page_id, i, j, inter, victim FROM pv", "regions")
def overlap_pairs(spark, d):
    return layout.overlap_pairs(X.regions(spark, d))


def _dedup_sql(source: str) -> str:
    return f"""{_pairs_sql(source)}, todo AS (SELECT page_id, i, j, CASE victim WHEN 'i' THEN i ELSE j END AS v, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS n FROM pv WHERE victim IS NOT NULL),
fold AS (SELECT page_id, 0::BIGINT AS n, []::INT[] AS gone FROM (SELECT DISTINCT page_id FROM todo) t
  UNION ALL SELECT f.page_id, t.n, CASE WHEN list_contains(f.gone, t.i) OR list_contains(f.gone, t.j) THEN f.gone ELSE list_append(f.gone, t.v) END FROM fold f JOIN todo t ON t.page_id = f.page_id AND t.n = f.n + 1),
lost AS (SELECT page_id, unnest(max_by(gone, n)) AS region_idx FROM fold GROUP BY page_id),
unique_ AS (SELECT s.* FROM {source} s ANTI JOIN lost l ON s.page_id = l.page_id AND s.region_idx = l.region_idx)"""


@query(f">{_dedup_sql('regions')} SELECT * FROM unique_", "regions", recursive=True)
def layout_dedup(spark, d):
    return layout.dedup(X.regions(spark, d))


def _columns_sql(source: str, tag: str = "") -> str:
    return f"""cw{tag} AS (SELECT page_id, region_idx, x0, x1, x1 - x0 AS w, median(x1 - x0) OVER (PARTITION BY page_id)::DOUBLE AS median_w FROM {source}),
cn{tag} AS (SELECT *, (x0 + x1) / 2.0::DOUBLE AS mid, count(*) OVER (PARTITION BY page_id) AS n FROM cw{tag} WHERE w <= median_w * 1.3::DOUBLE),
ca{tag} AS (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY page_id ORDER BY mid, region_idx) > median_w * 0.3::DOUBLE THEN 1 ELSE 0 END AS apart FROM cn{tag} WHERE n >= 3),
cr{tag} AS (SELECT *, sum(apart) OVER (PARTITION BY page_id ORDER BY mid, region_idx) AS run FROM ca{tag}),
raw{tag} AS (SELECT page_id, CAST(run AS INT) AS run, avg(mid) AS center, min(x0)::DOUBLE AS cl, max(x1)::DOUBLE AS cr, any_value(median_w) AS median_w FROM cr{tag} GROUP BY page_id, run),
ck{tag} AS (SELECT *, sum(CASE WHEN cr - cl >= median_w * 0.4::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY run) - 1 AS col_idx FROM raw{tag}),
cols{tag} AS (SELECT page_id, CAST(col_idx AS INT) AS col_idx, min_by(center, run) AS center, min_by(cl, run) AS cl, max(cr) AS cr, any_value(median_w) AS median_w FROM ck{tag} WHERE col_idx >= 0 GROUP BY page_id, col_idx)"""


@query(f">{_columns_sql('regions')} SELECT * FROM raw", "regions")
def columns_raw(spark, d):
    return layout.raw_columns(X.regions(spark, d))


@query(f">{_columns_sql('regions')} SELECT * FROM cols", "regions")
def columns_final(spark, d):
    return layout.columns(X.regions(spark, d))


def _gaps_sql(source: str, tag: str = "") -> str:
    return f"""{_columns_sql(source, tag)},
many{tag} AS (SELECT c.* FROM cols{tag} c JOIN (SELECT page_id FROM cols{tag} GROUP BY page_id HAVING count(*) >= 2) m USING (page_id) JOIN (SELECT page_id FROM {source} GROUP BY page_id HAVING count(*) >= 3) k USING (page_id)),
mem{tag} AS (SELECT c.page_id, c.col_idx, c.cl, c.cr, s.region_idx, s.x0, s.y0, s.x1, s.y1 FROM {source} s JOIN many{tag} c ON s.page_id = c.page_id
  WHERE s.x1 - s.x0 <= c.median_w * 1.3::DOUBLE AND c.cr > c.cl AND least(s.x1::DOUBLE, c.cr) - greatest(s.x0::DOUBLE, c.cl) > (c.cr - c.cl) * 0.3::DOUBLE),
st{tag} AS (SELECT page_id, col_idx, any_value(cl) AS cl, any_value(cr) AS cr, min(y0) AS top, max(y1) AS bot, sum(y1 - y0) AS covered FROM mem{tag} GROUP BY page_id, col_idx),
sparse{tag} AS (SELECT * FROM st{tag} WHERE CASE WHEN bot > top THEN covered::DOUBLE / (bot - top) ELSE 1 END <= 0.85::DOUBLE),
seq{tag} AS (SELECT m.*, s.top, row_number() OVER w AS gap_no, max(m.y1) OVER (PARTITION BY m.page_id, m.col_idx ORDER BY m.y0, m.y1, m.x0, m.x1, m.region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM mem{tag} m JOIN sparse{tag} s USING (page_id, col_idx) WINDOW w AS (PARTITION BY m.page_id, m.col_idx ORDER BY m.y0, m.y1, m.x0, m.x1, m.region_idx)),
gaps{tag} AS (SELECT page_id, col_idx, CAST(gap_no AS INT) AS gap_no, CAST(trunc(cl) AS INT) AS x0, greatest(top, coalesce(before, top)) AS y0, CAST(trunc(cr) AS INT) AS x1, y0 AS y1 FROM seq{tag} WHERE y0 - greatest(top, coalesce(before, top)) >= 80
  UNION ALL SELECT page_id, col_idx, 1073741824, CAST(trunc(cl) AS INT), bot, CAST(trunc(cr) AS INT), CAST(trunc(least((height - 20)::DOUBLE, bot + (bot - top) * 0.15::DOUBLE)) AS INT) FROM sparse{tag} JOIN pages_ USING (page_id)
  WHERE least((height - 20)::DOUBLE, bot + (bot - top) * 0.15::DOUBLE) - bot >= 80)"""


@query(f">{_gaps_sql('regions')} SELECT * FROM gaps", "regions", "pages_")
def column_gaps(spark, d):
    return layout.column_gaps(X.regions(spark, d), X.pages(spark, d))


def _order_sql(source: str, tag: str) -> str:
    return f"""{_columns_sql(source, tag)},
hit{tag} AS (SELECT s.page_id, s.region_idx, c.col_idx, c.cr > c.cl AND least(s.x1::DOUBLE, c.cr) - greatest(s.x0::DOUBLE, c.cl) > (c.cr - c.cl) * 0.2::DOUBLE AS hit, abs(c.center - (s.x0 + s.x1) / 2.0::DOUBLE) AS far FROM {source} s JOIN cols{tag} c ON s.page_id = c.page_id),
pl{tag} AS (SELECT page_id, region_idx, sum(hit::INT) AS hits, min(CASE WHEN hit THEN col_idx END) AS low, max(CASE WHEN hit THEN col_idx END) AS high, arg_min(col_idx, (far, col_idx)) AS near, count(*) AS n_cols FROM hit{tag} GROUP BY page_id, region_idx),
ky{tag} AS (SELECT s.*, coalesce(p.hits > 1, false) AS multi, coalesce(p.hits > 1 AND high - low + 1 >= n_cols - 1, false) AS banner, coalesce(low, near, 0) AS col, count(*) OVER (PARTITION BY s.page_id) AS n FROM {source} s LEFT JOIN pl{tag} p ON s.page_id = p.page_id AND s.region_idx = p.region_idx),
rd{tag} AS (SELECT page_id, region_idx, label, x0, y0, x1, y1, text, confidence, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN banner THEN 0 ELSE 1 END, CASE WHEN banner THEN 0 ELSE col END, CASE WHEN multi THEN 0 ELSE 1 END, CASE WHEN n > 1 THEN y0 ELSE 0 END, region_idx) - 1 AS INT) AS position FROM ky{tag})"""


@query(f">{_order_sql('regions', '')} SELECT * FROM rd", "regions")
def reading_order(spark, d):
    return layout.reading_order(X.regions(spark, d))


_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _merge_sql(source: str) -> str:
    """The fold as a recursive query: the open region, and the finished ones of each step."""
    kind = "STRUCT(label VARCHAR, x0 INT, y0 INT, x1 INT, y1 INT, text VARCHAR, confidence DOUBLE, members INT[])"
    plain = "{'label': r.label, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1, 'text': r.text, 'confidence': r.confidence, 'members': [r.region_idx]}"
    fits = "f.cur IS NOT NULL AND least(f.cur.x1 - f.cur.x0, r.x1 - r.x0) > 0 AND greatest(0, least(f.cur.x1, r.x1) - greatest(f.cur.x0, r.x0))::DOUBLE / least(f.cur.x1 - f.cur.x0, r.x1 - r.x0) >= 0.5 AND r.y0 - f.cur.y1 BETWEEN 0 AND 30 AND greatest(f.cur.y1, r.y1) - f.cur.y0 <= 600"
    merged = f"{{'label': f.cur.label, 'x0': least(f.cur.x0, r.x0), 'y0': f.cur.y0, 'x1': greatest(f.cur.x1, r.x1), 'y1': greatest(f.cur.y1, r.y1), 'text': CASE WHEN f.cur.text <> '' OR r.text <> '' THEN trim(f.cur.text || chr(10) || r.text, {_CHARS}) ELSE '' END, 'confidence': greatest(f.cur.confidence, r.confidence), 'members': list_concat(f.cur.members, [r.region_idx])}}"
    title = "r.label IN ('doc_title', 'paragraph_title')"
    flushed = "CASE WHEN f.cur IS NULL THEN f.done ELSE list_append(f.done, f.cur) END"
    return f"""mf AS (SELECT page_id, -1 AS position, []::{kind}[] AS done, NULL::{kind} AS cur FROM (SELECT DISTINCT page_id FROM {source}) q
  UNION ALL SELECT f.page_id, r.position, CASE WHEN {title} THEN list_append({flushed}, {plain}) WHEN {fits} THEN f.done ELSE {flushed} END, CASE WHEN {title} THEN NULL WHEN {fits} THEN {merged} ELSE {plain} END
  FROM mf f JOIN {source} r ON r.page_id = f.page_id AND r.position = f.position + 1),
ml AS (SELECT f.page_id, {flushed} AS done FROM mf f JOIN (SELECT page_id, max(position) AS position FROM mf GROUP BY page_id) m USING (page_id, position)),
mg AS (SELECT page_id, CAST(k - 1 AS INT) AS region_idx, done[k] AS m FROM (SELECT page_id, done, unnest(range(1, len(done) + 1)) AS k FROM ml) u),
merged AS (SELECT page_id, region_idx, m.label AS label, m.x0 AS x0, m.y0 AS y0, m.x1 AS x1, m.y1 AS y1, m.text AS text, m.confidence AS confidence, m.members AS members FROM mg)"""


@query(f">{_order_sql('regions', '')}, {_merge_sql('rd')} SELECT * FROM merged", "regions", recursive=True)
def merge_adjacent(spark, d):
    return layout.merge_adjacent(layout.reading_order(X.regions(spark, d)))


@query("SELECT r.* FROM regions r LEFT JOIN (SELECT DISTINCT page_id, region_idx, true AS has FROM region_lines) l USING (page_id, region_idx) WHERE has OR label NOT IN ('text', 'paragraph_title', 'doc_title', 'figure_title')", "regions", "region_lines")
def drop_empty(spark, d):
    return layout.drop_empty(X.regions(spark, d), X.region_lines(spark, d))


_PROCESS = f"""{_RESCUE}, {_dedup_sql('rescued')}, base AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY region_idx) - 1 AS INT) AS region_idx, label, x0, y0, x1, y1, text, confidence FROM unique_),
{_gaps_sql('base')}, filled AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, region_idx, col_idx, gap_no) - 1 AS INT) AS region_idx, label, x0, y0, x1, y1, text, confidence
  FROM (SELECT 0 AS k, page_id, region_idx, 0 AS col_idx, 0 AS gap_no, label, x0, y0, x1, y1, text, confidence FROM base UNION ALL SELECT 1, page_id, 0, col_idx, gap_no, 'text', x0, y0, x1, y1, '', 0.0 FROM gaps) z),
{_order_sql('filled', '_f')}, placed AS (SELECT page_id, position AS region_idx, label, x0, y0, x1, y1, text, confidence, position FROM rd_f), {_merge_sql('placed')}"""


@query(f">{_PROCESS} SELECT page_id, region_idx, label, x0, y0, x1, y1, text, confidence FROM merged", "regions", "pages_", recursive=True)
def layout_process(spark, d):
    return layout.process(X.regions(spark, d), X.pages(spark, d)).drop("sources")


# recognition


@query("SELECT doc_id, length(text) >= 30 AND (length(text) - length(replace(text, text[1:10], ''))) / 10.0::DOUBLE >= 3 AS flag FROM documents")
def repetition_flag(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.repeats_itself(F.col("text")).alias("flag"))


@query(
    f"""WITH some AS (SELECT doc_id, text FROM documents WHERE position(text[1:10] IN text[11:]) > 0),
tried AS (SELECT doc_id, text, unnest(range(10, length(text) // 2 + 1)) AS n FROM some),
found AS (SELECT doc_id, min(n) AS n FROM tried WHERE text[n + 1:n + 10] = text[1:10] AND text[1:n] = text[n + 1:2 * n] GROUP BY doc_id)
SELECT doc_id, trim(CASE WHEN n IS NULL THEN text ELSE text[1:n] END, {_CHARS}) AS text FROM documents LEFT JOIN found USING (doc_id)"""
)
def repetition_truncate(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.without_repetition(F.col("text")).alias("text"))


@query("SELECT r.page_id, r.region_idx, CASE WHEN n > 0 THEN 'lines' ELSE 'region' END AS route FROM regions r LEFT JOIN (SELECT page_id, region_idx, count(*) AS n FROM region_lines GROUP BY 1, 2) l USING (page_id, region_idx)", "regions", "region_lines")
def route_regions(spark, d):
    return recognize.routes(X.regions(spark, d), X.region_lines(spark, d))


@query("SELECT page_id, region_idx, coalesce(string_agg(nullif(text, ''), ' ' ORDER BY line_idx), '') AS text FROM region_lines GROUP BY 1, 2", "region_lines")
def region_text_join(spark, d):
    return recognize.texts_of_lines(X.region_lines(spark, d))


@query("SELECT page_id, region_idx, line_idx, confidence FROM region_lines WHERE confidence * 100 < 70", "region_lines")
def fallback_candidates(spark, d):
    return recognize.doubtful(X.region_lines(spark, d)).select("page_id", "region_idx", "line_idx", "confidence")


@query(
    """>f AS (SELECT page_id, region_idx, line_idx, CASE WHEN confidence * 100 < 70 THEN upper(text) ELSE text END AS text FROM region_lines)
SELECT page_id, region_idx, coalesce(string_agg(nullif(text, ''), ' ' ORDER BY line_idx), '') AS text FROM f GROUP BY 1, 2""",
    "region_lines",
)
def fallback_apply(spark, d):
    again = lambda rows: rows.withColumn("text", F.upper("text"))
    return recognize.texts_of_lines(recognize.with_fallback(X.region_lines(spark, d), again, whole=True))


# text cleaning


@query("SELECT page_id, region_idx, coalesce(median(CASE WHEN y1 > y0 THEN y1 - y0 END), 0)::DOUBLE AS median_height FROM lines GROUP BY 1, 2", "lines")
def median_line_height(spark, d):
    return clean.median_heights(X.lines(spark, d))


@query("SELECT page_id, region_idx, line_idx, (text LIKE '%—' OR text LIKE '%--' OR text LIKE '% -') AS dash FROM lines", "lines")
def semantic_dash(spark, d):
    return X.lines(spark, d).select("page_id", "region_idx", "line_idx", T.semantic_dash(F.col("text")).alias("dash"))


_GLUE = rf"""tr AS (SELECT *, trim(text, {_CHARS}) AS t, coalesce(median(CASE WHEN y1 > y0 THEN y1 - y0 END) OVER (PARTITION BY page_id, region_idx), 0)::DOUBLE AS mh, max(x1) OVER (PARTITION BY page_id, region_idx) AS pw FROM lines),
pv AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY page_id, region_idx ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt, y0 - lag(y1) OVER o AS gap, x0 - lag(x0) OVER o AS shift, lag(t) OVER o AS lt, lag(x1) OVER o - lag(x0) OVER o AS lw FROM tr WINDOW o AS (PARTITION BY page_id, region_idx ORDER BY line_idx)),
fl AS (SELECT *, coalesce((mh > 0 AND gap > 1.5::DOUBLE * mh) OR (pw > 0 AND abs(shift) > 0.15::DOUBLE * pw) OR (mh > 0 AND shift > mh), false)
    OR coalesce(pw > 0 AND lt[-1:] IN ('.', '!', '?', ':', ';') AND regexp_matches(t, '^\p{{Lu}}') AND lw < 0.85::DOUBLE * pw, false) AS broken,
  coalesce(pt LIKE '%-' AND NOT (pt LIKE '%—' OR pt LIKE '%--' OR pt LIKE '% -') AND regexp_matches(t, '^[\p{{Ll}}ªº]'), false) AS dehyphenated,
  coalesce(pt[-1:] NOT IN ('.', '!', '?', ':', ';') AND regexp_matches(t, '^[\p{{Ll}}ªº\p{{Nd}}²³¹⁰⁴-⁹₀-₉]'), false) AS continued FROM pv),
gl AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN pt IS NULL OR dehyphenated THEN '' WHEN continued AND NOT broken THEN ' ' ELSE chr(10) || chr(10) END AS glue FROM fl),
pc AS (SELECT page_id, region_idx, line_idx, glue, CASE WHEN first_value(CASE WHEN t <> '' THEN dehyphenated END IGNORE NULLS) OVER (PARTITION BY page_id, region_idx ORDER BY line_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) THEN t[1:length(t) - 1] ELSE t END AS piece, t FROM gl),
pieces AS (SELECT * FROM pc WHERE t <> '')"""
_CLEAN = f"{_GLUE}, cleaned AS (SELECT page_id, region_idx, string_agg(glue || piece, '' ORDER BY line_idx) AS text FROM pieces GROUP BY 1, 2)"


@query(f">{_GLUE} SELECT page_id, region_idx, line_idx, pt AS before, t AS after FROM gl WHERE dehyphenated", "lines")
def dehyphenate_pairs(spark, d):
    return clean.glue(X.lines(spark, d)).where("dehyphenated").select("page_id", "region_idx", "line_idx", F.col("pt").alias("before"), F.col("t").alias("after"))


@query(f">{_GLUE} SELECT page_id, region_idx, line_idx FROM gl WHERE broken", "lines")
def block_breaks(spark, d):
    return clean.glue(X.lines(spark, d)).where("broken").select("page_id", "region_idx", "line_idx")


@query(f">{_GLUE} SELECT page_id, region_idx, line_idx, glue FROM gl", "lines")
def line_glue(spark, d):
    return clean.glue(X.lines(spark, d)).select("page_id", "region_idx", "line_idx", "glue")


@query(f">{_CLEAN} SELECT * FROM cleaned", "lines")
def clean_text(spark, d):
    return clean.clean(X.lines(spark, d))


@query(
    f""">{_GLUE}, pn AS (SELECT *, CAST(sum(CASE WHEN glue = chr(10) || chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, region_idx ORDER BY line_idx) AS INT) AS para_idx FROM pieces)
SELECT page_id, region_idx, para_idx, string_agg(CASE WHEN glue = chr(10) || chr(10) THEN '' ELSE glue END || piece, '' ORDER BY line_idx) AS text FROM pn GROUP BY 1, 2, 3""",
    "lines",
)
def paragraphs(spark, d):
    return clean.paragraphs(X.lines(spark, d))


# spelling

_DICT = "dict AS (SELECT term, count(*) AS \"count\" FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) w GROUP BY term HAVING count(*) >= 5)"
_TOKENS = "toks AS (SELECT page_id, region_idx, CAST(k - 1 AS INT) AS token_idx, p[k] AS token FROM (SELECT page_id, region_idx, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT page_id, region_idx, string_split(text, ' ') AS p FROM turns WHERE text <> '') s) u)"
_AFFIX = (
    _TOKENS
    + """, led AS (SELECT *, regexp_extract(token, '^[[:^alnum:]]*') AS lead FROM toks), rest AS (SELECT *, substr(token, length(lead) + 1) AS rest FROM led),
aff AS (SELECT page_id, region_idx, token_idx, token, lead, left(rest, length(rest) - length(regexp_extract(rest, '[[:^alnum:]]*$'))) AS word, regexp_extract(rest, '[[:^alnum:]]*$') AS trail FROM rest)"""
)
_ELIGIBLE = _AFFIX + r""", elig AS (SELECT *, length(word) > 2 AND NOT regexp_matches(word, '^\p{Nd}+$') AND NOT regexp_matches(word, '[a-z][A-Z]') AS eligible FROM aff)"""
_OOV = f"{_DICT}, {_ELIGIBLE}, oov AS (SELECT DISTINCT lower(word) AS word FROM elig WHERE eligible AND lower(word) NOT IN (SELECT term FROM dict))"
_FIX = (
    _OOV
    + r""", wd AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM oov) a),
td AS (SELECT term, i, substr(term, 1, i - 1) || substr(term, i + 1) AS rest FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM dict) a),
sw AS (SELECT word, substr(word, 1, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) AS other FROM (SELECT word, unnest(range(1, length(word))) AS i FROM oov) a),
pairs AS (SELECT word, term FROM wd JOIN dict ON rest = term UNION SELECT word, term FROM td JOIN oov ON rest = word UNION SELECT word, term FROM wd JOIN td ON wd.rest = td.rest AND wd.i = td.i UNION SELECT word, term FROM sw JOIN dict ON other = term),
near AS (SELECT word, term, "count", 1 AS dist FROM pairs JOIN dict USING (term)),
best AS (SELECT word AS w, term FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY dist, "count" DESC, term) AS rk FROM near) z WHERE rk = 1),
fixed AS (SELECT page_id, region_idx, token_idx, token, CASE WHEN term IS NULL THEN token ELSE lead || CASE WHEN word = upper(word) AND word <> lower(word) THEN upper(term)
  WHEN regexp_matches(word[1:1], '^\p{Lu}') AND word[2:] = lower(word[2:]) AND word[2:] <> upper(word[2:]) THEN upper(term[1:1]) || lower(term[2:]) WHEN word = lower(word) AND word <> upper(word) THEN lower(term) ELSE term END || trail END AS corrected
  FROM elig LEFT JOIN best ON eligible AND lower(word) = w)"""
)


def _dictionary(spark, d):
    return corpus_dictionary(X.table(spark, d, "documents"))


@query("WITH " + _DICT + " SELECT * FROM dict")
def spell_dictionary(spark, d):
    return _dictionary(spark, d)


@query(f">{_TOKENS} SELECT * FROM toks", "turns")
def spell_tokens(spark, d):
    return spell.tokens(X.turns(spark, d))


@query(f">{_AFFIX} SELECT * FROM aff", "turns")
def spell_affixes(spark, d):
    return spell.affixes(spell.tokens(X.turns(spark, d)))


@query(f">{_ELIGIBLE} SELECT * FROM elig", "turns")
def spell_eligible(spark, d):
    return spell.eligible(spell.affixes(spell.tokens(X.turns(spark, d))))


@query(f">{_OOV} SELECT * FROM oov", "turns")
def spell_oov(spark, d):
    return spell.unknown(spell.eligible(spell.affixes(spell.tokens(X.turns(spark, d)))), _dictionary(spark, d))


@query(f">{_FIX} SELECT * FROM fixed", "turns")
def spell_correct(spark, d):
    return spell.corrected(X.turns(spark, d), _dictionary(spark, d), 1)


@query()
def spell_correct_d2(spark, d):
    return spell.corrected(X.turns(spark, d), _dictionary(spark, d), 2)


@query(
    r"""SELECT conv_id, turn, CAST(k - 1 AS INT) AS token_idx, CASE WHEN o = upper(o) AND o <> lower(o) THEN 'RECEIVED' WHEN regexp_matches(o[1:1], '^\p{Lu}') AND o[2:] = lower(o[2:]) AND o[2:] <> upper(o[2:]) THEN 'Received' WHEN o = lower(o) AND o <> upper(o) THEN 'received' ELSE 'Received' END AS corrected
FROM (SELECT conv_id, turn, p[k] AS o, k FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT conv_id, turn, string_split(text, ' ') AS p FROM conversations) a) b) c"""
)
def spell_case(spark, d):
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("token_idx", "o"))
    return rows.select("conv_id", "turn", "token_idx", T.like_original(F.col("o"), F.lit("Received")).alias("corrected"))


@query(f">{_FIX} SELECT page_id, region_idx, token_idx, token AS original, corrected FROM fixed WHERE token <> corrected", "turns")
def spell_corrections(spark, d):
    return spell.corrections(X.turns(spark, d), _dictionary(spark, d), 1)


@query(f">{_FIX} SELECT page_id, region_idx, string_agg(corrected, ' ' ORDER BY token_idx) AS text FROM fixed GROUP BY 1, 2 UNION ALL SELECT * FROM turns WHERE coalesce(text, '') = ''", "turns")
def spell_text(spark, d):
    return spell.check(X.turns(spark, d), _dictionary(spark, d), 1)


# output


@query(f">{_CLEAN} SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY region_idx) AS text FROM cleaned WHERE text <> '' GROUP BY page_id", "lines")
def fmt_text(spark, d):
    return formats.page_texts(clean.clean(X.lines(spark, d)))


_LINE_JSON = "{'text': l.text, 'confidence': l.confidence, 'bbox': {'x0': l.x0, 'y0': l.y0, 'x1': l.x1, 'y1': l.y1}}"


@query(
    f""">ln AS (SELECT page_id, region_idx, list({_LINE_JSON} ORDER BY line_idx) AS lines FROM region_lines l GROUP BY 1, 2),
rg AS (SELECT r.page_id, list({{'label': r.label, 'bbox': {{'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}, 'text': r.text, 'confidence': r.confidence, 'lines': coalesce(ln.lines, [])}} ORDER BY r.region_idx) AS regions FROM regions r LEFT JOIN ln USING (page_id, region_idx) GROUP BY r.page_id)
SELECT page_id, to_json({{'width': width, 'height': height, 'regions': regions}})::VARCHAR AS json FROM pages_ JOIN rg USING (page_id)""",
    "regions", "region_lines", "pages_",
)
def fmt_json(spark, d):
    return formats.as_json(formats.nested_pages(X.pages(spark, d), X.regions(spark, d), X.region_lines(spark, d)), None)


_ESCAPED = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HEAD = " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in formats.HOCR_HEAD)


@query(
    f""">sp AS (SELECT page_id, region_idx, string_agg(format('      <span class="ocr_line" id="line_{{}}_{{}}" title="bbox {{}} {{}} {{}} {{}}">', region_idx, line_idx, x0, y0, x1, y1) || {_ESCAPED.format(c='text')} || '</span>', chr(10) ORDER BY line_idx) AS spans FROM region_lines GROUP BY 1, 2),
ar AS (SELECT page_id, string_agg(format('    <div class="ocr_carea" id="block_{{}}" title="bbox {{}} {{}} {{}} {{}}">', region_idx, x0, y0, x1, y1) || coalesce(chr(10) || spans, '') || chr(10) || '    </div>', chr(10) ORDER BY region_idx) AS body FROM regions LEFT JOIN sp USING (page_id, region_idx) GROUP BY page_id)
SELECT page_id, {_HEAD} || chr(10) || format('  <div class="ocr_page" title="bbox 0 0 {{}} {{}}">', width, height) || coalesce(chr(10) || body, '') || chr(10) || '  </div>' || chr(10) || '</body>' || chr(10) || '</html>' AS hocr FROM pages_ LEFT JOIN ar USING (page_id)""",
    "regions", "region_lines", "pages_",
)
def fmt_hocr(spark, d):
    return formats.as_hocr(X.pages(spark, d), X.regions(spark, d), X.region_lines(spark, d))


@query(f"SELECT page_id, {_ESCAPED.format(c='html')} AS escaped FROM pages")
def html_escape(spark, d):
    return X.table(spark, d, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


# whole pipelines


@query(
    f""">{_CLEAN}, fin AS (SELECT page_id, string_agg(text, chr(10) || chr(10) ORDER BY region_idx) AS result FROM cleaned WHERE text <> '' GROUP BY page_id)
SELECT p.page_id, coalesce(result, '') AS result FROM (SELECT CAST(doc_id AS BIGINT) AS page_id FROM documents) p LEFT JOIN fin USING (page_id)""",
    "lines",
)
def page_pipeline(spark, d):
    pages = X.table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("page_id"), F.lit(400).alias("width"), F.lit(900).alias("height"))
    lines = X.lines(spark, d)
    regions = lines.groupBy("page_id", "region_idx").agg(F.lit("article").alias("label"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.lit("").alias("text"), F.lit(1.0).alias("confidence"))
    return Pipeline(layout_processing=False).run(pages, regions, lines)
