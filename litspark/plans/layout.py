"""Queries over the boxes of captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import layout
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
_CROPS = """SELECT id, doc, page, 0.0::DOUBLE AS x0, y0, 612.0::DOUBLE AS x1, y1 FROM (SELECT caption_id AS id, item_key AS doc, page_num AS page, caption_type AS kind, bbox.y0 AS y0,
  coalesce(lead(bbox.y0) OVER (PARTITION BY item_key, page_num ORDER BY y_center, caption_id), 792.0) AS y1 FROM detected_captions) WHERE kind = '%s' AND y1 > y0"""


def _captions(spark, d):
    return table(spark, d, "detected_captions").select(
        F.col("caption_id").alias("id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("caption_type").alias("kind"),
        F.col("bbox.y0").alias("y0"), "y_center", F.col("bbox").alias("box"), "number",
    )


@query(_CROPS % "table")
def crop_boxes(spark, d):
    """Boxes below the captions of tables."""
    return layout.crops(_captions(spark, d), "table")


@query(f"""SELECT id, k AS strip, round(CAST(y0 + k * 612 * 0.85 AS DOUBLE), 6) AS y0, round(CAST(least(y0 + k * 612 * 0.85 + CASE WHEN n > 1 THEN 612 ELSE y1 - y0 END, y1) AS DOUBLE), 6) AS y1 FROM (SELECT *, unnest(range(0, n)) AS k FROM
  (SELECT *, CASE WHEN y1 - y0 <= 612 THEN 1 ELSE CAST(ceil((y1 - y0 - 612) / (612 * 0.85)) + 1 AS BIGINT) END AS n FROM ({_CROPS % 'figure'})))""")
def strip_split(spark, d):
    """Boxes below the captions of figures as strips."""
    out = layout.strips(layout.crops(_captions(spark, d), "figure"))
    return out.select("id", "strip", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


_INTER = "greatest(least(a.bbox.x1, b.bbox.x1) - greatest(a.bbox.x0, b.bbox.x0), 0) * greatest(least(a.bbox.y1, b.bbox.y1) - greatest(a.bbox.y0, b.bbox.y0), 0)"
_AREA = "greatest({0}.bbox.x1 - {0}.bbox.x0, 0) * greatest({0}.bbox.y1 - {0}.bbox.y0, 0)"


@query(f"""SELECT id_a, id_b, round(i / greatest(s - i, 1e-9), 6) AS iou FROM (SELECT a.caption_id AS id_a, b.caption_id AS id_b, {_INTER} AS i, {_AREA.format('a')} + {_AREA.format('b')} AS s
  FROM detected_captions a JOIN detected_captions b ON a.item_key = b.item_key AND a.page_num = b.page_num AND a.caption_id < b.caption_id) WHERE i / greatest(s - i, 1e-9) > 0""")
def iou_pairs(spark, d):
    """Captions of one page that overlap."""
    return layout.overlapping(_captions(spark, d)).withColumn("iou", F.round("iou", 6))


@query("""WITH p AS (SELECT caption_id AS id, item_key AS doc, page_num AS page, u.k AS place, u.x AS x, u.y AS y FROM detected_captions, unnest([
  {'k': 0, 'x': bbox.x1 + 12, 'y': (bbox.y0 + bbox.y1) / 2}, {'k': 1, 'x': bbox.x0 - 12, 'y': (bbox.y0 + bbox.y1) / 2}, {'k': 2, 'x': (bbox.x0 + bbox.x1) / 2, 'y': bbox.y0 - 12},
  {'k': 3, 'x': (bbox.x0 + bbox.x1) / 2, 'y': bbox.y1 + 12}]) AS t(u)), n AS (SELECT DISTINCT p.id, p.place FROM p JOIN detected_captions c ON c.item_key = p.doc AND c.page_num = p.page AND c.caption_id <> p.id
  WHERE sqrt(pow(greatest(c.bbox.x0 - x, 0, x - c.bbox.x1), 2) + pow(greatest(c.bbox.y0 - y, 0, y - c.bbox.y1), 2)) < 24)
  SELECT id, CAST(place AS BIGINT) AS place, x, y FROM (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY p.place) AS rn FROM p ANTI JOIN n USING (id, place)) WHERE rn = 1""")
def region_free_point(spark, d):
    """A free place beside each caption."""
    return layout.free_points(_captions(spark, d).select("id", "doc", "page", "box"))


_GAPS = """SELECT doc, kind, n, largest, repeated, array_to_string(list_filter(range(1, largest + 1), lambda x: NOT list_contains(ks, x)), ',') AS missing FROM (SELECT item_key AS doc, caption_type AS kind, count(*) AS n, max(k) AS largest,
  count(*) FILTER (t > 1) AS repeated, list(k) AS ks FROM (SELECT item_key, caption_type, CAST(number AS INTEGER) AS k, count(*) AS t FROM detected_captions WHERE regexp_matches(number, '^[0-9]{1,4}$') GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(_GAPS)
def number_gaps(spark, d):
    """Numbers of tables and figures that an item lacks."""
    return layout.number_gaps(_captions(spark, d))


_FOUND = """SELECT item_key AS doc, count(*) FILTER (chunk_type = 'text' AND coalesce(document, '') <> '') AS pages, count(DISTINCT section) FILTER (section NOT IN ('unknown', 'table', 'figure', 'formula')) AS sections,
  count(*) FILTER (chunk_type = 'table') AS tf, count(*) FILTER (chunk_type = 'table' AND coalesce(document, '') <> '') AS tc, count(*) FILTER (chunk_type = 'figure') AS ff, count(*) FILTER (chunk_type = 'figure' AND coalesce(document, '') <> '') AS fc
  FROM chunk_records WHERE item_key IS NOT NULL GROUP BY 1"""
_MISSING = f"SELECT doc, kind, n + repeated AS captions, CASE WHEN missing = '' THEN 0 ELSE len(string_split(missing, ',')) END AS missing FROM ({_GAPS})"


@query(f"""WITH m AS ({_MISSING}), x AS (SELECT f.*, coalesce(t.captions, 0) AS ts, coalesce(t.missing, 0) AS tm, coalesce(g.captions, 0) AS gs, coalesce(g.missing, 0) AS gm FROM ({_FOUND}) f
  LEFT JOIN m t ON t.doc = f.doc AND t.kind = 'table' LEFT JOIN m g ON g.doc = f.doc AND g.kind = 'figure'),
  y AS (SELECT *, CAST(tf > 0 AND tc = 0 AS INTEGER) + CAST(ff > 0 AND fc = 0 AS INTEGER) + CAST(gs > 0 AND ff = 0 AS INTEGER) + CAST(ts > 0 AND tf = 0 AS INTEGER) AS missed FROM x)
  SELECT doc, CASE WHEN pages = 0 OR missed >= 2 THEN 'F' WHEN missed = 1 THEN 'D' WHEN tm <= 0 AND gm <= 0 AND tf - tc <= 0 AND ff - fc <= 0 AND sections > 0 THEN 'A'
  WHEN (ff > 0 AND fc / ff < 0.8) OR (tf > 0 AND tc / tf < 0.8) THEN 'C' ELSE 'B' END AS grade FROM y""")
def completeness_grade(spark, d):
    """A letter for what was taken out of each document."""
    rows = table(spark, d, "chunk_records").where("item_key is not null")
    kind, full = F.col("chunk_type"), F.coalesce("document", F.lit("")) != ""
    found = rows.groupBy(F.col("item_key").alias("doc")).agg(
        F.count_if((kind == "text") & full).alias("pages"),
        F.count_distinct(F.when(~F.col("section").isin("unknown", "table", "figure", "formula"), F.col("section"))).alias("sections"),
        *[F.count_if(kind == k).alias(f"{k}_found") for k in ("table", "figure")], *[F.count_if((kind == k) & full).alias(f"{k}_captioned") for k in ("table", "figure")],
    )
    gaps = layout.number_gaps(_captions(spark, d))
    gaps = gaps.select("doc", "kind", (F.col("n") + F.col("repeated")).alias("captions"), F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))).alias("missing"))
    for k in ("table", "figure"):
        own = gaps.where(F.col("kind") == k).select("doc", F.col("captions").alias(f"{k}_captions"), F.col("missing").alias(f"{k}_missing"))
        found = found.join(own, "doc", "left").fillna(0, [f"{k}_captions", f"{k}_missing"])
    counts = [{c: F.col(f"{k}_{c}") for c in ("found", "captioned", "captions", "missing")} for k in ("table", "figure")]
    return found.select("doc", layout.grade(F.col("pages"), F.col("sections"), *counts).alias("grade"))


@query("""SELECT kind, q3 + 1.5 * (q3 - q1) AS threshold FROM (SELECT kind, v[len(v) // 4 + 1] AS q1, v[3 * len(v) // 4 + 1] AS q3, len(v) AS n FROM (SELECT caption_type AS kind, list(y_center ORDER BY y_center) AS v FROM detected_captions GROUP BY 1)) WHERE n >= 3""")
def iqr_threshold(spark, d):
    """The height above which captions of a kind are outliers."""
    return layout.outlier_threshold(_captions(spark, d), "kind", "y_center")
