"""Queries of figures, tables and quotes on pages; the boxes of captions stand for those of what they name."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import figures, formulas, quotes
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
_AREA = "(bbox.x1 - bbox.x0) * (bbox.y1 - bbox.y0)"


def _boxes(spark, d):
    return table(spark, d, "detected_captions").select(
        F.col("caption_id").alias("id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("bbox").alias("box"), "caption_type", "number", "text", "y_center"
    )


@query("""SELECT caption_id, round(x0 + 0.1 * w, 4) AS x0, round(y0, 4) AS y0, round(x0 + w, 4) AS x1, round(y0 + 0.5 * h, 4) AS y1 FROM (SELECT caption_id, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 - bbox.x0 AS w, bbox.y1 - bbox.y0 AS h FROM detected_captions)""")
def percent_recrop(spark, d):
    """A part of each box by percentages, of which two lie outside the bounds."""
    percent = F.array(F.lit(10.0), F.lit(-5.0), F.lit(120.0), F.lit(50.0))
    out = _boxes(spark, d).select("id", figures.recrop(F.col("box"), percent).alias("b"))
    return out.select(F.col("id").alias("caption_id"), *[F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"SELECT caption_id, {_AREA} >= 612.0 * 792.0 / 200 AND {_AREA} <= 0.9 * 612.0 * 792.0 AS sized FROM detected_captions")
def figure_area(spark, d):
    """Whether boxes are as large as figures."""
    return _boxes(spark, d).select(F.col("id").alias("caption_id"), figures.figure_sized(F.col("box"), F.lit(612.0 * 792.0)).alias("sized"))


@query("""SELECT DISTINCT a.item_key AS doc, a.page_num AS page, EXISTS (SELECT 1 FROM detected_captions x JOIN detected_captions y ON x.item_key = y.item_key AND x.page_num = y.page_num AND x.caption_id < y.caption_id
  WHERE x.item_key = a.item_key AND x.page_num = a.page_num AND least(x.bbox.y1 - x.bbox.y0, y.bbox.y1 - y.bbox.y0) > 0 AND least(x.bbox.y1, y.bbox.y1) - greatest(x.bbox.y0, y.bbox.y0) > 0.3 * least(x.bbox.y1 - x.bbox.y0, y.bbox.y1 - y.bbox.y0)) AS beside FROM detected_captions a""")
def side_by_side(spark, d):
    """Pages with boxes beside each other."""
    return figures.side_by_side(_boxes(spark, d))


@query(f"""SELECT t.caption_id AS id, coalesce(t.number IS NULL AND {_AREA.replace('bbox', 't.bbox')} > 0 AND EXISTS (SELECT 1 FROM detected_captions f WHERE f.caption_type = 'figure' AND f.item_key = t.item_key AND f.page_num = t.page_num AND
  greatest(least(f.bbox.x1, t.bbox.x1) - greatest(f.bbox.x0, t.bbox.x0), 0) * greatest(least(f.bbox.y1, t.bbox.y1) - greatest(f.bbox.y0, t.bbox.y0), 0) > 0.1 * {_AREA.replace('bbox', 't.bbox')}), false) AS inside FROM detected_captions t WHERE t.caption_type = 'table'""")
def tables_in_figures(spark, d):
    """Tables without a number that a figure covers by a tenth."""
    boxes = _boxes(spark, d)
    tables = boxes.where("caption_type = 'table'").withColumn("captioned", F.col("number").isNotNull())
    return figures.tables_in_figures(tables, boxes.where("caption_type = 'figure'"), 0.1)


_TABLES = """SELECT id, string_split(table_id, '_table_')[1] AS doc, CAST(substr(string_split(table_id, '_table_')[2], 1, 4) AS INTEGER) AS page, CASE WHEN agent_idx % 3 > 0 THEN table_label END AS caption, hs,
  list_filter(list_transform(hs, lambda h: lower(trim(coalesce(h, '')))), lambda h: h <> '') AS names FROM (SELECT *, CAST(CAST(headers_json AS JSON) AS VARCHAR[]) AS hs FROM vision_agent_results WHERE headers_json IS NOT NULL AND table_id LIKE '%\\_table\\_____\\_%' ESCAPE '\\')"""


def _tables(spark, d):
    rows = table(spark, d, "vision_agent_results").where("headers_json is not null").where(F.col("table_id").rlike("_table_[0-9]{4}_"))
    part = F.split("table_id", "_table_")
    return rows.select(
        "id", part[0].alias("doc"), F.substring(part[1], 1, 4).cast("int").alias("page"), F.when(F.col("agent_idx") % 3 > 0, F.col("table_label")).alias("caption"),
        figures.header_key(F.from_json("headers_json", "array<string>")).alias("key"),
    )


@query(f"""WITH t AS (SELECT *, CASE WHEN len(hs) >= 2 AND len(names) > 0 THEN array_to_string(names, chr(31)) END AS key FROM ({_TABLES}))
  SELECT a.id, arg_min(b.caption, b.id) || ' (continued)' AS caption FROM t a JOIN t b ON a.caption IS NULL AND b.caption IS NOT NULL AND b.doc = a.doc AND b.key = a.key AND abs(b.page - a.page) <= 2 GROUP BY 1""")
def continuation_tables(spark, d):
    """Tables without a caption as continuations of those with the same headers nearby."""
    return figures.continued(_tables(spark, d))


@query("""SELECT t.caption_id AS id, arg_max(l.caption_id, (l.bbox.y1, l.caption_id)) AS line_id FROM detected_captions t JOIN detected_captions l ON t.caption_type = 'table' AND l.caption_type = 'figure' AND l.item_key = t.item_key AND l.page_num = t.page_num
  AND l.bbox.y1 <= t.bbox.y0 AND l.bbox.y1 >= t.bbox.y0 - 250 GROUP BY 1""")
def nearest_above(spark, d):
    """The lowest figure's caption above each table's within 250 points."""
    boxes = _boxes(spark, d)
    things = boxes.where("caption_type = 'table'").select("id", "doc", "page", F.col("box.y0").alias("y0"))
    lines = boxes.where("caption_type = 'figure'").select(F.col("id").alias("line_id"), "doc", "page", F.col("box.y1").alias("y1"))
    return figures.nearest_above(things, lines, 250.0)


@query("""SELECT caption_id, thing_id FROM (SELECT caption_id, item_key AS doc, page_num AS page, row_number() OVER (PARTITION BY item_key, page_num ORDER BY CAST(number AS INTEGER), caption_id) AS r FROM detected_captions WHERE regexp_matches(number, '^[0-9]{1,4}$'))
  JOIN (SELECT meta_id AS thing_id, item_key AS doc, page_num AS page, row_number() OVER (PARTITION BY item_key, page_num ORDER BY chunk_index, meta_id) AS r FROM chunk_records WHERE chunk_type IN ('table', 'figure')) USING (doc, page, r)""")
def captions_by_rank(spark, d):
    """Captions in order of number beside the tables and figures of their page."""
    captions = _boxes(spark, d).where(F.col("number").rlike("^[0-9]{1,4}$")).select(F.col("id").alias("caption_id"), "doc", "page", F.col("number").cast("int").alias("number"))
    things = table(spark, d, "chunk_records").where("chunk_type in ('table', 'figure')")
    things = things.select(F.col("meta_id").alias("thing_id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("chunk_index").alias("y"))
    return figures.paired_by_rank(captions, things)


@query("SELECT caption_type AS kind, list(round(bbox.y1 - bbox.y0, 4) ORDER BY round(bbox.y1 - bbox.y0, 4))[count(*) // 2 + 1] AS median FROM detected_captions GROUP BY 1")
def scan_zone(spark, d):
    """The upper median of the heights of captions."""
    rows = _boxes(spark, d).select(F.col("caption_type").alias("kind"), F.round(F.col("box.y1") - F.col("box.y0"), 4).alias("high"))
    return figures.upper_median(rows, "kind", "high")


_MODE = "SELECT item_key, section, chunk_type, sum(length(document)) AS n FROM chunk_records WHERE page_num BETWEEN 3 AND 9 AND document IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2, 3"


@query(f"SELECT item_key, section, chunk_type FROM ({_MODE}) QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY n DESC, section, chunk_type) = 1")
def main_style(spark, d):
    """The section and kind of most characters on pages three to nine."""
    rows = table(spark, d, "chunk_records").where("page_num between 3 and 9 and document is not null and section is not null").withColumn("n", F.length("document"))
    return figures.main_style(rows, "item_key", ["section", "chunk_type"], "n")


@query("SELECT item_key, sum(CASE WHEN chunk_type <> 'text' THEN length(document) ELSE 0 END) > 0.5 * sum(length(document)) AS mostly FROM chunk_records WHERE item_key IS NOT NULL AND document IS NOT NULL GROUP BY 1")
def mostly_marked(spark, d):
    """Items of which over half the characters are not text."""
    rows = table(spark, d, "chunk_records").where("item_key is not null and document is not null").withColumn("n", F.length("document"))
    return figures.mostly(rows, "item_key", F.col("chunk_type") != "text", "n")


@query("""SELECT meta_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY section_confidence DESC NULLS LAST, meta_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_key, page_num ORDER BY section_confidence DESC NULLS LAST, meta_id) AS r FROM chunk_records WHERE chunk_type <> 'text') WHERE r <= 1) WHERE k <= 3""")
def best_of_pages(spark, d):
    """The best passage of other kinds of each page, three of each item."""
    rows = table(spark, d, "chunk_records").where("chunk_type <> 'text'")
    rows = rows.select(F.col("meta_id").alias("id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("section_confidence").alias("confidence"))
    return figures.picked(rows, 1, 3).select("id")


@query("""SELECT e.caption_id AS id, arg_min(b.meta_id, (CASE b.page_num - e.page_num WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, b.meta_id)) AS box_id FROM detected_captions e JOIN chunk_records b ON b.item_key = e.item_key AND b.page_num BETWEEN e.page_num - 1 AND e.page_num + 1
  AND e.caption_type <> '' AND b.section <> '' AND (contains(lower(e.caption_type), lower(b.section)) OR contains(lower(b.section), lower(e.caption_type))) GROUP BY 1""")
def entries_in_boxes(spark, d):
    """For each caption the passage of its kind on its page or beside."""
    entries = _boxes(spark, d).select("id", "doc", "page", F.col("caption_type").alias("text"))
    boxes = table(spark, d, "chunk_records").select(F.col("meta_id").alias("box_id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("section").alias("text"))
    return figures.entries_in_boxes(entries, boxes)


@query("""WITH t AS (SELECT id, table_label, CAST(CAST(headers_json AS JSON) AS VARCHAR[]) AS hs, CAST(CAST(rows_json AS JSON) AS VARCHAR[][]) AS rs FROM vision_agent_results WHERE headers_json IS NOT NULL AND rows_json IS NOT NULL AND parse_success = 1),
  c AS (SELECT *, list_filter(list_concat(hs, flatten(rs)), lambda x: x IS NOT NULL) AS cells, len(rs) + CASE WHEN len(hs) > 0 THEN 1 ELSE 0 END AS n FROM t),
  m AS (SELECT *, len(list_filter(cells, lambda x: regexp_matches(trim(x), '^[0-9]+(\\.[0-9]+)*\\.?\\s+\\S.*\\s[0-9]{1,4}$'))) AS entry, len(list_filter(rs, lambda r: len(r) >= 3 AND regexp_matches(trim(r[1]), '^[0-9]+(\\.[0-9]+)*\\.?$') AND regexp_matches(trim(r[-1]), '^[0-9]+(\\.[0-9]+)*\\.?$'))) AS cols,
  coalesce(regexp_matches(table_label, '(?i)^\\s*(table|tab\\.)\\s*[0-9ivx]'), false) AS real FROM c)
  SELECT id, CASE WHEN entry >= 3 AND entry >= 0.4 * n THEN 'table_of_contents' WHEN NOT real AND n >= 2 AND cols >= 2 AND cols >= 0.4 * n THEN 'table_of_contents' WHEN NOT real AND regexp_matches(array_to_string(cells, ' '), '(?i)\\bfig(ure|\\.)\\s*[0-9]+\\s*[.:]') THEN 'diagram_as_table' END AS artifact FROM m""")
def artifact_tables(spark, d):
    """Readings that are no tables."""
    rows = table(spark, d, "vision_agent_results").where("headers_json is not null and rows_json is not null and parse_success = 1")
    found = figures.artifact(F.from_json("headers_json", "array<string>"), F.from_json("rows_json", "array<array<string>>"), F.col("table_label"))
    return rows.select("id", found.alias("artifact"))


@query("""SELECT caption_id AS id, CASE WHEN kind IS NULL OR kind NOT IN ('highlight', 'region') THEN 'kind' WHEN kind = 'highlight' AND trim(coalesce(text, '')) = '' THEN 'no quote' WHEN strlen(text) > 150 THEN 'quote too long' WHEN strlen(number) > 1 THEN 'comment too long'
  WHEN kind = 'region' AND NOT (bbox.x1 > bbox.x0 AND bbox.y1 > bbox.y0) THEN 'box' END AS problem FROM (SELECT *, CASE WHEN caption_type = 'table' THEN 'highlight' WHEN page_num < 20 THEN 'region' ELSE 'other' END AS kind FROM detected_captions)""")
def mark_problems(spark, d):
    """Why marks made of captions could not be made."""
    kind = F.when(F.col("caption_type") == "table", "highlight").when(F.col("page") < 20, "region").otherwise("other")
    return _boxes(spark, d).select("id", figures.valid_mark(F.col("text"), kind, F.col("number"), F.col("box"), caps=(150, 1)).alias("problem"))


@query("SELECT caption_id, replace(replace(replace(replace(replace(text, 'ffi', chr(64259)), 'ffl', chr(64260)), 'ff', chr(64256)), 'fi', chr(64257)), 'fl', chr(64258)) AS text FROM detected_captions")
def ligatures_set(spark, d):
    """Captions with ligatures for the letters they stand for."""
    return table(spark, d, "detected_captions").select("caption_id", quotes.with_ligatures(F.col("text")).alias("text"))


@query("SELECT caption_id, text FROM detected_captions")
def ligatures_round(spark, d):
    """Captions with ligatures set and taken out again."""
    return table(spark, d, "detected_captions").select("caption_id", quotes.without_ligatures(quotes.with_ligatures(F.col("text"))).alias("text"))


@query()
def plain_quotes(spark, d):
    """Passages in the form in which quotes are compared."""
    return table(spark, d, "chunk_records").select("meta_id", quotes.plain_quote(F.col("document")).alias("text"))


_QUOTES = "SELECT meta_id AS quote_id, item_key AS doc, trim(substr(regexp_replace(document, '\\s+', ' ', 'g'), 21, 8 + chunk_index % 40)) AS quote, page_num + chunk_index % 2 AS hint FROM chunk_records WHERE chunk_type = 'text' AND document IS NOT NULL"
_QPAGES = "SELECT item_key AS doc, page_num AS page, string_agg(regexp_replace(document, '\\s+', ' ', 'g'), ' ' ORDER BY meta_id) AS text FROM chunk_records WHERE document IS NOT NULL AND item_key IS NOT NULL GROUP BY 1, 2"


def _quotes(spark, d):
    """Pieces of passages, and the pages they are looked for on."""
    one = F.regexp_replace("document", r"\s+", " ")
    rows = table(spark, d, "chunk_records").where("document is not null")
    asked = rows.where("chunk_type = 'text'").select(
        F.col("meta_id").alias("quote_id"), F.col("item_key").alias("doc"), F.trim(one.substr(F.lit(21), (8 + F.col("chunk_index") % 40).cast("int"))).alias("quote"), (F.col("page_num") + F.col("chunk_index") % 2).alias("hint")
    )
    pages = rows.where("item_key is not null").groupBy(F.col("item_key").alias("doc"), F.col("page_num").alias("page"))
    return asked, pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("meta_id", one.alias("t")))), lambda x: x["t"]), " ").alias("text"))


@query(f"""WITH q AS ({_QUOTES}), p AS ({_QPAGES}), m AS (SELECT q.quote_id, p.page, p.page <> q.hint AS other, (length(p.text) - length(replace(p.text, q.quote, ''))) / length(q.quote) AS times FROM q JOIN p USING (doc) WHERE length(q.quote) >= 12 AND contains(p.text, q.quote)),
  f AS (SELECT quote_id, arg_min({{'page': page, 'times': times}}, (other, page)) AS x FROM m GROUP BY 1)
  SELECT q.quote_id, x.page AS page, CASE WHEN length(quote) < 12 THEN 'short' WHEN x IS NULL THEN 'missing' WHEN x.times > 1 THEN 'ambiguous' ELSE 'placed' END AS state FROM q LEFT JOIN f USING (quote_id)""")
def quotes_placed(spark, d):
    """Pieces of passages found again on the pages of their item."""
    return quotes.placed(*_quotes(spark, d))


@query(f"""WITH q AS ({_QUOTES}), p AS ({_QPAGES}), m AS (SELECT DISTINCT q.quote_id FROM q JOIN p USING (doc) WHERE length(q.quote) >= 12 AND contains(p.text, q.quote))
  SELECT CASE WHEN length(quote) < 12 THEN 'short' WHEN quote_id IN (SELECT quote_id FROM m) THEN 'found' ELSE 'missing' END AS state, count(*) AS n FROM q GROUP BY 1""")
def placement_coverage(spark, d):
    """How many quotes are short, found and missing."""
    return quotes.coverage(*_quotes(spark, d))


@query()
def rects_merged(spark, d):
    """Boxes of each page, joined where they are near and above each other."""
    return figures.merged(_boxes(spark, d), 60.0).select("doc", "page", "no", "box.x0", "box.y0", "box.x1", "box.y1")


_SIGNS = formulas.SYMBOLS.replace("'", "''")
_SCORED = f"""SELECT meta_id, document AS t, 10.0 * chunk_index AS wide, 4.0 + page_num AS high, chunk_type = 'formula' AS font, section_confidence > 0.8 AS flags, length(document) AS n, len(regexp_extract_all(document, '{_SIGNS}')) AS signs,
  len(regexp_extract_all(document, '{formulas.WORDS}')) AS words FROM chunk_records"""


@query(f"""SELECT meta_id, CASE WHEN t IS NULL OR n NOT BETWEEN 4 AND 900 OR regexp_matches(t, '{formulas.NOISE}') OR wide < 8 OR high < 5 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN signs >= 2 THEN 0.25 ELSE 0 END + CASE WHEN signs / n >= 0.04 THEN 0.2 ELSE 0 END
  + CASE WHEN font THEN 0.22 ELSE 0 END + CASE WHEN flags THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(t, '{formulas.NUMBERED}') THEN 0.08 ELSE 0 END + CASE WHEN wide > 80 AND high < 120 THEN 0.08 ELSE 0 END
  + CASE WHEN regexp_matches(t, '\\b[A-Za-z]\\s*[=<>≈]\\s*') THEN 0.15 ELSE 0 END - CASE WHEN words > 14 AND signs / n < 0.08 THEN 0.25 ELSE 0 END)), 6) END AS score FROM ({_SCORED})""")
def formula_score(spark, d):
    """How likely each passage is a formula."""
    rows = table(spark, d, "chunk_records")
    font, flags = F.col("chunk_type") == "formula", F.coalesce(F.col("section_confidence") > 0.8, F.lit(False))
    score = formulas.formula_score(F.col("document"), 10.0 * F.col("chunk_index"), 4.0 + F.col("page_num"), font, flags)
    return rows.select("meta_id", F.round(score, 6).alias("score"))


@query(f"""SELECT meta_id, length(t) BETWEEN 3 AND 1500 AND NOT regexp_matches(t, '{formulas.NOISE}') AND len(list_distinct(string_split(t, ''))) > 2 AND (len(regexp_extract_all(t, '{_SIGNS}')) >= 2 OR contains(t, chr(92)) OR (contains(t, '=') AND regexp_matches(t, '[A-Za-z][_^]|\\b[A-Za-z]\\b'))) AS useful
  FROM (SELECT meta_id, trim(coalesce(document, '')) AS t FROM chunk_records WHERE chunk_type IN ('formula', 'table'))""")
def latex_quality(spark, d):
    """Formulas and tables that read like a formula's source."""
    rows = table(spark, d, "chunk_records").where("chunk_type in ('formula', 'table')")
    return rows.select("meta_id", formulas.useful_latex(F.col("document")).alias("useful"))


@query("""WITH t AS (SELECT caption_id AS thing_id, item_key AS doc, page_num AS page, y_center AS y FROM detected_captions WHERE number IS NULL OR caption_type = 'table'), c AS (SELECT caption_id, item_key AS doc, page_num AS page, y_center AS y FROM detected_captions WHERE caption_type = 'figure'),
  m AS (SELECT thing_id, caption_id, abs(t.y - c.y) AS away, row_number() OVER (PARTITION BY thing_id ORDER BY abs(t.y - c.y), caption_id) AS n FROM t JOIN c USING (doc, page) WHERE abs(t.y - c.y) <= 300)
  SELECT thing_id, caption_id FROM (SELECT *, row_number() OVER (PARTITION BY caption_id ORDER BY away, thing_id) AS k FROM m WHERE n = 1) WHERE k = 1""")
def captions_recovered(spark, d):
    """The figure's caption nearest to each table's on its page."""
    boxes = _boxes(spark, d)
    things = boxes.where("number is null or caption_type = 'table'").select(F.col("id").alias("thing_id"), "doc", "page", F.col("y_center").alias("y"))
    captions = boxes.where("caption_type = 'figure'").select(F.col("id").alias("caption_id"), "doc", "page", F.col("y_center").alias("y"))
    return formulas.recovered_captions(things, captions, 300.0)
