"""Queries over passages, headings, captions and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import text
from litspark.operators import chunking, fulltext
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)

# one step of the cutter: the end of a passage that begins at s
_END = """CASE WHEN s + 1600 >= n THEN n ELSE coalesce(""" + ", ".join(
    f"(SELECT s + 1280 + (320 - strpos(reverse(substr(text, CAST(s + 1281 AS BIGINT), 320)), reverse({m})) + 1) FROM (SELECT 1) WHERE strpos(reverse(substr(text, CAST(s + 1281 AS BIGINT), 320)), reverse({m})) > 0)"
    for m in ("'. '", "'.' || chr(10)", "'? '", "'?' || chr(10)", "'! '", "'!' || chr(10)")
) + ", s + 1600) END"
_CUT = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text <> ''),
  c AS (SELECT doc_id, text, n, CAST(0 AS BIGINT) AS s, CAST(({_END.replace('s +', '0 +').replace('WHEN s', 'WHEN 0')}) AS BIGINT) AS e FROM d
  UNION ALL SELECT doc_id, text, n, s, CAST(({_END}) AS BIGINT) AS e FROM (SELECT doc_id, text, n, CASE WHEN e - 400 > s THEN e - 400 ELSE e END AS s FROM c) WHERE s < n),
  p AS (SELECT doc_id, s, e, regexp_replace(substr(text, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS t FROM c)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, s AS char_start, e AS char_end, t AS text FROM p WHERE t <> ''"""


@query(f"SELECT doc_id, idx, char_start, char_end FROM ({_CUT})")
def chunk_offsets(spark, d):
    """Where the passages of all documents begin and end."""
    return chunking.passages(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "idx", "char_start", "char_end")


@query(f"SELECT doc_id, idx, text FROM ({_CUT})")
def chunk_text(spark, d):
    """The passages of all documents."""
    return chunking.passages(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "idx", "text")


_PAGES = """SELECT item_key AS doc, page_num, string_agg(coalesce(document, ''), ' ' ORDER BY meta_id) AS page FROM chunk_records GROUP BY 1, 2"""


def _pages(spark, d):
    rows = table(spark, d, "chunk_records").groupBy(F.col("item_key").alias("doc"), "page_num")
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("meta_id", F.coalesce("document", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    return rows.agg(page.alias("page"))


_STARTS = f"SELECT doc, page_num, CAST(coalesce(sum(length(page) + 1) OVER (PARTITION BY doc ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM ({_PAGES})"


@query(_STARTS)
def page_starts(spark, d):
    """Where each page begins in the joined text of its item."""
    return chunking.page_starts(_pages(spark, d), "doc", "page_num", "page").select("doc", "page_num", F.col("char_start").cast("long").alias("char_start"))


@query(f"""WITH s AS ({_STARTS}) SELECT caption_id, coalesce((SELECT arg_max(page_num, char_start) FROM s WHERE s.doc = c.item_key AND s.char_start <= c.page_num * 500), 1) AS page_num
  FROM detected_captions c""")
def page_asof(spark, d):
    """The page in which a position of each caption's item lies."""
    starts = chunking.page_starts(_pages(spark, d), "doc", "page_num", "page")
    points = table(spark, d, "detected_captions").select("caption_id", F.col("item_key").alias("doc"), (F.col("page_num") * 500).alias("at"))
    return chunking.page_of(points, starts).select("caption_id", "page_num")


@query("""SELECT doc_id, pos, CASE WHEN pos < n_chars // 3 THEN 'introduction' WHEN pos < 2 * (n_chars // 3) THEN 'methods' WHEN pos < n_chars THEN 'results' ELSE 'unknown' END AS section,
  CASE WHEN pos < n_chars // 3 THEN 1.0::DOUBLE WHEN pos < 2 * (n_chars // 3) THEN 0.85::DOUBLE WHEN pos < n_chars THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars + 350, 350)) AS pos FROM documents)""")
def section_assign(spark, d):
    """The section of positions in every document whose thirds are sections."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") + 349, F.lit(350).cast("long"))).alias("pos"))
    third = F.expr("n_chars div 3")
    span = lambda label, a, b, c: F.struct(F.lit(label).alias("label"), a.cast("long").alias("char_start"), b.cast("long").alias("char_end"), F.lit(c).alias("confidence"))
    spans = F.array(span("introduction", F.lit(0), third, 1.0), span("methods", third, 2 * third, 0.85), span("results", 2 * third, F.col("n_chars"), 1.0))
    label, confidence = chunking.section_of(F.col("pos"), spans)
    return rows.select("doc_id", "pos", label.alias("section"), confidence.alias("confidence"))


@query("""WITH h AS (SELECT item_key AS doc, page_num * 1000 AS pos, min(coalesce(section, 'unknown')) AS label FROM chunk_records GROUP BY 1, 2),
  n AS (SELECT doc, max(pos) + 1000 AS n FROM h GROUP BY 1)
  SELECT doc, label, CAST(pos AS BIGINT) AS char_start, CAST(lead(pos, 1, n) OVER (PARTITION BY doc ORDER BY pos, label) AS BIGINT) AS char_end FROM h JOIN n USING (doc)
  UNION ALL SELECT doc, 'preamble', 0, CAST(min(pos) AS BIGINT) FROM h GROUP BY doc HAVING min(pos) > 0""")
def heading_spans(spark, d):
    """Spans between the pages of an item, labelled by their first section."""
    h = table(spark, d, "chunk_records").groupBy(F.col("item_key").alias("doc"), (F.col("page_num") * 1000).cast("long").alias("at"))
    h = h.agg(F.min(F.coalesce("section", F.lit("unknown"))).alias("label"))
    ends = h.groupBy("doc").agg((F.max("at") + 1000).alias("n_chars"))
    return chunking.spans(h.join(ends, "doc"))


def _case(col: str) -> str:
    has = lambda words: " OR ".join(f"contains({col}, '" + w.replace("'", "''") + "')" for w in words)
    whens = "".join(f" WHEN {has(words)} THEN '{label}'" for label, words in text.SECTION_WORDS)
    first = f"CASE WHEN {has(('online content', 'correspondence and requests'))} THEN 'appendix'"
    return f"{first}{whens} WHEN contains({col}, 'summary') THEN CASE WHEN {has(text.SUMMARY_OF_DATA)} THEN 'results' ELSE 'conclusion' END END"


@query(f"SELECT work_id, {_case('lower(title)')} AS section FROM crossref_works")
def heading_category(spark, d):
    """The section that the words of a title name."""
    return table(spark, d, "crossref_works").select("work_id", text.section_of_heading(F.col("title")).alias("section"))


_SIGN = {k: p.replace("'", "''") for k, p in text.SIGNS.items()}
_ENTRY = "(regexp_matches(x, '" + text.COUNTED + "') OR (regexp_matches(x, '" + _SIGN["year"] + "') AND (" + " OR ".join(f"regexp_matches(x, '{_SIGN[k]}')" for k in ("address", "extent", "initials")) + ")))"


@query(f"""WITH l AS (SELECT meta_id, length(trim(coalesce(document, ''))) AS n_chars, list_filter(list_transform(string_split(coalesce(document, ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s', ' ', 'g'))), lambda x: x <> '') AS ls FROM chunk_records),
  c AS (SELECT *, len(ls) AS n, len(list_filter(ls, lambda x: {_ENTRY})) AS entries, len(list_filter(ls, lambda x: regexp_matches(x, '{text.COUNTED}'))) AS counted, len(list_filter(ls, lambda x: regexp_matches(x, '{_SIGN["address"]}'))) AS addressed FROM l)
  SELECT meta_id, coalesce(lower(trim(translate(ls[1], '#*_.:', '     '))) IN {text.BIBLIOGRAPHY_HEADINGS}, false) OR (n_chars >= 250 AND ((n >= 4 AND entries >= 0.45 * n) OR counted >= 3 OR (addressed >= 3 AND entries >= 0.3 * n))) AS reference_like FROM c""")
def reference_like(spark, d):
    """Chunks that look like a bibliography."""
    return table(spark, d, "chunk_records").select("meta_id", text.reference_like(F.col("document")).alias("reference_like"))


@query("""SELECT caption_id, CASE WHEN starts_with(w, 'fig') THEN 'figure' WHEN starts_with(w, 'tab') THEN 'table' END AS kind, nullif(num, '') AS num FROM (SELECT caption_id,
  lower(regexp_extract(text, '(?i)^\\s*(supplementary\\s+)?(figure|fig\\.?|table|tab\\.?)\\s*((?:[a-z]\\.?)?[0-9]+|[ivxlc]+)\\b', 2)) AS w,
  regexp_extract(text, '(?i)^\\s*(supplementary\\s+)?(figure|fig\\.?|table|tab\\.?)\\s*((?:[a-z]\\.?)?[0-9]+|[ivxlc]+)\\b', 3) AS num FROM detected_captions)""")
def caption_parse(spark, d):
    """Kind and number that open each caption."""
    return table(spark, d, "detected_captions").select("caption_id", text.caption_kind(F.col("text")).alias("kind"), text.caption_number(F.col("text")).alias("num"))


_CELLS = """SELECT id, r - 1 AS row_idx, c - 1 AS col_idx, cells[c] AS cell FROM (SELECT id, r, rws[r] AS cells, unnest(range(1, len(rws[r]) + 1)) AS c FROM
  (SELECT id, rws, unnest(range(1, len(rws) + 1)) AS r FROM (SELECT id, CAST(from_json(rows_json, '[["VARCHAR"]]') AS VARCHAR[][]) AS rws FROM vision_agent_results WHERE parse_success = 1 AND rows_json IS NOT NULL)))"""


def _cells(spark, d):
    rows = table(spark, d, "vision_agent_results").where("parse_success = 1")
    rows = rows.select("id", F.posexplode(F.from_json("rows_json", "array<array<string>>")).alias("row_idx", "row"))
    return rows.select("id", F.col("row_idx").cast("long"), F.posexplode("row").alias("col_idx", "cell")).withColumn("col_idx", F.col("col_idx").cast("long"))


_CLEAN = """regexp_replace(regexp_replace(trim(regexp_replace(translate(cell, chr(8722) || chr(8211), '--'), '\\s+', ' ', 'g')), '^- ([0-9.])', '-\\1'), '^(-?)\\.([0-9])', '\\g<1>0.\\2')""".replace("\\g<1>", "\\1")


@query(f"SELECT id, row_idx, col_idx, {_CLEAN} AS cell FROM ({_CELLS})")
def clean_cells(spark, d):
    """The cells of all readings, cleaned."""
    return _cells(spark, d).select("id", "row_idx", "col_idx", text.clean_cell(F.col("cell")).alias("cell"))


@query(f"""SELECT id, string_agg('| ' || line || ' |', chr(10) ORDER BY row_idx) AS markdown FROM (SELECT id, row_idx,
  string_agg(coalesce(cell, ''), ' | ' ORDER BY col_idx) AS line FROM ({_CELLS}) GROUP BY 1, 2) GROUP BY 1""")
def table_markdown(spark, d):
    """Readings as lines of a table in markdown."""
    rows = table(spark, d, "vision_agent_results").where("parse_success = 1")
    parsed = F.from_json("rows_json", "array<array<string>>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    full = F.filter(parsed, lambda r: F.size(r) > 0)
    return rows.where(F.size(full) > 0).select("id", F.array_join(F.transform(full, line), "\n").alias("markdown"))


@query("""SELECT meta_id, coalesce((SELECT sum(length(w)) / greatest(count(*), 1) FROM unnest(regexp_split_to_array(document, '\\s+')) AS u(w) WHERE w <> '' AND NOT contains(w, '-')) > 25, false) AS garbled,
  coalesce(len(ws) >= 5 AND len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{L}$'))) > 0.4 * len(ws), false) AS interleaved
  FROM (SELECT *, list_filter(regexp_split_to_array(trim(document), '\\s+'), lambda w: w <> '') AS ws FROM chunk_records)""")
def garble_flags(spark, d):
    """Chunks of overlong words or single letters."""
    return table(spark, d, "chunk_records").select("meta_id", text.garbled(F.col("document")).alias("garbled"), text.interleaved(F.col("document")).alias("interleaved"))


_TOKENS = """list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'into')))"""


@query(f"""WITH t AS (SELECT work_id, unnest({_TOKENS}) AS w FROM crossref_works), i AS (SELECT item_key, unnest({_TOKENS}) AS w FROM library_items)
  SELECT item_key, work_id, count(*) AS overlap FROM i JOIN t USING (w) GROUP BY 1, 2 HAVING count(*) >= 3""")
def title_tokens_overlap(spark, d):
    """Items and works with three title words in common."""
    of = lambda t, k: table(spark, d, t).select(k, text.title_tokens(F.col("title")).alias("words"))
    return fulltext.overlaps(of("library_items", "item_key"), of("crossref_works", "work_id"), "item_key", "work_id", "words", 3)


@query(f"""WITH t AS (SELECT work_id, unnest({_TOKENS}) AS w FROM crossref_works), i AS (SELECT item_key, unnest({_TOKENS}) AS w FROM library_items)
  SELECT item_key, work_id, count(*) AS overlap FROM i JOIN t USING (w) GROUP BY 1, 2 HAVING count(*) >= 2""")
def title_overlap(spark, d):
    """Items and works with two title words in common, however frequent the words are."""
    of = lambda t, k: table(spark, d, t).select(k, text.title_tokens(F.col("title")).alias("words"))
    return fulltext.overlaps(of("library_items", "item_key"), of("crossref_works", "work_id"), "item_key", "work_id", "words", 2)


@query("""SELECT work_id, trim(regexp_replace(regexp_replace(title, '<[^<>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM crossref_works""")
def strip_markup(spark, d):
    """Titles without markup."""
    return table(spark, d, "crossref_works").select("work_id", text.strip_tags(F.col("title")).alias("title"))


@query("""SELECT item_key, count(*) AS pages, count(*) FILTER (chars = 0) AS empty_pages, CAST(sum(chars) AS BIGINT) AS chars FROM
  (SELECT item_key, page_num, sum(length(trim(coalesce(document, '')))) AS chars FROM chunk_records GROUP BY 1, 2) GROUP BY 1""")
def page_stats(spark, d):
    """Pages, empty pages and characters of each item."""
    pages = table(spark, d, "chunk_records").groupBy("item_key", "page_num").agg(F.sum(F.length(F.trim(F.coalesce("document", F.lit(""))))).alias("chars"))
    return pages.groupBy("item_key").agg(F.count("*").alias("pages"), F.count_if(F.col("chars") == 0).alias("empty_pages"), F.sum("chars").alias("chars"))
