"""Queries of headings, sections and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import sections
from litspark.plans.register import registrar
from litspark.plans.texts import _case
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_UNMARKED = _TRIM.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^#+\\s*', ''), '[*_]', '', 'g'), '^[0-9]+(\\.[0-9]+)*\\.?\\s*', ''), '\\(\\s*[a-z]\\s*\\)', '', 'g')")
_BARE = "regexp_replace(lower({}), '^[#*_ .:\\s]+|[#*_ .:\\s]+$', '', 'g')"
_PREAMBLE = f"({_BARE} IN {sections.PREAMBLE} OR " + " OR ".join(f"starts_with({_BARE}, '{x}')" for x in sections.PREAMBLE_BEGINS) + ")"


@query(f"SELECT caption_id, {_UNMARKED.format('text')} AS text FROM detected_captions")
def unmarked_captions(spark, d):
    """Captions without marks and leading numbers."""
    return table(spark, d, "detected_captions").select("caption_id", sections.unmarked(F.col("text")).alias("text"))


@query(f"SELECT DISTINCT section, coalesce({_PREAMBLE.replace('{}', 'section')}, false) AS preamble FROM documents")
def preamble_headings(spark, d):
    """Whether the sections of documents are labels of a title page."""
    return table(spark, d, "documents").select("section", sections.preamble_heading(F.col("section")).alias("preamble")).distinct()


_LINES = """SELECT doc_id, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, line FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL)"""
_LABEL = f"""CASE WHEN r <> '' AND length(r) <= 100 AND (starts_with(r, '#') OR starts_with(r, '**') OR {_BARE.format('r')} IN {sections.BARE_HEADINGS}) AND label IN {sections.INLINE_LABELS} THEN label END"""
_INLINE = f"SELECT doc_id, pos, {_LABEL} AS label FROM (SELECT *, {_case('lower(u)')} AS label FROM (SELECT *, {_UNMARKED.format('r')} AS u FROM (SELECT *, {_TRIM.format(chr(39) + '## ' + chr(39) + ' || line')} AS r FROM ({_LINES}))))"


def _lines(spark, d):
    return sections.lines_of(table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT doc_id, pos AS start_char, length(line) AS size FROM ({_LINES})")
def line_offsets(spark, d):
    """Where the lines of each document begin."""
    return _lines(spark, d).select("doc_id", F.col("at").alias("start_char"), F.length("line").cast("long").alias("size"))


@query(f"SELECT doc_id, pos AS start_char, label FROM ({_INLINE}) WHERE label IS NOT NULL")
def inline_headings(spark, d):
    """Short lines that as headings would open a section."""
    label = sections.inline_heading(F.concat(F.lit("## "), "line"))
    return _lines(spark, d).select("doc_id", F.col("at").alias("start_char"), label.alias("label")).where("label is not null")


@query(f"""WITH k AS (SELECT doc_id, pos + 3 AS pos, 'known' AS label FROM ({_LINES}) WHERE length(line) % 4 = 0), f AS (SELECT doc_id, pos, label FROM ({_INLINE}) WHERE label IS NOT NULL)
  SELECT doc_id, pos AS start_char, label FROM k UNION ALL SELECT doc_id, pos, label FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = f.doc_id AND abs(k.pos - f.pos) <= 5)""")
def headings_merged(spark, d):
    """Known headings and those found in lines that are not near one."""
    lines = _lines(spark, d)
    known = lines.where(F.length("line") % 4 == 0).select("doc_id", (F.col("at") + 3).alias("at"), F.lit("known").alias("label"))
    found = lines.select("doc_id", "at", sections.inline_heading(F.concat(F.lit("## "), "line")).alias("label")).where("label is not null")
    return sections.headings_merged(known, found, "doc_id").withColumnRenamed("at", "start_char")


_ENTRIES = "SELECT meta_id, item_key, page_num, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN section IN ('unknown', 'preamble') THEN NULL ELSE section END AS label FROM chunk_records"


@query(f"SELECT meta_id, coalesce(label, last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY item_key ORDER BY chunk_index, meta_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS inherited FROM ({_ENTRIES})")
def section_inherited(spark, d):
    """Sections of passages, unknown ones by the last known one of the first level."""
    rows = table(spark, d, "chunk_records").withColumn("level", F.when(F.col("chunk_index") % 3 == 0, 1).otherwise(2))
    rows = rows.withColumn("label", F.when(~F.col("section").isin("unknown", "preamble"), F.col("section")))
    return sections.inherited(rows, "item_key", ["chunk_index", "meta_id"], "level", "label").select("meta_id", "inherited")


@query(f"""WITH m AS (SELECT meta_id, item_key, coalesce(section, 'unknown') AS label, substr(coalesce(document, ''), 1, 40) AS h FROM chunk_records),
  t AS (SELECT *, label = 'unknown' AND {_UNMARKED.format('h')} <> '' AND NOT coalesce({_PREAMBLE.replace('{}', _UNMARKED.format('h'))}, false) AS telling FROM m),
  w AS (SELECT *, coalesce(max(CAST(label IN {sections.TERMINAL} AS INTEGER)) OVER (PARTITION BY item_key ORDER BY meta_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS ended,
  coalesce(max(CAST(label IN {sections.OPENING} OR telling AS INTEGER)) OVER (PARTITION BY item_key ORDER BY meta_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS begun FROM t)
  SELECT meta_id, CASE WHEN telling AND begun AND NOT ended THEN 'results' ELSE label END AS relabel FROM w""")
def section_relabelled(spark, d):
    """Unknown passages within the body as results."""
    rows = table(spark, d, "chunk_records").select("meta_id", "item_key", F.coalesce("section", F.lit("unknown")).alias("label"), F.substring(F.coalesce("document", F.lit("")), 1, 40).alias("h"))
    return sections.relabelled(rows, "item_key", "meta_id", "label", "h").select("meta_id", "relabel")


_SPANS = """SELECT doc_id, k AS label, CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end FROM (SELECT doc_id, n_chars, unnest(['methods', 'references', 'results', 'appendix']) AS k,
  unnest([0, n_chars // 4, n_chars // 3, n_chars // 2]) AS s, unnest([n_chars // 4, n_chars // 2, n_chars // 2, n_chars // 2 + 50]) AS e FROM documents WHERE text IS NOT NULL)"""


def _spans(spark, d):
    q = lambda k: F.floor(F.col("n_chars") / k)
    span = lambda label, s, e: F.struct(F.lit(label).alias("label"), s.cast("long").alias("char_start"), e.cast("long").alias("char_end"))
    spans = F.array(span("methods", F.lit(0), q(4)), span("references", q(4), q(2)), span("results", q(3), q(2)), span("appendix", q(2), q(2) + 50))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.inline(spans))


@query(f"""WITH s AS ({_SPANS}), n AS (SELECT doc_id, CAST(n_chars // 5 AS BIGINT) AS a, CAST(n_chars // 5 + n_chars // 10 AS BIGINT) AS b FROM documents WHERE text IS NOT NULL)
  SELECT * FROM (SELECT doc_id, label, char_start, least(char_end, a) AS char_end FROM s JOIN n USING (doc_id) UNION ALL SELECT doc_id, label, greatest(char_start, b), char_end FROM s JOIN n USING (doc_id)) WHERE char_start < char_end
  UNION ALL SELECT doc_id, 'abstract', a, b FROM n""")
def abstract_inserted(spark, d):
    """Spans of each document with an abstract that cuts them."""
    n = F.col("n_chars")
    new = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit("abstract").alias("label"), F.floor(n / 5).cast("long").alias("char_start"), (F.floor(n / 5) + F.floor(n / 10)).cast("long").alias("char_end"))
    return sections.inserted(_spans(spark, d), new, "doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars // 4 < n_chars // 2 + 50 THEN substr(text, 1, n_chars // 4) || substr(text, n_chars // 2 + 51) ELSE text END AS text FROM documents WHERE text IS NOT NULL""")
def section_trimmed(spark, d):
    """Documents without their spans of references and appendix."""
    texts = table(spark, d, "documents").where("text is not null")
    return sections.trimmed(texts, _spans(spark, d), "doc_id", "text", ("references", "appendix"))


@query(f"""SELECT p.doc_id, p.start_char, s.label FROM (SELECT doc_id, pos AS start_char FROM ({_LINES})) p LEFT JOIN (SELECT * FROM ({_SPANS}) WHERE label <> 'results') s ON s.doc_id = p.doc_id AND p.start_char >= s.char_start AND p.start_char < s.char_end""")
def lines_in_spans(spark, d):
    """The span in which each line begins, as pages that begin in the references are skipped."""
    lines = _lines(spark, d).select("doc_id", F.col("at").alias("start_char"))
    return sections.span_of(lines, _spans(spark, d).where("label <> 'results'"), "doc_id", "start_char")


_PAGES = "SELECT item_key, count(*) AS pages, sum(n) AS chars, count(*) FILTER (n < 120) AS empty FROM (SELECT item_key, page_num, sum(length(coalesce(document, ''))) AS n FROM chunk_records WHERE item_key IS NOT NULL GROUP BY 1, 2) GROUP BY 1"


@query(f"SELECT item_key, pages > 0 AND chars < 400 * pages AND empty >= 0.3 * pages AS scanned FROM ({_PAGES})")
def recognition_gate(spark, d):
    """Items of few characters a page and many nearly empty ones."""
    pages = table(spark, d, "chunk_records").where("item_key is not null").groupBy("item_key", "page_num").agg(F.sum(F.length(F.coalesce("document", F.lit("")))).alias("n"))
    items = pages.groupBy("item_key").agg(F.count("*").alias("pages"), F.sum("n").alias("chars"), F.count_if(F.col("n") < 120).alias("empty"))
    return items.select("item_key", sections.needs_recognition(F.col("chars"), F.col("pages"), F.col("empty"), 400, 0.3).alias("scanned"))


@query("""SELECT item_key, native > 200 AND ((md < 0.5 * native AND md < 50 * greatest(pages, 1)) OR (native_lost = 0 AND md > 0 AND md_lost > 0.005 * md)) AS prefer FROM (SELECT item_key, count(DISTINCT page_num) AS pages,
  sum(length(coalesce(document, ''))) AS native, coalesce(sum(length(document)) FILTER (chunk_type = 'table'), 0) AS md, 0 AS native_lost, coalesce(sum(len(regexp_extract_all(document, '[@|!]'))) FILTER (chunk_type = 'table'), 0) AS md_lost FROM chunk_records WHERE item_key IS NOT NULL GROUP BY 1)""")
def native_gate(spark, d):
    """Items whose tables hold far less than their whole text, or marks that it lacks."""
    n = F.length(F.coalesce("document", F.lit("")))
    read = F.col("chunk_type") == "table"
    marks = F.size(F.expr("regexp_extract_all(coalesce(document, ''), '[@|!]', 0)"))
    items = table(spark, d, "chunk_records").where("item_key is not null").groupBy("item_key").agg(
        F.count_distinct("page_num").alias("pages"), F.sum(n).alias("native"), F.sum(F.when(read, n).otherwise(0)).alias("md"), F.sum(F.when(read, marks).otherwise(0)).alias("md_lost")
    )
    prefer = sections.prefer_native(F.col("md"), F.col("native"), F.col("pages"), F.col("md_lost"), F.lit(0))
    return items.select("item_key", prefer.alias("prefer"))
