"""Queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import identifiers
from litspark.operators import catalog, library, vectors
from litspark.plans.register import registrar
from litspark.plans.scholarly import _DOI, _KEY
from litspark.plans.vectors import _KNN
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)


@query("""SELECT work_id, item_type FROM crossref_works WHERE (item_type NOT IN ('preprint', 'dataset') OR item_type IS NULL) AND work_id NOT IN (SELECT candidate_id FROM ingest_candidates WHERE needs_manual_verification)""")
def live_items_typed(spark, d):
    """Works of their own kind whose candidate needs no check."""
    deleted = table(spark, d, "ingest_candidates").where("needs_manual_verification").select(F.col("candidate_id").alias("work_id"))
    return catalog.live_items(table(spark, d, "crossref_works"), "item_type", deleted, "work_id", ("preprint", "dataset")).select("work_id", "item_type")


@query("""SELECT item_key, CASE WHEN path IN (SELECT DISTINCT '/lib/storage/' || item_key || '/' || item_key || '.pdf' FROM chunk_records WHERE item_key IS NOT NULL) THEN path END AS path FROM (SELECT item_key,
  CASE WHEN coalesce(year, 0) % 3 <> 2 THEN '/lib/storage/' || item_key || '/' || item_key || '.pdf' END AS path FROM library_items)""")
def attachment_paths(spark, d):
    """Where the files of items lie, if they do."""
    items = table(spark, d, "library_items")
    path = catalog.attachment_path(F.concat(F.lit("storage:"), "item_key", F.lit(".pdf")), F.coalesce("year", F.lit(0)) % 3, F.col("item_key"), "/lib")
    listing = table(spark, d, "chunk_records").where("item_key is not null").select(F.concat(F.lit("/lib/storage/"), "item_key", F.lit("/"), "item_key", F.lit(".pdf")).alias("path"))
    return catalog.existing(items.select("item_key", path.alias("path")), "path", listing).select("item_key", "path")


@query("""SELECT l.item_key, l.title, c.meta_id FROM library_items l JOIN (SELECT item_key, meta_id FROM chunk_records WHERE chunk_type = 'text' QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY page_num, chunk_index, meta_id) = 1) c USING (item_key)""")
def item_attachment(spark, d):
    """Items with their first passage; items without one are left out."""
    rows = table(spark, d, "chunk_records").where("chunk_type = 'text'")
    first = library.pick(rows, "item_key", F.col("page_num"), F.col("chunk_index"), F.col("meta_id")).select("item_key", "meta_id")
    return table(spark, d, "library_items").select("item_key", "title").join(first, "item_key")


@query("""SELECT item_key, (SELECT count(*) FROM chunk_records c WHERE c.item_key = l.item_key) AS passages, (SELECT count(*) FROM detected_captions c WHERE c.item_key = l.item_key) AS captions, (SELECT count(*) FROM documents c WHERE c.item_key = l.item_key) AS documents FROM library_items l""")
def item_attributes(spark, d):
    """Items with the number of their passages, captions and documents."""
    tables = {name: table(spark, d, t) for name, t in (("passages", "chunk_records"), ("captions", "detected_captions"), ("documents", "documents"))}
    return catalog.with_attributes(table(spark, d, "library_items").select("item_key"), "item_key", **tables)


@query(f"""SELECT {_KEY.format("split_part(line, ',', 1)")} AS title, trim(substr(line, strpos(line, ',') + 1)) AS quartile FROM (SELECT trim(CASE WHEN quartile IS NULL THEN '# ' || title_normalized || ',x' ELSE ' ' || upper(title_normalized) || ' , ' || quartile END) AS line FROM scimago_titles)
  WHERE NOT starts_with(line, '#') AND contains(line, ',')""")
def override_lines(spark, d):
    """Lines of overrides made of the list, its rows without a quartile as comments."""
    line = F.when(F.col("quartile").isNull(), F.concat(F.lit("# "), "title_normalized", F.lit(",x"))).otherwise(F.concat(F.lit(" "), F.upper("title_normalized"), F.lit(" , "), "quartile"))
    return catalog.override_lines(table(spark, d, "scimago_titles").select(line.alias("line")), "line")


_ARXIV = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(arxiv_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '^(arxiv:\\s*|https?://(www\\.)?arxiv\\.[a-z]+/(abs|pdf)/)', ''), '\\.pdf$', ''), 'v[0-9]+$', ''), '')"


@query(f"""WITH k AS (SELECT {_DOI.format('doi')} AS v, min(work_id) AS work_id FROM crossref_works GROUP BY 1), c AS (SELECT candidate_id, {_DOI.format('doi')} AS a, '10.48550/arxiv.' || {_ARXIV} AS b FROM ingest_candidates)
  SELECT candidate_id, work_id, 1 AS tier FROM c JOIN k ON k.v = c.a UNION ALL SELECT candidate_id, k.work_id, 2 FROM c JOIN k ON k.v = c.b WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.v = c.a)""")
def local_duplicate_tiers(spark, d):
    """Candidates that a work has by DOI, else by the DOI of an arXiv id."""
    other = identifiers.doi(F.col("doi"))
    tiers = [(identifiers.doi(F.col("doi")), other), (F.concat(F.lit("10.48550/arxiv."), identifiers.arxiv(F.col("arxiv_id"))), other)]
    return catalog.duplicate_of(table(spark, d, "ingest_candidates"), table(spark, d, "crossref_works"), tiers, "candidate_id", "work_id")


_PARSED = "SELECT id, table_label, CAST(CAST(headers_json AS JSON) AS VARCHAR[]) AS hs, CAST(CAST(rows_json AS JSON) AS VARCHAR[][]) AS rs FROM vision_agent_results WHERE headers_json IS NOT NULL AND rows_json IS NOT NULL AND parse_success = 1"


def _parsed(spark, d):
    rows = table(spark, d, "vision_agent_results").where("headers_json is not null and rows_json is not null and parse_success = 1")
    return rows.select("id", "table_label", F.from_json("headers_json", "array<string>").alias("hs"), F.from_json("rows_json", "array<array<string>>").alias("rs"))


@query(f"""SELECT id, CASE WHEN coalesce(table_label, '') <> '' THEN '**' || table_label || '**' || chr(10) || chr(10) ELSE '' END || '| ' || array_to_string(list_transform(hs, lambda c: coalesce(c, '')), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(hs, lambda c: '---'), ' | ') || ' |'
  || array_to_string(list_transform(rs, lambda r: chr(10) || '| ' || array_to_string(list_concat(list_transform(coalesce(r, []), lambda c: coalesce(c, '')), list_transform(hs, lambda c: ''))[1:len(hs)], ' | ') || ' |'), '') AS markdown FROM ({_PARSED})""")
def markdown_tables(spark, d):
    """Readings as tables in markdown with headers, rows filled up."""
    return _parsed(spark, d).select("id", catalog.markdown_table(F.col("hs"), F.col("rs"), F.col("table_label")).alias("markdown"))


@query(f"SELECT id, r AS row_idx, array_to_string(list_transform(rs[r], lambda c: regexp_replace(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g'), '^ | $', '', 'g')), '|') AS cells FROM (SELECT id, rs, unnest(range(1, len(rs) + 1)) AS r FROM ({_PARSED})) WHERE len(rs[r]) > 0")
def html_tables(spark, d):
    """Readings written as HTML and read again."""
    mark = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, mark), ""), F.lit("</tr>"))
    full = F.filter("rs", lambda r: r.isNotNull())
    markup = _parsed(spark, d).select("id", F.concat(F.lit("<table>"), F.array_join(F.transform(full, row), ""), F.lit("</table>")).alias("markup"))
    rows = markup.select("id", F.posexplode(catalog.html_rows("markup")).alias("row_idx", "cells")).where("size(cells) > 0")
    return rows.select("id", (F.col("row_idx") + 1).cast("long").alias("row_idx"), F.array_join("cells", "|").alias("cells"))


@query("""SELECT item_key, concat_ws(chr(10), CASE WHEN coalesce(title, '') <> '' THEN 'Title: ' || title END, CASE WHEN coalesce(authors, '') <> '' THEN 'Authors: ' || authors END, CASE WHEN year IS NOT NULL THEN 'Year: ' || year END, CASE WHEN coalesce(publication, '') <> '' THEN 'Venue: ' || publication END) AS overview FROM library_items""")
def item_overview(spark, d):
    """What is known of each item, a line for each."""
    fields = [("Title", F.col("title")), ("Authors", F.col("authors")), ("Year", F.col("year")), ("Venue", F.col("publication"))]
    return table(spark, d, "library_items").select("item_key", catalog.overview(fields).alias("overview"))


@query("""SELECT doc_id, trim(substr(p, greatest(greatest(strpos(p, '. '), 1) - 60, 1), 120)) AS context FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS p FROM documents)""")
def context_around(spark, d):
    """A hundred and twenty characters around the end of the first sentence."""
    return table(spark, d, "documents").select("doc_id", catalog.around(F.col("text"), ". ", 120).alias("context"))


@query("""SELECT work_id, nullif(trim(abstract), '') AS abstract FROM crossref_works WHERE title IS NOT NULL AND NOT contains(title, chr(10)) AND (abstract IS NULL OR NOT contains(abstract, chr(10) || '#'))""")
def abstract_found(spark, d):
    """The abstract of texts made of title, abstract and a heading."""
    works = table(spark, d, "crossref_works").where(r"title is not null and not contains(title, '\n') and (abstract is null or not contains(abstract, '\n#'))")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n**Abstract**\n"), F.coalesce("abstract", F.lit("")), F.lit("\n# Introduction\nBody"))
    return works.select("work_id", catalog.abstract_of(text).alias("abstract"))


@query("""SELECT meta_id FROM chunk_records c WHERE NOT (chunk_type = 'formula' AND item_key IN (SELECT item_key FROM detected_captions WHERE number = '1')) UNION ALL SELECT -caption_id FROM detected_captions WHERE number = '1'""")
def formula_backfill(spark, d):
    """Passages after new formulas took the place of old ones of the same documents."""
    old = table(spark, d, "chunk_records").select("meta_id", "item_key", "chunk_type")
    new = table(spark, d, "detected_captions").where("number = '1'").select((-F.col("caption_id")).alias("meta_id"), "item_key", F.lit("formula").alias("chunk_type"))
    return catalog.replaced_rows(old, new, "item_key", "chunk_type", "formula").select("meta_id")


@query("""SELECT id, row_number() OVER (PARTITION BY table_id ORDER BY agent_idx, id) - 1 AS place FROM vision_agent_results WHERE parse_success = 1""")
def table_index(spark, d):
    """The place of each parsed reading of its table."""
    rows = table(spark, d, "vision_agent_results").where("parse_success = 1")
    return catalog.numbered_within(rows, ["table_id"], ["agent_idx", "id"], "place").select("id", F.col("place").cast("long").alias("place"))


@query("""SELECT caption_id, row_number() OVER (PARTITION BY item_key, page_num ORDER BY y_center, caption_id) - 1 AS place FROM detected_captions""")
def captions_by_height(spark, d):
    """The place of each caption on its page from above."""
    return catalog.numbered_within(table(spark, d, "detected_captions"), ["item_key", "page_num"], ["y_center", "caption_id"], "place").select("caption_id", F.col("place").cast("long").alias("place"))


@query("""SELECT item_key, array_to_string(list_transform(list_sort(list(DISTINCT {'n': length(number), 't': number})), lambda x: x.t), ',') AS numbers FROM detected_captions WHERE number IS NOT NULL GROUP BY 1""")
def caption_numbers(spark, d):
    """Numbers of captions of each item by length and text."""
    rows = table(spark, d, "detected_captions").where("number is not null").groupBy("item_key")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.length("number").alias("n"), F.col("number").alias("t")))), lambda x: x["t"]), ",").alias("numbers"))


@query("""SELECT candidate_id, coalesce(TRY_CAST(nullif(trim(regexp_extract(substr(t, 1, 4), '^\\s*[+-]?[0-9]+')), '') AS INTEGER), 0) AS year FROM (SELECT candidate_id, regexp_extract(coalesce(doi, ''), '[0-9]{4}[-./]') AS t FROM ingest_candidates)""")
def year_prefix(spark, d):
    """The leading year of the part of an identifier."""
    part = F.regexp_extract(F.coalesce("doi", F.lit("")), r"[0-9]{4}[-./]", 0)
    return table(spark, d, "ingest_candidates").select("candidate_id", library.year_prefix(part).alias("year"))


@query("""SELECT item_type AS kind, count(DISTINCT lower(title)) AS titles, count(*) AS works, count(*) FILTER (coalesce(doi, '') = '') AS unresolved FROM crossref_works GROUP BY 1""")
def catalog_diagnostics(spark, d):
    """Works and distinct titles of each kind, and those without an identifier."""
    rows = table(spark, d, "crossref_works").groupBy(F.col("item_type").alias("kind"))
    return rows.agg(F.count_distinct(F.lower("title")).alias("titles"), F.count("*").alias("works"), F.count_if(F.coalesce("doi", F.lit("")) == "").alias("unresolved"))


@query(f"SELECT count(*) AS queries, count(*) FILTER (query_id = id) AS found, min(score) >= 0.999 AS near FROM ({_KNN.replace('%%', '%').replace('%s', '').replace('%d', '1')})")
def recovery_check(spark, d):
    """Whether vectors of an index are their own nearest."""
    rows = table(spark, d, "embeddings")
    first = vectors.nearest(rows, rows.where("vec_id % 100 = 0"), 1)
    return first.agg(F.count("*").alias("queries"), F.count_if(F.col("query_id") == F.col("id")).alias("found"), (F.min("score") >= 0.999).alias("near"))


@query("""SELECT item_key, count(DISTINCT page_num) AS pages, count(DISTINCT page_num) FILTER (metadata['quality_grade'] IN ('D', 'F')) AS read_again FROM chunk_records WHERE item_key IS NOT NULL GROUP BY 1""")
def pages_read_again(spark, d):
    """Pages of each item, and those of a low grade."""
    rows = table(spark, d, "chunk_records").where("item_key is not null").groupBy("item_key")
    return rows.agg(F.count_distinct("page_num").alias("pages"), F.count_distinct(F.expr("case when metadata['quality_grade'] in ('D', 'F') then page_num end")).alias("read_again"))
