"""Queries of retrieval: filters, orders, contexts, typed passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import retrieval, vectors
from litspark.plans.register import registrar
from litspark.plans.vectors import _KNN
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)

@query("""SELECT item_key, title FROM library_items WHERE contains(lower(coalesce(authors, '')), 'ald') AND contains(lower(coalesce(collections, '')), 'estuar')""")
def text_filter(spark, d):
    """Items whose authors and collections hold a text."""
    return table(spark, d, "library_items").where(retrieval.text_filter(authors="Ald", collections="ESTUAR", tags=None)).select("item_key", "title")


@query("""SELECT meta_id, chunk_type FROM (SELECT *, coalesce(TRY_CAST(metadata['year'] AS INTEGER), 0) AS y FROM chunk_records) WHERE y <= 1990 AND chunk_type IN ('table', 'figure')""")
def chunk_filter(spark, d):
    """Tables and figures of documents up to a year; unknown years are 0 and pass."""
    year = F.coalesce(F.expr("try_cast(metadata['year'] as int)"), F.lit(0))
    return table(spark, d, "chunk_records").where(retrieval.passage_filter(year, F.col("chunk_type"), 0, 1990, ("table", "figure"))).select("meta_id", "chunk_type")


@query("""SELECT item_key, title FROM library_items WHERE regexp_matches(title, '(?i)(flux|sediment).*(model|record)')""")
def title_regex(spark, d):
    """Items whose title a pattern matches."""
    items = table(spark, d, "library_items")
    return items.where(retrieval.title_pattern(F.col("title"), "(flux|sediment).*(model|record)")).select("item_key", "title")


@query("""SELECT item_key, title, year FROM library_items WHERE item_key IN (SELECT item_key FROM ingest_routing_results WHERE status = 'saved')""")
def key_restriction(spark, d):
    """Items that were saved."""
    keys = table(spark, d, "ingest_routing_results").where("status = 'saved'").select("item_key")
    return table(spark, d, "library_items").join(keys, "item_key", "left_semi").select("item_key", "title", "year")


_SHOWN = """SELECT c.item_key AS doc_id, l.year, c.page_num AS page, c.chunk_index, round(c.section_confidence * 0.777777, 3) AS relevance_score, round(c.section_confidence * 0.5, 3) AS composite_score,
  c.section, c.chunk_type, CASE WHEN c.chunk_type = 'formula' THEN c.document END AS formula_source{} FROM chunk_records c JOIN library_items l USING (item_key)"""


def _hits(spark, d):
    items = table(spark, d, "library_items")
    rows = table(spark, d, "chunk_records").select(
        "item_key", F.col("page_num").alias("page"), "chunk_index", "section", "chunk_type", "section_confidence", F.col("document").alias("formula_source"),
        (F.col("section_confidence") * 0.777777).alias("relevance_score"), (F.col("section_confidence") * 0.5).alias("composite_score"),
    )
    return rows.join(items, "item_key").withColumnRenamed("item_key", "doc_id")


@query(_SHOWN.format(""))
def verbosity_minimal(spark, d):
    """Passages in the columns of the minimal verbosity."""
    return retrieval.shown(_hits(spark, d), "minimal")


@query(_SHOWN.format(", l.authors, l.citation_key, l.publication, round(c.section_confidence, 2) AS section_confidence, l.journal_quartile"))
def verbosity_standard(spark, d):
    """Passages in the columns of the standard verbosity."""
    return retrieval.shown(_hits(spark, d), "standard")


@query(_SHOWN.format(", l.authors, l.citation_key, l.publication, round(c.section_confidence, 2) AS section_confidence, l.journal_quartile, l.tags, l.collections"))
def verbosity_full(spark, d):
    """Passages in all columns."""
    return retrieval.shown(_hits(spark, d))


@query(f"""SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS position FROM ({_KNN.replace('%%', '%').replace('%s', '').replace('%d', '90')})
  JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id) WHERE label IN (0, 2, 4, 6) QUALIFY position <= 10""")
def passage_filtered_topk(spark, d):
    """The ten nearest rows of some labels among as many as a filtered search fetches."""
    rows = table(spark, d, "embeddings")
    found = vectors.nearest(rows, rows.where("vec_id % 100 = 0"), retrieval.fetch_size(10, True))
    kept = found.join(rows.select(F.col("vec_id").alias("id"), "label"), "id").where("label in (0, 2, 4, 6)")
    return retrieval.ordered(kept, "query_id", [F.col("rank")], 10).select("query_id", "id", "score", "position")


_COMPOSITE = f"""SELECT query_id, id, rank, round(pow(greatest(score, 0), 0.7) * CASE id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.65 WHEN 3 THEN 0.45 ELSE 0.7 END, 6) AS composite
  FROM ({_KNN.replace('%%', '%').replace('%s', '').replace('%d', '50')})"""


def _weighed(spark, d):
    rows = table(spark, d, "embeddings")
    found = vectors.nearest(rows, rows.where("vec_id % 100 = 0"), 50)
    venue = F.expr("case id % 5 when 0 then 1.0D when 1 then 0.85D when 2 then 0.65D when 3 then 0.45D else 0.7D end")
    return found.withColumn("composite", F.round(F.pow(F.greatest("score", F.lit(0.0)), 0.7) * venue, 6))


@query(f"SELECT query_id, id, composite, CAST(row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, rank) AS INTEGER) AS position FROM ({_COMPOSITE}) QUALIFY position <= 20")
def rerank_order(spark, d):
    """Hits by their composite; ties keep the order of similarity."""
    return retrieval.ordered(_weighed(spark, d), "query_id", [F.desc("composite"), F.col("rank")], 20).select("query_id", "id", "composite", "position")


@query(f"""SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(a, 3) DESC, f, doc) AS INTEGER) AS position
  FROM (SELECT query_id, id % 50 AS doc, avg(composite) AS a, min(rank) AS f FROM ({_COMPOSITE}) GROUP BY 1, 2) QUALIFY position <= 5""")
def topic_order(spark, d):
    """The first documents of a topic."""
    topics = _weighed(spark, d).groupBy("query_id", (F.col("id") % 50).alias("doc")).agg(F.avg("composite").alias("avg_composite"), F.min("rank").alias("first_rank"))
    return retrieval.topic_order(topics, "query_id", 5).select("query_id", "doc", "position")


@query("""SELECT item_key, title, year, CAST(row_number() OVER (ORDER BY coalesce(year, 0) DESC, item_key) AS INTEGER) AS position FROM library_items
  WHERE item_key IN (SELECT item_key FROM chunk_records WHERE contains(lower(document), 'sediment')) QUALIFY position <= 200""")
def boolean_items(spark, d):
    """Items with a passage that holds a word, newest first."""
    keys = table(spark, d, "chunk_records").where("contains(lower(document), 'sediment')").select("item_key")
    return retrieval.decorated(keys, table(spark, d, "library_items").select("item_key", "title", "year"), "item_key", 200)


_LIKE = "contains(lower(title), 'model') OR year > 2015"


@query(f"""SELECT item_key, year, CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, item_key) AS INTEGER) AS position FROM library_items WHERE {_LIKE} QUALIFY position <= 100""")
def advanced_search(spark, d):
    """Items by two conditions, newest first, a hundred of them."""
    found = table(spark, d, "library_items").where("contains(lower(title), 'model') or year > 2015")
    return retrieval.sorted_items(found.select("item_key", "year"), "year", True, 100)


@query("""SELECT item_key, title, CAST(row_number() OVER (ORDER BY title NULLS FIRST, item_key) AS INTEGER) AS position FROM library_items QUALIFY position <= 50""")
def items_by_title(spark, d):
    """The first fifty items by title, those without one before."""
    return retrieval.sorted_items(table(spark, d, "library_items").select("item_key", "title"), "title", False, 50)


_CAPTIONS = """SELECT caption_id, item_key AS doc, page_num AS page, caption_type AS kind, number FROM detected_captions WHERE number IS NOT NULL"""
_MAP = f"""WITH said AS (SELECT DISTINCT item_key AS doc, chunk_index, regexp_replace(unnest(regexp_extract_all(lower(document), '((?:table|figure|fig\\.?) [0-9ivxlc]+)', 1)), '^fig\\.? ', 'figure ') AS mention
  FROM chunk_records WHERE chunk_type = 'text' AND document IS NOT NULL), m AS (SELECT doc, mention, min(chunk_index) AS by_mention FROM said GROUP BY 1, 2),
  f AS (SELECT item_key AS doc, page_num AS page, min(chunk_index) AS by_page FROM chunk_records WHERE chunk_type = 'text' GROUP BY 1, 2)
  SELECT caption_id, coalesce(by_mention, by_page, -1) AS chunk_index, CASE WHEN by_mention IS NOT NULL THEN 'mention' WHEN by_page IS NOT NULL THEN 'page' ELSE 'none' END AS how
  FROM ({_CAPTIONS}) c LEFT JOIN m ON m.doc = c.doc AND m.mention = c.kind || ' ' || lower(c.number) LEFT JOIN f ON f.doc = c.doc AND f.page = c.page"""


def _captions(spark, d):
    rows = table(spark, d, "detected_captions").where("number is not null")
    return rows.select("caption_id", F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("caption_type").alias("kind"), "number")


def _texts(spark, d):
    rows = table(spark, d, "chunk_records").where("chunk_type = 'text'")
    return rows.select(F.col("item_key").alias("doc"), F.col("page_num").alias("page"), "chunk_index", F.col("document").alias("text"))


@query(_MAP)
def reference_map(spark, d):
    """The passage that each caption points to."""
    return retrieval.reference_map(_captions(spark, d), _texts(spark, d))


@query(f"""SELECT p.caption_id, max(substr(coalesce(t.document, ''), 1, 200)) AS context FROM ({_MAP}) p JOIN detected_captions c USING (caption_id)
  LEFT JOIN (SELECT * FROM chunk_records WHERE chunk_type = 'text') t ON t.item_key = c.item_key AND t.chunk_index = p.chunk_index GROUP BY 1""")
def reference_context(spark, d):
    """The beginning of the passage that each caption points to."""
    pointed = retrieval.reference_map(_captions(spark, d), _texts(spark, d)).join(_captions(spark, d).select("caption_id", "doc"), "caption_id")
    texts = _texts(spark, d).select("doc", "chunk_index", F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("text"))
    return pointed.join(texts, ["doc", "chunk_index"], "left").groupBy("caption_id").agg(F.coalesce(F.max("text"), F.lit("")).alias("context"))


@query("""SELECT f.meta_id AS formula_id, t.meta_id AS id FROM chunk_records f JOIN chunk_records t ON t.item_key = f.item_key AND t.page_num = f.page_num AND t.chunk_type = 'text' WHERE f.chunk_type = 'formula'
  UNION ALL SELECT meta_id, meta_id FROM chunk_records WHERE chunk_type = 'formula'""")
def formula_context(spark, d):
    """The text passages on the page of each formula, and the formula."""
    rows = table(spark, d, "chunk_records")
    return retrieval.formula_context(rows.select(F.col("meta_id").alias("id"), F.col("item_key").alias("doc"), F.col("page_num").alias("page"), F.col("chunk_type").alias("kind")))


_BOX = "printf('%.2f,%.2f,%.2f,%.2f', bbox.x0, bbox.y0, bbox.x1, bbox.y1)"


@query(f"""SELECT chroma_id AS id, 'text' AS kind, document AS text, CAST(count(*) OVER (PARTITION BY item_key) AS BIGINT) AS total, '' AS box FROM chunk_records WHERE chunk_type = 'text'
  UNION ALL SELECT item_key || '_' || caption_type || '_' || printf('%04d', page_num) || '_' || caption_id, caption_type, CASE WHEN coalesce(text, '') <> '' THEN text ELSE 'Figure on page ' || page_num END,
  CAST(count(*) OVER (PARTITION BY item_key, caption_type) AS BIGINT), {_BOX} FROM detected_captions""")
def typed_passages(spark, d):
    """Text passages, tables and figures as the rows of one index."""
    texts = table(spark, d, "chunk_records").where("chunk_type = 'text'")
    sizes = texts.groupBy("item_key").agg(F.count("*").alias("total"))
    texts = texts.join(sizes, texts["item_key"].eqNullSafe(sizes["item_key"])).select(
        F.col("chroma_id").alias("id"), F.lit("text").alias("kind"), F.col("document").alias("text"), "total", F.lit("").alias("box")
    )
    seen = table(spark, d, "detected_captions")
    n = seen.groupBy("item_key", "caption_type").agg(F.count("*").alias("total"))
    name = F.concat_ws("_", "item_key", "caption_type", F.lpad(F.col("page_num").cast("string"), 4, "0"), "caption_id")
    figures = seen.join(n, ["item_key", "caption_type"]).select(
        name, "caption_type", retrieval.figure_text(F.col("text"), F.col("page_num")), "total", retrieval.box_text(F.col("bbox"))
    )
    return texts.union(figures)


@query("""SELECT chunk_type, count(*) AS n FROM chunk_records WHERE item_key NOT IN (SELECT item_key FROM ingest_routing_results WHERE is_error_page AND item_key IS NOT NULL) OR item_key IS NULL GROUP BY 1""")
def delete_documents(spark, d):
    """What remains of each kind without the documents that were saved as error pages."""
    gone = table(spark, d, "ingest_routing_results").where("is_error_page").select("item_key")
    return retrieval.without_documents(table(spark, d, "chunk_records"), gone, "item_key").groupBy("chunk_type").agg(F.count("*").alias("n"))


@query("""SELECT chunk_type, count(*) AS n FROM chunk_records c WHERE NOT (chunk_type = 'formula' AND EXISTS (SELECT 1 FROM library_items l WHERE l.item_key = c.item_key AND l.year < 2000)) GROUP BY 1""")
def delete_by_kind(spark, d):
    """What remains of each kind without the formulas of older items."""
    gone = table(spark, d, "library_items").where("year < 2000").select("item_key")
    return retrieval.without_documents(table(spark, d, "chunk_records"), gone, "item_key", "formula").groupBy("chunk_type").agg(F.count("*").alias("n"))


@query("""SELECT item_key, meta_id, section, page_num FROM chunk_records WHERE item_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY meta_id) = 1""")
def document_meta(spark, d):
    """What the first passage of each document says of it."""
    return retrieval.document_meta(table(spark, d, "chunk_records").where("item_key is not null"), "item_key", "meta_id", "section", "page_num")


@query("""SELECT a.n AS ids, a.n AS texts, b.n AS vectors, a.n = a.k AND b.n = a.n AND b.k = a.n AS aligned FROM (SELECT count(meta_id) AS n, count(DISTINCT meta_id) AS k FROM chunk_records) a,
  (SELECT count(vec_id) AS n, count(DISTINCT vec_id) AS k FROM embeddings) b""")
def alignment_guard(spark, d):
    """Whether passages and vectors agree in number."""
    rows = table(spark, d, "chunk_records").select(F.col("meta_id").alias("id"))
    return retrieval.aligned(rows, rows, table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), "id")


@query("""SELECT item_key, title, coalesce(citation_key, '') AS citation_key, date_added FROM library_items WHERE item_key IN (SELECT min(item_key) FROM library_items)""")
def item_lookup(spark, d):
    """One item by its key."""
    items = table(spark, d, "library_items")
    key = items.agg(F.min("item_key").alias("item_key"))
    return items.join(F.broadcast(key), "item_key").select("item_key", "title", F.coalesce("citation_key", F.lit("")).alias("citation_key"), "date_added")


@query("""SELECT meta_id, 'Formula on page ' || page_num || CASE WHEN coalesce(section, '') <> '' THEN chr(10) || 'Context: ' || section ELSE '' END || CASE WHEN coalesce(document, '') <> '' AND NOT contains(coalesce(section, ''), document)
  THEN chr(10) || 'Detected formula text: ' || document ELSE '' END || CASE WHEN document IS NOT NULL THEN chr(10) || 'LaTeX: ' || document ELSE '' END AS text FROM chunk_records WHERE chunk_type = 'formula'""")
def formula_texts(spark, d):
    """What each formula is found by."""
    rows = table(spark, d, "chunk_records").where("chunk_type = 'formula'")
    return rows.select("meta_id", retrieval.formula_text(F.col("document"), F.col("page_num"), F.col("section"), F.col("document")).alias("text"))
