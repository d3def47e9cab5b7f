"""Queries over vectors and passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.functions import embedding
from litspark.operators import vectors
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
# The sections and quartiles that stand for the labels of the test vectors.
SECTIONS = ("results", "conclusion", "methods", "abstract", "background", "discussion", "introduction", "preamble", "appendix", "other")
QUARTILES = ("Q1", "Q2", "Q3", "Q4", None)

_COS = "round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6)"
_KNN = f"""SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score, e.label AS label FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 %s)) WHERE rank <= %d"""
_WEIGHTED = f"""SELECT *, CASE id % 5 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' WHEN 3 THEN 'Q4' END AS quartile,
  ['results','conclusion','methods','abstract','background','discussion','introduction','preamble','appendix','other'][l.label + 1] AS section
  FROM ({_KNN.replace('%s', '').replace('%d', '50')}) k JOIN (SELECT vec_id, label FROM embeddings) l ON l.vec_id = k.id"""
_COMPOSITE = "pow(greatest(score, 0), 0.7) * %s * CASE quartile WHEN 'Q1' THEN 1.0 WHEN 'Q2' THEN 0.85 WHEN 'Q3' THEN 0.65 WHEN 'Q4' THEN 0.45 ELSE 0.7 END"
_BY_SECTION = "CASE section WHEN 'results' THEN 1.0 WHEN 'conclusion' THEN 1.0 WHEN 'methods' THEN 0.85 WHEN 'abstract' THEN 0.75 WHEN 'background' THEN 0.7 WHEN 'discussion' THEN 0.65 WHEN 'introduction' THEN 0.5 WHEN 'preamble' THEN 0.3 WHEN 'appendix' THEN 0.3 ELSE 0.7 END"
_KNN = _KNN.replace("q.vec_id % 100", "q.vec_id %% 100")


def _hits(spark, d, k, where=None):
    rows = table(spark, d, "embeddings")
    found = rows if where is None else rows.where(where)
    return vectors.nearest(found, rows.where("vec_id % 100 = 0"), k)


def _described(spark, d, k=50):
    """Hits with the section and quartile that their label and id stand for."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    section = F.try_element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("label") + 1)
    quartile = F.try_element_at(F.array(*[F.lit(q) for q in QUARTILES]), (F.col("id") % 5 + 1).cast("int"))
    return _hits(spark, d, k).join(labels, "id").withColumn("section", section).withColumn("quartile", quartile)


@query(_KNN % ("", 10))
def knn_topk(spark, d):
    """The ten nearest rows of every hundredth vector."""
    return _hits(spark, d, 10)


@query(_KNN % ("AND e.label IN (1, 3, 5)", 5))
def knn_topk_filtered(spark, d):
    """The five nearest rows with some labels."""
    return _hits(spark, d, 5, "label in (1, 3, 5)")


@query(f"SELECT query_id, id, rank, round({_COMPOSITE % _BY_SECTION}, 6) AS composite FROM ({_WEIGHTED}) WHERE {_COMPOSITE % _BY_SECTION} > 0")
def rerank_composite(spark, d):
    """Hits weighed by section and venue."""
    out = vectors.rerank(_described(spark, d))
    return out.select("query_id", "id", "rank", F.round("composite", 6).alias("composite"))


_OVERRIDE = "CASE section WHEN 'abstract' THEN 1.0 WHEN 'other' THEN 0.2 ELSE " + _BY_SECTION + " END"


@query(f"SELECT query_id, id, rank, round({_COMPOSITE % _OVERRIDE}, 6) AS composite FROM ({_WEIGHTED}) WHERE {_COMPOSITE % _OVERRIDE} > 0")
def rerank_weight_override(spark, d):
    """Hits weighed with overrides, one of them over 1."""
    out = vectors.rerank(_described(spark, d), sections={"abstract": 3, "other": 0.2})
    return out.select("query_id", "id", "rank", F.round("composite", 6).alias("composite"))


@query(f"SELECT query_id, count(*) AS hits FROM ({_WEIGHTED}) WHERE {_COMPOSITE % _BY_SECTION} > 0 AND section NOT IN ('results', 'preamble') GROUP BY 1")
def rerank_zero_weight_excludes(spark, d):
    """A weight of 0 leaves a section out."""
    out = vectors.rerank(_described(spark, d), sections={"results": 0, "preamble": 0})
    return out.groupBy("query_id").agg(F.count("*").alias("hits"))


@query(f"""SELECT query_id, doc, round(avg(c), 6) AS avg_composite, round(max(c), 6) AS best_composite, count(*) AS hits, round(avg(score), 6) AS avg_score,
  arg_max(id, (c, -rank)) AS best_id FROM (SELECT *, id % 50 AS doc, {_COMPOSITE % _BY_SECTION} AS c FROM ({_WEIGHTED})) WHERE c > 0 GROUP BY 1, 2""")
def topic_rank(spark, d):
    """Hits gathered by document."""
    hits = vectors.rerank(_described(spark, d)).withColumn("doc", F.col("id") % 50)
    out = vectors.topics(hits, ["query_id", "doc"])
    return out.select("query_id", "doc", *[F.round(c, 6).alias(c) for c in ("avg_composite", "best_composite", "avg_score")], "hits", "best_id")


@query("""SELECT item_key, chunk_type, chunk_index, meta_id FROM (SELECT *, row_number() OVER (PARTITION BY item_key, chunk_type, chunk_index
  ORDER BY section_confidence DESC NULLS LAST, meta_id) AS rn FROM chunk_records) WHERE rn = 1""")
def merge_best_chunk(spark, d):
    """The most confident record of each chunk."""
    rows = table(spark, d, "chunk_records").select("item_key", "chunk_type", "chunk_index", "meta_id", "section_confidence")
    return vectors.best_of(rows, ["item_key", "chunk_type", "chunk_index"], "section_confidence", F.col("meta_id")).drop("section_confidence")


_TEXTS = "SELECT item_key AS doc, chunk_index AS idx, arg_min(document, meta_id) AS text FROM chunk_records WHERE chunk_type = 'text' AND document IS NOT NULL GROUP BY 1, 2"


def _texts(spark, d):
    rows = table(spark, d, "chunk_records").where("chunk_type = 'text' and document is not null")
    return rows.groupBy(F.col("item_key").alias("doc"), F.col("chunk_index").alias("idx")).agg(F.min_by("document", "meta_id").alias("text"))


@query(f"""WITH t AS ({_TEXTS}) SELECT c.doc, c.idx, coalesce(string_agg(n.text, chr(10) || chr(10) ORDER BY n.idx) FILTER (n.idx < c.idx), '') AS before, any_value(c.text) AS text,
  coalesce(string_agg(n.text, chr(10) || chr(10) ORDER BY n.idx) FILTER (n.idx > c.idx), '') AS after FROM t c LEFT JOIN t n
  ON n.doc = c.doc AND n.idx BETWEEN c.idx - 2 AND c.idx + 2 AND n.idx <> c.idx GROUP BY c.doc, c.idx""")
def adjacent_context(spark, d):
    """Each text chunk with two chunks on either side."""
    return vectors.adjacent(_texts(spark, d), 2)


@query(f"""WITH t AS ({_TEXTS}) SELECT c.doc, c.idx, string_agg(n.text, chr(10) || chr(10) ORDER BY n.idx) AS merged FROM t c JOIN t n
  ON n.doc = c.doc AND n.idx BETWEEN c.idx - 1 AND c.idx + 1 GROUP BY c.doc, c.idx""")
def full_context_merge(spark, d):
    """Each text chunk and its neighbours as one text."""
    return vectors.merged(_texts(spark, d), 1)


@query("""SELECT section, chunk_type, count(*) AS chunks, count(DISTINCT item_key) AS items FROM chunk_records
  WHERE chunk_type IN ('text', 'table') AND (section IS NULL OR section <> 'references') GROUP BY 1, 2""")
def year_type_filter(spark, d):
    """Chunks of two types outside the references, by section."""
    rows = table(spark, d, "chunk_records").where("chunk_type in ('text', 'table') and (section is null or section <> 'references')")
    return rows.groupBy("section", "chunk_type").agg(F.count("*").alias("chunks"), F.count_distinct("item_key").alias("items"))


@query("""SELECT meta_id, c.item_key FROM chunk_records c SEMI JOIN (SELECT item_key FROM library_items WHERE year >= 2015) i ON c.item_key = i.item_key
  WHERE coalesce(section, '') <> ''""")
def live_semi_join(spark, d):
    """Chunks of items that are in the library and recent."""
    items = table(spark, d, "library_items").where("year >= 2015").select("item_key")
    return table(spark, d, "chunk_records").where("coalesce(section, '') <> ''").select("meta_id", "item_key").join(items, "item_key", "left_semi").select("meta_id", "item_key")


@query()
def passage_search(spark, d):
    """The five passages nearest to every hundredth one, by hashed embeddings, weighed by section and venue."""
    chunks = table(spark, d, "chunk_records").where("chunk_type = 'text' and document <> ''").select("meta_id", "item_key", "section", "document")
    rows = embedding.embedded(chunks, "document")
    hits = vectors.nearest(rows.select("meta_id", "embedding"), rows.where("meta_id % 100 = 0").select("meta_id", "embedding"), 5, "meta_id")
    venues = table(spark, d, "library_items").select("item_key", F.col("journal_quartile").alias("quartile"))
    named = hits.join(chunks.select(F.col("meta_id").alias("id"), "item_key", "section"), "id").join(venues, "item_key", "left")
    return vectors.rerank(named).select("query_id", "id", "rank", "section", F.round("composite", 6).alias("composite"))
