"""Queries over library metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import fulltext, library, predicates
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
PART_FIELDS = ["p_name", "p_brand", "p_type", "p_size"]
TAGS = "list_filter(list_transform(string_split(tags, ';'), lambda t: trim(t)), lambda t: t <> '')"


@query("""SELECT p_partkey AS item, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def eav_pivot(spark, d):
    """Part columns as fields of items, and back."""
    return library.pivot_fields(library.to_fields(table(spark, d, "part"), "p_partkey", PART_FIELDS), PART_FIELDS)


@query("""SELECT p_partkey AS item, f.field AS field, f.value AS value FROM part, unnest([
  {'field': 'p_name', 'value': p_name}, {'field': 'p_brand', 'value': p_brand}, {'field': 'p_type', 'value': p_type},
  {'field': 'p_size', 'value': CAST(p_size AS VARCHAR)}]) AS u(f) WHERE f.value IS NOT NULL""")
def eav_fields(spark, d):
    """Part columns as rows of (item, field, value)."""
    return library.to_fields(table(spark, d, "part"), "p_partkey", PART_FIELDS)


@query("""SELECT work_id, CASE WHEN coalesce(len(authors), 0) = 0 THEN '[No Author]' ELSE
  coalesce(authors[1].lastName, '') || CASE WHEN length(authors[1].firstName) > 0 THEN ', ' || authors[1].firstName[1] || '.' ELSE '' END
  || CASE WHEN len(authors) > 1 THEN ' et al.' ELSE '' END END AS display FROM crossref_works""")
def author_display(spark, d):
    """Short form of the authors of each work."""
    return table(spark, d, "crossref_works").select("work_id", library.author_display(F.col("authors")).alias("display"))


@query("""SELECT work_id, coalesce(array_to_string(list_transform(authors, lambda p:
  concat_ws(', ', nullif(p.lastName, ''), nullif(p.firstName, ''))), '; '), '') AS names FROM crossref_works""")
def author_list(spark, d):
    """All authors of each work, in order."""
    return table(spark, d, "crossref_works").select("work_id", library.author_list(F.col("authors")).alias("names"))


@query("""SELECT l_orderkey, string_agg(tag, '; ' ORDER BY tag) AS tags FROM
  (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS tag FROM lineitem) GROUP BY 1""")
def tags_concat(spark, d):
    """Distinct flags of each order, joined."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("tag"))
    return library.joined(rows, "l_orderkey", "tag", "tags")


@query(f"""SELECT tag, count(*) AS items FROM (SELECT item_key, unnest(list_distinct({TAGS})) AS tag FROM library_items) GROUP BY 1""")
def tag_usage(spark, d):
    """How many items carry each tag."""
    return library.usage(table(spark, d, "library_items"), "tags", "tag")


@query(f"""SELECT collection, count(*) AS items FROM
  (SELECT item_key, unnest(list_distinct({TAGS.replace('tags', 'collections')})) AS collection FROM library_items) GROUP BY 1""")
def collection_counts(spark, d):
    """How many items each collection holds."""
    return library.usage(table(spark, d, "library_items"), "collections", "collection")


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth, r_name AS path FROM region UNION ALL
  SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
  SELECT 'c' || c_custkey, 2, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def collection_tree(spark, d):
    """Paths in the tree of regions, nations and customers."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    nodes = region.select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(nation.select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    nodes = nodes.unionByName(customer.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    return library.tree_paths(spark, nodes)


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def attachment_pick(spark, d):
    """One line of each order: flag N first, then the greatest part and supplier."""
    order = (F.when(F.col("l_returnflag") == "N", 0).otherwise(1), F.desc("l_partkey"), F.desc("l_suppkey"))
    return library.pick(table(spark, d, "lineitem"), "l_orderkey", *order).select("l_orderkey", "l_partkey", "l_suppkey")


@query("""SELECT item_key, title FROM library_items WHERE item_key NOT IN (SELECT item_key FROM chunk_records WHERE item_key IS NOT NULL)""")
def live_items_anti(spark, d):
    """Items without any chunk."""
    return table(spark, d, "library_items").select("item_key", "title").join(table(spark, d, "chunk_records"), "item_key", "left_anti")


@query(f"""SELECT i.item_key, coalesce(title, '[No Title]') AS title, coalesce(nullif(authors, ''), '[No Author]') AS authors, coalesce(year, 0) AS year,
  coalesce(publication, '') AS publication, coalesce(journal_quartile, '') AS quartile, len(coalesce({TAGS}, [])) AS n_tags,
  coalesce(n, 0) AS chunks FROM library_items i LEFT JOIN (SELECT item_key, count(*) AS n FROM chunk_records GROUP BY 1) c ON c.item_key = i.item_key""")
def library_scan(spark, d):
    """All items with display defaults and their number of chunks."""
    counts = table(spark, d, "chunk_records").groupBy("item_key").agg(F.count("*").alias("n"))
    return table(spark, d, "library_items").join(counts, "item_key", "left").select(
        "item_key",
        F.coalesce("title", F.lit("[No Title]")).alias("title"),
        F.coalesce(F.nullif("authors", F.lit("")), F.lit("[No Author]")).alias("authors"),
        F.coalesce("year", F.lit(0)).alias("year"),
        F.coalesce("publication", F.lit("")).alias("publication"),
        F.coalesce("journal_quartile", F.lit("")).alias("quartile"),
        F.coalesce(F.size(library.names_of(F.col("tags"))), F.lit(0)).cast("long").alias("n_tags"),
        F.coalesce("n", F.lit(0)).cast("long").alias("chunks"),
    )


def _search(spark, d, conditions, match="all"):
    return predicates.search(table(spark, d, "library_items"), conditions, match).select("item_key", "year")


@query("""SELECT item_key, year FROM library_items WHERE lower(title) LIKE '%model%' AND year > 2010 AND NOT coalesce(lower(publication) = 'turbine biology review', false)""")
def predicate_all(spark, d):
    """Three conditions, all of them."""
    return _search(spark, d, [("title", "contains", "Model"), ("year", "gt", 2010), ("publication", "isNot", "Turbine Biology Review")])


@query("""SELECT item_key, year FROM library_items WHERE coalesce(starts_with(lower(title), 'mapping'), false) OR coalesce(year < 1990, false)
  OR coalesce(CAST(year AS VARCHAR) LIKE '199%', false)""")
def predicate_any(spark, d):
    """Three conditions, any of them."""
    return _search(spark, d, [("title", "beginsWith", "mapping"), ("year", "lt", 1990), ("year", "beginsWith", "199")], "any")


@query("""SELECT item_key, year FROM library_items WHERE lower(publication) IS DISTINCT FROM 'harbour chemistry letters' AND year <> 2017""")
def predicate_is_not_null_rule(spark, d):
    """A null text passes isNot, a null year doesn't."""
    return _search(spark, d, [("publication", "isNot", "Harbour Chemistry Letters"), ("year", "isNot", 2017)])


@query(f"""SELECT item_key, year FROM library_items WHERE len(list_filter({TAGS}, lambda t: lower(t) = 'thesis')) > 0""")
def predicate_tag_exists(spark, d):
    """Items with a tag."""
    return _search(spark, d, [("tags", "is", "Thesis")])


@query(f"""SELECT item_key, year FROM library_items WHERE coalesce(len(list_filter({TAGS}, lambda t: lower(t) = 'imported')), 0) = 0
  AND coalesce(len(list_filter({TAGS.replace('tags', 'collections')}, lambda t: starts_with(lower(t), 'a'))), 0) = 0""")
def predicate_tag_not_exists(spark, d):
    """Items without a tag, in no collection of that beginning."""
    items = _search(spark, d, [("tags", "isNot", "imported")])
    return items.join(_search(spark, d, [("collections", "beginsWith", "a")]), "item_key", "left_anti")


@query("""SELECT item_key, year FROM library_items WHERE coalesce(year, 0) >= 2000 AND year <= 2012""")
def predicate_year_range(spark, d):
    """Bounds that a null year fails."""
    return table(spark, d, "library_items").where(predicates.years(F.col("year"), 2000, 2012)).select("item_key", "year")


@query("""SELECT doc_id FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents)
  WHERE w IN ('the', 'lattice', 'embankment') GROUP BY doc_id HAVING count(DISTINCT w) = 3""")
def fulltext_and(spark, d):
    """Documents with three words."""
    words = ["the", "Lattice", "embankment"]
    return fulltext.all_words(fulltext.postings(table(spark, d, "documents"), "doc_id", "text", words), words).withColumnRenamed("id", "doc_id")


@query("""SELECT doc_id, count(DISTINCT w) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents)
  WHERE w IN ('lattice', 'vegetation', 'böschung', 'cohort') GROUP BY doc_id""")
def fulltext_or(spark, d):
    """Documents with any of four words, and how many of them."""
    words = ["lattice", "vegetation", "Böschung", "cohort"]
    return fulltext.any_word(fulltext.postings(table(spark, d, "documents"), "doc_id", "text", words), words).withColumnRenamed("id", "doc_id")


@query("""SELECT w AS word, count(*) AS documents FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents)
  WHERE w <> '' GROUP BY 1""")
def word_documents(spark, d):
    """In how many documents each word stands."""
    return fulltext.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("word").agg(F.count("*").alias("documents"))


@query("""SELECT item_key, date_added, (SELECT count(*) FROM library_items) AS total FROM library_items ORDER BY date_added DESC, item_key LIMIT 50 OFFSET 100""")
def overview_page(spark, d):
    """A page of the items added last, with the total."""
    items = table(spark, d, "library_items").select("item_key", "date_added")
    return library.page(items, [F.desc("date_added"), F.col("item_key")], 100, 50)


@query("""SELECT year, count(*) AS items FROM library_items WHERE year > 1000 GROUP BY 1""")
def year_histogram(spark, d):
    """Items of each year."""
    return library.year_histogram(table(spark, d, "library_items"))


@query("""SELECT publication, count(*) AS items FROM library_items WHERE publication <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def top_journals(spark, d):
    """The twenty publications with most items."""
    return table(spark, d, "library_items").where("publication <> ''").groupBy("publication").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "publication").limit(20)


@query("""WITH r AS (SELECT count(*) AS items, min(year) FILTER (year > 1000) AS min_year,
  count(*) FILTER (year > 1000 AND year < 2015) / greatest(count(*) FILTER (year > 1000), 1) AS old_share,
  count(*) FILTER (regexp_matches(coalesce(tags, ''), '(?i)survey|review')) / greatest(count(*), 1) AS survey_share FROM library_items)
  SELECT *, coalesce(min_year >= 2015, false) OR old_share < 0.05 AS lacks_old, survey_share < 0.05 AS lacks_surveys FROM r""")
def coverage_gaps(spark, d):
    """What the library lacks: older works, surveys."""
    return library.coverage_gaps(table(spark, d, "library_items"))


@query("""SELECT CASE WHEN c.n IS NULL THEN 'no chunks' WHEN c.empty = c.n THEN 'empty' ELSE 'indexed' END AS state, count(*) AS items,
  CAST(coalesce(sum(c.n), 0) AS BIGINT) AS chunks FROM library_items i LEFT JOIN (SELECT item_key, count(*) AS n,
  count(*) FILTER (coalesce(trim(document), '') = '') AS empty FROM chunk_records GROUP BY 1) c USING (item_key) GROUP BY 1""")
def library_diagnostics(spark, d):
    """Items by the state of their text."""
    chunks = table(spark, d, "chunk_records").groupBy("item_key").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("document"), F.lit("")) == "").alias("empty")
    )
    state = F.when(F.col("n").isNull(), "no chunks").when(F.col("empty") == F.col("n"), "empty").otherwise("indexed")
    joined = table(spark, d, "library_items").select("item_key").join(chunks, "item_key", "left")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


@query("""SELECT item_key, CASE WHEN length(title) <= 60 THEN title ELSE left(title, 57) || '...' END AS title FROM library_items""")
def truncated_titles(spark, d):
    """Titles cut to sixty characters."""
    return table(spark, d, "library_items").select("item_key", library.truncated(F.col("title"), 60).alias("title"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '(?i)\\bsediment\\b') AND regexp_matches(coalesce(text, ''), '(?i)\\bacross\\b')""")
def required_terms(spark, d):
    """Documents with two whole words."""
    return table(spark, d, "documents").where(predicates.has_words(F.col("text"), ["sediment", "Across"])).select("doc_id")
