"""Queries of notes and feeds; documents of the library are the notes, and the other sources the feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import notes
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)


def _notes(spark, d):
    return table(spark, d, "documents").where("source = 'library_notes'")


@query("""SELECT doc_id, item_key, CAST(row_number() OVER (ORDER BY added_at DESC, doc_id) AS INTEGER) AS position FROM documents WHERE source = 'library_notes' AND contains(lower(text), 'sediment') QUALIFY position <= 50""")
def notes_search(spark, d):
    """The newest notes that hold a word."""
    return notes.notes_search(_notes(spark, d), "Sediment", 50).select("doc_id", "item_key", "position")


@query("""SELECT item_key, count(*) AS notes, max(added_at) AS newest FROM documents WHERE source = 'library_notes' AND item_key IS NOT NULL GROUP BY 1""")
def notes_by_item(spark, d):
    """How many notes an item has, and the time of the newest."""
    rows = _notes(spark, d).where("item_key is not null")
    return rows.groupBy("item_key").agg(F.count("*").alias("notes"), F.max("added_at").alias("newest"))


@query("""SELECT work_id, trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(title, '<(?:!--.*?--|[/!?]?[a-zA-Z][^<>]*)>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&'),
  ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288) || chr(8239) || chr(8201)) AS title FROM crossref_works WHERE title IS NOT NULL""")
def plain_titles(spark, d):
    """Titles without markup and with entities decoded."""
    return table(spark, d, "crossref_works").where("title is not null").select("work_id", notes.plain_text("title").alias("title"))


@query("""SELECT item_key, title, origin FROM (SELECT item_key, result_title AS title, 'result' AS origin, 1 AS r FROM ingest_routing_results WHERE result_title IS NOT NULL AND item_key IS NOT NULL
  UNION ALL SELECT item_key, title, 'library', 0 FROM library_items) QUALIFY row_number() OVER (PARTITION BY item_key ORDER BY r DESC, title DESC NULLS LAST) = 1""")
def sources_merged(spark, d):
    """Titles of items from the library and from the results of saving them, of which the latter win."""
    results = table(spark, d, "ingest_routing_results").where("result_title is not null").select("item_key", F.col("result_title").alias("title"))
    return notes.merged(table(spark, d, "library_items"), results, "item_key", ["title"], "library", "result")


@query("""SELECT s.source, count(x.doc_id) AS items FROM source_weights s LEFT JOIN (SELECT * FROM documents WHERE item_key IS NULL) x USING (source) GROUP BY 1""")
def feed_counts(spark, d):
    """The documents of each source that belong to no item."""
    feeds = table(spark, d, "source_weights").select("source")
    return notes.counted(feeds, table(spark, d, "documents").where("item_key is null"), "source")


@query("""SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY added_at DESC, doc_id) AS INTEGER) AS position FROM documents QUALIFY position <= 20""")
def feed_items(spark, d):
    """The twenty newest documents of each source."""
    return notes.newest_of_each(table(spark, d, "documents"), "source", "added_at", "doc_id", 20).select("source", "doc_id", "position")


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""SELECT doc_id, CASE WHEN coalesce(section, '') <> '' THEN '<h1>' || {_ESCAPED.format('section')} || '</h1>' ELSE '' END || array_to_string(list_transform(list_filter(list_transform(
  regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> ''), lambda p: '<p>' || replace({_ESCAPED.format('p')}, chr(10), '<br/>') || '</p>'), '') AS html
  FROM documents WHERE source = 'library_notes'""")
def note_html(spark, d):
    """Notes as HTML under the name of their section."""
    return _notes(spark, d).select("doc_id", notes.paragraphs(F.col("text"), F.col("section")).alias("html"))
