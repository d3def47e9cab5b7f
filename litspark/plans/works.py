"""Queries of works and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import works
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)


@query("""SELECT candidate_id, CASE WHEN regexp_matches(x, '^(https?://)?(dx\\.)?doi\\.[a-z]+/|^doi:') THEN 'doi' WHEN regexp_matches(x, 'arxiv\\.[a-z]+/(abs|pdf)/|^arxiv:') THEN 'arxiv' WHEN regexp_matches(x, '^10\\.[0-9]{4,}/\\S+$') THEN 'doi'
  WHEN regexp_matches(x, '^[0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?$|^[a-z-]+(\\.[a-z]{2})?/[0-9]{7}(v[0-9]+)?$') THEN 'arxiv' WHEN regexp_matches(x, '^[0-9a-f]{40}$') THEN 's2' END AS kind
  FROM (SELECT candidate_id, lower(regexp_replace(coalesce(arxiv_id, doi), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS x FROM ingest_candidates)""")
def identifier_kind(spark, d):
    """What kind of identifier each candidate names."""
    rows = table(spark, d, "ingest_candidates")
    return rows.select("candidate_id", works.identifier_kind(F.coalesce("arxiv_id", "doi")).alias("kind"))


_ARXIV = "(?i)arxiv\\.[a-z]+/(?:abs|pdf)/([a-z-]+(?:\\.[a-z]{2})?/[0-9]{7}|[0-9]{4}\\.[0-9]{4,5})"


@query(f"""SELECT candidate_id, coalesce(nullif(regexp_extract(arxiv_id, '{_ARXIV}', 1), ''), nullif(regexp_extract('https://arxiv.example/pdf/' || arxiv_id || '.pdf?x=1', '{_ARXIV}', 1), '')) AS arxiv FROM ingest_candidates""")
def arxiv_addresses(spark, d):
    """The arXiv id in the addresses of each candidate."""
    rows = table(spark, d, "ingest_candidates")
    made = F.concat(F.lit("https://arxiv.example/pdf/"), "arxiv_id", F.lit(".pdf?x=1"))
    return rows.select("candidate_id", works.arxiv_of_addresses(F.col("arxiv_id"), made).alias("arxiv"))


_ASKED = "SELECT work_id, CASE WHEN year % 3 = 0 THEN 'Author: ' || coalesce(authors[1].lastName, '') || ' | ' || title WHEN year % 3 = 1 THEN 'author:' || coalesce(authors[1].lastName, '') ELSE title END AS q FROM crossref_works WHERE year IS NOT NULL AND title IS NOT NULL"


def _asked(spark, d):
    rows = table(spark, d, "crossref_works").where("year is not null and title is not null")
    name = F.coalesce(F.get("authors", F.lit(0))["lastName"], F.lit(""))
    q = F.when(F.col("year") % 3 == 0, F.concat(F.lit("Author: "), name, F.lit(" | "), "title")).when(F.col("year") % 3 == 1, F.concat(F.lit("author:"), name)).otherwise(F.col("title"))
    return rows.select("work_id", q.alias("q"))


@query(f"""SELECT work_id, CASE WHEN p AND r <> '' THEN trim(string_split(r, '|')[1]) END AS author, CASE WHEN p THEN trim(CASE WHEN strpos(r, '|') > 0 THEN substr(r, strpos(r, '|') + 1) ELSE '' END) ELSE q END AS topic
  FROM (SELECT work_id, q, starts_with(lower(q), 'author:') AS p, trim(substr(q, 8)) AS r FROM ({_ASKED}))""")
def author_query(spark, d):
    """Author and topic of queries of three forms."""
    author, topic = works.author_of_query(F.col("q"))
    return _asked(spark, d).select("work_id", author.alias("author"), topic.alias("topic"))


@query(f"""SELECT work_id, trim(q) <> '' AND NOT (regexp_matches(q, '(?i)^\\s*author:|10\\.[0-9]{{4,}}/|^\\s*doi:') OR contains(q, '"') OR regexp_matches(q, ' (AND|OR) ')) AS natural FROM ({_ASKED})""")
def natural_query(spark, d):
    """Whether a query is words of a language."""
    return _asked(spark, d).select("work_id", works.natural_query(F.col("q")).alias("natural"))


@query("""SELECT result_id, CASE WHEN regexp_matches(t, '^[0-9]+(\\.[0-9]+)?$') THEN CAST(t AS DOUBLE) ELSE CAST(coalesce(nullif(regexp_extract(t, '(?i)retry[-_]?delay\\W{1,4}([0-9]+(?:\\.[0-9]+)?)', 1), ''),
  nullif(regexp_extract(t, '(?i)retry[-_]?after\\W{1,4}([0-9]+(?:\\.[0-9]+)?)', 1), '')) AS DOUBLE) END AS seconds FROM (SELECT result_id, trim(CASE WHEN status = 'saved' THEN enqueue_time_s::INTEGER::VARCHAR WHEN status = 'blocked'
  THEN 'code 429, retryDelay: "' || doi || '42s"' ELSE 'Retry-After: ' || result_id END) AS t FROM ingest_routing_results)""")
def retry_seconds(spark, d):
    """Seconds that made-up errors of three forms name."""
    detail = F.expr("""case when status = 'saved' then cast(cast(bround(enqueue_time_s, 0) as int) as string) when status = 'blocked' then concat('code 429, retryDelay: "', doi, '42s"') else concat('Retry-After: ', result_id) end""")
    return table(spark, d, "ingest_routing_results").select("result_id", works.retry_seconds(detail).alias("seconds"))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT doc_id, CASE WHEN length(w) <= 600 THEN w ELSE coalesce(nullif({_TRIM.format("regexp_replace(substr(w, 1, 600), chr(10) || '[^' || chr(10) || ']*$', '')")}, ''), {_TRIM.format('substr(w, 1, 600)')}) END AS text
  FROM (SELECT doc_id, {_TRIM.format("coalesce(text, '')")} AS w FROM documents)""")
def cut_at_line(spark, d):
    """Documents cut to six hundred characters at a line break."""
    return table(spark, d, "documents").select("doc_id", works.cut_at_line(F.col("text"), 600).alias("text"))


@query("SELECT publisher, make_date(min(year), 1, 1) AS first_day, make_date(max(year), 12, 31) AS last_day FROM crossref_works WHERE year > 0 GROUP BY 1")
def year_dates(spark, d):
    """The first and the last day of each publisher's years."""
    years = table(spark, d, "crossref_works").where("year > 0").groupBy("publisher").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    first, last = works.year_dates(F.col("a"), F.col("b"))
    return years.select("publisher", first.alias("first_day"), last.alias("last_day"))


@query("""SELECT item_key, coalesce(date_diff('second', date_trunc('second', date_added), (SELECT date_trunc('second', max(date_added)) FROM library_items)) <= 86400, true) AS recent FROM library_items""")
def save_window(spark, d):
    """Whether an item was added within a day of the newest; items without a time pass."""
    items = table(spark, d, "library_items")
    now = items.agg(F.max("date_added").alias("now"))
    text = F.concat(F.date_format("date_added", "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    return items.crossJoin(F.broadcast(now)).select("item_key", works.within_window(text, F.col("now"), 86_400).alias("recent"))


@query("""SELECT work_id FROM crossref_works WHERE publisher IN ('Pinemoor University Press', 'Tessera Open Journals') AND oa_url IS NOT NULL AND coalesce(doi, '') <> '' AND year >= 1990 AND year <= 2015 AND len(list_filter(authors, lambda a: contains(lower(coalesce(a.lastName, '')), 'en'))) > 0""")
def work_filter(spark, d):
    """Open works of two publishers by years and author."""
    found = works.work_filter(table(spark, d, "crossref_works"), ("Pinemoor University Press", "Tessera Open Journals"), True, True, (1990, 2015), "EN")
    return found.select("work_id")


_RANKED = "SELECT work_id, coalesce(len(authors), 0) AS cited, oa_url IS NOT NULL AS top, CAST(coalesce(year, 0) AS DOUBLE) AS relevance FROM crossref_works"


def _scored(spark, d):
    return table(spark, d, "crossref_works").select(
        "work_id", F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).alias("cited"), F.col("oa_url").isNotNull().alias("top"), F.coalesce("year", F.lit(0)).cast("double").alias("relevance")
    )


@query(f"SELECT work_id, CAST(row_number() OVER (ORDER BY cited DESC, top DESC, relevance DESC, work_id) AS INTEGER) AS position FROM ({_RANKED}) QUALIFY position <= 100")
def work_rank(spark, d):
    """The first hundred works by three keys."""
    return works.ranked(_scored(spark, d), "cited", "top", "relevance", "work_id", 100).select("work_id", "position")


@query(f"SELECT work_id, relevance FROM ({_RANKED}) WHERE relevance < 2005 OR (relevance = 2005 AND work_id > 300) ORDER BY relevance DESC, work_id LIMIT 50")
def page_after(spark, d):
    """The fifty works after a given one, newest first."""
    return works.page_after(_scored(spark, d), "relevance", "work_id", (2005.0, 300), 50).select("work_id", "relevance")


@query("""SELECT DISTINCT c.publisher AS name, k.id, k.id IS NOT NULL AS resolved FROM ingest_candidates c LEFT JOIN (SELECT lower(trim(publisher)) AS low, min(work_id) AS id FROM crossref_works GROUP BY 1) k ON k.low = lower(trim(c.publisher)) WHERE c.publisher IS NOT NULL""")
def names_resolved(spark, d):
    """Publishers of candidates by the first work of that publisher, with those that have none."""
    return works.names_resolved(table(spark, d, "ingest_candidates"), "publisher", table(spark, d, "crossref_works"), "publisher", "work_id")


_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+')), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'into'))"


@query(f"""WITH p AS (SELECT r.result_id AS ask_id, l.item_key AS item, count(*) AS overlap FROM (SELECT result_id, unnest({_WORDS.replace('title', 'result_title')}) AS w FROM ingest_routing_results) r
  JOIN (SELECT item_key, unnest({_WORDS}) AS w FROM library_items) l USING (w) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY overlap DESC, item DESC) AS k, lead(overlap) OVER (PARTITION BY ask_id ORDER BY overlap DESC, item DESC) AS nxt FROM p)
  SELECT ask_id, item, overlap FROM o WHERE k = 1 AND overlap >= 3 AND overlap >= 2 * coalesce(nxt, 0)""")
def titles_resolved(spark, d):
    """The item that each saved title means by its words, where it is clear."""
    asked = table(spark, d, "ingest_routing_results").select(F.col("result_id").alias("ask_id"), F.col("result_title").alias("title"))
    return works.titles_resolved(asked, table(spark, d, "library_items").select(F.col("item_key").alias("item"), "title"))


@query("""SELECT openalex_id AS key, min(candidate_id) AS first, coalesce(array_to_string(list_sort(list(DISTINCT publisher) FILTER (publisher IS NOT NULL)), ', '), '') AS sources, count(*) AS copies FROM ingest_candidates WHERE openalex_id IS NOT NULL GROUP BY 1""")
def best_candidates(spark, d):
    """The first candidate of each external key, with the publishers of all."""
    rows = table(spark, d, "ingest_candidates").withColumnRenamed("openalex_id", "key")
    return works.best_of_key(rows, "key", "candidate_id", "publisher")


@query("""WITH c AS (SELECT work_id, publisher, coalesce(len(abstract), 0) AS v FROM crossref_works WHERE publisher IS NOT NULL), t AS (SELECT publisher, greatest(list(v ORDER BY v)[CAST(floor(count(*) * 0.75) AS INTEGER) + 1], 10) AS bound FROM c GROUP BY 1 HAVING count(*) >= 5)
  SELECT work_id, coalesce(v >= bound, false) AS top FROM c LEFT JOIN t USING (publisher)""")
def batch_quartile(spark, d):
    """Works in the upper quarter of their publisher's by the length of the abstract."""
    rows = table(spark, d, "crossref_works").where("publisher is not null").select("work_id", "publisher", F.coalesce(F.length("abstract"), F.lit(0)).alias("v"))
    return works.above_upper_quartile(rows, "publisher", "v").select("work_id", "top")


@query("""SELECT id, coalesce(array_to_string(list_filter(CASE WHEN json_valid(headers_json) AND json_type(headers_json) = 'ARRAY' THEN CAST(CAST(headers_json AS JSON) AS VARCHAR[]) ELSE list_transform(string_split(coalesce(headers_json, ''), ','), lambda x: trim(x)) END,
  lambda x: x IS NOT NULL AND trim(x) <> ''), '|'), '') AS headers FROM vision_agent_results""")
def json_lists(spark, d):
    """Headers of tables from JSON lists."""
    return table(spark, d, "vision_agent_results").select("id", F.array_join(works.json_texts(F.col("headers_json")), "|").alias("headers"))


@query("""SELECT id, CASE WHEN parse_success = 1 THEN CAST(id AS BIGINT) END AS found, CASE WHEN parse_success = 1 THEN coalesce(model, '') END AS model FROM vision_agent_results""")
def model_answers(spark, d):
    """The object in answers that hold one between other text; failed ones have none."""
    text = F.concat(F.lit('Here it is:\n```json\n{"id": '), "id", F.lit(', "model": "'), F.coalesce("model", F.lit("")), F.lit('"}\n```'))
    answer = F.when(F.col("parse_success") == 1, text).otherwise(F.lit("```json"))
    found = works.first_object(answer, "id bigint, model string")
    return table(spark, d, "vision_agent_results").select("id", found["id"].alias("found"), found["model"].alias("model"))


@query("""SELECT coalesce(MAP {'journalArticle': 'journal-article', 'preprint': 'posted-content', 'conferencePaper': 'proceedings-article', 'bookSection': 'book-chapter', 'book': 'book', 'thesis': 'dissertation', 'report': 'report', 'dataset': 'dataset'}[item_type], 'other') AS kind, count(*) AS works FROM crossref_works GROUP BY 1""")
def external_types(spark, d):
    """Works of each external type."""
    return table(spark, d, "crossref_works").groupBy(works.external_type(F.col("item_type")).alias("kind")).agg(F.count("*").alias("works"))


@query("SELECT coalesce(quartile, 'unknown') AS quartile, count(*) AS venues FROM (SELECT title_normalized, max(quartile) AS quartile FROM scimago_titles GROUP BY 1) GROUP BY 1")
def quartile_counts(spark, d):
    """Venues of each quartile; a repeated venue counts once."""
    venues = table(spark, d, "scimago_titles").groupBy("title_normalized").agg(F.max("quartile").alias("quartile"))
    return venues.groupBy(F.coalesce("quartile", F.lit("unknown")).alias("quartile")).agg(F.count("*").alias("venues"))
