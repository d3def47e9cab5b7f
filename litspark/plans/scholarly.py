"""Queries over works, candidates, venues and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.functions import identifiers
from litspark.operators import scholar
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
_DOI = r"""nullif(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '^https?://(dx\.)?doi\.[a-z]+/', ''), '^doi:[\s\p{{Z}}]*', ''), '')"""
_ARXIV = r"""nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '^(arxiv:\s*|https?://(www\.)?arxiv\.[a-z]+/(abs|pdf)/)', ''), '\.pdf$', ''), 'v[0-9]+$', ''), '')"""
_HOST = r"""regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\.', '')"""


@query(f"SELECT candidate_id, d AS doi, coalesce(regexp_matches(d, '^10\\.[0-9]{{4,}}/\\S+$'), false) AS valid FROM (SELECT candidate_id, {_DOI.format('doi')} AS d FROM ingest_candidates)")
def doi_normalise(spark, d):
    """DOIs in the library's form, and whether they are complete."""
    rows = table(spark, d, "ingest_candidates").select("candidate_id", identifiers.doi(F.col("doi")).alias("doi"))
    return rows.withColumn("valid", identifiers.is_doi(F.col("doi")))


@query(f"SELECT candidate_id, {_ARXIV.format('arxiv_id')} AS arxiv FROM ingest_candidates")
def arxiv_normalise(spark, d):
    """arXiv ids in the library's form."""
    return table(spark, d, "ingest_candidates").select("candidate_id", identifiers.arxiv(F.col("arxiv_id")).alias("arxiv"))


@query(f"""WITH w AS (SELECT {_DOI.format('doi')} AS k, min(work_id) AS work_id FROM crossref_works GROUP BY 1) SELECT c.candidate_id, w.work_id FROM ingest_candidates c JOIN w ON w.k = {_DOI.format('c.doi')}
  WHERE regexp_matches(w.k, '^10\\.[0-9]{{4,}}/\\S+$')""")
def local_duplicate(spark, d):
    """Candidates whose DOI a work has."""
    key = identifiers.doi(F.col("doi")).alias("k")
    works = table(spark, d, "crossref_works").select(key, "work_id").where(identifiers.is_doi(F.col("k"))).groupBy("k").agg(F.min("work_id").alias("work_id"))
    return table(spark, d, "ingest_candidates").select("candidate_id", key).join(works, "k").select("candidate_id", "work_id")


@query("""SELECT work_id, coalesce(array_to_string(list_transform(authors[1:5], lambda p: concat_ws(' ', nullif(p.firstName, ''), nullif(p.lastName, ''))), '; '), '') AS first_authors,
  CAST(coalesce(len(authors), 0) AS BIGINT) AS n_authors, coalesce(journal, '') AS venue, year, coalesce(doi, '') <> '' AS has_doi, oa_url IS NOT NULL AS is_open FROM crossref_works""")
def work_flatten(spark, d):
    """Works as flat rows."""
    return scholar.flat_work(table(spark, d, "crossref_works"))


@query("""SELECT work_id, array_to_string(regexp_split_to_array(trim(abstract), '\\s+'), ' ') AS text FROM crossref_works WHERE abstract IS NOT NULL""")
def abstract_rebuild(spark, d):
    """Abstracts taken apart into word positions and put together again."""
    index = scholar.inverted_index(table(spark, d, "crossref_works"), "work_id", "abstract")
    return index.select(F.col("id").alias("work_id"), scholar.rebuilt(F.col("index")).alias("text"))


@query("""SELECT publisher, greatest(v[CAST(floor(len(v) * 0.75) AS BIGINT) + 1], 10.0) AS threshold FROM (SELECT publisher, list(total_time_s ORDER BY total_time_s) AS v FROM ingest_routing_results WHERE total_time_s IS NOT NULL GROUP BY 1) WHERE len(v) >= 5""")
def top_venue_relative(spark, d):
    """Upper quartile of the times of each publisher."""
    return scholar.upper_quartile(table(spark, d, "ingest_routing_results"), "publisher", "total_time_s", 10.0)


@query(f"""SELECT key, min(candidate_id) AS first_id, count(*) AS copies, coalesce(string_agg(DISTINCT publisher, '; ' ORDER BY publisher), '') AS sources FROM (SELECT *, coalesce('0:' || {_DOI.format('doi')}, '1:' || openalex_id, '2:' || {_ARXIV.format('arxiv_id')}, '3:' || landing_page_url, '4:' || oa_url,
  '5:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS key FROM ingest_candidates) WHERE key IS NOT NULL GROUP BY 1""")
def candidate_dedup(spark, d):
    """Candidates by their first identifier."""
    keys = [identifiers.doi(F.col("doi")), F.col("openalex_id"), identifiers.arxiv(F.col("arxiv_id")), F.col("landing_page_url"), F.col("oa_url"), identifiers.title_key(F.col("title"))]
    return scholar.deduplicated(table(spark, d, "ingest_candidates"), keys, "candidate_id", "publisher")


_EDGES = "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _edges(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return scholar.edges_between((orders, "o_custkey", "o_orderkey"), (lines, "l_orderkey", "l_suppkey"))


@query(f"SELECT src, dst FROM ({_EDGES})")
def citations_out(spark, d):
    """Which suppliers each customer draws on."""
    return _edges(spark, d)


@query(f"SELECT dst AS node, count(*) AS cited_by, min(src) AS first_citing FROM ({_EDGES}) GROUP BY 1")
def citations_in(spark, d):
    """By how many customers each supplier is drawn on."""
    return _edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("cited_by"), F.min("src").alias("first_citing"))


@query(f"""WITH e AS ({_EDGES}), n AS (SELECT dst, count(*) AS n FROM e GROUP BY 1) SELECT src, count(*) AS out_degree, CAST(sum(n.n) AS BIGINT) AS reach FROM e JOIN n ON n.dst = e.dst GROUP BY 1""")
def citation_counts(spark, d):
    """References of each customer, and how often those are referred to."""
    e = _edges(spark, d)
    n = e.groupBy("dst").agg(F.count("*").alias("n"))
    return e.join(n, "dst").groupBy("src").agg(F.count("*").alias("out_degree"), F.sum("n").alias("reach"))


@query("""SELECT publisher, candidate_id, turn FROM (SELECT publisher, candidate_id, CAST(row_number() OVER (PARTITION BY publisher ORDER BY candidate_id) AS INTEGER) AS turn, count(*) OVER (PARTITION BY publisher) AS size FROM ingest_candidates WHERE publisher IS NOT NULL)
  ORDER BY turn, size DESC, publisher LIMIT 200""")
def publisher_sample(spark, d):
    """Two hundred candidates, one of each publisher in turn."""
    return scholar.round_robin(table(spark, d, "ingest_candidates").where("publisher is not null"), "publisher", "candidate_id", 200)


@query(f"SELECT {_HOST.format('landing_page_url')} AS host, count(*) AS n, count(DISTINCT publisher) AS publishers FROM ingest_candidates WHERE landing_page_url IS NOT NULL GROUP BY 1")
def url_host(spark, d):
    """Candidates of each host."""
    rows = table(spark, d, "ingest_candidates").where("landing_page_url is not null").groupBy(identifiers.host(F.col("landing_page_url")).alias("host"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("publisher").alias("publishers"))


@query("""WITH k AS (SELECT work_id, lower(regexp_extract(p, '^([a-zA-Z]+://[^/]*)', 1)) || substr(p, length(regexp_extract(p, '^([a-zA-Z]+://[^/]*)', 1)) + 1) AS key FROM (SELECT work_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS p FROM crossref_works WHERE url IS NOT NULL))
  SELECT key, count(*) AS works, min(work_id) AS first_id FROM k GROUP BY 1""")
def url_match(spark, d):
    """Works by their address without query and fragment."""
    rows = table(spark, d, "crossref_works").where("url is not null").groupBy(identifiers.url_key(F.col("url")).alias("key"))
    return rows.agg(F.count("*").alias("works"), F.min("work_id").alias("first_id"))


@query("""SELECT publisher, count(*) AS failures, array_to_string(list(result_id ORDER BY result_id)[1:3], ',') AS sample FROM ingest_routing_results WHERE status <> 'saved' GROUP BY 1""")
def preflight_groups(spark, d):
    """Failures of each publisher with three examples."""
    rows = table(spark, d, "ingest_routing_results").where("status <> 'saved'")
    # the three least ids of a group, without gathering the group
    w = Window.partitionBy("publisher").orderBy("result_id")
    first = rows.select("publisher", "result_id").withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("publisher")
    first = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list("result_id")), lambda i: i.cast("string")), ",").alias("sample"))
    counts = rows.groupBy("publisher").agg(F.count("*").alias("failures"))
    return counts.join(first.withColumnRenamed("publisher", "p"), F.col("publisher").eqNullSafe(F.col("p"))).select("publisher", "failures", "sample")


_KEY = "trim(regexp_replace(regexp_replace(lower({0}), '[&:\\-/]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"""SELECT journal, quartile FROM (SELECT DISTINCT journal FROM crossref_works WHERE journal IS NOT NULL) j JOIN (SELECT title_normalized, max(quartile) AS quartile FROM scimago_titles GROUP BY 1) s ON s.title_normalized = {_KEY.format('journal')}""")
def venue_exact(spark, d):
    """Venues that are in the list as typed."""
    found = scholar.venue_lookup(table(spark, d, "crossref_works"), "journal", table(spark, d, "scimago_titles"), "title_normalized", "quartile")
    return found.where("tier = 1").select(F.col("name").alias("journal"), F.col("value").alias("quartile"))


def _ways() -> str:
    """SQL of the list of a name's keys with abbreviations written out."""
    out = "[lower(journal)]"
    for short, words in scholar.ABBREVIATIONS.items():
        texts = ", ".join(f"regexp_replace(x, '{short.replace('.', chr(92) + '.')}', '{w}')" for w in words)
        out = f"flatten(list_transform({out}, lambda x: CASE WHEN contains(x, '{short}') THEN [{texts}] ELSE [x] END))"
    return f"list_transform({out}, lambda x: {_KEY.format('x')})"


_OVERRIDES = "SELECT journal AS title, 'Q0' AS quartile FROM crossref_works WHERE journal LIKE '%rch.%' GROUP BY 1 HAVING count(*) > 3"


@query(f"""WITH o AS (SELECT {_KEY.format('title')} AS entry, 'Q0' AS value FROM ({_OVERRIDES}) GROUP BY 1), s AS (SELECT title_normalized AS entry, max(quartile) AS value FROM scimago_titles GROUP BY 1),
  k AS (SELECT *, 0 AS tier FROM o UNION ALL SELECT *, 1 FROM s WHERE entry NOT IN (SELECT entry FROM o)), j AS (SELECT DISTINCT journal, {_KEY.format('journal')} AS key FROM crossref_works WHERE journal IS NOT NULL),
  e AS (SELECT journal, value, tier FROM j JOIN k ON k.entry = j.key), w AS (SELECT journal, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT journal, {_ways()} AS ws FROM j WHERE journal NOT IN (SELECT journal FROM e) AND contains(journal, '.')))
  SELECT * FROM e UNION ALL SELECT journal, arg_min(value, pos), 2 FROM w JOIN k ON k.entry = ws[pos] GROUP BY 1""")
def venue_expanded(spark, d):
    """Venues that an override or the list has, as typed or with abbreviations written out."""
    works = table(spark, d, "crossref_works")
    own = works.where("journal like '%rch.%'").groupBy("journal").agg(F.count("*").alias("n")).where("n > 3").select("journal", F.lit("Q0").alias("quartile"))
    found = scholar.venue_lookup(works, "journal", table(spark, d, "scimago_titles"), "title_normalized", "quartile", 100, own)
    return found.select(F.col("name").alias("journal"), "value", "tier")


@query()
def venue_tiers(spark, d):
    """All venues that the list has exactly, abbreviated or nearly."""
    return scholar.venue_lookup(table(spark, d, "crossref_works"), "journal", table(spark, d, "scimago_titles"), "title_normalized", "quartile")
