"""Queries over the state of the index, its statistics, runs and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import state
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)
_JOURNAL = "SELECT item_key AS doc, CASE WHEN has_pdf THEN 'committed' ELSE 'in_progress' END AS state FROM ingest_routing_results WHERE item_key IS NOT NULL"


def _docs(spark, d, name):
    return table(spark, d, name).where("item_key is not null").select(F.col("item_key").alias("doc"))


def _journal(spark, d):
    rows = table(spark, d, "ingest_routing_results").where("item_key is not null")
    return rows.select(F.col("item_key").alias("doc"), F.when(F.col("has_pdf"), "committed").otherwise("in_progress").alias("state"))


@query(f"""SELECT DISTINCT item_key AS doc FROM library_items WHERE item_key IN (SELECT item_key FROM chunk_records) AND item_key NOT IN
  (SELECT doc FROM ({_JOURNAL}) GROUP BY doc HAVING max(CASE WHEN state = 'committed' THEN 1 ELSE 0 END) = 0)""")
def indexed_authority(spark, d):
    """Items that are indexed for sure."""
    return state.authoritative(_docs(spark, d, "library_items"), _docs(spark, d, "chunk_records"), _journal(spark, d))


@query("""SELECT DISTINCT item_key AS doc FROM documents WHERE item_key IS NOT NULL AND item_key NOT IN (SELECT item_key FROM chunk_records WHERE item_key IS NOT NULL)""")
def orphans(spark, d):
    """Items of documents that have no chunks."""
    return state.orphans(_docs(spark, d, "chunk_records"), _docs(spark, d, "documents"))


@query("""WITH s AS (SELECT DISTINCT item_key AS doc FROM chunk_records WHERE item_key IS NOT NULL), o AS (SELECT count(*) AS orphans FROM s WHERE doc NOT IN (SELECT item_key FROM documents WHERE item_key IS NOT NULL)),
  n AS (SELECT count(*) AS stored FROM s) SELECT stored, orphans, orphans / greatest(stored, 1) AS share, CASE WHEN orphans = 0 THEN 'nothing' WHEN orphans / greatest(stored, 1) > 0.25 THEN 'refuse' ELSE 'delete' END AS decision FROM n, o""")
def mass_delete_decision(spark, d):
    """Whether the chunks of items without documents may be deleted."""
    return state.deletion(_docs(spark, d, "documents"), _docs(spark, d, "chunk_records"))


@query("""SELECT item_key AS doc FROM library_items WHERE item_key NOT IN (SELECT item_key FROM documents WHERE item_key IS NOT NULL)""")
def unindexed(spark, d):
    """Items without documents."""
    return state.orphans(_docs(spark, d, "documents"), _docs(spark, d, "library_items"))


@query("""WITH i AS (SELECT item_key AS doc, sha256(coalesce(title, '') || '|' || coalesce(CAST(year AS VARCHAR), '')) AS hash FROM library_items),
  s AS (SELECT item_key AS doc, max(CASE WHEN status = 'saved' THEN sha256(coalesce(result_title, '') || '|') END) AS hash, max(CASE WHEN is_error_page THEN 'in_progress' END) AS stage FROM ingest_routing_results WHERE item_key IS NOT NULL GROUP BY 1)
  SELECT i.doc, CASE WHEN s.doc IS NULL THEN 'new' WHEN stage = 'in_progress' THEN 'stale_in_progress' WHEN coalesce(s.hash, '') = '' THEN 'no_hash' WHEN s.hash <> i.hash THEN 'changed' ELSE 'current' END AS reason FROM i LEFT JOIN s ON s.doc = i.doc""")
def reindex_reason(spark, d):
    """Why an item would be indexed again."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    items = table(spark, d, "library_items").select(F.col("item_key").alias("doc"), F.sha2(F.concat(plain("title"), F.lit("|"), plain("year")), 256).alias("hash"))
    rows = table(spark, d, "ingest_routing_results").where("item_key is not null").groupBy(F.col("item_key").alias("doc"))
    known = rows.agg(
        F.max(F.when(F.col("status") == "saved", F.sha2(F.concat(plain("result_title"), F.lit("|")), 256))).alias("hash"),
        F.max(F.when(F.col("is_error_page"), "in_progress")).alias("stage"),
    )
    return state.reindex_reason(items, known)


@query("""SELECT count(DISTINCT item_key) AS docs, count(*) AS chunks, round(count(*) / greatest(count(DISTINCT item_key), 1), 1) AS avg_chunks FROM chunk_records""")
def index_stats(spark, d):
    """Documents, chunks, and chunks of a document."""
    docs = F.count_distinct("item_key")
    return table(spark, d, "chunk_records").agg(docs.alias("docs"), F.count("*").alias("chunks"), F.round(F.count("*") / F.greatest(docs, F.lit(1)), 1).alias("avg_chunks"))


@query("""SELECT coalesce(section, 'unknown') AS section, count(*) AS chunks, round(avg(section_confidence), 5) AS confidence FROM chunk_records GROUP BY 1""")
def section_coverage(spark, d):
    """Chunks of each section, all of them counted."""
    rows = table(spark, d, "chunk_records").groupBy(F.coalesce("section", F.lit("unknown")).alias("section"))
    return rows.agg(F.count("*").alias("chunks"), F.round(F.avg("section_confidence"), 5).alias("confidence"))


@query("""SELECT coalesce(nullif(q, ''), 'unknown') AS quartile, count(*) AS docs FROM (SELECT c.item_key, min(journal_quartile) AS q FROM (SELECT DISTINCT item_key FROM chunk_records) c LEFT JOIN library_items i USING (item_key) GROUP BY 1) GROUP BY 1""")
def journal_coverage(spark, d):
    """Indexed items by the quartile of their venue."""
    docs = table(spark, d, "chunk_records").select("item_key").distinct()
    of = docs.join(table(spark, d, "library_items"), "item_key", "left").groupBy("item_key").agg(F.min("journal_quartile").alias("q"))
    return of.groupBy(F.coalesce(F.nullif("q", F.lit("")), F.lit("unknown")).alias("quartile")).agg(F.count("*").alias("docs"))


@query("""SELECT item_key, count(*) FILTER (chunk_type = 'text') AS text, count(*) FILTER (chunk_type = 'table') AS tables, count(*) FILTER (chunk_type = 'figure') AS figures,
  count(*) FILTER (chunk_type = 'formula') AS formulas FROM chunk_records GROUP BY 1""")
def chunk_type_counts(spark, d):
    """Chunks of each kind for each item, zeros included."""
    kinds = {"text": "text", "table": "tables", "figure": "figures", "formula": "formulas"}
    return table(spark, d, "chunk_records").groupBy("item_key").agg(*[F.count_if(F.col("chunk_type") == k).alias(n) for k, n in kinds.items()])


@query("""SELECT meta_id, regexp_extract(chroma_id, '^(.*)_(chunk|table|fig|formula)_', 1) AS doc, regexp_extract(chroma_id, '^(.*)_(chunk|table|fig|formula)_', 2) AS kind FROM chunk_records""")
def key_parse(spark, d):
    """Document and kind named by each chunk key."""
    part = lambda k: F.regexp_extract("chroma_id", "^(.*)_(chunk|table|fig|formula)_", k)
    return table(spark, d, "chunk_records").select("meta_id", part(1).alias("doc"), part(2).alias("kind"))


@query("""SELECT user_id, island, count(*) AS length, any_value(sig) AS signature FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *,
  CASE WHEN failed AND sig IS NOT DISTINCT FROM lag(sig) OVER (PARTITION BY user_id ORDER BY ts, event_id) AND coalesce(lag(failed) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 0 ELSE 1 END AS new FROM
  (SELECT *, event_type IN ('error', 'click') AS failed, CASE WHEN event_type IN ('error', 'click') THEN event_type END AS sig FROM events))) WHERE failed GROUP BY 1, 2 HAVING count(*) >= 2""")
def failure_islands(spark, d):
    """Events of a user of one kind of two in a row."""
    failed = F.col("event_type").isin("error", "click")
    return state.failure_islands(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], failed, F.col("event_type"), 2)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(max(CASE WHEN recent = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'not attempted'
  WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS recent FROM events)) GROUP BY 1""")
def abort_tail(spark, d):
    """Events before and after the second error in a row of a user."""
    out = state.after_abort(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", 2)
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT result_id, CASE WHEN rn = 1 THEN 'trial' WHEN coalesce(ok, false) THEN 'pass' ELSE 'skip' END AS gate FROM (SELECT result_id, row_number() OVER w AS rn,
  first_value(status = 'saved') OVER w AS ok FROM ingest_routing_results WINDOW w AS (PARTITION BY publisher ORDER BY recorded_at, result_id))""")
def canary_gate(spark, d):
    """Results of a publisher, gated by its first one."""
    out = state.first_outcome_gate(table(spark, d, "ingest_routing_results"), "publisher", ["recorded_at", "result_id"], F.col("status") == "saved")
    return out.select("result_id", "gate")


@query("""SELECT doc_id, sha256(coalesce(text, '') || ':' || coalesce(lang, '') || ':' || coalesce(source, '')) AS hash FROM documents""")
def config_hash(spark, d):
    """A hash of the fields of each document that matter to the index."""
    plain = [F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source")]
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws(":", *plain), 256).alias("hash"))


@query("""SELECT user_id, count(*) AS calls, round(sum(value), 4) AS total, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, min(ts) AS first_ts FROM events GROUP BY 1""")
def cost_rollup(spark, d):
    """Calls, sums and first time of each session."""
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.min("ts").alias("first_ts"),
    )


@query("""SELECT meta_id AS id, CAST(to_json({'quality_grade': metadata['quality_grade'], 'year': metadata['year']}) AS VARCHAR) AS text FROM chunk_records WHERE len(map_keys(metadata)) > 0
  AND metadata['quality_grade'] IS NOT NULL AND metadata['year'] IS NOT NULL""")
def recovery_reassemble(spark, d):
    """Metadata taken apart into typed rows and put together again."""
    entries = table(spark, d, "chunk_records").where("metadata['quality_grade'] is not null and metadata['year'] is not null")
    rows = entries.select(F.col("meta_id").alias("id"), F.explode("metadata").alias("key", "value"))
    whole = F.when(F.col("key") == "year", F.col("value").cast("long"))
    typed = rows.select("id", "key", F.when(F.col("key") != "year", F.col("value")).alias("string_value"), whole.alias("int_value"),
                        F.lit(None).cast("double").alias("float_value"), F.lit(None).cast("boolean").alias("bool_value"))
    return state.reassembled(typed, ["quality_grade", "year"])


@query("""SELECT status, coalesce(experiment, '') AS experiment, count(*) AS n, count(*) FILTER (has_pdf) AS with_pdf, round(avg(nullif(total_time_s, -1)), 4) AS mean_s FROM ingest_routing_results GROUP BY 1, 2""")
def run_summary(spark, d):
    """Outcomes of each experiment, with the mean time where it was measured."""
    rows = table(spark, d, "ingest_routing_results").groupBy("status", F.coalesce("experiment", F.lit("")).alias("experiment"))
    return rows.agg(F.count("*").alias("n"), F.count_if("has_pdf").alias("with_pdf"), F.round(F.avg(F.nullif("total_time_s", F.lit(-1.0))), 4).alias("mean_s"))
