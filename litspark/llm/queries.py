"""Queries of the numbered problems, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litspark.llm.canonical import map_values
from litspark.llm.consensus import cell_readings, consensus
from litspark.llm.copies import copy_groups, count_copies
from litspark.llm.encoding import find_garbled
from litspark.llm.identifiers import record_key, with_identifier_keys
from litspark.llm.leaks import find_leaks
from litspark.llm.matching import match_records
from litspark.llm.mixing import mix
from litspark.llm.scans import find_scanned, learn, repair
from litspark.llm.spans import removal_clusters, shared_pairs, shared_share, shared_windows, span_links, span_starts, with_paragraphs
from litspark.llm.templates import find_stand_ins
from litspark.sources.tables import table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk_records")
    return find_garbled(chunks, "meta_id", "document", margin=None)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold text decoded with a wrong encoding."""
    return _garbled(spark, d).select(F.col("id").alias("meta_id")).distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled chunks with the chain of encodings and the restored text."""
    return _garbled(spark, d).withColumnRenamed("id", "meta_id")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunk_records").select(F.lit("chunk_records").alias("rec_table"), F.col("meta_id").alias("rec_id"), F.col("document").alias("text"))
    captions = table(spark, d, "detected_captions").select(F.lit("detected_captions").alias("rec_table"), F.col("caption_id").alias("rec_id"), "text")
    return chunks.unionByName(captions)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and captions that bear traces of scanning."""
    texts = _scanned(spark, d)
    return find_scanned(texts, learn(texts.select("text"))).select("rec_table", "rec_id").distinct()


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The records with traces, as continuous paragraphs."""
    texts = _scanned(spark, d)
    lexicon = learn(texts.select("text"))
    found = find_scanned(texts, lexicon).select("rec_table", "rec_id").distinct()
    return repair(texts.join(found, ["rec_table", "rec_id"], "left_semi"), lexicon)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    items, works = table(spark, d, "library_items"), table(spark, d, "crossref_works")
    people = F.array_join(F.transform("authors", lambda x: F.concat_ws(" ", x["firstName"], x["lastName"])), "; ")
    left = items.select(F.col("item_key").alias("id"), "title", F.col("authors").alias("names_text"), "year")
    right = works.select(F.col("work_id").alias("id"), "title", people.alias("names_text"), "year")
    known = with_identifier_keys(works.select(F.col("work_id").alias("id"), "doi"), "keys", "doi")
    labels = known.where("size(keys) = 1").select("id", F.col("keys")[0].alias("label"))
    return match_records(left, right, labels)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a library item and a work record of the same publication."""
    return _matches(spark, d).select(F.col("a_id").alias("item_key"), F.col("b_id").alias("work_id"))


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with the rule that found them and its confidence."""
    return _matches(spark, d).withColumnsRenamed({"a_id": "item_key", "b_id": "work_id"})


def _stand_ins(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "ingest_routing_results")
    return find_stand_ins(results, "result_id", "result_title", results.select("publisher").where("publisher is not null"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Results whose title is a stand-in."""
    return _stand_ins(spark, d).select(F.col("id").alias("result_id"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Results with a title, without the stand-ins."""
    results = table(spark, d, "ingest_routing_results").where("trim(result_title) <> ''")
    found = _stand_ins(spark, d).select(F.col("id").alias("result_id"))
    return results.join(found, "result_id", "left_anti").select("result_id", "doi", "publisher", "result_title")


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    works = table(spark, d, "crossref_works").select(
        F.lit("crossref_works").alias("rec_table"), F.col("work_id").alias("rec_id"), "doi", F.lit(None).cast("string").alias("arxiv_id")
    )
    candidates = table(spark, d, "ingest_candidates").select(
        F.lit("ingest_candidates").alias("rec_table"), F.col("candidate_id").alias("rec_id"), "doi", "arxiv_id"
    )
    both = works.unionByName(candidates)
    groups = copy_groups(with_identifier_keys(both, "keys", "doi", "arxiv_id"), "rec_id", F.col("keys"), scope=F.col("rec_table"))
    return both, groups.select(F.col("scope").alias("rec_table"), "rec_id", "first_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of copies by DOI or arXiv id, in each of the two tables."""
    return _copies(spark, d)[1]


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record for each publication, with its number of copies; a record that names nothing stands for itself."""
    both, groups = _copies(spark, d)
    whole = both.select("rec_table", "rec_id").join(groups, ["rec_table", "rec_id"], "left")
    first = F.coalesce("first_id", "rec_id").alias("first_id")
    return whole.groupBy("rec_table", first).agg(F.count("*").alias("copies"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """Captions and titles that stand more than once but for formatting: (rec_table, first_id, copies)."""
    works = table(spark, d, "crossref_works").select(
        F.lit("crossref_works").alias("rec_table"), F.col("work_id").alias("rec_id"), record_key(F.col("title"), F.col("journal")).alias("key")
    )
    captions = table(spark, d, "detected_captions").select(
        F.lit("detected_captions"), "caption_id", record_key(F.col("item_key"), F.col("caption_type"), F.col("text"))
    )
    rows = works.union(captions).withColumn("key", F.concat_ws("\u001e", "key", "rec_table"))
    found = count_copies(rows, "rec_id", F.col("key")).where("copies > 1")
    return found.select(F.substring_index("key", "\u001e", -1).alias("rec_table"), "first_id", "copies")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The agreed text of each cell that is read in at least two ways."""
    cells, _ = consensus(cell_readings(table(spark, d, "vision_agent_results")), unique=True)
    return cells.where("labels > 1").select("table_id", "row_idx", "col_idx", F.col("label").alias("cell_text"))


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of each reader beside the accuracy it reports of itself."""
    results = table(spark, d, "vision_agent_results")
    _, readers = consensus(cell_readings(results), unique=True)
    said = results.groupBy(F.col("agent_idx").cast("long").alias("agent")).agg(F.avg("cell_accuracy_pct").alias("said_pct"))
    return readers.join(said, "agent", "left").select(F.col("agent").alias("agent_idx"), "reliability", "group", "said_pct")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Works whose journal means a venue of the list, and that venue."""
    works = table(spark, d, "crossref_works")
    found = map_values(works, "journal", table(spark, d, "scimago_titles"), "title_normalized").where("matched is not null")
    found = found.select(F.col("value").alias("journal"), F.col("matched").alias("title_normalized"))
    return works.select("work_id", "journal").join(found, "journal").select("work_id", "title_normalized")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Journal values that mean no venue of the list, with their number of rows."""
    works = table(spark, d, "crossref_works")
    found = map_values(works, "journal", table(spark, d, "scimago_titles"), "title_normalized")
    return found.where("matched is null").select(F.col("value").alias("journal"), F.col("n").alias("rows"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation item, how many documents hold a passage and the longest one."""
    found = _leaks(spark, d).groupBy("item_id")
    return found.agg(F.count("*").alias("documents"), F.max("words").alias("longest"), F.max("similarity").alias("similarity"))


def p9_mix_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the largest mixture in which every source reaches its share, with their copies."""
    selection, _ = mix(table(spark, d, "documents"), table(spark, d, "source_weights"))
    return selection.withColumnRenamed("id", "doc_id")


def p9_mix_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that this mixture reaches."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def p9_mix_fixed_total(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached when the mixture is to be five million tokens, and small sources fall short."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"), total=5_000_000)[1]


def p9_mix_short_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached at three times the largest mixture without shortage, so that small sources fall short at any size of the data."""
    return mix(table(spark, d, "documents"), table(spark, d, "source_weights"), times=3.0)[1]


def _starts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents")
    windows = shared_windows(documents, "doc_id", "text")
    return windows, with_paragraphs(span_starts(windows), documents, "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common span of at least 300 characters."""
    return shared_pairs(*_starts(spark, d)).toDF("doc_id_a", "doc_id_b")


def p10_shared_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's text that stands verbatim in another one."""
    documents = table(spark, d, "documents")
    share = shared_share(documents, shared_windows(documents, "doc_id", "text"), "doc_id", "text")
    return share.withColumnRenamed("id", "doc_id")


def p10_links(spark: SparkSession, d: str) -> DataFrame:
    """Each document beside the first one with which it shares a paragraph: a row for each, not for each pair."""
    return span_links(_starts(spark, d)[1]).toDF("doc_id", "first_id")


def p10_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined by shared spans, under the least id of their cluster."""
    return removal_clusters(span_links(_starts(spark, d)[1])).withColumnRenamed("id", "doc_id")


_WINDOWS = """SELECT doc_id, pos, md5(substr(text, pos + 1, 300)) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS pos FROM documents WHERE length(text) >= 300)"""
_PAIRS = f"SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, w FROM ({_WINDOWS})) a JOIN (SELECT DISTINCT doc_id, w FROM ({_WINDOWS})) b ON a.w = b.w AND a.doc_id < b.doc_id"
_COPY_KEY = "array_to_string(list_sort([regexp_replace(lower(coalesce(CAST(x AS VARCHAR), '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') for x in [{}]]), chr(31))"

ORACLE: dict[str, str] = {
    "p7_records": f"""SELECT rec_table, min(id) AS first_id, count(*) AS copies FROM (SELECT 'crossref_works' AS rec_table, work_id AS id, {_COPY_KEY.format("title, journal")} AS key FROM crossref_works
        UNION ALL SELECT 'detected_captions', caption_id, {_COPY_KEY.format("item_key, caption_type, text")} FROM detected_captions) GROUP BY rec_table, key HAVING count(*) > 1""",
    "p10_found": _PAIRS,
    "p10_clusters": f"""WITH RECURSIVE e AS (SELECT doc_id_a AS a, doc_id_b AS b FROM ({_PAIRS}) UNION SELECT doc_id_b, doc_id_a FROM ({_PAIRS})), r AS (SELECT DISTINCT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT doc_id, min(reached) AS cluster FROM r GROUP BY 1""",
    "p10_shared_share": f"""WITH w AS ({_WINDOWS}), s AS (SELECT w.doc_id, pos, pos - lag(pos, 1, -1000000000) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM w SEMI JOIN (SELECT w FROM w GROUP BY 1 HAVING min(doc_id) < max(doc_id)) k USING (w)),
        p AS (SELECT doc_id, CAST(sum(least(step, 300)) AS BIGINT) AS shared_chars, CAST(sum(CASE WHEN step > 300 THEN 1 ELSE 0 END) AS BIGINT) AS spans FROM s GROUP BY 1)
        SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(spans, 0) AS spans, CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0) / length(text) ELSE 0.0 END AS shared FROM documents LEFT JOIN p USING (doc_id)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_reliability, p2_found, p2_unmatched, p3_found, p3_restored, p4_found, p4_repaired, p5_found, p5_confidence, p6_found, p6_kept, p7_found,
        p7_collapsed, p7_records, p8_found, p8_report, p9_mix_selection, p9_mix_shares, p9_mix_fixed_total, p9_mix_short_shares, p10_found, p10_shared_share,
        p10_links, p10_clusters,
    )
}
