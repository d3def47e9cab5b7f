"""Queries of runs over the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from litspark.operators import runs
from litspark.plans.register import registrar
from litspark.sources.tables import table

REGISTERED: dict = {}
query = registrar(REGISTERED)


def _keys(df, column="item_key"):
    return df.where(f"{column} is not null").select(F.col(column).alias("item_key")).distinct()


@query("""WITH l AS (SELECT DISTINCT item_key FROM library_items), c AS (SELECT DISTINCT item_key FROM detected_captions), p AS (SELECT DISTINCT item_key FROM ingest_routing_results WHERE status <> 'saved'), i AS (SELECT DISTINCT item_key FROM chunk_records)
  SELECT item_key, 'changed' AS why FROM l WHERE item_key IN (SELECT item_key FROM c WHERE item_key IS NOT NULL)
  UNION ALL SELECT item_key, 'in progress' FROM l WHERE item_key NOT IN (SELECT item_key FROM c WHERE item_key IS NOT NULL) AND item_key IN (SELECT item_key FROM p) AND item_key IN (SELECT item_key FROM i)""")
def delete_plan(spark, d):
    """Items whose rows go before a run: those with new captions, and those left unsaved that have passages."""
    left = table(spark, d, "ingest_routing_results").where("status <> 'saved'")
    parts = [_keys(table(spark, d, t)) for t in ("library_items", "detected_captions")] + [_keys(left), _keys(table(spark, d, "chunk_records"))]
    return runs.delete_plan(*parts, "item_key")


_TAGS = "SELECT item_key, string_split(tags, '; ') AS own, string_split(collections, '; ') AS given FROM library_items WHERE tags IS NOT NULL AND collections IS NOT NULL"


def _tags(spark, d):
    rows = table(spark, d, "library_items").where("tags is not null and collections is not null")
    return rows.select("item_key", F.split("tags", "; ").alias("own"), F.split("collections", "; ").alias("given"))


@query(f"SELECT item_key, array_to_string(list_sort(list_distinct(list_concat(own, given))), '; ') AS tags FROM ({_TAGS})")
def tags_added(spark, d):
    """Tags of each item with its collections as tags."""
    return _tags(spark, d).select("item_key", F.array_join(runs.tags_added(F.col("own"), F.col("given")), "; ").alias("tags"))


@query(f"SELECT item_key, array_to_string(list_filter(list_concat(own, given), lambda t: NOT list_contains(given, t)), '; ') AS tags FROM ({_TAGS})")
def tags_removed(spark, d):
    """Tags of each item after its collections' names were given as tags and taken back."""
    own = F.concat("own", "given")
    return _tags(spark, d).select("item_key", F.array_join(runs.tags_removed(own, F.col("given")), "; ").alias("tags"))


@query("""WITH v AS (SELECT list(DISTINCT t) AS words FROM (SELECT unnest(string_split(tags, '; ')) AS t FROM library_items WHERE year >= 2000))
  SELECT item_key, array_to_string(list_sort(list_distinct(list_filter(string_split(tags, '; '), lambda t: NOT list_contains(words, t)))), '; ') AS unknown FROM library_items, v WHERE tags IS NOT NULL""")
def tag_guard(spark, d):
    """Tags of each item that no newer item has."""
    items = table(spark, d, "library_items").where("tags is not null")
    # the vocabulary is one row of distinct tags
    words = items.where("year >= 2000").select(F.explode(F.split("tags", "; ")).alias("t")).agg(F.collect_set("t").alias("words"))
    out = items.crossJoin(F.broadcast(words))
    return out.select("item_key", F.array_join(runs.unknown_tags(F.split("tags", "; "), F.col("words")), "; ").alias("unknown"))


_MEMBERS = "SELECT DISTINCT item_key AS item, unnest(string_split(collections, '; ')) AS collection FROM library_items WHERE collections IS NOT NULL"


@query(f"""SELECT * FROM ({_MEMBERS}) WHERE NOT (collection = 'Archive' AND item IN (SELECT item_key FROM library_items WHERE year >= 2010)) UNION SELECT item_key, 'Reading' FROM library_items WHERE year >= 2010""")
def collection_moves(spark, d):
    """Membership after newer items were moved from one collection to another."""
    items = table(spark, d, "library_items")
    members = items.where("collections is not null").select(F.col("item_key").alias("item"), F.explode(F.split("collections", "; ")).alias("collection"))
    return runs.moved(members, "Reading", items.where("year >= 2010").select(F.col("item_key").alias("item")), "Archive")


@query("""SELECT item_key, started, CAST(row_number() OVER (ORDER BY started DESC, item_key) AS INTEGER) AS position FROM (SELECT item_key, item_key IN (SELECT item_key FROM ingest_routing_results WHERE status = 'blocked' AND item_key IS NOT NULL) AS started FROM library_items) QUALIFY position <= 200""")
def resume_order(spark, d):
    """The first two hundred items of a run, those left blocked before."""
    started = _keys(table(spark, d, "ingest_routing_results").where("status = 'blocked'"))
    return runs.run_order(table(spark, d, "library_items").select("item_key"), started, "item_key", 200)


@query("""SELECT item_key, date_added, (SELECT count(*) > 25 FROM library_items) AS has_more FROM library_items QUALIFY row_number() OVER (ORDER BY date_added DESC, item_key) <= 25""")
def run_batch(spark, d):
    """The newest 25 items, and whether there are more."""
    items = table(spark, d, "library_items").select("item_key", "date_added")
    return runs.batch(items, [F.desc("date_added"), F.col("item_key")], 25)


@query("""SELECT l.item_key, CASE WHEN pages > 20 THEN 'skipped' ELSE 'kept' END AS status FROM library_items l LEFT JOIN (SELECT item_key, max(page_num) AS pages FROM chunk_records GROUP BY 1) c USING (item_key)""")
def page_ceiling(spark, d):
    """Items of over twenty pages are skipped."""
    pages = table(spark, d, "chunk_records").groupBy("item_key").agg(F.max("page_num").alias("pages"))
    items = table(spark, d, "library_items").select("item_key").join(pages, "item_key", "left")
    return runs.page_ceiling(items, F.col("pages"), 20).select("item_key", "status")


@query("""SELECT item_key, CASE WHEN h THEN 'ready' ELSE 'skipped' END AS status, CASE WHEN NOT h THEN 'no attachment' END AS reason FROM (SELECT item_key, item_key IN (SELECT item_key FROM chunk_records WHERE item_key IS NOT NULL) AS h FROM library_items)""")
def without_attachment(spark, d):
    """Items without passages are skipped with a reason."""
    return runs.without_attachment(table(spark, d, "library_items"), _keys(table(spark, d, "chunk_records")), "item_key")


_COSTS = """SELECT id, table_id, model, written_at, (length(coalesce(rows_json, '')) * CASE WHEN model LIKE '%-l1' THEN 5.0 ELSE 1.0 END + coalesce(execution_time_ms, 0) * 0.1) / 1e6 AS cost FROM vision_agent_results"""


def _costs(spark, d):
    usage = table(spark, d, "vision_agent_results").withColumn("output", F.length(F.coalesce("rows_json", F.lit("")))).withColumn("cached", F.col("execution_time_ms"))
    models = usage.select(F.col("model").alias("name")).distinct().where("name is not null")
    prices = models.withColumn("output_price", F.when(F.col("name").endswith("-l1"), 5.0).otherwise(1.0)).withColumn("cached_price", F.lit(0.1))
    joined = usage.join(prices, usage["model"].eqNullSafe(prices["name"]), "left")
    return joined.select("id", "table_id", "model", "written_at", runs.cost(joined, joined, "model", ("output", "cached")).alias("cost"))


@query(f"SELECT id, round(cost, 8) AS cost FROM ({_COSTS})")
def cost_of_rows(spark, d):
    """What each reading would cost by its size."""
    return _costs(spark, d).select("id", F.round("cost", 8).alias("cost"))


@query(f"SELECT count(*) AS rows, round(coalesce(sum(cost), 0), 6) AS total, round(avg(cost), 8) AS mean FROM ({_COSTS})")
def cost_totals(spark, d):
    """Rows, total and mean of all costs."""
    whole, _ = runs.cost_totals(_costs(spark, d), "table_id", "cost", "written_at")
    return whole.select("rows", F.round("total", 6).alias("total"), F.round("mean", 8).alias("mean"))


@query(f"SELECT table_id, count(*) AS rows, round(sum(cost), 6) AS total, min(written_at) AS first FROM ({_COSTS}) GROUP BY 1")
def cost_by_table(spark, d):
    """Costs of each table."""
    _, each = runs.cost_totals(_costs(spark, d), "table_id", "cost", "written_at")
    return each.select("table_id", "rows", F.round("total", 6).alias("total"), "first")


@query(f"SELECT id, table_id, written_at FROM ({_COSTS}) QUALIFY row_number() OVER (ORDER BY written_at DESC, id) <= 30")
def cost_recent(spark, d):
    """The thirty newest entries of the cost log."""
    return _costs(spark, d).orderBy(F.desc("written_at"), "id").limit(30).select("id", "table_id", "written_at")


@query("""SELECT state, count(*) AS rows FROM (SELECT CASE WHEN e.embedding IS NULL THEN 'missing' WHEN len(e.embedding) <> 64 THEN 'wrong' ELSE 'ok' END AS state FROM chunk_records c LEFT JOIN embeddings e ON e.vec_id = c.meta_id) GROUP BY 1""")
def recovered_vectors(spark, d):
    """Recovered passages with a vector, without one, and with one of another size."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("meta_id"), "embedding")
    return runs.with_vectors(table(spark, d, "chunk_records").select("meta_id"), vectors, "meta_id", "embedding", 64).groupBy("state").agg(F.count("*").alias("rows"))


@query("""SELECT item_key, title, 'recovered' AS origin FROM library_items WHERE item_key IN (SELECT item_key FROM chunk_records WHERE item_key IS NOT NULL)
  UNION ALL SELECT item_key, title, 'live' FROM library_items WHERE item_key NOT IN (SELECT item_key FROM chunk_records WHERE item_key IS NOT NULL)""")
def live_only_merge(spark, d):
    """Items that were recovered, and the live ones that were not."""
    items = table(spark, d, "library_items").select("item_key", "title")
    recovered = items.join(_keys(table(spark, d, "chunk_records")), "item_key", "left_semi")
    return runs.live_only(items, recovered, "item_key")


_HASH = "substr(sha256(concat_ws(':', section, chunk_type, CAST({} AS VARCHAR))), 1, 16)"


@query(f"""SELECT meta_id, CASE WHEN stored = {_HASH.format('flag')} THEN 'current' WHEN stored = {_HASH.format('NOT flag')} THEN 'flag' ELSE 'changed' END AS drift
  FROM (SELECT *, {_HASH.format('page_num > 3')} AS stored, page_num > 5 AS flag FROM chunk_records WHERE section IS NOT NULL)""")
def settings_drift(spark, d):
    """Whether a stored hash is that of the settings, of those with one flag turned, or of none."""
    rows = table(spark, d, "chunk_records").where("section is not null")
    stored = F.substring(F.sha2(F.concat_ws(":", "section", "chunk_type", (F.col("page_num") > 3).cast("string")), 256), 1, 16)
    return rows.select("meta_id", runs.drift(stored, [F.col("section"), F.col("chunk_type")], F.col("page_num") > 5).alias("drift"))


@query("""SELECT doc_id, CAST(k AS INTEGER) AS page_num, p[k] AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS k FROM documents WHERE text IS NOT NULL)""")
def fallback_pages(spark, d):
    """Documents as pages, parted at blank lines."""
    rows = table(spark, d, "documents").where("text is not null").withColumn("pages", F.split("text", "\n\n", -1))
    return runs.fallback_pages(rows, "doc_id", "pages")
