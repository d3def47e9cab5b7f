"""Works and candidates of external sources: kinds of identifiers, queries, ranking, resolution of names and titles, tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import title_tokens
from litspark.operators import fulltext

# The item types of external types; others are articles.
TYPES = {
    "journalArticle": "journal-article", "preprint": "posted-content", "conferencePaper": "proceedings-article", "bookSection": "book-chapter",
    "book": "book", "thesis": "dissertation", "report": "report", "dataset": "dataset",
}


def identifier_kind(text: Column) -> Column:
    """doi, arxiv or s2 by the form of an identifier, addresses before bare forms; null if it is none."""
    low = F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return (
        F.when(low.rlike(r"^(https?://)?(dx\.)?doi\.[a-z]+/|^doi:"), "doi")
        .when(low.rlike(r"arxiv\.[a-z]+/(abs|pdf)/|^arxiv:"), "arxiv")
        .when(low.rlike(r"^10\.[0-9]{4,}/\S+$"), "doi")
        .when(low.rlike(r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$|^[a-z-]+(\.[a-z]{2})?/[0-9]{7}(v[0-9]+)?$"), "arxiv")
        .when(low.rlike(r"^[0-9a-f]{40}$"), "s2")
    )


def arxiv_of_addresses(*addresses: Column) -> Column:
    """The arXiv id in the first of the addresses that holds one, without version, ending and query; null if none does."""
    pattern = r"(?i)arxiv\.[a-z]+/(?:abs|pdf)/([a-z-]+(?:\.[a-z]{2})?/[0-9]{7}|[0-9]{4}\.[0-9]{4,5})"
    return F.coalesce(*[F.nullif(F.regexp_extract(a, pattern, 1), F.lit("")) for a in addresses])


def author_of_query(query: Column) -> tuple[Column, Column]:
    """(author, topic) of "author:name|topic"; a query of another form is a topic."""
    prefixed = F.lower(query).startswith("author:")
    rest = F.trim(F.substring(query, 8, 1_000_000))
    parts = F.split(rest, r"\|", 2)
    author = F.when(prefixed & (rest != ""), F.trim(parts[0]))
    topic = F.when(prefixed, F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).otherwise(query)
    return author, topic


def natural_query(query: Column) -> Column:
    """Whether a query is words of a language: not blank, no author, identifier, quotation or operator."""
    text = F.coalesce(query, F.lit(""))
    special = text.rlike(r"(?i)^\s*author:|10\.[0-9]{4,}/|^\s*doi:") | text.contains('"') | text.rlike(r" (AND|OR) ")
    return (F.trim(text) != "") & ~special


def retry_seconds(detail: Column) -> Column:
    """Seconds to wait that an error names: the whole text a number, or a number after a name of a delay; null if none is named."""
    text = F.trim(detail)
    number = r"([0-9]+(?:\.[0-9]+)?)"
    named = [F.regexp_extract(text, rf"(?i)retry[-_]?{word}\W{{1,4}}{number}", 1) for word in ("delay", "after")]
    return F.when(text.rlike(rf"^{number}$"), text.cast("double")).otherwise(F.coalesce(*[F.nullif(n, F.lit("")) for n in named]).cast("double"))


def cut_at_line(text: Column, most: int = 6000) -> Column:
    """A trimmed text of at most ``most`` characters, cut back to its last line break if that leaves anything."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    head = F.substring(whole, 1, most)
    lines = F.regexp_replace(F.regexp_replace(head, r"\n[^\n]*$", ""), r"^\s+|\s+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.when(lines != "", lines).otherwise(F.regexp_replace(head, r"^\s+|\s+$", "")))


def year_dates(first: Column, last: Column) -> tuple[Column, Column]:
    """The first day of the first year and the last day of the last; null bounds stay null."""
    return F.make_date(first, F.lit(1), F.lit(1)), F.make_date(last, F.lit(12), F.lit(31))


def within_window(added: Column, now: Column, seconds: int) -> Column:
    """Whether a time, written with a Z or not, is no older than ``seconds``; what is no time passes."""
    at = F.try_to_timestamp(F.regexp_replace(added, "Z$", ""))
    return at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) <= seconds)


def work_filter(works: DataFrame, publishers: tuple[str, ...] = (), open_access: bool | None = None, has_doi: bool | None = None, years: tuple[int | None, int | None] = (None, None), author: str | None = None) -> DataFrame:
    """Works that meet every filter that is given."""
    if publishers:
        works = works.where(F.col("publisher").isin(*publishers))
    if open_access is not None:
        works = works.where(F.col("oa_url").isNotNull() == F.lit(open_access))
    if has_doi is not None:
        works = works.where((F.coalesce("doi", F.lit("")) != "") == F.lit(has_doi))
    low, high = years
    if low:
        works = works.where(F.col("year") >= low)
    if high:
        works = works.where(F.col("year") <= high)
    if author:
        works = works.where(F.exists("authors", lambda a: F.contains(F.lower(F.coalesce(a["lastName"], F.lit(""))), F.lit(author.lower()))))
    return works


def ranked(works: DataFrame, cited: str, top: str, relevance: str, key: str, most: int) -> DataFrame:
    """The first ``most`` works by citations, top venue and relevance, with ``position``."""
    order = [F.desc(F.coalesce(cited, F.lit(0))), F.desc(F.coalesce(top, F.lit(False))), F.desc(F.coalesce(relevance, F.lit(0.0))), F.col(key)]
    return works.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def page_after(works: DataFrame, order: str, key: str, after: tuple | None, size: int) -> DataFrame:
    """The next ``size`` rows by ``order``, greatest first, then key, after the row that ``after`` names."""
    if after is not None:
        value, last = after
        works = works.where((F.col(order) < value) | ((F.col(order) == value) & (F.col(key) > last)))
    return works.orderBy(F.desc(order), key).limit(size)


def names_resolved(names: DataFrame, name: str, known: DataFrame, known_name: str, known_id: str) -> DataFrame:
    """(name, id, resolved): each distinct name by a known one, whatever the case; of equal names the least id."""
    low = known.select(F.lower(F.trim(known_name)).alias("low"), F.col(known_id).alias("id")).groupBy("low").agg(F.min("id").alias("id"))
    asked = names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("low", F.lower(F.trim("name")))
    return asked.join(low, "low", "left").select("name", "id", F.col("id").isNotNull().alias("resolved"))


def titles_resolved(asked: DataFrame, titles: DataFrame, least: int = 3, times: float = 2.0) -> DataFrame:
    """(ask_id, item, overlap): the title that each asked title means by its words.

    Titles are (item, title), asked ones (ask_id, title); ids are distinct. A title is meant if it
    shares at least ``least`` words and ``times`` as many as the next one.
    """
    of = lambda df, key: df.select(key, title_tokens(F.col("title")).alias("words"))
    return fulltext.clear_best(of(asked, "ask_id"), of(titles, "item"), "ask_id", "item", "words", least, times)


def best_of_key(rows: DataFrame, key: str, order: str, sources: str) -> DataFrame:
    """(key, first, sources, copies): of the rows of a key the first in order, and the distinct sources of all."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(order).alias("first"), F.array_join(F.array_sort(F.collect_set(sources)), ", ").alias("sources"), F.count("*").alias("copies")
    )


def above_upper_quartile(rows: DataFrame, batch: str, value: str, floor: int = 10, least: int = 5) -> DataFrame:
    """``rows`` with ``top``: at least the value at three quarters of its batch in order, and at least ``floor``; small batches have none.

    Values are counted first; the running count is over distinct values of a batch.
    """
    counts = rows.groupBy(batch, F.coalesce(value, F.lit(0)).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(batch)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("v"))).withColumn("whole", F.sum("n").over(w))
    at = F.floor(F.col("whole") * 0.75)
    bound = run.where((F.col("whole") >= least) & (F.col("upto") > at)).groupBy(batch).agg(F.greatest(F.min("v"), F.lit(floor)).alias("bound"))
    return rows.join(bound, batch, "left").withColumn("top", F.coalesce(F.coalesce(F.col(value), F.lit(0)) >= F.col("bound"), F.lit(False))).drop("bound")


def json_texts(value: Column) -> Column:
    """A list of texts from JSON, or from a text parted by commas; blank parts are dropped, null is empty."""
    parsed = F.from_json(value, "array<string>")
    plain = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(F.coalesce(parsed, plain), lambda x: x.isNotNull() & (F.trim(x) != ""))


def first_object(text: Column, schema: str) -> Column:
    """The JSON object in a model's answer, from the first brace to the last, whatever stands around it; null if there is none."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(body != "", F.from_json(body, schema))


def external_type(kind: Column) -> Column:
    """The external name of an item type, and "other" for a type that has none."""
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit("other"))
