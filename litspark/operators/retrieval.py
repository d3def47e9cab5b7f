"""Passages as a user asks for them: filters, sizes of a fetch, order, context, and typed passages of a document."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of passages.
KINDS = ("text", "table", "figure", "formula")
# How many rows a search fetches for k results: a factor, a bound, and the factor of a search with filters.
PASSAGES, TABLES = (3, 150, 3), (3, 90, 2)


def conjunction(conditions: list[Column]) -> Column:
    """All conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def passage_filter(year: Column, kind: Column, year_min: int | None = None, year_max: int | None = None, kinds: tuple[str, ...] = ()) -> Column:
    """Passages within years and of some kinds. A bound of 0 or None is none, and the year 0 of unknown passes an upper bound."""
    wrong = set(kinds) - set(KINDS)
    if wrong:
        raise ValueError(f"no kind of passage: {', '.join(sorted(wrong))}; known are {', '.join(KINDS)}")
    parts = [year >= year_min] if year_min else []
    parts += [year <= year_max] if year_max else []
    parts += [kind.isin(*kinds)] if kinds else []
    return conjunction(parts)


def text_filter(**needles: str | None) -> Column:
    """Rows in which every named column holds its text, whatever the case; empty texts ask for nothing, null columns hold none."""
    parts = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x.lower())) for c, x in needles.items() if x]
    return conjunction(parts)


def title_pattern(title: Column, pattern: str, longest: int = 200) -> Column:
    """Titles that a regular expression matches somewhere, whatever the case; ValueError if it is too long or none."""
    if len(pattern) > longest:
        raise ValueError(f"a pattern of over {longest} characters")
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"no regular expression: {error}") from None
    return F.coalesce(title.rlike(f"(?i){pattern}"), F.lit(False))


def fetch_size(k: int, filtered: bool = False, rule: tuple[int, int, int] = PASSAGES) -> int:
    """Rows to fetch for ``k`` results; more if a filter will drop some afterwards."""
    factor, most, more = rule
    return min(k * factor, most) * (more if filtered else 1)


def topic_fetch_size(n: int, filtered: bool = False) -> int:
    """Passages to fetch for ``n`` documents of a topic."""
    base = min(n * 10, 400)
    return min(base + n * 5, 500) if filtered else base


def shown(rows: DataFrame, verbosity: str = "full") -> DataFrame:
    """Results in the columns that a verbosity shows: minimal, standard or full; scores to three digits, confidences to two.

    A formula's source is shown in formulas only; it is null in others.
    """
    if verbosity not in ("minimal", "standard", "full"):
        raise ValueError(f"no verbosity: {verbosity}")
    score = lambda c, digits=3: F.round(c, digits).alias(c)
    formula = F.when(F.col("chunk_type") == "formula", F.col("formula_source")).alias("formula_source")
    columns = ["doc_id", "year", "page", "chunk_index", score("relevance_score"), score("composite_score"), "section", "chunk_type", formula]
    if verbosity != "minimal":
        columns += ["authors", "citation_key", "publication", score("section_confidence", 2), "journal_quartile"]
    return rows.select(*columns, *(["tags", "collections"] if verbosity == "full" else []))


def ordered(rows: DataFrame, query: str, by: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each query, with ``position``; a limit within each task comes before the shuffle."""
    w = Window.partitionBy(query).orderBy(*by)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)


def topic_order(topics: DataFrame, query: str, most: int) -> DataFrame:
    """Documents by their mean composite to three digits, ties by their first passage, with ``position``."""
    return ordered(topics, query, [F.desc(F.round("avg_composite", 3)), F.col("first_rank"), F.col("doc")], most)


def decorated(keys: DataFrame, items: DataFrame, key: str, most: int) -> DataFrame:
    """Items of the matched keys, newest first, a missing year as 0, with ``position``; keys without an item are dropped."""
    found = items.join(keys.select(key).distinct(), key, "left_semi")
    first = found.orderBy(F.desc(F.coalesce("year", F.lit(0))), key).limit(most)
    return first.withColumn("position", F.row_number().over(Window.orderBy(F.desc(F.coalesce("year", F.lit(0))), key)))


def sorted_items(items: DataFrame, by: str, descending: bool, most: int, key: str = "item_key") -> DataFrame:
    """The first ``most`` items by a column, nulls first in ascending and last in descending order, with ``position``."""
    order = [F.desc(by) if descending else F.asc(by), F.col(key)]
    return items.orderBy(*order).limit(most).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def mention_of(kind: Column, number: Column) -> Column:
    """The words by which a text mentions a table or figure, in lower case."""
    return F.concat(kind, F.lit(" "), F.lower(number))


def reference_map(captions: DataFrame, passages: DataFrame) -> DataFrame:
    """(caption_id, chunk_index, how): the passage that first mentions a caption's number, else the first of its page, else -1.

    Captions are (caption_id, doc, page, kind, number), passages (doc, page, chunk_index, text).
    A number that a longer one begins with is not mentioned by it. Captions and passages meet by
    document and mention, which are taken out of the passages once.
    """
    pattern = r"(?:table|figure|fig\.?) [0-9ivxlc]+"
    found = F.array_distinct(F.expr(f"regexp_extract_all(lower(text), r'({pattern})', 1)"))
    said = passages.where("text is not null").select("doc", "chunk_index", F.explode(found).alias("said"))
    said = said.select("doc", "chunk_index", F.regexp_replace("said", r"^fig\.? ", "figure ").alias("mention"))
    said = said.groupBy("doc", "mention").agg(F.min("chunk_index").alias("by_mention"))
    first = passages.groupBy("doc", "page").agg(F.min("chunk_index").alias("by_page"))
    asked = captions.withColumn("mention", mention_of(F.col("kind"), F.col("number")))
    out = asked.join(said, ["doc", "mention"], "left").join(first, ["doc", "page"], "left")
    how = F.when(F.col("by_mention").isNotNull(), "mention").when(F.col("by_page").isNotNull(), "page").otherwise("none")
    return out.select("caption_id", F.coalesce("by_mention", "by_page", F.lit(-1)).alias("chunk_index"), how.alias("how"))


def formula_context(passages: DataFrame) -> DataFrame:
    """(formula_id, id): each formula beside itself and the text passages of its page."""
    formulas = passages.where("kind = 'formula'").select(F.col("id").alias("formula_id"), "doc", "page")
    texts = passages.where("kind = 'text'").select("id", "doc", "page")
    own = formulas.select("formula_id", F.col("formula_id").alias("id"))
    return formulas.join(texts, ["doc", "page"]).select("formula_id", "id").union(own)


def figure_text(caption: Column, page: Column, context: Column | None = None) -> Column:
    """What a figure is found by: its caption, or its page, and the text around its mention."""
    name = F.when(F.coalesce(caption, F.lit("")) != "", caption).otherwise(F.concat(F.lit("Figure on page "), page))
    return name if context is None else F.concat_ws("\n", name, F.when(context != "", context))


def formula_text(latex: Column, page: Column, context: Column, raw: Column) -> Column:
    """What a formula is found by: its page, the text around it, the text it was read as if that says more, and its source."""
    more = F.when((raw != "") & ~F.contains(F.coalesce(context, F.lit("")), raw), F.concat(F.lit("Detected formula text: "), raw))
    around = F.when(context != "", F.concat(F.lit("Context: "), context))
    return F.concat_ws("\n", F.concat(F.lit("Formula on page "), page), around, more, F.concat(F.lit("LaTeX: "), latex))


def box_text(box: Column) -> Column:
    """A box as four numbers of two decimals."""
    return F.format_string("%.2f,%.2f,%.2f,%.2f", box["x0"], box["y0"], box["x1"], box["y1"])


def without_documents(passages: DataFrame, gone: DataFrame, doc: str, kind: str | None = None) -> DataFrame:
    """Passages but for those of the documents in ``gone``, or but for those of one kind of them; ValueError for an unknown kind."""
    if kind is not None and kind not in KINDS:
        raise ValueError(f"no kind of passage: {kind}")
    if kind is None:
        return passages.join(gone.select(doc).distinct(), doc, "left_anti")
    marked = gone.select(doc).distinct().withColumn("kind_", F.lit(kind))
    return passages.join(marked, (passages[doc] == marked[doc]) & (passages["chunk_type"] == marked["kind_"]), "left_anti")


def document_meta(passages: DataFrame, doc: str, key: str, *columns: str) -> DataFrame:
    """The columns of each document's first passage in the order of ``key``."""
    first = F.min_by(F.struct(key, *columns), F.col(key)).alias("first")
    return passages.groupBy(doc).agg(first).select(doc, "first.*")


def aligned(ids: DataFrame, texts: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(ids, texts, vectors, aligned): whether every id has one text and one vector, as an index needs."""
    n = lambda df, name: df.agg(F.count(key).alias(name), F.count_distinct(key).alias(f"{name}_distinct"))
    rows = n(ids, "ids").crossJoin(n(texts, "texts")).crossJoin(n(vectors, "vectors"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col("ids") for c in ("ids_distinct", "texts", "texts_distinct", "vectors", "vectors_distinct")])
    return rows.select("ids", "texts", "vectors", same.alias("aligned"))
