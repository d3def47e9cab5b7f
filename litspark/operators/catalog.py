"""The catalog of a library: attachments and their paths, attributes of items, duplicates, tables as markdown and HTML, overviews."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from litspark.functions.identifiers import venue_key

# Kinds of items that are no items of their own.
NO_ITEMS = ("note", "attachment")


def live_items(items: DataFrame, kind: str, deleted: DataFrame, key: str, others: tuple[str, ...] = NO_ITEMS) -> DataFrame:
    """Items of their own that were not deleted."""
    return items.where(~F.col(kind).isin(*others) | F.col(kind).isNull()).join(deleted.select(key), key, "left_anti")


def attachment_path(path: Column, mode: Column, key: Column, folder: str) -> Column:
    """Where an attachment lies: a stored file in the folder of its key; null for links (mode 2), other paths and none."""
    name = F.regexp_extract(path, r"^storage:(.+)$", 1)
    return F.when((mode != 2) & (name != ""), F.concat(F.lit(f"{folder}/storage/"), key, F.lit("/"), name))


def existing(paths: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """``paths`` with null in place of a path that the listing (path) of files lacks."""
    there = listing.select(F.col("path").alias(path)).distinct().withColumn("_there", F.lit(True))
    joined = paths.join(there, path, "left")
    return joined.withColumn(path, F.when(F.col("_there"), F.col(path))).drop("_there")


def with_attributes(items: DataFrame, key: str, **counts: DataFrame) -> DataFrame:
    """Items with the number of their rows in each table, 0 for none: one aggregate and one join a table, in place of a subquery an item."""
    for name, rows in counts.items():
        n = rows.groupBy(key).agg(F.count("*").alias(name))
        items = items.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return items


def group_library(groups: DataFrame, group: int) -> int:
    """The library of a group (group_id, library_id); ValueError if there is none."""
    found = groups.where(F.col("group_id") == group).select("library_id").limit(1).collect()
    if not found:
        raise ValueError(f"no group {group}")
    return found[0][0]


def venue_dimension(spark: SparkSession, path: str) -> DataFrame:
    """(title_normalized, quartile) of a CSV file with a header; rows with a blank are left out, of a repeated title the greatest quartile stays."""
    rows = spark.read.csv(path, header=True).select(F.trim("title_normalized").alias("title_normalized"), F.trim("quartile").alias("quartile"))
    return rows.where("title_normalized <> '' and quartile <> ''").groupBy("title_normalized").agg(F.max("quartile").alias("quartile"))


def override_lines(lines: DataFrame, line: str) -> DataFrame:
    """(title, quartile) of lines "title,quartile": comments (#) and lines without a comma are left out, titles are keys."""
    text = F.trim(line)
    parts = F.split(text, ",", 2)
    rows = lines.where(~text.startswith("#") & text.contains(","))
    return rows.select(venue_key(parts[0]).alias("title"), F.trim(parts[1]).alias("quartile"))


def duplicate_of(candidates: DataFrame, known: DataFrame, tiers: list[tuple[Column, Column]], key: str, known_key: str) -> DataFrame:
    """(key, known_key, tier): each candidate by the first tier in which its value equals a known one; of equals the least known key."""
    found = None
    for no, (own, other) in enumerate(tiers, 1):
        left = candidates if found is None else candidates.join(found.select(key), key, "left_anti")
        values = known.select(other.alias("v"), known_key).where("v is not null").groupBy("v").agg(F.min(known_key).alias(known_key))
        met = left.select(key, own.alias("v")).join(values, "v").select(key, known_key, F.lit(no).alias("tier"))
        found = met if found is None else found.unionByName(met)
    return found


def markdown_table(headers: Column, rows: Column, caption: Column) -> Column:
    """A table in markdown: its caption, a line of headers and one below, rows filled up or cut to the headers' number."""
    n = F.greatest(F.size(headers), F.lit(0))
    cell = lambda c: F.coalesce(c, F.lit(""))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    full = lambda r: F.slice(F.concat(F.transform(F.coalesce(r, F.array().cast("array<string>")), cell), F.array_repeat(F.lit(""), n)), F.lit(1), n)
    head = F.when(F.coalesce(caption, F.lit("")) != "", F.array(F.concat(F.lit("**"), caption, F.lit("**")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    top = F.array(line(F.transform(headers, cell)), line(F.array_repeat(F.lit("---"), n)))
    return F.array_join(F.concat(head, top, F.transform(rows, lambda r: line(full(r)))), "\n")


class _Table(HTMLParser):
    """The cells of a table by row and column; a cell of several columns or rows stands in each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.grid: dict[tuple[int, int], str] = {}
        self.row, self.cell, self.size = -1, None, (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.row += 1
        elif tag in ("td", "th") and self.row >= 0:
            sizes = {k: int(v) for k, v in attrs if v and v.isdigit()}
            self.cell, self.size = [], (max(1, sizes.get("rowspan", 1)), max(1, sizes.get("colspan", 1)))

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            column = 0
            while (self.row, column) in self.grid:
                column += 1
            text = " ".join("".join(self.cell).split())
            self.grid |= {(self.row + r, column + c): text for r in range(self.size[0]) for c in range(self.size[1])}
            self.cell = None

    def rows(self) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in range(self.row + 1)]
        for (r, _), text in sorted(self.grid.items()):
            if r <= self.row:
                out[r].append(text)
        return out


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def html_rows(markup: pd.Series) -> pd.Series:
    """The rows of cells of an HTML table; white space is single, null gives no rows."""

    def one(text: str | None) -> list[list[str]]:
        parser = _Table()
        parser.feed(text or "")
        return parser.rows()

    return markup.map(one)


def overview(fields: list[tuple[str, Column]]) -> Column:
    """Lines "label: value" of the values that are there."""
    return F.concat_ws("\n", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in fields])


def around(text: Column, part: Column, most: int = 520) -> Column:
    """``most`` characters of a text with the first place of a part in their middle, in single blanks; the beginning if it is not there."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    at = F.coalesce(F.nullif(F.instr(plain, part), F.lit(0)), F.lit(1)) if isinstance(part, str) else F.greatest(F.locate(part, plain), F.lit(1))
    return F.trim(F.substring(plain, F.greatest(at - most // 2, F.lit(1)), F.lit(most)))


def abstract_of(text: Column) -> Column:
    """What stands between a heading "Abstract" in the first lines and the next heading or the end; null without one."""
    body = F.regexp_extract(text, r"(?is)^(?:[^\n]*\n){0,5}[#* ]*abstract[*:. ]*\n(.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(body, r"(?s)\n#.*$", "")), F.lit(""))


def replaced_rows(old: DataFrame, new: DataFrame, doc: str, kind: str, of: str) -> DataFrame:
    """Rows after new ones of one kind were made: a document's old rows of that kind go only if it has new ones."""
    gone = new.select(doc).distinct().withColumn(kind, F.lit(of))
    return old.join(gone, [doc, kind], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def numbered_within(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their place in their group, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)


def ligature_cells(cells: Column) -> Column:
    """How many cells hold a ligature, or a word that one has fallen out of, as "eld" in "fi eld" read as " eld"."""
    return F.size(F.filter(cells, lambda c: c.rlike(r"[ﬀ-ﬆ]|\b(eld|ow|ux|rst|nal|lter)\b")))
