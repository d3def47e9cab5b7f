"""Figures and tables on pages: captions that belong to them, continuations, overlaps, merging, and the choice of formulas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.operators.layout import area, shared_area


def recrop(box: Column, percent: Column) -> Column:
    """A part of a box that four percentages of its width and height name, each held between 0 and 100."""
    held = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent[k])) / 100.0
    wide, high = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return F.struct(
        (box["x0"] + held(0) * wide).alias("x0"), (box["y0"] + held(1) * high).alias("y0"), (box["x0"] + held(2) * wide).alias("x1"), (box["y0"] + held(3) * high).alias("y1")
    )


def figure_sized(box: Column, page: Column) -> Column:
    """Whether a box is as large as a figure: a two-hundredth of the page at least, nine tenths at most."""
    return (area(box) >= page / 200) & (area(box) <= 0.9 * page)


def _bands(rows: DataFrame, high: float = 50.0) -> DataFrame:
    b = F.col("box")
    return rows.withColumn("band", F.explode(F.sequence(F.floor(b["y0"] / high).cast("int"), F.floor(b["y1"] / high).cast("int"))))


def side_by_side(boxes: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc, page, beside): whether two boxes (id, doc, page, box) of a page share over ``share`` of the lower one's height.

    Boxes meet in the bands of the page that they touch.
    """
    a = _bands(boxes)
    b = a.select("doc", "page", "band", F.col("id").alias("other"), F.col("box").alias("other_box"))
    high = lambda x: x["y1"] - x["y0"]
    mine, its = F.col("box"), F.col("other_box")
    both = F.least(mine["y1"], its["y1"]) - F.greatest(mine["y0"], its["y0"])
    least = F.least(high(mine), high(its))
    met = a.join(b, ["doc", "page", "band"]).where((F.col("id") < F.col("other")) & (least > 0) & (both > share * least))
    pages = met.select("doc", "page").distinct().withColumn("beside", F.lit(True))
    return boxes.select("doc", "page").distinct().join(pages, ["doc", "page"], "left").fillna(False, ["beside"])


def tables_in_figures(tables: DataFrame, figures: DataFrame, share: float = 0.5) -> DataFrame:
    """(id, inside): of tables (id, doc, page, box, captioned) those without a caption whose area a figure of the page covers by over ``share``."""
    placed = _bands(tables.where(~F.col("captioned") & (area(F.col("box")) > 0)))
    other = _bands(figures).select("doc", "page", "band", F.col("box").alias("figure"))
    covered = placed.join(other, ["doc", "page", "band"]).where(shared_area(F.col("box"), F.col("figure")) > share * area(F.col("box")))
    return tables.select("id").join(covered.select("id").distinct().withColumn("inside", F.lit(True)), "id", "left").fillna(False, ["inside"])


def header_key(headers: Column) -> Column:
    """The headers of a table in lower case without blank ones, as one text; null if it has fewer than two."""
    names = F.filter(F.transform(headers, lambda h: F.lower(F.trim(F.coalesce(h, F.lit(""))))), lambda h: h != "")
    return F.when((F.size(headers) >= 2) & (F.size(names) > 0), F.array_join(names, "\u001f"))


def continued(tables: DataFrame, within: int = 2) -> DataFrame:
    """(id, caption): tables (id, doc, page, caption, key) without a caption as the continuation of the first one of equal headers near it."""
    first = tables.where("caption is not null and key is not null").groupBy("doc", "key", "page").agg(F.min_by("caption", "id").alias("caption"), F.min("id").alias("first"))
    near = first.withColumn("near", F.explode(F.sequence(F.col("page") - within, F.col("page") + within))).select("doc", "key", "near", "caption", "first")
    bare = tables.where("caption is null and key is not null").select("id", "doc", "key", F.col("page").alias("near"))
    found = bare.join(near, ["doc", "key", "near"]).groupBy("id").agg(F.min_by("caption", "first").alias("caption"))
    return found.select("id", F.concat("caption", F.lit(" (continued)")).alias("caption"))


def merged(boxes: DataFrame, gap: float = 20.0, share: float = 0.2) -> DataFrame:
    """(doc, page, no, box): boxes (doc, page, box) of a page in reading order, each joined to the last if they are near and above each other.

    Near are boxes that touch within ``gap``; boxes beside each other, which share under ``share``
    of the narrower one's width, stay apart. A page's boxes are folded in one row.
    """
    row = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
    rows = boxes.groupBy("doc", "page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("box.y0").alias("y0"), F.col("box.x0").alias("x0"), F.col("box.y1").alias("y1"), F.col("box.x1").alias("x1")))).alias("b")
    )

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        wide = F.least(last["x1"] - last["x0"], b["x1"] - b["x0"])
        beside = (wide > 0) & (F.least(last["x1"], b["x1"]) - F.greatest(last["x0"], b["x0"]) < share * wide)
        near = (b["x0"] < last["x1"] + gap) & (b["x1"] > last["x0"] - gap) & (b["y0"] < last["y1"] + gap) & (b["y1"] > last["y0"] - gap)
        own = F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
        union = F.struct(
            F.least(last["x0"], b["x0"]).alias("x0"), F.least(last["y0"], b["y0"]).alias("y0"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1")
        )
        kept = F.slice(done, 1, F.size(done) - 1)
        return F.when((F.size(done) == 0) | beside | ~near, F.concat(done, F.array(own))).otherwise(F.concat(kept, F.array(union)))

    folded = rows.select("doc", "page", F.aggregate("b", F.array().cast(row), step).alias("m"))
    return folded.select("doc", "page", F.posexplode("m").alias("no", "box"))


def nearest_above(things: DataFrame, lines: DataFrame, zone: float) -> DataFrame:
    """(id, line_id): the lowest line (line_id, doc, page, y1) that ends within ``zone`` above each thing (id, doc, page, y0); lines meet things by bands of the zone's height."""
    cell = lambda c: F.floor(c / zone)
    near = lines.withColumn("cell", F.explode(F.array(cell(F.col("y1")), cell(F.col("y1")) + 1)))
    met = things.withColumn("cell", cell(F.col("y0"))).join(near, ["doc", "page", "cell"]).where((F.col("y1") <= F.col("y0")) & (F.col("y1") >= F.col("y0") - zone))
    return met.groupBy("id").agg(F.max_by("line_id", F.struct("y1", "line_id")).alias("line_id"))


def paired_by_rank(captions: DataFrame, things: DataFrame) -> DataFrame:
    """(caption_id, thing_id): on each page the captions in order of number beside the things in order of height."""
    w = lambda *order: Window.partitionBy("doc", "page").orderBy(*order)
    a = captions.withColumn("rank", F.row_number().over(w("number", "caption_id")))
    b = things.withColumn("rank", F.row_number().over(w("y", "thing_id")))
    return a.join(b, ["doc", "page", "rank"]).select("caption_id", "thing_id")


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the value at place n div 2 of each group in order; values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("whole", F.sum("n").over(w))
    return run.where(F.col("upto") > F.floor(F.col("whole") / 2)).groupBy(group).agg(F.min(value).alias("median"))


def main_style(spans: DataFrame, doc: str, style: list[str], size: str) -> DataFrame:
    """(doc, style...): the style that most characters of a document have; of equal ones the first in order."""
    sums = spans.groupBy(doc, *style).agg(F.sum(size).alias("n"))
    best = F.min_by(F.struct(*style), F.struct((-F.col("n")).alias("n"), *style)).alias("s")
    return sums.groupBy(doc).agg(best).select(doc, "s.*")


def mostly(spans: DataFrame, key: str, flag: Column, size: str) -> DataFrame:
    """(key, mostly): whether over half of a key's characters have a flag."""
    return spans.groupBy(key).agg((F.sum(F.when(flag, F.col(size)).otherwise(0)) > 0.5 * F.sum(size)).alias("mostly"))


def picked(rows: DataFrame, a_page: int, a_document: int) -> DataFrame:
    """Rows (id, doc, page, confidence): the best of each page, and of these the best of each document."""
    order = [F.desc("confidence"), F.col("id")]
    page = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc", "page").orderBy(*order))).where(F.col("_n") <= a_page)
    return page.withColumn("_n", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).where(F.col("_n") <= a_document).drop("_n")


def entries_in_boxes(entries: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, box_id): for each entry (id, doc, page, text) the box (box_id, doc, page, text) of its page, else the next, else the one before, of which one text holds the other."""
    asked = entries.select("id", "doc", F.lower("text").alias("t"), F.inline(F.array(*[F.struct((F.col("page") + s).alias("page"), F.lit(k).alias("turn")) for k, s in enumerate((0, 1, -1))])))
    near = boxes.select("box_id", "doc", "page", F.lower("text").alias("b"))
    met = asked.join(near, ["doc", "page"]).where((F.col("t") != "") & (F.col("b") != "") & (F.contains("t", "b") | F.contains("b", "t")))
    return met.groupBy("id").agg(F.min_by("box_id", F.struct("turn", "box_id")).alias("box_id"))


def artifact(headers: Column, rows: Column, caption: Column) -> Column:
    """What a table that is none is: table_of_contents if enough of its cells, or of its rows by first and last cell, are entries of one; diagram_as_table if it holds a figure's caption; null else."""
    cells = F.concat(F.coalesce(headers, F.array().cast("array<string>")), F.coalesce(F.flatten(rows), F.array().cast("array<string>")))
    n = F.greatest(F.size(rows), F.lit(0)) + F.when(F.size(headers) > 0, 1).otherwise(0)
    entry = F.size(F.filter(cells, lambda c: F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)*\.?\s+\S.*\s[0-9]{1,4}$")))
    number = lambda c: F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)*\.?$")
    columns = F.size(F.filter(rows, lambda r: (F.size(r) >= 3) & number(F.get(r, F.lit(0))) & number(F.element_at(r, -1))))
    real = F.coalesce(caption.rlike(r"(?i)^\s*(table|tab\.)\s*[0-9ivx]"), F.lit(False))
    figure = F.array_join(cells, " ").rlike(r"(?i)\bfig(ure|\.)\s*[0-9]+\s*[.:]")
    return (
        F.when((entry >= 3) & (entry >= 0.4 * n), "table_of_contents")
        .when(~real & (n >= 2) & (columns >= 2) & (columns >= 0.4 * n), "table_of_contents")
        .when(~real & figure, "diagram_as_table")
    )


def valid_mark(quote: Column, kind: Column, comment: Column, box: Column, kinds: tuple[str, ...] = ("highlight", "region"), caps: tuple[int, int] = (500, 1000)) -> Column:
    """Why a mark on a page can't be made: its kind, a quote or comment of too many bytes or none, or a box turned over; null if it can."""
    coords = [box[c] for c in ("x0", "y0", "x1", "y1")]
    finite = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in coords])
    return (
        F.when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "kind")
        .when((kind == "highlight") & (F.trim(F.coalesce(quote, F.lit(""))) == ""), "no quote")
        .when(F.octet_length(quote) > caps[0], "quote too long")
        .when(F.octet_length(comment) > caps[1], "comment too long")
        .when((kind == "region") & ~(finite & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])), "box")
    )
