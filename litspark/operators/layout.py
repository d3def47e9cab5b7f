"""Boxes on pages: crops, strips, overlaps, free places, gaps in numbers, thresholds, grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crops(captions: DataFrame, kind: str, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """(id, doc, page, x0, y0, x1, y1): from each caption of a kind down to the next caption of any kind, or the page's end.

    Captions are (id, doc, page, kind, y0, y_center); empty crops are left out.
    """
    w = Window.partitionBy("doc", "page").orderBy("y_center", "id")
    boxes = captions.withColumn("y1", F.coalesce(F.lead("y0").over(w), F.lit(height))).where((F.col("kind") == kind) & (F.col("y1") > F.col("y0")))
    return boxes.select("id", "doc", "page", F.lit(0.0).alias("x0"), "y0", F.lit(width).alias("x1"), "y1")


def strips(boxes: DataFrame, overlap: float = 0.15) -> DataFrame:
    """(id, strip, y0, y1): tall boxes (id, x0, y0, x1, y1) as square strips that overlap; others stay whole."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    step = w * (1 - overlap)
    n = F.when((h <= w) | (w <= 0), F.lit(1)).otherwise(F.ceil((h - w) / step) + 1).cast("int")
    rows = boxes.withColumn("_step", step).withColumn("_w", F.when(n > 1, w).otherwise(h)).withColumn("strip", F.explode(F.sequence(F.lit(0), n - 1)))
    top = F.col("y0") + F.col("strip") * F.col("_step")
    return rows.select("id", F.col("strip").cast("long").alias("strip"), top.alias("_top"), F.least(top + F.col("_w"), F.col("y1")).alias("y1")).withColumnRenamed("_top", "y0")


def area(box: Column) -> Column:
    return F.greatest(box["x1"] - box["x0"], F.lit(0.0)) * F.greatest(box["y1"] - box["y0"], F.lit(0.0))


def shared_area(a: Column, b: Column) -> Column:
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def overlapping(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """(id_a, id_b, iou): boxes (id, doc, page, box) of one page that overlap by more than ``least``.

    Boxes are joined through the cells of a grid that they touch, so that only neighbours meet,
    however many boxes a page has.
    """
    cell = 100.0
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))
    b = F.col("box")
    placed = boxes.withColumn("cx", F.explode(cells(b["x0"], b["x1"]))).withColumn("cy", F.explode(cells(b["y0"], b["y1"])))
    other = placed.select("doc", "page", "cx", "cy", F.col("id").alias("id_b"), F.col("box").alias("box_b"))
    pairs = placed.join(other, ["doc", "page", "cx", "cy"]).where("id < id_b").select(F.col("id").alias("id_a"), "id_b", "box", "box_b").dropDuplicates(["id_a", "id_b"])
    inter = shared_area(F.col("box"), F.col("box_b"))
    iou = inter / F.greatest(area(F.col("box")) + area(F.col("box_b")) - inter, F.lit(1e-9))
    return pairs.select("id_a", "id_b", iou.alias("iou")).where(F.col("iou") > least)


def distance(x: Column, y: Column, box: Column) -> Column:
    """Distance of a point from a box, 0 inside."""
    dx = F.greatest(box["x0"] - x, F.lit(0.0), x - box["x1"])
    dy = F.greatest(box["y0"] - y, F.lit(0.0), y - box["y1"])
    return F.sqrt(dx * dx + dy * dy)


def free_points(boxes: DataFrame, clear: float = 24.0, away: float = 12.0) -> DataFrame:
    """(id, place, x, y): for each box (id, doc, page, box) the first of four places beside it that no other box of the page is near.

    Places are right, left, above and below; a box without a free place is left out.
    """
    b = F.col("box")
    mid_x, mid_y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    place = lambda k, x, y: F.struct(F.lit(k).alias("place"), x.alias("x"), y.alias("y"))
    places = F.array(place(0, b["x1"] + away, mid_y), place(1, b["x0"] - away, mid_y), place(2, mid_x, b["y0"] - away), place(3, mid_x, b["y1"] + away))
    points = boxes.select("id", "doc", "page", F.explode(places).alias("p")).select("id", "doc", "page", "p.place", "p.x", "p.y")
    # points meet the boxes of the cells around them, as far as ``clear`` reaches
    cell = lambda v: F.floor(v / 100.0).cast("int")
    points = points.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y")))
    other = boxes.select(F.col("id").alias("other"), "doc", "page", F.col("box").alias("foreign"))
    o = F.col("foreign")
    other = other.withColumn("cx", F.explode(F.sequence(cell(o["x0"] - clear), cell(o["x1"] + clear))))
    other = other.withColumn("cy", F.explode(F.sequence(cell(o["y0"] - clear), cell(o["y1"] + clear))))
    near = points.join(other, ["doc", "page", "cx", "cy"]).where((F.col("other") != F.col("id")) & (distance(F.col("x"), F.col("y"), F.col("foreign")) < clear))
    free = points.join(near.select("id", "place").distinct(), ["id", "place"], "left_anti")
    return free.groupBy("id").agg(F.min(F.struct("place", "x", "y")).alias("p")).select("id", F.col("p.place").cast("long").alias("place"), "p.x", "p.y")


def number_gaps(captions: DataFrame) -> DataFrame:
    """(doc, kind, n, largest, repeated, missing): of captions (doc, kind, number) the whole numbers, which of them stand twice, and which are left out."""
    numbers = captions.where(F.col("number").rlike("^[0-9]{1,4}$")).withColumn("k", F.col("number").cast("int"))
    counts = numbers.groupBy("doc", "kind", "k").agg(F.count("*").alias("times"))
    out = counts.groupBy("doc", "kind").agg(F.count("*").alias("n"), F.max("k").alias("largest"), F.count_if(F.col("times") > 1).alias("repeated"), F.sort_array(F.collect_list("k")).alias("ks"))
    gaps = F.array_except(F.when(F.col("largest") >= 1, F.sequence(F.lit(1), F.col("largest"))).otherwise(F.array().cast("array<int>")), "ks")
    return out.select("doc", "kind", "n", "largest", "repeated", F.array_join(gaps, ",").alias("missing"))


def outlier_threshold(rows: DataFrame, group: str, value: str, least: int = 3) -> DataFrame:
    """(group, threshold): q3 + 1.5 (q3 - q1) of each group of ``least`` values, the quartiles at index n div 4 and 3 n div 4 in order."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("whole", F.sum("n").over(w))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    q = run.where(F.col("whole") >= least).groupBy(group).agg(at(F.floor(F.col("whole") / 4)).alias("q1"), at(F.floor(3 * F.col("whole") / 4)).alias("q3"))
    return q.select(group, (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("threshold"))


def grade(pages: Column, sections: Column, tables: dict[str, Column], figures: dict[str, Column]) -> Column:
    """A letter for what was taken out of a document.

    ``tables`` and ``figures`` are counts: found, captioned (of the found), captions (seen in the
    text) and missing (numbers left out). F: no page with text, or two fields missed whole; D: one
    missed whole; A: nothing missing, and sections; C: under four fifths of tables or figures have
    a caption; B else. A field is missed whole if things were found and none has a caption, or
    captions were seen and nothing was found.
    """
    zero = F.lit(0)
    missed = [F.when((k["found"] > 0) & (k["captioned"] == 0), 1).otherwise(zero) for k in (tables, figures)]
    missed += [F.when((k["captions"] > 0) & (k["found"] == 0), 1).otherwise(zero) for k in (tables, figures)]
    fields = reduce(lambda a, b: a + b, missed)
    whole = [(k["missing"] <= 0) & (k["found"] <= k["captioned"]) for k in (tables, figures)]
    few = [(k["found"] > 0) & (k["captioned"] < 0.8 * k["found"]) for k in (tables, figures)]
    return (
        F.when((pages == 0) | (fields >= 2), "F").when(fields == 1, "D").when(whole[0] & whole[1] & (sections > 0), "A").when(few[0] | few[1], "C").otherwise("B")
    )
