"""Formulas among the lines of a text: how likely a line is one, and whether its source is worth an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that no formula holds, the signs of mathematics, and the points of each sign of a formula.
NOISE = r"(?i)\b(abstract|references|figure|table|copyright|doi|keywords)\b"
SYMBOLS = r"[=+\-*/<>≤≥≈≠∑∏∫√∞∂∇α-ωΑ-Ω_{}^]|\\[A-Za-z]+"
WORDS = r"[A-Za-z]{3,}"
POINTS = {"symbols": 0.25, "density": 0.20, "font": 0.22, "flags": 0.10, "number": 0.08, "shape": 0.08, "assignment": 0.15, "prose": -0.25}
LENGTH, LEAST_DENSITY, PROSE_WORDS, PROSE_DENSITY = (4, 900), 0.04, 14, 0.08
#: A number of an equation: named, or in brackets at the end behind a sign.
NUMBERED = r"(?i)\beq\.? ?\([0-9]+(\.[0-9]+)?\)|[=+\-*/<>≤≥≈≠∑∏∫√∞∂∇_{}^][^()\n]{0,160}\([0-9]+(\.[0-9]+)?\)\s*$"


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def formula_score(text: Column, wide: Column, high: Column, math_font: Column, math_flags: Column) -> Column:
    """How likely a line is a formula, from 0 to 1: points for its signs, its fonts, its number and its shape, less some for prose.

    Lines that are too short, too long or too small, or hold a word that no formula holds, have 0; null has 0.
    """
    signs, n = _hits(text, SYMBOLS), F.length(text)
    density = signs / F.greatest(n, F.lit(1))
    shown = {
        "symbols": signs >= 2, "density": density >= LEAST_DENSITY, "font": math_font, "flags": math_flags, "number": text.rlike(NUMBERED),
        "shape": (wide > 80) & (high < 120), "assignment": text.rlike(r"\b[A-Za-z]\s*[=<>≈]\s*"), "prose": (_hits(text, WORDS) > PROSE_WORDS) & (density < PROSE_DENSITY),
    }
    score = F.lit(0.0)
    for name, there in shown.items():
        score = score + F.when(there, POINTS[name]).otherwise(0.0)
    none = text.isNull() | ~n.between(*LENGTH) | text.rlike(NOISE) | (wide < 8) | (high < 5)
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def useful_latex(latex: Column) -> Column:
    """Whether a formula's source is worth an index: of 3 to 1,500 characters, no words of a page, over two different characters, and signs, a command, or an assignment of a variable."""
    text = F.trim(F.coalesce(latex, F.lit("")))
    kinds = F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))
    command = F.contains(text, F.lit("\\"))
    assigned = F.contains(text, F.lit("=")) & text.rlike(r"[A-Za-z][_^]|\b[A-Za-z]\b")
    return F.length(text).between(3, 1500) & ~text.rlike(NOISE) & (kinds > 2) & ((_hits(text, SYMBOLS) >= 2) | command | assigned)


def recovered_captions(things: DataFrame, captions: DataFrame, most: float) -> DataFrame:
    """(thing_id, caption_id): things without a caption (thing_id, doc, page, y) and the floating caption (caption_id, doc, page, y) nearest to each within ``most``.

    A caption goes to the nearest thing that it is nearest to; ties go to the smaller ids. Things
    and captions meet in bands of a page.
    """
    cell = lambda c: F.floor(c / most)
    near = captions.withColumn("cell", F.explode(F.array(cell(F.col("y")) - 1, cell(F.col("y")), cell(F.col("y")) + 1))).withColumnRenamed("y", "caption_y")
    met = things.withColumn("cell", cell(F.col("y"))).join(near, ["doc", "page", "cell"]).withColumn("away", F.abs(F.col("y") - F.col("caption_y")))
    first = lambda key, other: F.row_number().over(Window.partitionBy(key).orderBy("away", other))
    one = met.where(F.col("away") <= most).withColumn("n", first("thing_id", "caption_id")).where("n = 1")
    return one.withColumn("n", first("caption_id", "thing_id")).where("n = 1").select("thing_id", "caption_id")
