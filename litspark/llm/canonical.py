"""Problem 2: values typed freely, mapped to a canonical list by character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.sources.tables import small, written

#: Least weighted cosine of a candidate, and by how much the best must beat the next that stands the exact check.
THRESHOLD, MARGIN = 0.5, 0.002
#: Share of what may be left out of a form's squared weights that is left out; less of it makes fewer candidates of more lookups.
LIGHT = 0.2
#: Words that carry no meaning in a venue name.
EMPTY_WORDS = ("of", "on", "the", "in", "and", "de", "for", "la", "le", "der", "und", "et", "del", "f")


def _ascii_letters() -> tuple[str, str]:
    """Letters with marks, and the letters they are without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words(value: Column) -> Column:
    """The meaningful words of a name as typed: entities and marks resolved, decorations and empty words dropped.

    A closing part in brackets, a volume or issue, and a remark after a dash are decorations;
    "X, Journal of" is read as "Journal of X". Null gives an empty array.
    """
    text = F.lower(F.coalesce(value, F.lit("")))
    text = F.regexp_replace(text, r"&(amp|#38);|&", " and ")
    text = F.regexp_replace(text, r"[\s\p{Z}/_]+", " ")
    text = F.translate(text, *_ascii_letters())
    text = F.regexp_replace(F.trim(text), r"\s*[(\[][^)\]]*[)\]]?$", "")
    text = F.regexp_replace(text, r"\s+-\s+[^-]*$", "")
    text = F.regexp_replace(text, r"[\s,]+(v[a-z]{0,2}\.?\s*)?[0-9]+(\s*\([0-9]+\))?\s*$", "")
    text = F.regexp_replace(text, r"^([^,]+),\s*([^,]+)$", "$2 $1")
    parts = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(*EMPTY_WORDS))


def _grams(parts: Column) -> Column:
    """Distinct trigrams of the words, anchored at their beginnings, so that an abbreviation's are among the word's."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                parts,
                lambda w: F.transform(
                    F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^^"), w), i, F.lit(3))
                ),
            )
        )
    )


@lru_cache(maxsize=200_000)
def _distance(a: str, b: str) -> int:
    """Edits between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (x != y))
    return row[-1]


@lru_cache(maxsize=200_000)
def _edits(word: str, name: str, known: bool) -> int | None:
    """Edits by which a typed word differs from a word of a name; None if it means another word."""
    if word == name:
        return 0
    if known:
        return None
    if name.startswith(word):
        return 0
    most = 3 if len(name) >= 10 else 2 if len(name) >= 6 else 1
    if abs(len(word) - len(name)) <= 4:
        whole = _distance(word, name)
        if whole <= most or (whole <= 4 and sorted(word) == sorted(name)):
            return whole
    if 4 <= len(word) < len(name):
        begun = _distance(word, name[: len(word)])
        return begun + 1 if begun <= 1 else None
    return None


@lru_cache(maxsize=50_000)
def _empty(word: str) -> bool:
    """Whether a typed word may stand for nothing: one or two letters, or a misspelt empty word."""
    return len(word) < 3 or (len(word) <= 4 and any(_distance(word, e) <= 1 for e in EMPTY_WORDS))


def _left_over(typed: list[str], own: list[bool], names: list[str]) -> int | None:
    """The exact check: every word of the entry is typed, whole, begun or misspelt, and every typed word is one of the entry's or empty.

    The number of typed words of three letters and more that stand for none of the entry's; None if the check fails.
    """
    met = [[_edits(w, n, k) is not None for n in names] for w, k in zip(typed, own)]
    idle = [w for m, w in zip(met, typed) if not any(m)]
    if not all(any(m[k] for m in met) for k in range(len(names))) or not all(map(_empty, idle)):
        return None
    return sum(len(w) >= 3 for w in idle)


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates with their exact cosine, those that stand the check of the words."""
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            shared = set(r.grams)
            dot = sum(w * w for g, w in zip(r.name_grams, r.weights) if g in shared)
            cosine = dot / (r.form_norm * r.norm)
            left = _left_over(list(r.words), list(r.own), list(r.name_words)) if cosine >= r.threshold else None
            if left is not None:
                out.append((r.form, r.name, cosine, left))
        yield pd.DataFrame(out, columns=["form", "name", "cosine", "left"])


def map_values(
    values: DataFrame, value_col: str, canon: DataFrame, canon_col: str, threshold: float = THRESHOLD, margin: float = MARGIN
) -> DataFrame:
    """(value, n, matched, cosine): each distinct value, its rows, and the entry of the list it means, or null.

    Distinct values are normalised to words, and their distinct forms looked up in an inverted
    index of trigrams of the list by their weightiest trigrams: the light ones, which very many
    entries have, are left out as far as they could not lift a cosine to ``threshold`` alone.
    Candidates that can reach it are scored by the exact cosine of idf weights. Of those that
    reach it and stand an exact check, by which every word of the entry must be typed, whole,
    begun or misspelt, and every typed word but one or two letters and misspelt empty words must
    be one of the entry's, the best of those with the fewest words left over is accepted if it
    beats the next by ``margin``. Null, blank
    and filler values and ties remain unmatched. Repeated entries of the list count once.
    """
    typed = values.select(F.col(value_col).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    typed = written(typed.withColumn("words", words(F.col("value"))).withColumn("form", F.array_join("words", " ")), "typed")
    names = canon.select(F.col(canon_col).alias("name")).where("name is not null").distinct()
    names = names.withColumn("name_words", words(F.col("name"))).where("size(name_words) > 0")
    # entries, trigrams and forms go by numbers, which are fixed once they are written
    names = written(names.withColumn("name_id", F.monotonically_increasing_id()), "names")
    index = names.select("name_id", F.explode(_grams(F.col("name_words"))).alias("gram"))
    weights = index.groupBy("gram").agg(F.log1p(F.lit(float(names.count())) / F.count("*")).alias("w"))
    weights = small(written(weights.withColumn("gram_id", F.monotonically_increasing_id()), "weights"))
    index = index.join(weights, "gram")
    entries = index.groupBy("name_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list("gram_id").alias("name_grams"), F.collect_list("w").alias("weights")
    )
    entries = small(written(entries.join(names, "name_id"), "entries"))
    index = index.join(entries.select("name_id", "norm"), "name_id").select("gram_id", "name_id", "norm", (F.col("w") * F.col("w")).alias("part"))
    index = small(written(index, "grams"))

    # few bytes make much work here, so the parts are set by the cores and not by their size
    parts = 4 * values.sparkSession.sparkContext.defaultParallelism
    forms = typed.where("size(words) > 0").select("form", "words").distinct()
    # words that the list itself uses mean themselves
    own = small(written(names.select(F.explode("name_words").alias("word")).distinct().withColumn("own", F.lit(True)), "own"))
    known = forms.select("form", F.posexplode("words").alias("at", "word")).join(own, "word", "left").groupBy("form").agg(
        F.sort_array(F.collect_list(F.struct("at", "word", F.coalesce("own", F.lit(False)).alias("own")))).alias("p")
    )
    known = known.select("form", F.col("p.word").alias("words"), F.col("p.own").alias("own"), _grams(F.col("p.word")).alias("grams"))
    asked = known.select("form", F.explode("grams").alias("gram")).join(weights, "gram", "left")
    square = F.col("w") * F.col("w")
    asked_norms = asked.groupBy("form").agg(
        F.sum(F.coalesce(square, F.lit(1.0))).alias("whole"),
        F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct(square.alias("part"), "gram_id")))).alias("known"),
    )
    # grams from the lightest; those within the share of the norm that can't lift a cosine to the threshold
    sums = F.aggregate(
        "known", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["part"]))
    )
    asked_norms = asked_norms.withColumn("sums", sums)
    asked_norms = asked_norms.withColumn("light", F.size(F.filter("sums", lambda x: x < LIGHT * threshold**2 * F.col("whole"))) - 1)
    asked_norms = asked_norms.select(
        "form", F.sqrt("whole").alias("form_norm"), F.element_at("sums", F.col("light") + 1).alias("rest"), F.col("known.gram_id").alias("grams"),
        F.slice("known", F.col("light") + 1, F.greatest(F.size("known") - F.col("light"), F.lit(0)))["gram_id"].alias("heavy"),
    )
    known = known.drop("grams").join(asked_norms, "form").withColumn("form_id", F.monotonically_increasing_id())
    known = written(known, "forms").repartition(parts, "form_id")
    heavy = known.select("form_id", "form_norm", "rest", F.explode("heavy").alias("gram_id"))
    # all of a form is in one part, so that its candidates are summed where they are found
    met = heavy.join(index, "gram_id").groupBy("form_id", "name_id", "form_norm", "rest", "norm").agg(F.sum("part").alias("part"))
    rest = F.least("rest", F.col("norm") * F.col("norm") - F.col("part"))
    met = met.where(F.col("part") + rest >= (threshold - 1e-9) * F.col("form_norm") * F.col("norm")).select("form_id", "name_id")
    pairs = met.join(known.drop("heavy", "rest"), "form_id").join(entries, "name_id").withColumn("threshold", F.lit(threshold))
    checked = pairs.mapInPandas(_checked, "form string, name string, cosine double, left int")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("left"), "cosine", "name")), False)
    best = checked.groupBy("form").agg(ranked.alias("r")).withColumn("next", F.get("r", F.lit(1)))
    beaten = F.col("next").isNull() | (F.col("next.left") < F.col("r")[0]["left"]) | (F.col("r")[0]["cosine"] - F.col("next.cosine") >= margin)
    best = best.where(beaten).select("form", F.col("r")[0]["name"].alias("matched"), F.col("r")[0]["cosine"].alias("cosine"))
    return typed.join(best, "form", "left").select("value", "n", "matched", "cosine")
