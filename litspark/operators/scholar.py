"""Works, candidates, venues and citations."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.functions.identifiers import venue_key

# Abbreviations in venue names and what each may stand for.
ABBREVIATIONS = {
    "trans.": ("transactions",),
    "biomed.": ("biomedical",),
    "eng.": ("engineering",),
    "j.": ("journal",),
    "proc.": ("proceedings",),
    "int.": ("international",),
    "sci.": ("science", "sciences"),
    "rev.": ("review", "reviews"),
    "lett.": ("letters",),
    "comput.": ("computer", "computing", "computational"),
    "med.": ("medicine", "medical"),
    "phys.": ("physics", "physical"),
    "chem.": ("chemistry", "chemical"),
    "appl.": ("applied",),
    "res.": ("research",),
    "biol.": ("biology", "biological"),
    "conf.": ("conference",),
    "symp.": ("symposium",),
    "ann.": ("annual", "annals"),
    "eur.": ("european",),
    "am.": ("american",),
    "nat.": ("national", "nature", "natural"),
    "tech.": ("technology", "technical"),
    "syst.": ("systems",),
    "commun.": ("communications",),
    "electr.": ("electrical", "electronic", "electronics"),
    "rehabil.": ("rehabilitation",),
    "neurosci.": ("neuroscience",),
    "cardiovasc.": ("cardiovascular",),
    "physiol.": ("physiology", "physiological"),
}


def flat_work(works: DataFrame, most: int = 5) -> DataFrame:
    """(work_id, first_authors, n_authors, venue, year, has_doi, is_open) of each work; at most ``most`` authors are shown."""
    shown = F.array_join(F.transform(F.slice("authors", 1, most), lambda p: F.concat_ws(" ", F.nullif(p["firstName"], F.lit("")), F.nullif(p["lastName"], F.lit("")))), "; ")
    return works.select(
        "work_id", F.coalesce(shown, F.lit("")).alias("first_authors"), F.coalesce(F.size("authors"), F.lit(0)).cast("long").alias("n_authors"),
        F.coalesce("journal", F.lit("")).alias("venue"), "year", (F.coalesce("doi", F.lit("")) != "").alias("has_doi"), F.col("oa_url").isNotNull().alias("is_open"),
    )


def inverted_index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, index): a map of each word of a text to its positions, from 0."""
    words = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.trim(text_col), r"\s+")).alias("at", "word"))
    by_word = words.groupBy("id", "word").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return by_word.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "ats"))).alias("index"))


def rebuilt(index: Column) -> Column:
    """The text of a map of words to positions; of two words at one position the later in order stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")


def upper_quartile(rows: DataFrame, group: str, value: str, floor: float, least: int = 5) -> DataFrame:
    """(group, threshold): the value at index n * 3/4 of each group in order, at least ``floor``; groups of fewer than ``least`` have none.

    Values are counted first, so that a group of very many rows is a short list of distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("whole", F.sum("n").over(w))
    hit = run.where((F.col("whole") >= least) & (F.col("upto") > F.floor(F.col("whole") * 0.75)))
    return hit.groupBy(group).agg(F.greatest(F.min(value), F.lit(floor)).alias("threshold"))


def deduplicated(candidates: DataFrame, keys: list[Column], order: str, sources: str) -> DataFrame:
    """(key, first_id, copies, sources): candidates of one key, the first key a candidate has in the order of ``keys``.

    ``sources`` are the distinct values of a column, in order.
    """
    tagged = [F.concat(F.lit(f"{k}:"), c) for k, c in enumerate(keys)]
    rows = candidates.select(F.coalesce(*tagged).alias("key"), F.col(order).alias("at"), F.col(sources).alias("source")).where("key is not null")
    return rows.groupBy("key").agg(
        F.min("at").alias("first_id"), F.count("*").alias("copies"), F.array_join(F.sort_array(F.collect_set("source")), "; ").alias("sources")
    )


def round_robin(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows, one of each group in turn, larger groups first.

    Only the first ``n`` of a group can be taken, and they are found by a limit of each group
    before the groups meet.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"))
    w = Window.partitionBy(group).orderBy(order)
    first = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return first.join(sizes, group).orderBy("turn", F.desc("size"), group).limit(n).select(group, order, "turn")


def _written_out(short: str, words: tuple[str, ...]) -> Callable[[Column], Column]:
    def write(x: Column) -> Column:
        every = [F.overlay(x, F.lit(w), F.locate(short, x), F.lit(len(short))) for w in words]
        return F.when(x.contains(short), F.array(*every)).otherwise(F.array(x))

    return write


def expansions(name: Column) -> Column:
    """The keys that a venue's name may stand for: each abbreviation it holds in turn, at its first place, by each of its words."""
    out = F.array(F.lower(name))
    for short, words in ABBREVIATIONS.items():
        out = F.flatten(F.transform(out, _written_out(short, words)))
    # every abbreviation ends in a point
    return F.transform(F.when(name.contains("."), out).otherwise(F.array(F.lower(name))), venue_key)


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 x (1 - insertions and deletions / both lengths), from the longest common subsequence."""

    def one(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        row = [0] * (len(y) + 1)
        for ch in x:
            before = 0
            for k, other in enumerate(y, 1):
                before, row[k] = row[k], before + 1 if ch == other else max(row[k], row[k - 1])
        return 200.0 * row[-1] / (len(x) + len(y))

    return pd.Series([one(x, y) if x is not None and y is not None else None for x, y in zip(a, b)])


def venue_lookup(
    names: DataFrame, name_col: str, dim: DataFrame, key_col: str, value_col: str, cutoff: float = 90.0, overrides: DataFrame | None = None
) -> DataFrame:
    """(name, value, tier) of each distinct name: 0 an override (title, value), 1 exact key, 2 abbreviations written out, 3 the most alike entry from ``cutoff``.

    Of several ways to write a name out the first that is an override or an entry counts. An alike
    name holds one of an entry's segments, near its place: an entry has one segment more
    than the insertions and deletions that the cutoff allows at any length of the name, so that
    none is lost. Of these, those with a Levenshtein distance that the cutoff allows are scored by
    the exact ratio. Ties go to the first entry in order.
    """
    named = names.select(F.col(name_col).alias("name")).where("name is not null").distinct()
    keyed = named.withColumn("key", venue_key(F.col("name"))).withColumn("long", F.col("key"))
    dim = dim.select(F.col(key_col).alias("entry"), F.col(value_col).alias("value")).where("entry is not null").groupBy("entry").agg(F.max("value").alias("value"))
    known = dim.withColumn("tier", F.lit(1))
    if overrides is not None:
        given = overrides.select(venue_key(F.col(overrides.columns[0])).alias("entry"), F.col(overrides.columns[1]).alias("value"), F.lit(0).alias("tier"))
        given = given.groupBy("entry").agg(F.max("value").alias("value"), F.max("tier").alias("tier"))
        known = given.unionByName(known.join(given.select("entry"), "entry", "left_anti"))
    exact = keyed.join(known, F.col("key") == F.col("entry")).select("name", "value", "tier")
    rest = keyed.join(exact, "name", "left_anti")
    ways = rest.where(F.col("name").contains(".")).select("name", F.posexplode(expansions(F.col("name"))).alias("at", "entry"))
    short = ways.join(known.select("entry", "value"), "entry").groupBy("name").agg(F.min_by("value", "at").alias("value"))
    short = short.select("name", "value", F.lit(2).alias("tier"))
    rest = rest.join(short, "name", "left_anti")
    if cutoff >= 100:
        return exact.unionByName(short)
    edits = F.floor(F.length("entry") * (2 * (100 - cutoff) / cutoff) + 1e-9).cast("int")
    segments = F.expr("""if(edits >= length(entry), array(struct('' AS part, 0 AS at)), transform(sequence(0, edits), i -> struct(
        substring(entry, cast(i * length(entry) div (edits + 1) AS int) + 1, cast((i + 1) * length(entry) div (edits + 1) - i * length(entry) div (edits + 1) AS int)) AS part,
        cast(i * length(entry) div (edits + 1) AS int) AS at)))""")
    entries = dim.where("entry <> ''").withColumn("edits", edits).select("entry", "value", "edits", F.inline(segments))
    longest = math.ceil(cutoff / (2 * (100 - cutoff)))
    pieces = F.expr(f"""concat(array(struct('' AS part, 0 AS place)), flatten(transform(sequence(1, {longest}), n -> transform(
        filter(sequence(0, length(long)), p -> p + n <= length(long)), p -> struct(substring(long, p + 1, n) AS part, p AS place)))))""")
    near = rest.select("name", "long", F.inline(pieces)).join(entries, "part").where(F.abs(F.col("at") - F.col("place")) <= F.col("edits"))
    most = F.floor((F.length("long") + F.length("entry")) * (100 - cutoff) / 100).cast("int")
    near = near.withColumn("most", most).where("abs(length(long) - length(entry)) <= most").select("name", "long", "entry", "value", "most").distinct()
    near = near.where("levenshtein(long, entry, most) >= 0").withColumn("ratio", indel_ratio("long", "entry")).where(F.col("ratio") >= cutoff)
    fuzzy = near.groupBy("name").agg(F.min_by("value", F.struct(-F.col("ratio"), "entry")).alias("value")).select("name", "value", F.lit(3).alias("tier"))
    return exact.unionByName(short).unionByName(fuzzy)


def edges_between(*steps: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct (src, dst) along a chain of two-column tables, each (table, from, to)."""
    first, *rest = steps
    out = first[0].select(F.col(first[1]).alias("src"), F.col(first[2]).alias("dst"))
    return reduce(lambda acc, s: acc.join(s[0].select(F.col(s[1]).alias("dst"), F.col(s[2]).alias("_to")), "dst").select("src", F.col("_to").alias("dst")), rest, out).distinct()
