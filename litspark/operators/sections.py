"""Sections of a text: headings in its lines, labels that run on, spans that are split or left out, and gates on what was read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspark.functions.text import section_of_heading

# Lines that are headings without a mark, labels a marked line may have, and what opens and closes a body.
BARE_HEADINGS = (
    "references", "bibliography", "literature cited", "methods", "online methods", "materials and methods", "data availability", "code availability",
    "acknowledgements", "acknowledgments", "author contributions", "competing interests", "ethics declarations", "additional information",
)
INLINE_LABELS = ("references", "appendix", "methods", "abstract", "introduction", "discussion", "conclusion")
OPENING, TERMINAL = ("abstract", "introduction", "background", "results"), ("methods", "references", "appendix")
# Labels of a title page.
PREAMBLE = (
    "article", "review article", "check for updates", "nature", "nature methods", "nature biotechnology", "nature cell biology",
    "nature reviews genetics", "open access", "main", "letters", "research article",
)
PREAMBLE_BEGINS = ("https://doi.org/", "doi:", "received:", "accepted:", "published:")


def unmarked(text: Column) -> Column:
    """A line without marks of markdown, a leading section number and a lone letter in brackets."""
    text = F.regexp_replace(F.regexp_replace(text, r"^#+\s*", ""), r"[*_]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"^[0-9]+(\.[0-9]+)*\.?\s*", ""), r"\(\s*[a-z]\s*\)", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bare(text: Column) -> Column:
    """A line in lower case without the marks at its ends."""
    return F.regexp_replace(F.lower(text), r"^[#*_ .:\s]+|[#*_ .:\s]+$", "")


def preamble_heading(text: Column) -> Column:
    """Whether a heading is a label of a title page."""
    low = bare(text)
    begins = F.lit(False)
    for x in PREAMBLE_BEGINS:
        begins = begins | low.startswith(x)
    return F.coalesce(low.isin(*PREAMBLE) | begins, F.lit(False))


def inline_heading(line: Column) -> Column:
    """The section that a line of at most 100 characters opens if it is marked as a heading or known as one; null else."""
    raw = F.regexp_replace(line, r"^\s+|\s+$", "")
    marked = raw.startswith("#") | raw.startswith("**") | bare(raw).isin(*BARE_HEADINGS)
    label = section_of_heading(unmarked(raw))
    return F.when((raw != "") & (F.length(raw) <= 100) & marked & label.isin(*INLINE_LABELS), label)


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, line): the lines of each text with the character at which they begin."""
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    w = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("at"), "line")


def headings_merged(known: DataFrame, found: DataFrame, key: str, apart: int = 5) -> DataFrame:
    """(key, at, label): known headings and the found ones that begin over ``apart`` characters from every known one."""
    cells = lambda df: df.withColumn("cell", F.floor(F.col("at") / (apart + 1)))
    near = cells(known).select(key, F.col("at").alias("other"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    met = cells(found).join(near, [key, "cell"]).where(F.abs(F.col("at") - F.col("other")) <= apart).select(key, "at").distinct()
    return known.select(key, "at", "label").unionByName(found.join(met, [key, "at"], "left_anti").select(key, "at", "label"))


def inherited(entries: DataFrame, key: str, order: list[str], level: str, label: str) -> DataFrame:
    """``entries`` with ``inherited``: an entry's own label, else the last label of an entry of level 1 before it."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col(level) == 1, F.col(label)), True).over(w)
    return entries.withColumn("inherited", F.coalesce(F.col(label), above))


def relabelled(spans: DataFrame, key: str, order: str, label: str, heading: str) -> DataFrame:
    """``spans`` with ``relabel``: an unknown span with a telling heading is of the results once the body has begun and before it ends.

    The body begins with a section that opens one, or with the first such span, which stays as it
    is; it ends with the first of methods, references or appendix.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    clean = unmarked(F.coalesce(heading, F.lit("")))
    telling = (F.col(label) == "unknown") & (clean != "") & ~preamble_heading(clean)
    ended = F.coalesce(F.max(F.col(label).isin(*TERMINAL)).over(upto), F.lit(False))
    marked = spans.withColumn("_telling", telling).withColumn("_ended", ended)
    begun = F.coalesce(F.max(F.col(label).isin(*OPENING) | F.col("_telling")).over(before), F.lit(False))
    relabel = F.when(F.col("_telling") & begun & ~F.col("_ended"), "results").otherwise(F.col(label))
    return marked.withColumn("relabel", relabel).drop("_telling", "_ended")


def inserted(spans: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, label, char_start, char_end): ``spans`` with one new span a key, which cuts what it covers.

    A span keeps what lies before and after the new one; nothing is kept of one that is covered whole.
    """
    cut = new.select(key, F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    piece = lambda low, high: F.struct(low.alias("char_start"), high.alias("char_end"))
    s, e, a, b = (F.col(c) for c in ("char_start", "char_end", "a", "b"))
    pieces = F.filter(F.array(piece(s, F.least(e, a)), piece(F.greatest(s, b), e)), lambda p: p["char_start"] < p["char_end"])
    hit = spans.join(cut, key, "left").withColumn("pieces", F.when(a.isNull(), F.array(piece(s, e))).otherwise(pieces))
    kept = hit.select(key, "label", F.explode("pieces").alias("p")).select(key, "label", "p.char_start", "p.char_end")
    return kept.unionByName(new.select(key, "label", "char_start", "char_end"))


def trimmed(texts: DataFrame, spans: DataFrame, key: str, text: str, labels: tuple[str, ...]) -> DataFrame:
    """(key, text): each text without its spans of some labels; spans that overlap are left out once."""
    w = Window.partitionBy(key).orderBy("char_start", "char_end")
    out = spans.where(F.col("label").isin(*labels) & (F.col("char_end") > F.col("char_start")))
    reach = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = out.withColumn("low", reach).withColumn("high", F.col("char_start")).where("low < high").select(key, "low", "high")
    last = out.groupBy(key).agg(F.max("char_end").alias("low")).select(key, "low", F.lit(None).cast("long").alias("high"))
    pieces = gaps.unionByName(last.select(key, F.col("low").cast("long"), "high")).join(texts.select(key, text), key)
    size = F.coalesce(F.col("high"), F.length(text).cast("long")) - F.col("low")
    cut = F.when(size > 0, F.col(text).substr((F.col("low") + 1).cast("int"), size.cast("int"))).otherwise("")
    joined = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", cut.alias("t")))), lambda x: x["t"]), "").alias("cut"))
    return texts.join(joined, key, "left").select(key, F.coalesce("cut", text).alias("text"))


def span_of(points: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """``points`` with the ``label`` of the span they lie in; spans meet points by the blocks of a thousand characters they cover."""
    blocks = F.sequence(F.floor(F.col("char_start") / 1000), F.floor((F.col("char_end") - 1) / 1000))
    cut = spans.where("char_end > char_start").select(key, "label", "char_start", "char_end", F.explode(blocks).alias("block"))
    placed = points.withColumn("block", F.floor(F.col(at) / 1000))
    joined = placed.alias("p").join(cut.alias("s"), (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p.block") == F.col("s.block")) & (F.col(f"p.{at}") >= F.col("s.char_start")) & (F.col(f"p.{at}") < F.col("s.char_end")), "left")
    return joined.select(*[f"p.{c}" for c in points.columns], "s.label")


def needs_recognition(chars: Column, pages: Column, empty: Column, least: int = 50, share: float = 0.8) -> Column:
    """Whether a document looks scanned: under ``least`` characters a page, and ``share`` of its pages nearly empty."""
    return (pages > 0) & (chars < least * pages) & (empty >= share * pages)


def prefer_native(read: Column, native: Column, pages: Column, read_lost: Column, native_lost: Column) -> Column:
    """Whether a document's own text layer beats what was read: there is one, and reading lost nearly all, or brought in lost characters."""
    lost_text = (read < 0.5 * native) & (read < 50 * F.greatest(pages, F.lit(1)))
    garbled = (native_lost == 0) & (read > 0) & (read_lost > 0.005 * read)
    return (native > 200) & (lost_text | garbled)
