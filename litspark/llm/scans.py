"""Problem 4: traces of scanned pages in text, found and repaired."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.sources.tables import written

#: Occurrences from which a form counts as a word, and by which a form must be outnumbered by its look-alike.
WORD, OUTNUMBERED, SHORT_OUTNUMBERED = 5, 60, 400
#: Occurrences of a look-alike, or of a joined word, that make an unknown form or two pieces suspect.
SUPPORT = 20
#: Share of all tokens from which a form, compound or pair counts too, which bounds the lexicon by five million entries
#: however large the corpus is.
SHARE = 2e-7
#: Lines of at most this length are looked at as headers; a masked line is usual from this many
#: occurrences, and from this share of the texts.
LINE, USUAL, USUAL_SHARE = 60, 12, 0.0008

# Glyphs that recognition confuses, each as the strokes it is read as.
_STROKES = str.maketrans(
    {"w": "vv", "m": "rri", "n": "ri", "u": "ii", "h": "li", "d": "cl", "e": "c", "t": "f", "1": "l", "0": "o", "@": "a", "9": "g", "8": "b", "6": "b",
     "!": "i", "|": "l", "(": "c", "5": "s", "$": "s"}
)
#: Words that may follow a hyphen left open, as in "pre- and post-season".
_LINKS = frozenset("and or to und oder bis y o e ou et a u и или nebo".split())
TOKEN = re.compile(r"[@!0-9]?[^\W\d_]+(?:[@!|(0-9][^\W\d_]+)*(?:[@0](?!\w))?")
PLAIN = re.compile(r"[^\W\d_]+")
HYPHEN = re.compile(r"([^\W\d_]+)(-[ \t]*\n\s*|[‐¬\xad][ \t]*\n?\s*|- )([^\W\d_]+)")
_WHOLE = re.compile(HYPHEN.pattern + r"(\S*)")
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
NUMBER = re.compile(r"^[\W_]*[+\-–−]?\d[\d.,]*(?:\s*±\s*[\d.,]+)?[\W_]*$")
PAGE_NUMBER = re.compile(r"^(?:[\-–—~*·|\[\](){}<>.\s]*)\d{1,5}(?:[\-–—~*·|\[\](){}<>.\s]*)$")
ROMAN = re.compile(r"^(?=[ivxlc])(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$", re.IGNORECASE)
#: What running headers and page numbers look like whatever their words.
PAGE = re.compile(
    r"^(?:page|pages|p\.|pp\.|seite|s\.|página|pág\.|strana|str\.|стр\.|страница|第)\s*\d+(?:\s*(?:of|/|von|de|sur|z|из|页)\s*\d*)?$", re.IGNORECASE
)
FURNITURE = re.compile(
    r"^vol(?:ume)?\.?\s*\d+\b.{0,30}\b(?:no|nr|iss(?:ue)?)\.?\s*\d+"
    r"|^[^a-zß-öø-ÿ]+ ET AL\.?$|\s\|\s+\d+$|^\d+\s+\|\s|^\d+ {2,}\S|\S {3,}\d+$|\(\d{4}\)\s*\d+\s*[–-]\s*\d+$"
    r"|^.{3,50} [–—-] .{3,40} [–—-] \d+$|^\S+ and others / |^downloaded |^©|^doi:",
    re.IGNORECASE,
)
_CAPS = re.compile(r"^\d+ {2,}[A-ZÀ-Ý]|^[A-ZÀ-Ý][A-ZÀ-Ý .\-]+ET AL\.?$")
LISTED = re.compile(r"^\s*(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
HEADING = re.compile(r"^\s*\d+(?:\.\d+)*\.?\s+\w")


def skeleton(word: str) -> str:
    """The strokes of a word: equal for words that recognition confuses."""
    return word.lower().translate(_STROKES)


def _readable(word: str) -> bool:
    """Whether a word is in an alphabet and has three letters, so that look-alikes mean something."""
    return sum(map(str.isalpha, word)) >= 3 and max(word) < "⺀"


def mask(line: str) -> str:
    """A line with digits, names and words masked, so that headers of one kind look alike."""
    line = re.sub(r"\d+", "#", line.strip())
    line = re.sub(r"\b[A-ZÀ-Ý][^\W\dA-Z_]{2,}\b", "Name", line)
    line = re.sub(r"\b[A-ZÀ-Ý]{3,}\b", "NAME", line)
    return re.sub(r"\b[^\W\dA-Z_]{3,}\b", "w", line)


@dataclass
class Lexicon:
    """Counts of the corpus: words, compounds with their hyphens, and masked lines that are usual."""

    words: dict[str, int] = field(default_factory=dict)
    compounds: dict[str, int] = field(default_factory=dict)
    shapes: frozenset[str] = frozenset()
    best: dict[str, str] = field(default_factory=dict)
    wrong: dict[str, str] = field(default_factory=dict)
    contexts: dict[tuple[str, str], int] = field(default_factory=dict)
    ends: set[str] = field(default_factory=set)
    supported: dict[tuple[str, str], tuple[int, str]] | None = None

    def __post_init__(self) -> None:
        groups: dict[str, list[str]] = {}
        for w in filter(_readable, self.words):
            groups.setdefault(skeleton(w), []).append(w)
        # what a compound begins and ends with, part by part, and the best supported form after each word
        for c in self.compounds:
            parts = c.split("-")
            for k in range(2, len(parts) + 1):
                self.ends.update(("-".join(parts[:k]), "-".join(parts[-k:])))
        for strokes, forms in groups.items():
            forms.sort(key=lambda w: (-self.words[w], not w.isalpha(), w))
            self.best[strokes] = forms[0]
            for w in forms[1:]:
                ratio = OUTNUMBERED if len(w) > 3 else SHORT_OUTNUMBERED
                if self.words[forms[0]] >= ratio * self.words[w] or (not w.isalpha() and self.words[forms[0]] >= self.words[w]):
                    self.wrong[w] = forms[0]

    def rivals(self) -> dict[str, list[str]]:
        """Frequent words of one skeleton, between which only the context decides."""
        groups: dict[str, list[str]] = {}
        for w in self.words:
            if w not in self.wrong and _readable(w):
                groups.setdefault(skeleton(w), []).append(w)
        return {s: forms for s, forms in groups.items() if len(forms) > 1}

    def meant(self, word: str, before: str = "") -> str | None:
        """The word that a misrecognised form stands for; None if it is a word or nothing is known.

        Of several frequent forms the one that the word before it supports is taken.
        """
        low = word.lower()
        if (low in self.words and low not in self.wrong) or not _readable(low):
            return None
        strokes = skeleton(low)
        best = self.wrong.get(low) or self.best.get(strokes)
        if best is None or best == low:
            return None
        support = SHORT_OUTNUMBERED if len(low) <= 3 else SUPPORT if low.isalpha() else WORD
        if low not in self.wrong and self.words[best] < support:
            return None
        if self.contexts:
            if self.supported is None:
                self.supported = {}
                for (b, w), n in self.contexts.items():
                    self.supported[b, skeleton(w)] = max(self.supported.get((b, skeleton(w)), (0, "")), (n, w))
            best = self.supported.get((before, strokes), (0, best))[1]
        return best


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words, compounds and masked short lines of a task's texts."""
    for b in batches:
        words, compounds, shapes = Counter(), Counter(), Counter()
        for text in b["text"]:
            words.update(TOKEN.findall(text.lower()))
            if "-" in text:
                compounds.update(COMPOUND.findall(text.lower()))
            if "\n" in text:
                shapes.update(mask(line) for line in text.split("\n") if 0 < len(line) <= LINE and any(map(str.isdigit, line)))
        rows = [("w", w, n) for w, n in words.items()] + [("c", w, n) for w, n in compounds.items()] + [("s", w, n) for w, n in shapes.items()]
        rows += [("t", "", len(b)), ("n", "", sum(words.values()))]
        yield pd.DataFrame(rows, columns=["kind", "name", "n"])


def header_shape(shape: str) -> bool:
    """Whether a masked line can be a header: a number, marks or names beside it, and hardly a word of text."""
    return "#" in shape and shape[0] != "|" and max(shape) < "⺀" and not re.search(r"[.:;,]$", shape) and shape.count("w") <= 2 and bool(
        re.search(r"[–—|/~\[\]]|  |\bName\b.*#", shape)
    )


def learn(texts: DataFrame) -> Lexicon:
    """The lexicon of all texts (one column, text).

    Words below WORD occurrences and below SHARE of all tokens, and masked lines below USUAL, tell
    nothing and stay on the executors, whatever their number. What remains has a proven bound: at
    most 1 / SHARE words, compounds and pairs each.
    """
    rows = texts.where("text is not null").mapInPandas(_tally, "kind string, name string, n long")
    counts = rows.groupBy("kind", "name").agg(F.sum("n").alias("n")).where("n > 1 or kind in ('t', 'n')")
    counts = written(counts, "counts")
    whole = {r["kind"]: r["n"] for r in counts.where("kind in ('t', 'n')").collect()}
    share = SHARE * whole.get("n", 0)
    least = F.when(F.col("kind") == "s", F.lit(float(USUAL))).when(F.col("kind") == "c", F.lit(max(2.0, share))).otherwise(F.lit(max(float(WORD), share)))
    found: dict[str, dict[str, int]] = {"w": {}, "c": {}, "s": {}, "t": {"": whole.get("t", 0)}, "n": {}}
    usual = (F.col("kind") != "s") | (F.col("n") >= USUAL_SHARE * whole.get("t", 0))
    for r in counts.where((F.col("n") >= least) & usual & ~F.col("kind").isin("t", "n")).toLocalIterator():
        found[r["kind"]][r["name"]] = r["n"]
    shapes = frozenset(s for s, n in found["s"].items() if n >= USUAL_SHARE * found["t"][""] and header_shape(s))
    lexicon = Lexicon(found["w"], found["c"], shapes)
    rivals = {w for forms in lexicon.rivals().values() for w in forms}
    if rivals:
        def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near: Counter = Counter()
                for text in b["text"]:
                    low = TOKEN.findall(text.lower())
                    if not rivals.isdisjoint(low):
                        near.update((x, y) for x, y in zip(low, low[1:]) if y in rivals)
                yield pd.DataFrame([(x, y, n) for (x, y), n in near.items()], columns=["before", "word", "n"])

        near = texts.where("text is not null").mapInPandas(pairs, "before string, word string, n long")
        near = near.groupBy("before", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(float(WORD), share))
        lexicon.contexts = {(r["before"], r["word"]): r["n"] for r in near.toLocalIterator()}
    return lexicon


def header_lines(text: str, lexicon: Lexicon) -> list[int]:
    """Numbers of the lines that are running headers or page numbers.

    A number alone is one unless it stands in a column of numbers; headings, lists and text are none.
    """
    lines = text.split("\n")
    if len(lines) < 2:
        return []
    found = []
    for k, line in enumerate(lines):
        plain = line.strip()
        if not plain or len(plain) > LINE or (plain[0] == "|" and plain.count("|") > 1):
            continue
        if NUMBER.match(plain):
            around = [x for x in (lines[k - 1] if k else "", lines[k + 1] if k + 1 < len(lines) else "") if x.strip()]
            column = any(NUMBER.match(x.strip()) or x.strip().endswith(":") for x in around)
            if PAGE_NUMBER.match(plain) and (not column or not plain[0].isdigit()):
                found.append(k)
        elif mask(plain) in lexicon.shapes and not HEADING.match(plain) and not (LISTED.match(line) and not re.search(r"\s\|\s|^-\s*\d+\s*-$", line)):
            found.append(k)
        elif PAGE.match(plain):
            found.append(k)
        elif LISTED.match(line) and not re.search(r"\s\|\s|^-\s*\d+\s*-$", line):
            continue
        elif ROMAN.match(plain) or _CAPS.match(plain):
            found.append(k)
        elif FURNITURE.search(plain) and not HEADING.match(plain.replace("  ", "")) and not re.search(r"[.:;,]$", re.sub(r"(?i)et al\.$", "", plain)):
            found.append(k)
    return found


def broken(match: re.Match, lexicon: Lexicon) -> bool:
    """Whether layout broke the word around a hyphen; a compound that breaks at its own hyphen is whole."""
    a, mark, b = match[1].lower(), match[2], match[3].lower()
    joined, whole = a + b, f"{a}-{b}"
    if b in _LINKS:
        return False
    if mark[0] in "‐¬\xad":
        return "\n" in mark or lexicon.words.get(joined, 0) >= WORD
    if "\n" in mark:
        # the part before may be the end of a longer compound
        return joined in lexicon.words or whole not in lexicon.ends
    return lexicon.words.get(joined, 0) >= SUPPORT and lexicon.words.get(joined, 0) > lexicon.compounds.get(whole, 0)


def split_words(text: str, lexicon: Lexicon) -> list[tuple[str, str]]:
    """Neighbouring pieces, one of them no word, that together are a frequent word."""
    found = []
    for line in text.split("\n"):
        parts = [(m[0].lower(), m.start(), m.end()) for m in PLAIN.finditer(line)]
        for (a, _, end), (b, start, _) in zip(parts, parts[1:]):
            if line[end:start] == " " and len(a + b) >= 5 and lexicon.words.get(a + b, 0) >= SUPPORT:
                whole = lexicon.words[a + b]
                if min(lexicon.words.get(a, 0), lexicon.words.get(b, 0)) * 10 <= whole:
                    found.append((a, b))
    return found


def traces(text: str | None, lexicon: Lexicon) -> list[str]:
    """The kinds of traces in a text: header, hyphen, split, glyph."""
    if not text:
        return []
    found = []
    if "\n" in text and header_lines(text, lexicon):
        found.append("header")
    if re.search(r"[-‐¬\xad]\s", text) or "\xad" in text:
        if any(broken(m, lexicon) for m in HYPHEN.finditer(text)):
            found.append("hyphen")
    odd = [w for w in set(TOKEN.findall(text.lower())) if w not in lexicon.words or w in lexicon.wrong]
    if odd:
        # pieces of broken words and cut ends are no misrecognised words
        pieces = {p for m in HYPHEN.finditer(text.lower()) for p in (m[1], m[3])}
        if any(len(w) > 1 and w not in pieces and lexicon.meant(w) for w in odd):
            found.append("glyph")
        if split_words(text, lexicon):
            found.append("split")
    return found


def find_scanned(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(rec_table, rec_id, traces) of the texts (rec_table, rec_id, text) that bear traces of scanning.

    Texts are looked at whole. Null and empty texts bear none; a repeated row stays repeated.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(t, i, ",".join(k)) for t, i, x in zip(b["rec_table"], b["rec_id"], b["text"]) if (k := traces(x, lexicon))]
            yield pd.DataFrame(out, columns=["rec_table", "rec_id", "traces"])

    kind = texts.schema["rec_id"].dataType.simpleString()
    return texts.select("rec_table", "rec_id", "text").where("text <> ''").mapInPandas(found, f"rec_table string, rec_id {kind}, traces string")


def repair(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(rec_table, rec_id, repaired): the texts as continuous paragraphs.

    Windows over a record's lines drop headers, join lines to paragraphs at blank lines,
    headings and list items, and close words broken at a line's end; misrecognised words get
    their frequent form. Repeated (rec_table, rec_id) keep the first text in order.
    """
    key = ["rec_table", "rec_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, i, text in zip(b["rec_table"], b["rec_id"], b["text"]):
                drop = set(header_lines(text, lexicon))
                text = _WHOLE.sub(lambda m: m[1] + m[3] + m[4] + ("\n" if "\n" in m[2] else "") if broken(m, lexicon) else m[0], text)
                for k, line in enumerate(text.split("\n")):
                    before, words = "", []
                    for part in re.split(f"({TOKEN.pattern})", line):
                        if part and TOKEN.fullmatch(part):
                            new = lexicon.meant(part, before)
                            before = (new or part).lower()
                            if new:
                                part = new.upper() if part.isupper() else new.capitalize() if part[0].isupper() else new
                        words.append(part)
                    out.append((t, i, k, "".join(words), k in drop))
            yield pd.DataFrame(out, columns=[*key, "line_no", "line", "dropped"])

    kind = texts.schema["rec_id"].dataType.simpleString()
    first = texts.where("text is not null").groupBy(*key).agg(F.min("text").alias("text"))
    lines = first.mapInPandas(cut, f"rec_table string, rec_id {kind}, line_no int, line string, dropped boolean")
    w = Window.partitionBy(*key).orderBy("line_no")
    blank = F.trim("line") == ""
    apart = blank | F.col("line").rlike(r"^\s*([-*•–|]|\(?\d{1,3}[.)])\s+\S") | (F.lag(blank, 1, True).over(w))
    lines = lines.where("not dropped").withColumn("paragraph", F.sum(apart.cast("int")).over(w))
    parts = lines.where(~blank).groupBy(*key, "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.trim(x["line"])), " ").alias("text")
    )
    return parts.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "text"))), lambda x: x["text"]), "\n").alias("repaired")
    )
