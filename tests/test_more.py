"""Operators of retrieval, runs, works, sections, figures and quotes on small cases: nulls, ties, empty tables, brute force."""

import random

import pytest
from pyspark.sql import functions as F

from litspark.operators import catalog, figures, fulltext, layout, notes, quotes, retrieval, runs, scholar, sections, works
from litspark.sources import tables
from litspark.streaming import progress

from .conftest import rows


def one(spark, schema, data, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_fetch_sizes():
    assert [retrieval.fetch_size(k) for k in (1, 50, 90)] == [3, 150, 150] and retrieval.fetch_size(10, True) == 90
    assert retrieval.fetch_size(40, True, retrieval.TABLES) == 180 and retrieval.topic_fetch_size(10) == 100
    assert retrieval.topic_fetch_size(100) == 400 and retrieval.topic_fetch_size(100, True) == 500


def test_arguments(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="no kind"):
        retrieval.passage_filter(F.lit(1), F.lit("text"), kinds=("page",))
    with pytest.raises(ValueError, match="no verbosity"):
        retrieval.shown(df, "loud")
    with pytest.raises(ValueError, match="expression"):
        retrieval.title_pattern(F.lit("x"), "(")
    with pytest.raises(ValueError, match="over 200"):
        retrieval.title_pattern(F.lit("x"), "a" * 201)
    with pytest.raises(ValueError, match="no kind"):
        retrieval.without_documents(df, df, "id", "page")


def test_text_filter(spark):
    df = spark.createDataFrame([(1, "Ann Ox", None), (2, None, "b"), (3, "OXEN", "B x")], "id int, authors string, tags string")
    assert rows(df.where(retrieval.text_filter(authors="ox", tags="b")).select("id")) == [(3,)]
    assert df.where(retrieval.text_filter(authors="", tags=None)).count() == 3
    year, kind = F.lit(0), F.lit("text")
    assert one(spark, "x int", [(1,)], retrieval.passage_filter(year, kind, 0, 1990), retrieval.passage_filter(year, kind, 1, None)) == [(True, False)]


def test_reference_map(spark):
    captions = spark.createDataFrame([(1, "d", 1, "table", "1"), (2, "d", 2, "figure", "12"), (3, "d", 9, "table", "3"), (4, "e", 1, "table", None)], "caption_id int, doc string, page int, kind string, number string")
    passages = spark.createDataFrame([("d", 1, 0, "See Table 12 and Fig. 12."), ("d", 2, 1, "In TABLE 1 it is."), ("d", 2, 2, None)], "doc string, page int, chunk_index int, text string")
    assert rows(retrieval.reference_map(captions, passages), "caption_id") == [(1, 1, "mention"), (2, 0, "mention"), (3, -1, "none"), (4, -1, "none")]
    assert retrieval.reference_map(captions.limit(0), passages.limit(0)).count() == 0


def test_notes(spark):
    got = one(spark, "t string, h string", [("a <b>\nc\n\n\n d&", "T'"), (None, None)], notes.paragraphs(F.col("t"), F.col("h")))
    assert got == [("<h1>T&#x27;</h1><p>a &lt;b&gt;<br/>c</p><p>d&amp;</p>",), ("",)]
    assert one(spark, "t string", [(" <p>a &lt; b</p>&eacute; ",), (None,), ("1 < 2",)], notes.plain_text("t")) == [("a < bé",), (None,), ("1 < 2",)]
    left = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "k string, v string")
    right = spark.createDataFrame([("b", "9"), ("b", "8"), ("c", None)], "k string, v string")
    assert rows(notes.merged(left, right, "k", ["v"], "l", "r"), "k") == [("a", "1", "l"), ("b", "9", "r"), ("c", None, "r")]


def test_runs(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert rows(runs.delete_plan(keys("a", "b", "c", None), keys("b", "x"), keys("b", "c"), keys("c")  , "k"), "k") == [("b", "changed"), ("c", "in progress")]
    assert rows(runs.moved(spark.createDataFrame([("i", "INBOX"), ("j", "INBOX"), ("i", "Z")], "item string, collection string"), "T", spark.createDataFrame([("i",)], "item string")), "item", "collection") == [("i", "T"), ("i", "Z"), ("j", "INBOX")]
    got = one(spark, "a array<string>, b array<string>", [(["y", "x", "y"], ["x", "z"]), (None, ["x"])], runs.tags_added(F.col("a"), F.col("b")), runs.tags_removed(F.col("a"), F.col("b")))
    assert got == [(["x", "y", "z"], ["y", "y"]), (["x"], None)]
    assert rows(runs.batch(keys("a", "b", "c"), [F.col("k")], 2)) == [("a", True), ("b", True)] and rows(runs.batch(keys("a"), [F.col("k")], 2)) == [("a", False)]
    assert runs.batch(keys(), [F.col("k")], 2).count() == 0


def test_works(spark):
    kinds = one(spark, "t string", [(" 10.1234/x ",), ("https://doi.org/10.1/x",), ("arXiv:2101.00001v2",), ("hep-th/9901001",), ("a" * 40,), ("word",), (None,)], works.identifier_kind(F.col("t")))
    assert [k for (k,) in kinds] == ["doi", "doi", "arxiv", "arxiv", "s2", None, None]
    waits = one(spark, "t string", [("42",), ("'retryDelay': '42s'",), ('"retry_after": 4.5',), ("Wed, 21 Oct 2015 07:28:00 GMT",), ("",), (None,)], works.retry_seconds(F.col("t")))
    assert [w for (w,) in waits] == [42.0, 42.0, 4.5, None, None, None]
    author, topic = works.author_of_query(F.col("q"))
    got = one(spark, "q string", [("author:Ox | mud | x",), ("Author: Ox",), ("author:",), ("mud",)], author, topic)
    assert got == [("Ox", "mud | x"), ("Ox", ""), (None, ""), (None, "mud")]
    assert one(spark, "t string", [("ab\ncd",), ("abcdef",), (None,)], works.cut_at_line(F.col("t"), 4)) == [("ab",), ("abcd",), ("",)]
    assert one(spark, "t string", [('["a", " ", null]',), ("a, b,",), (None,)], works.json_texts(F.col("t"))) == [(["a"],), (["a", "b"],), ([],)]
    assert one(spark, "t string", [('x {"n": 1} y',), ("{",), (None,)], works.first_object(F.col("t"), "n int")["n"]) == [(1,), (None,), (None,)]


def test_venue_expansions_and_overrides(spark):
    got = one(spark, "n string", [("J. Med. Comput.",), ("Nature",)], scholar.expansions(F.col("n")))
    words = {f"journal {m} {c}" for m in ("medicine", "medical") for c in ("computer", "computing", "computational")}
    assert set(got[0][0]) == words and got[1][0] == ["nature"]
    dim = spark.createDataFrame([("nature", "Q1"), ("journal medical computing", "Q2")], "t string, q string")
    over = spark.createDataFrame([("Nature", "Q4")], "t string, q string")
    names = spark.createDataFrame([("NATURE",), ("J. Med. Comput.",), (None,)], "j string")
    assert rows(scholar.venue_lookup(names, "j", dim, "t", "q", overrides=over), "name") == [("J. Med. Comput.", "Q2", 2), ("NATURE", "Q4", 0)]


def test_grades(spark):
    def letter(pages, sects, t, f):
        keys = ("found", "captioned", "captions", "missing")
        cols = [{k: F.lit(v) for k, v in zip(keys, x)} for x in (t, f)]
        return spark.range(1).select(layout.grade(F.lit(pages), F.lit(sects), *cols)).first()[0]

    none = (0, 0, 0, 0)
    assert letter(0, 1, none, none) == "F" and letter(1, 1, none, none) == "A" and letter(1, 0, none, none) == "B"
    assert letter(1, 1, (2, 0, 0, 0), (2, 0, 0, 0)) == "F" and letter(1, 1, (0, 0, 3, 0), none) == "D"
    assert letter(1, 1, (5, 3, 5, 0), none) == "C" and letter(1, 1, (5, 4, 5, 0), none) == "B" and letter(1, 1, (5, 5, 5, 1), none) == "B"


def test_sections(spark):
    got = one(spark, "t string", [("## 2.1. **Methods**",), ("References:",), ("The methods are new.",), ("# " + "x" * 120,), (None,), ("**Results**",)], sections.inline_heading(F.col("t")))
    assert [g for (g,) in got] == ["methods", "references", None, None, None, None]
    spans = spark.createDataFrame([("d", k, la, h) for k, (la, h) in enumerate([("unknown", "Check for updates"), ("unknown", "Deep mud"), ("unknown", "More mud"), ("methods", "M"), ("unknown", "Late")])], "doc string, n int, label string, h string")
    assert [r["relabel"] for r in sections.relabelled(spans, "doc", "n", "label", "h").orderBy("n").collect()] == ["unknown", "unknown", "results", "methods", "unknown"]
    texts = spark.createDataFrame([("a", "0123456789"), ("b", "xyz"), ("c", None)], "k string, t string")
    cut = spark.createDataFrame([("a", "r", 1, 4), ("a", "r", 2, 6), ("a", "r", 8, 99), ("b", "s", 0, 2)], "k string, label string, char_start long, char_end long")
    assert rows(sections.trimmed(texts, cut, "k", "t", ("r",)), "k") == [("a", "067"), ("b", "xyz"), ("c", None)]


def test_rects_against_fold(spark):
    rng = random.Random(2)
    boxes = [("d", p, tuple(float(v) for v in (x, y, x + rng.randrange(5, 90), y + rng.randrange(5, 60)))) for p in range(6) for _ in range(8) for x, y in [(rng.randrange(0, 300), rng.randrange(0, 400))]]
    df = spark.createDataFrame(boxes, "doc string, page int, box struct<x0: double, y0: double, x1: double, y1: double>")
    wanted = []
    for page in range(6):
        out = []
        for x0, y0, x1, y1 in sorted((b for _, p, b in boxes if p == page), key=lambda b: (b[1], b[0], b[3], b[2])):
            if out:
                a = out[-1]
                wide = min(a[2] - a[0], x1 - x0)
                beside = wide > 0 and min(a[2], x1) - max(a[0], x0) < 0.2 * wide
                if not beside and x0 < a[2] + 20 and x1 > a[0] - 20 and y0 < a[3] + 20 and y1 > a[1] - 20:
                    out[-1] = (min(a[0], x0), min(a[1], y0), max(a[2], x1), max(a[3], y1))
                    continue
            out.append((x0, y0, x1, y1))
        wanted += [(page, k, b) for k, b in enumerate(out)]
    assert [(p, k, tuple(b)) for _, p, k, b in rows(figures.merged(df), "doc", "page", "no")] == wanted
    assert figures.merged(df.limit(0)).count() == 0


def test_quotes(spark):
    raw = "**Figure 3:** the “meth-\n od” of x_t , by ﬁve ( of  six ) – done ."
    plain = 'Figure 3: the "method" of x_t, by five (of six) - done.'
    twice = quotes.plain_quote(quotes.plain_quote(F.col("t")))
    assert one(spark, "t string", [(raw,), (None,), ("",)], quotes.plain_quote(F.col("t")), twice) == [(plain, plain), ("", ""), ("", "")]
    asked = spark.createDataFrame([(1, "d", "a long enough quote", 2), (2, "d", "short", 1), (3, "e", "a long enough quote", 1)], "quote_id int, doc string, quote string, hint int")
    pages = spark.createDataFrame([("d", 1, "a long enough quote"), ("d", 2, "a long enough quote, a long enough quote"), ("d", 3, None)], "doc string, page int, text string")
    assert rows(quotes.placed(asked, pages), "quote_id") == [(1, 2, "ambiguous"), (2, None, "short"), (3, None, "missing")]


def test_quotes_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    texts = {(d, p): " ".join(word() for _ in range(rng.randrange(0, 60))) for d in "xy" for p in range(1, 6)}
    asked = []
    for k in range(300):
        t = texts[rng.choice("xy"), rng.randrange(1, 6)]
        at = rng.randrange(len(t) + 1)
        asked.append((k, rng.choice("xyz"), t[at : at + rng.randrange(0, 70)], rng.choice([None, *range(7)])))
    wanted = []
    for k, d, q, hint in asked:
        on = [p for p in range(1, 6) if len(q) >= 4 and q in texts.get((d, p), "")]
        page = min(on, key=lambda p: (p != hint, p)) if on else None
        wanted.append((k, page, "short" if len(q) < 4 else "missing" if page is None else "ambiguous" if texts[d, page].count(q) > 1 else "placed"))
    assert {s for _, _, s in wanted} == {"short", "missing", "ambiguous", "placed"}
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in texts.items()], "doc string, page int, text string")
    df = spark.createDataFrame(asked, "quote_id int, doc string, quote string, hint int")
    assert rows(quotes.placed(df, pages, 4), "quote_id") == wanted
    assert quotes.placed(df.limit(0), pages).count() == 0


def test_quotes_of_a_long_document(spark):
    # no text of a page meets the quotes of its document: that would be 25 million pairs here
    text = F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(4)])
    pages = spark.range(5000).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("page"), text.alias("text"))
    asked = pages.select(F.col("page").alias("quote_id"), "doc", F.substring("text", 9, 30).alias("quote"), F.lit(-1).alias("hint"))
    placed = quotes.placed(asked, pages)
    assert "contains(" not in placed._jdf.queryExecution().toString().lower()
    assert placed.where("state = 'placed' and page = quote_id").count() == 5000


def test_quotes_covered(spark):
    asked = spark.createDataFrame([(1, "d", "the first of all", 1), (2, "d", "the first of all", 9), (3, "d", "of", 1), (4, "e", "the first of all", 1), (5, None, "the first of all", 1), (6, "d", None, 1)], "quote_id int, doc string, quote string, hint int")
    pages = spark.createDataFrame([("d", k, "it is the first of all of them") for k in range(3)], "doc string, page int, text string")
    got = quotes.coverage(asked, pages)
    assert "contains(" not in got._jdf.queryExecution().toString().lower()
    assert rows(got, "state") == [("found", 2), ("missing", 3), ("short", 1)]


def test_titles_resolved_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(fulltext, "ROWS", 50)
    monkeypatch.setattr(fulltext, "ASKED", 30)
    some = lambda: " ".join(rng.choices([f"word{k}" for k in range(40)], [40 - k for k in range(40)], k=rng.randrange(0, 9)))
    titles = [(f"i{k:03}", some()) for k in range(200)] + [("none", None)]
    asked = [(k, rng.choice([some(), rng.choice(titles)[1], None])) for k in range(150)]
    wanted = []
    for k, q in asked:
        counts = sorted(((len(set((q or "").split()) & set((t or "").split())), i) for i, t in titles), reverse=True)
        if counts[0][0] >= 3 and counts[0][0] >= 2 * counts[1][0]:
            wanted.append((k, counts[0][1], counts[0][0]))
    assert wanted
    of = lambda found, names: spark.createDataFrame(found, names)
    resolved = works.titles_resolved(of(asked, "ask_id int, title string"), of(titles, "item string, title string"))
    assert rows(resolved, "ask_id") == wanted
    # no row for each pair of an asked word and a title leaves a join
    assert "explode" not in resolved._jdf.queryExecution().optimizedPlan().toString().lower().split("mapinarrow")[0]
    assert works.titles_resolved(of(asked, "ask_id int, title string").limit(0), of(titles, "item string, title string")).count() == 0


def test_small_and_shared_folder(spark):
    assert "broadcast" in tables.small(spark.range(10))._jdf.queryExecution().toString().lower()
    assert "broadcast" not in tables.small(spark.range(10), 1)._jdf.queryExecution().logical().toString().lower()


def test_first_of_period(spark, small):
    events = progress.event_stream(spark, small).withColumn("key", F.lit("all"))
    got = [r["ts"] for r in progress.run_available(progress.first_of_period(events, "key", 86_400)).orderBy("ts").collect()]
    wanted, last = [], None
    for r in spark.read.parquet(f"{small}/events.parquet").orderBy("ts", "event_id").collect():
        if last is None or (r["ts"] - last).total_seconds() >= 86_400:
            last = r["ts"]
            wanted.append(last)
    assert [t.timestamp() for t in got] == [t.timestamp() for t in wanted]


def test_catalog(spark, tmp_path):
    html = "<table><tr><th rowspan=2>a</th><th colspan='2'>b &amp; c</th></tr><tr><td>1</td><td> 2\n3 </td></tr><tr><td>x"
    assert one(spark, "t string", [(html,), (None,), ("",)], catalog.html_rows("t")) == [([["a", "b & c", "b & c"], ["a", "1", "2 3"], []],), ([],), ([],)]
    got = one(spark, "h array<string>, r array<array<string>>, c string", [(["x", "y"], [["1"], ["1", None, "3"], None], "T"), ([], [], None)], catalog.markdown_table(F.col("h"), F.col("r"), F.col("c")))
    assert got[0][0] == "**T**\n\n| x | y |\n| --- | --- |\n| 1 |  |\n| 1 |  |\n|  |  |"
    lines = spark.createDataFrame([("# c,1",), (" Nature: X , Q1",), ("none",), (None,)], "line string")
    assert rows(catalog.override_lines(lines, "line")) == [("nature x", "Q1")]
    (tmp_path / "v.csv").write_text("title_normalized,quartile\nnature,Q1\n,Q2\ncell,\nnature,Q2\n")
    assert rows(catalog.venue_dimension(spark, str(tmp_path / "v.csv"))) == [("nature", "Q2")]
    groups = spark.createDataFrame([(1, 7)], "group_id int, library_id int")
    assert catalog.group_library(groups, 1) == 7
    with pytest.raises(ValueError, match="no group"):
        catalog.group_library(groups, 2)
    path = catalog.attachment_path(F.col("p"), F.col("m"), F.col("k"), "/l")
    assert one(spark, "p string, m int, k string", [("storage:a.pdf", 0, "K"), ("storage:a.pdf", 2, "K"), ("a.pdf", 0, "K"), (None, 0, "K")], path) == [("/l/storage/K/a.pdf",), (None,), (None,), (None,)]
    assert one(spark, "c array<string>", [(["ﬁeld", "the eld", "field", "x"],)], catalog.ligature_cells(F.col("c"))) == [(2,)]
