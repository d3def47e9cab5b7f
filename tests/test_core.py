"""Small cases of the core operators: nulls, empty tables, ties, repeated rows, odd parameters."""

import random

import pytest
from pyspark.sql import functions as F

from litspark.functions import identifiers, text
from litspark.operators import chunking, fulltext, layout, library, predicates, scholar, state, vectors
from tests.conftest import rows


def test_session_writes_and_reads(spark):
    from litspark.sources.tables import written

    df = spark.range(5).withColumn("x", F.lit(None).cast("string"))
    again = written(df)
    assert again.schema.simpleString() == "struct<id:bigint,x:string>" and again.count() == 5


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "id", "rank", "composite"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_offsets_of_passages():
    assert chunking.offsets("") == []
    assert chunking.offsets("a" * 34) == [(0, 34)]
    assert chunking.offsets("a" * 401) == [(0, 401), (1, 401)]
    assert chunking.offsets("a" * 1000) == [(0, 1000), (600, 1000)]
    got = chunking.offsets("x" * 1300 + ". " + "y" * 1000)
    assert got[0] == (0, 1302)
    assert chunking.offsets(" " * 50) == []


def test_passages_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 500)], "id long, text string")
    got = chunking.passages(df, "id", "text")
    assert {r["id"] for r in got.collect()} == {3}
    assert chunking.passages(df.limit(0), "id", "text").count() == 0


def test_pages_and_sections(spark):
    starts = spark.createDataFrame([("d", 1, 0), ("d", 2, 56), ("d", 3, 114)], "doc string, page_num int, char_start long")
    points = spark.createDataFrame([("d", 0), ("d", 56), ("d", 113), ("d", 200), ("e", 5), ("d", None)], "doc string, at long")
    got = {(r["doc"], r["at"]): r["page_num"] for r in chunking.page_of(points, starts).collect()}
    assert got == {("d", 0): 1, ("d", 56): 2, ("d", 113): 2, ("d", 200): 3, ("e", 5): 1, ("d", None): 1}


def test_predicates(spark):
    items = spark.createDataFrame(
        [("a", "Deep Water", 2010, "x; Y", None), ("b", None, None, None, "Z"), ("c", "50%", 1999, "", "z; q")],
        "item_key string, title string, year int, tags string, collections string",
    ).withColumn("authors", F.lit("n")).withColumn("publication", F.lit(None).cast("string")).withColumn("citation_key", F.lit(""))
    keys = lambda *c, match="all": sorted(r["item_key"] for r in predicates.search(items, list(c), match).collect())
    assert keys(("title", "contains", "WATER")) == ["a"]
    assert keys(("title", "contains", "%")) == ["c"]
    assert keys(("title", "isNot", "deep water")) == ["b", "c"]
    assert keys(("year", "isNot", 2010)) == ["c"]
    assert keys(("tags", "is", "y")) == ["a"]
    assert keys(("tags", "isNot", "y")) == ["b", "c"]
    assert keys(("collections", "beginsWith", "z"), ("year", "lt", 2000), match="any") == ["b", "c"]
    assert keys() == ["a", "b", "c"]
    for bad in (("tags", "gt", "a"), ("nothing", "is", 1), ("title", "like", "a")):
        with pytest.raises(ValueError):
            keys(bad)


def test_required_words(spark):
    df = spark.createDataFrame([("a fine café day",), ("cafés",), (None,)], "t string")
    assert [r[0] for r in df.select(predicates.has_words(F.col("t"), ["café", "Fine"])).collect()] == [True, False, False]


def test_fulltext(spark):
    docs = spark.createDataFrame([(1, "One two\nTWO"), (2, "two three"), (3, None), (4, "")], "id long, text string")
    index = fulltext.postings(docs, "id", "text")
    assert rows(fulltext.any_word(index, ["two", "Two", "one"]), "id") == [(1, 2), (2, 1)]
    assert rows(fulltext.all_words(index, ["two", "two", "three"]), "id") == [(2,)]


def test_authors(spark):
    people = "array<struct<creatorType:string,firstName:string,lastName:string>>"
    df = spark.createDataFrame([([("author", "Ann", "Lee")],), ([("author", "", "Kay"), ("author", "B", "Moe")],), ([],), (None,)], f"p {people}")
    assert [r[0] for r in df.select(library.author_display(F.col("p"))).collect()] == ["Lee, A.", "Kay et al.", "[No Author]", "[No Author]"]
    assert [r[0] for r in df.select(library.author_list(F.col("p"))).collect()] == ["Lee, Ann", "Kay; Moe, B", "", ""]


def test_year_prefix(spark):
    df = spark.createDataFrame([("2020-01-15",), ("20xx",), ("x",), (None,), (" 199",)], "d string")
    assert [r[0] for r in df.select(library.year_prefix(F.col("d"))).collect()] == [2020, 20, 0, 0, 199]


def test_tree(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "lost", "X")], "node string, parent string, name string")
    assert rows(library.tree_paths(spark, nodes), "node") == [("a", 0, "A"), ("b", 1, "A/B"), ("c", 2, "A/B/C")]


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    got = rows(vectors.nearest(df, df.where("vec_id = 1"), 3), "rank")
    assert [(r[1], r[2]) for r in got] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert vectors.nearest(df, df.limit(0), 3).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 0.5, "results", "Q1"), (2, 0.5, "results", "Q4"), (3, -1.0, "results", "Q1"), (4, 0.5, "nowhere", None)], "id long, score double, section string, quartile string")
    got = {r["id"]: r["composite"] for r in vectors.rerank(hits).collect()}
    assert set(got) == {1, 2, 4} and got[1] > got[2] and abs(got[4] - 0.5**0.7 * 0.49) < 1e-9
    assert {r["id"] for r in vectors.rerank(hits, sections={"results": 0}).collect()} == {4}


def test_adjacent(spark):
    chunks = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("d", 3, "e"), ("d", 2, "")], "doc string, idx int, text string")
    got = {r["idx"]: (r["before"], r["after"]) for r in vectors.adjacent(chunks, 1).collect()}
    assert got[1] == ("a", "") and got[0] == ("", "b") and got[3] == ("", "")
    assert {r["idx"]: r["merged"] for r in vectors.merged(chunks, 1).collect()}[3] == "\n\ne"


def test_state(spark):
    doc = lambda *d: spark.createDataFrame([(x,) for x in d], "doc string")
    journal = spark.createDataFrame([("a", "committed"), ("b", "in_progress")], "doc string, state string")
    assert rows(state.authoritative(doc("a", "b", "c", "d"), doc("a", "b", "c", "x"), journal), "doc") == [("a",), ("c",)]
    assert rows(state.deletion(doc("a"), doc("a", "b")))[0][3] == "refuse"
    assert rows(state.deletion(doc("a"), doc("a", "b"), allow=True))[0][3] == "delete"
    assert rows(state.deletion(spark.createDataFrame([], "doc string"), doc("a"), allow=True))[0][3] == "refuse"
    assert rows(state.deletion(doc("a"), doc("a")))[0][3] == "nothing"


def test_gate(spark):
    df = spark.createDataFrame([(1, "p", False), (2, "p", True), (3, "q", True), (4, "q", False), (5, None, True)], "id long, k string, ok boolean")
    got = {r["id"]: r["gate"] for r in state.first_outcome_gate(df, "k", ["id"], F.col("ok")).collect()}
    assert got == {1: "trial", 2: "skip", 3: "trial", 4: "pass", 5: "trial"}


def test_identifiers(spark):
    df = spark.createDataFrame([(" https://doi.example/10.1234/AbC ",), ("doi: 10.1/x",), ("",), (None,)], "d string")
    assert [r[0] for r in df.select(identifiers.doi(F.col("d"))).collect()] == ["10.1234/abc", "10.1/x", None, None]
    df = spark.createDataFrame([("http://www.Site.example/a/?q=1#x",), (None,)], "u string")
    assert rows(df.select(identifiers.host(F.col("u")), identifiers.url_key(F.col("u"))))[0] == ("site.example", "http://www.site.example/a")


def test_headings_and_captions(spark):
    df = spark.createDataFrame([("2. Materials and Methods",), ("Summary statistics",), ("Summary",), ("Nothing",), (None,)], "h string")
    assert [r[0] for r in df.select(text.section_of_heading(F.col("h"))).collect()] == ["methods", "results", "conclusion", None, None]
    df = spark.createDataFrame([("Fig. 4 – x",), ("TABLE IV: y",), ("no caption",), (None,)], "t string")
    assert rows(df.select(text.caption_kind(F.col("t")), text.caption_number(F.col("t")))) == [("figure", "4"), ("table", "IV"), (None, None), (None, None)]


def test_cells_and_noise(spark):
    df = spark.createDataFrame([("− 3.5",), (" .5",), ("a  b",), (None,)], "c string")
    assert [r[0] for r in df.select(text.clean_cell(F.col("c"))).collect()] == ["-3.5", "0.5", "a b", None]
    df = spark.createDataFrame([("a b c d e f",), ("plain words stand here now",), (None,)], "t string")
    assert [r[0] for r in df.select(text.interleaved(F.col("t"))).collect()] == [True, False, False]


def test_geometry(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([(1, "d", 1, (0.0, 0.0, 10.0, 10.0)), (2, "d", 1, (5.0, 0.0, 15.0, 10.0)), (3, "d", 2, (0.0, 0.0, 10.0, 10.0)), (4, "d", 1, (500.0, 500.0, 510.0, 510.0))], f"id long, doc string, page int, box {box}")
    assert [(a, b, round(i, 4)) for a, b, i in rows(layout.overlapping(df))] == [(1, 2, 0.3333)]
    assert layout.overlapping(df.limit(0)).count() == 0
    caps = spark.createDataFrame([("d", "table", "1"), ("d", "table", "4"), ("d", "table", "4"), ("d", "table", "IV"), ("d", "table", None)], "doc string, kind string, number string")
    assert rows(layout.number_gaps(caps)) == [("d", "table", 2, 4, 1, "2,3")]


def test_venues(spark):
    dim = spark.createDataFrame([("journal of applied research", "Q1"), ("nature", "Q1"), ("applied sciences", "Q3")], "title_normalized string, quartile string")
    names = spark.createDataFrame([("Nature",), ("J. of Appl. Res.",), ("Applied Sciencess",), ("Unknown",), (None,)], "journal string")
    got = {r["name"]: (r["value"], r["tier"]) for r in scholar.venue_lookup(names, "journal", dim, "title_normalized", "quartile").collect()}
    assert got == {"Nature": ("Q1", 1), "J. of Appl. Res.": ("Q1", 2), "Applied Sciencess": ("Q3", 3)}


def test_venues_alike_as_by_brute_force(spark):
    entries = ["annals of subalpine biology", "archives of pollen chemistry", "nature", "cell", "journal of applied sciences", "journal of applied science letters"]
    cut = random.Random(5)
    names = ["annlas of subalpine biollogy", "arhcives of pollen chemistty"]
    for k in range(200):
        name = list(entries[k % len(entries)])
        for _ in range(cut.randint(1, 3)):
            at = cut.randrange(len(name))
            name[at : at + 1] = cut.choice(([], ["x"], [name[at], "y"], [name[at]] * 2))
        names.append("".join(name))
    names = [n for n in dict.fromkeys(names) if n not in entries and n == n.strip()]

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for ch in x:
            before = 0
            for k, other in enumerate(y, 1):
                before, row[k] = row[k], before + 1 if ch == other else max(row[k], row[k - 1])
        return 200.0 * row[-1] / (len(x) + len(y))

    best = {n: min((-ratio(n, e), e) for e in entries) for n in names}
    dim = spark.createDataFrame([(e, e) for e in entries], "title_normalized string, quartile string")
    got = scholar.venue_lookup(spark.createDataFrame([(n,) for n in names], "journal string"), "journal", dim, "title_normalized", "quartile")
    assert {r["name"]: r["value"] for r in got.collect()} == {n: e for n, (r, e) in best.items() if -r >= 90}


def test_overlaps_of_frequent_words(spark):
    left = spark.createDataFrame([(i, ["river", "delta", f"only{i}"]) for i in range(30)] + [(99, ["river"]), (98, [])], "a long, words array<string>")
    right = spark.createDataFrame([(i, ["delta", "basin", "river"]) for i in range(30)] + [(99, ["delta"])], "b long, words array<string>")
    got = rows(fulltext.overlaps(left, right, "a", "b", "words", 2), "a", "b")
    assert got == [(a, b, 2) for a in range(30) for b in range(30)]


def test_overlaps_are_counted_in_blocks(spark, monkeypatch):
    for name, n in (("ROWS", 40), ("ASKED", 30), ("PAIRS", 50)):
        monkeypatch.setattr(fulltext, name, n)
    of = lambda i, m: [f"w{k}" for k in range(12) if (i * 7 + k * m) % 5 < 2]
    a, b = {f"a{i}": of(i, 3) for i in range(90)}, {i: of(i, 2) for i in range(100)}
    left, right = spark.createDataFrame(list(a.items()), "a string, words array<string>"), spark.createDataFrame(list(b.items()), "b long, words array<string>")
    for least in (2, 3):
        got = fulltext.overlaps(left, right, "a", "b", "words", least)
        assert "array_intersect" not in got._jdf.queryExecution().toString()
        assert rows(got, "a", "b") == sorted((x, y, n) for x in a for y in b for n in [len({*a[x]} & {*b[y]})] if n >= least)
    assert fulltext.overlaps(left.limit(0), right, "a", "b", "words", 2).count() == 0


def test_inverted_index(spark):
    df = spark.createDataFrame([(1, "b a b  c"), (2, None)], "id long, t string")
    got = scholar.inverted_index(df, "id", "t").select("id", scholar.rebuilt(F.col("index")))
    assert rows(got) == [(1, "b a b c")]


def test_embeddings(spark):
    from litspark.functions import embedding

    df = spark.createDataFrame([(1, "one two"), (2, "TWO one"), (3, ""), (4, None)], "id long, t string")
    got = {r["id"]: list(r["embedding"]) for r in embedding.embedded(df, "t").collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[3]) and not any(got[4])
    with pytest.raises(Exception, match="expected 3 dimensions"):
        embedding.embedded(df, "t").select(embedding.checked(F.col("embedding"), 3)).collect()
