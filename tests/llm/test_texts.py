"""Problems 3, 4 and 6: round trips, repairs, and look-alikes that are none."""

import pandas as pd
from pyspark.sql import functions as F

from litspark.llm import encoding, scans, templates

CLEAN = [
    "El año pequeño de la región húmeda y la estación cálida, según el diseño.", "Die höhere Größenordnung wurde für die Böschung überprüft.",
    "L’équipe a montré que la méthode était altérée à cause de la forêt.", "Следующая область показала высокую влажность на участке.",
    "Později průměrná šířka změnila běžná údolí a vzdálenost.", "在沿岸条件下，温度放大了浓度与含水层之间的关系。", "Não há correção mínima; a estação é rápida à noite.",
    "Costs of €30,981 per detector, a ratio √326 ≈ 3,970 and “margins” of ±2 µm.",
]


def model():
    batch = pd.DataFrame({"text": CLEAN * 60})
    counts = pd.concat(encoding.count_pairs(iter([batch]))).groupby("pair").n.sum()
    return encoding.Model(counts.index.to_numpy(), counts.to_numpy())


def spoil(text, codec, written="utf-8"):
    chars = encoding._table(codec)[0]
    return "".join(chars[b] for b in text.encode(written))


def test_round_trips():
    m = model()
    for text in CLEAN:
        for codec in ("cp1252", "cp1250", "mac_roman", "cp437", "cp850"):
            chain, restored, gain = encoding.best_chain(spoil(text, codec), m)
            assert chain and gain > 6 and restored == text, (text, codec, restored)
        assert encoding.best_chain(text, m)[2] < 6
    twice = spoil(spoil(CLEAN[0], "cp1252"), "cp1252")
    assert encoding.best_chain(twice, m)[1] == CLEAN[0]
    assert encoding.best_chain(spoil(CLEAN[3], "cp1252", "cp1251"), m)[1] == CLEAN[3]
    assert encoding.best_chain(spoil(CLEAN[5], "cp1252", "gb18030"), m)[1] == CLEAN[5]
    half = CLEAN[3] + " " + spoil(CLEAN[3], "cp1252")
    assert encoding.best_chain(half, m)[1] == CLEAN[3] + " " + CLEAN[3]


def test_garbled_records(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 40)]
    bad = [(1000, spoil(CLEAN[0], "cp1252")), (1001, "F�r die Pr�fung"), (1002, None), (1003, ""), (1004, "plain"), (1000, spoil(CLEAN[0], "cp1252"))]
    df = spark.createDataFrame(rows + bad, "meta_id long, document string")
    m = encoding.train(df, "document")
    got = encoding.find_garbled(df, "meta_id", "document", m, encoding.validated_margin(df, "document", m)).collect()
    assert sorted(r["id"] for r in got) == [1000, 1000, 1001]
    assert {r["restored"] for r in got} == {CLEAN[0], None}
    empty = df.limit(0)
    assert encoding.find_garbled(empty, "meta_id", "document").count() == 0


def test_misreadings_that_recur(spark):
    # every pair of the misread text stands often enough to look usual
    bad = spoil(CLEAN[4], "cp1252", "cp1250")
    rows = [(i, t) for i, t in enumerate(CLEAN * 400)] + [(10_000 + i, bad) for i in range(40)]
    df = spark.createDataFrame(rows, "meta_id long, document string")
    m = encoding.train(df, "document")
    got = encoding.find_garbled(df, "meta_id", "document", m).collect()
    assert sorted(r["id"] for r in got) == list(range(10_000, 10_040))
    assert {r["restored"] for r in got} == {CLEAN[4]}


def test_margin_of_all_records(spark):
    # the first rows are rich in letters beyond ASCII, the others have one each
    light = "One light word with an é is all that this record holds beyond the plain letters."
    rows = [(i, CLEAN[3]) for i in range(3_000)] + [(i, light) for i in range(3_000, 4_000)] + [(5_000, spoil(light, "cp1252"))]
    df = spark.createDataFrame(rows, "meta_id long, document string").coalesce(1)
    m = encoding.train(df, "document")
    margin = encoding.validated_margin(df, "document", m)
    assert margin == encoding.validated_margin(df.orderBy(F.desc("meta_id")), "document", m)
    assert [r["restored"] for r in encoding.find_garbled(df, "meta_id", "document", m, margin).collect()] == [light]


WORDS = "the question remains whether turbine north mineral figures from transformed sediment well mixed reading change".split()


def lexicon():
    words = {w: 900 for w in WORDS} | {"wellmixed": 0}
    words.pop("wellmixed")
    return scans.Lexicon(words, {"well-mixed": 40, "change-point": 9}, frozenset())


def test_traces():
    lex = lexicon()
    assert scans.traces("the tur-\nbine north", lex) == ["hyphen"]
    assert scans.traces("a well-\nmixed reading", lex) == []
    assert scans.traces("whether the sedi\xadment", lex) == ["hyphen"]
    assert scans.traces("mineral- and north", lex) == []
    assert "glyph" in scans.traces("the rnineral figurcs", lex)
    assert "glyph" in scans.traces("the m!neral", lex)
    assert scans.traces("the sedi ment north", lex) == ["split"]
    assert scans.traces("mineral north\nPage 12 of 80\nthe turbine", lex) == ["header"]
    assert scans.traces("mineral north\n17\nthe turbine", lex) == ["header"]
    assert scans.traces("Readings at North:\n17\n18\n19", lex) == []
    assert scans.traces("1. mineral north\n2. the turbine", lex) == []
    assert scans.traces("NORTH AND TURBINE\n\nthe mineral", lex) == []
    assert scans.traces("| north | 1 |\n| mineral | 2 |", lex) == []
    assert scans.traces(None, lex) == scans.traces("", lex) == []


def test_scanned_and_repaired(spark):
    good = [("chunk_records", i, "the question remains whether turbine figures transformed mineral sediment") for i in range(300)]
    bad = [("chunk_records", 1000, "the tur-\nbine north\nPage 3 of 9\nfigurcs from the sediment"), ("chunk_records", 1001, None), ("chunk_records", 1002, "")]
    df = spark.createDataFrame(good + bad, "rec_table string, rec_id long, text string")
    lex = scans.learn(df.select("text"))
    assert [r["rec_id"] for r in scans.find_scanned(df, lex).collect()] == [1000]
    out = scans.repair(df.where("rec_id = 1000"), lex).collect()
    assert [r["repaired"] for r in out] == ["the turbine north figures from the sediment"]
    assert scans.find_scanned(df.limit(0), scans.learn(df.limit(0).select("text"))).count() == 0


STAND_INS = [
    "404 Not Found", "Page not found | Harbour Library", "{{ article.title }}", "Lorem ipsum dolor sit amet", "untitled-12.pdf", "www.site.example/x", "Home",
    "Please enable JavaScript and cookies to continue", "Seite nicht gefunden", "页面不存在", "Stránka nenalezena", "[Insert title here]", "Error 503", "NaN", "401",
    "Just a moment...", "⚠ Access Denied", "View <%= title %>", "Quay Press",
]
TITLES = [
    "Page not found: the decay of links in shallow turbulence papers", "Null results for paired ecosystem", "404 days at Bremix: reflective strain under watch",
    "Lorem ipsum: a history of filler text", "Preface | Quay Press", "On the viscosity of <sub>x</sub>", "{Spectrum, pollen}-algebras and the ridge", "", None,
]


def test_stand_ins(spark):
    sites = frozenset({"quay press"})
    assert [t for t in STAND_INS if templates.coverage(t, sites) < templates.COVERAGE] == []
    assert [t for t in TITLES if templates.coverage(t, sites) >= templates.COVERAGE] == []
    rows = list(enumerate(STAND_INS + TITLES)) + [(0, STAND_INS[0])]
    df = spark.createDataFrame(rows, "result_id long, result_title string").withColumn("text", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    names = spark.createDataFrame([("Quay Press",), (None,)], "publisher string")
    got = sorted(r["id"] for r in templates.find_stand_ins(df, "result_id", "result_title", names).collect())
    assert got == sorted([0, *range(len(STAND_INS))])
    assert templates.find_stand_ins(df.limit(0), "result_id", "result_title").count() == 0
    assert templates.coverage("x" * 100_000) == 0.0


def test_titles_that_look_like_stand_ins():
    for title in ("1984", "3.14", "Node.js", "Bioinformatics.org", "Human error", "Status of the error in the article"):
        assert templates.coverage(title) < templates.COVERAGE, title
    for text in ("404", "…", "quillwater.org", "www.tides.de", "reef.ac.uk/index", "Error", "ERROR 218", "Status 404", "{0}: {1}", "Please verify you are a human"):
        assert templates.coverage(text) >= templates.COVERAGE, text
