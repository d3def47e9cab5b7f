"""Problem 7 and components: brute force, odd notations, nulls, empty tables, hot keys."""

import random

from pyspark.sql import functions as F

from litspark.llm.components import components
from litspark.llm.copies import copy_groups, count_copies, radix_leaves
from litspark.llm.identifiers import record_key, with_identifier_keys


def keys(spark, *pairs):
    df = spark.createDataFrame(list(pairs), "doi string, arxiv_id string")
    return [sorted(r["k"]) for r in with_identifier_keys(df, "k", "doi", "arxiv_id").select("k").collect()]


def test_notations(spark):
    same = ["10.1234/Ab-1", " https://doi.example/10.1234%2FAB‑1?x=1", "doi:10.1234/ab-1).", "<10.1234/ab-1>", "１０．１２３４／ab-1", "10.12​34 / ab-1", "(10.1234/ab-1)"]
    assert keys(spark, *[(s, None) for s in same]) == [["d:10.1234/ab-1"]] * len(same)
    assert keys(spark, ("10.1016/s0022(99)00012-3", None)) == [["d:10.1016/s0022(99)00012-3"]]
    arxiv = ["arXiv:2101.00001v2", "https://arxiv.example/pdf/2101.00001.pdf", "2101.00001 [cs.LG]", "oai:arxiv.example:2101.00001"]
    assert keys(spark, *[(None, s) for s in arxiv]) == [["a:2101.00001"]] * len(arxiv)
    assert keys(spark, ("10.48550/arXiv.2101.00001", None), (None, "hep-th.XY/9901001v3")) == [["a:2101.00001"], ["a:hep-th/9901001"]]
    assert keys(spark, ("10.5555/", "arXiv:"), (None, None), ("", "n/a"), ("doi:", "2101.")) == [[], [], [], []]


def test_groups_against_union_find(spark):
    rng = random.Random(3)
    rows = [(i, [f"k{rng.randrange(120)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))]) for i in range(300)] + [(7, ["k1"]), (900, None)]
    rows += [(1000 + i, ["hot"]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, keys array<string>")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    first = {}
    for i, k in rows:
        first.setdefault(i, k)
    whole = copy_groups(df.where("id <> 7 or keys[0] <> 'k1'").where("keys is not null"), "id", F.col("keys"))
    own = {i: set(k) for i, k in rows if k and not (i == 7 and k == ["k1"])}
    for k in own.values():
        k = sorted(k)
        for other in k[1:]:
            parent[find(other)] = find(k[0])
    groups = {}
    for i, k in own.items():
        groups.setdefault(find(min(k)), set()).add(i)
    wanted = {(i, min(g), len(g)) for g in groups.values() if len(g) > 1 for i in g}
    assert {(r["rec_id"], r["first_id"], r["copies"]) for r in whole.collect()} == wanted


def test_buckets_split_and_counts(spark):
    rows = [(i, f"prefix/{i % 400:04d}") for i in range(3000)] + [(5000 + i, "prefix/same") for i in range(1000)] + [(1, None)]
    df = spark.createDataFrame(rows, "id long, key string")
    got = {r["key"]: (r["copies"], r["first_id"]) for r in count_copies(df, "id", F.col("key"), capacity=50).collect()}
    assert got["prefix/same"] == (1000, 5000) and got["prefix/0007"] == (8, 7) and len(got) == 401
    leaves = radix_leaves(df.where("key is not null").select("key").distinct(), capacity=50)
    assert leaves.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 50 and leaves.count() == 401


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "id long, keys array<string>, scope string, key string")
    assert copy_groups(empty, "id", F.col("keys")).count() == 0
    df = spark.createDataFrame([(1, ["a"], "x", "q"), (2, ["a"], "x", "q"), (3, ["a"], "y", "q")], "rec_id long, keys array<string>, scope string, root string")
    assert sorted((r["scope"], r["rec_id"]) for r in copy_groups(df, "rec_id", F.col("keys"), scope=F.col("scope")).collect()) == [("x", 1), ("x", 2)]


def test_record_key(spark):
    df = spark.createDataFrame([("A b", "C-d", None), ("c d", "a  B.", ""), ("a", "b", "c")], "x string, y string, z string")
    k = [r[0] for r in df.select(record_key(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert k[0] == k[1] != k[2]


def test_components_of_chain_and_star(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y")]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"c{i:03d}"] for i in range(61)} == {"c000"} and {got[f"s{i}"] for i in range(50)} == {"hub"} and "x" not in got
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_p7_on_small_tables(spark, small):
    from litspark.llm.queries import p7_found

    got = p7_found(spark, small)
    assert got.columns == ["rec_table", "rec_id", "first_id"] and got.count() == got.distinct().count() > 0
    sizes = got.groupBy("rec_table", "first_id").count()
    assert sizes.agg(F.min("count")).first()[0] >= 2
