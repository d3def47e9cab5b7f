"""Problems 8 and 10 against brute force, and their odd cases."""

import random

import pytest

from litspark.llm import leaks, spans
from litspark.llm.queries import p8_found, p10_found


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [text_of(rng, 200) for _ in range(6)]
    texts = []
    for i in range(24):
        n = rng.choice([250, 299, 300, 301, 340, 500])
        src = rng.choice(base)
        at = rng.randrange(0, len(src) - n)
        texts.append(text_of(rng, rng.randrange(0, 30)) + src[at : at + n] + text_of(rng, rng.randrange(0, 30)))
    texts += [texts[0], "", base[0], base[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in spans.shared_pairs(spans.shared_windows(df, "doc_id", "text")).collect()}
    windows = [{t[k : k + 300] for k in range(len(t) - 299)} for t in texts]
    wanted = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if windows[i] & windows[j]}
    assert got == wanted


def test_share(spark):
    rng = random.Random(5)
    common = text_of(rng, 80)[:400]
    rows = [(1, "x" * 10 + common + "y" * 90), (2, common), (3, text_of(rng, 90)), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["shared_chars"], r["spans"]) for r in spans.shared_share(df, spans.shared_windows(df, "doc_id", "text"), "doc_id", "text").collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_hot_notice_makes_no_pairs(spark):
    rng = random.Random(6)
    notice = text_of(rng, 50)[:250]
    df = spark.createDataFrame([(i, text_of(rng, 40) + notice + text_of(rng, 40)) for i in range(60)], "doc_id long, text string")
    assert spans.shared_pairs(spans.shared_windows(df, "doc_id", "text")).count() == 0


def test_span_clusters_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(spans.shared_windows(empty, "doc_id", "text")).count() == 0
    pairs = spark.createDataFrame([(1, 2), (2, 5), (7, 9)], "id_a long, id_b long")
    assert {tuple(r) for r in spans.removal_clusters(pairs).collect()} == {(1, 1), (2, 1), (5, 1), (7, 7), (9, 7)}


def brute_leak(own, asked):
    for shift in range(-len(asked), len(own)):
        same = [0 <= k + shift < len(own) and own[k + shift] == asked[k] for k in range(len(asked))]
        for a in range(len(asked)):
            for e in range(a + 11, len(asked)):
                part = same[a : e + 1]
                inside = 0 <= a + shift and e + shift < len(own)
                if inside and part[0] and part[-1] and part.count(False) * 8 <= len(part):
                    return True
    return False


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, text_of(rng, rng.randrange(20, 40))) for i in range(5)]
    docs = []
    for i in range(60):
        words = items[rng.randrange(5)][1].split()
        n = rng.choice([10, 11, 12, 13, 16, 20])
        at = rng.randrange(0, max(1, len(words) - n))
        part = words[at : at + n]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            part[rng.randrange(len(part))] = "other"
        part = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
        docs.append((i, text_of(rng, 8) + "\n" + " – ".join(part) + " " + text_of(rng, 8)))
    docs += [(100, None), (101, ""), (102, "a b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([*items, (50, None), (51, "short")], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in leaks.find_leaks(d, "doc_id", "text", q, "item_id", "text").collect()}
    wanted = {(i, j) for i, t in docs if t for j, x in items if brute_leak(leaks._words(t), leaks._words(x))}
    assert got == wanted and wanted


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, "ONE, two three\nfour five!"), (3, None), (4, "one")], "id long, text string")
    got = {(r["id"], r["at"]): r["print"] for r in leaks.fingerprints(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)} and got[1, 0] == got[2, 0] != got[1, 1]


def test_queries(spark, small):
    assert p8_found(spark, small).columns == ["doc_id", "item_id"]
    pairs = p10_found(spark, small)
    assert pairs.columns == ["doc_id_a", "doc_id_b"] and pairs.where("doc_id_a >= doc_id_b").count() == 0
