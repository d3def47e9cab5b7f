"""Problem 9: sources mixed to target weights, by hierarchical budgets and seeded epochs."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.sources.tables import small, written

#: Default tokenizer: the public byte-level BPE of 50,256 ranks.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents of a part of an epoch's order, within which running sums are taken; the parts grow with the documents.
IN_PART = 20_000
# The domains of the tree; a source that is not named is its own domain.
DOMAINS = {
    "publisher_fulltext": "publications", "preprint_fulltext": "publications", "abstracts": "publications", "thesis_chapters": "publications",
    "library_notes": "library", "table_markdown": "library", "web_snapshots": "web", "feed_digest": "web",
}


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    if "/" not in path:
        import public_tokenizers

        path, pattern = public_tokenizers.path(path), public_tokenizers.PATTERN
    else:
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, *keep, tokens) of the documents; null texts have 0 tokens. ``tokenizer`` is a file of ranks or its public name."""
    rows = documents.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for b in batches:
            tokens = [len(encoding.encode_ordinary(t)) if t else 0 for t in b["text"]]
            yield b.drop(columns="text").assign(tokens=tokens)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInPandas(counted, f"{fields}, tokens long")


def fill(children: dict, weights: dict, caps: dict, amount: float) -> dict:
    """``amount`` divided among children by weight, none above its cap; what one can't take goes to its siblings."""
    given = dict.fromkeys(children, 0.0)
    open_ = {c for c in children if weights[c] > 0 and caps[c] > 0}
    left = min(amount, sum(caps[c] for c in open_))
    while open_ and left > 1e-9:
        whole = sum(weights[c] for c in open_)
        full = {c for c in open_ if given[c] + left * weights[c] / whole >= caps[c]}
        if not full:
            for c in open_:
                given[c] += left * weights[c] / whole
            break
        for c in full:
            left -= caps[c] - given[c]
            given[c] = caps[c]
        open_ -= full
    return given


def budgets(leaves: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """Budget of each leaf (domain, language, source) with (weight, capacity).

    Weights and capacities add up along the tree. A node divides its budget among its children,
    and a shortage stays among siblings before it reaches the ancestors' siblings.
    """
    def below(part: dict, amount: float, depth: int) -> dict[tuple, float]:
        groups: dict = {}
        for leaf, x in part.items():
            groups.setdefault(leaf[depth], {})[leaf] = x
        weights = {g: sum(w for w, _ in p.values()) for g, p in groups.items()}
        caps = {g: sum(c for _, c in p.values()) for g, p in groups.items()}
        given = fill(groups, weights, caps, amount)
        if depth == 2:
            return {leaf: given[g] for g, p in groups.items() for leaf in p}
        return {leaf: x for g, p in groups.items() for leaf, x in below(p, given[g], depth + 1).items()}

    return below(leaves, total, 0)


def mix(
    documents: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, seed: int = 42,
    tokenizer: str = TOKENIZER, times: float = 1.0, domains: dict[str, str] = DOMAINS,
) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of documents (id, text, source, lang) mixed to weights (source, target_share, max_repeats).

    Selection: (id, source, copies), the documents to take and how often. Report: (source,
    target_share, actual_share, tokens_available, tokens_taken, documents, most_copies). Without
    ``total`` the mixture is ``times`` the largest in which every source that has tokens reaches
    its share; a larger total lets small sources fall short, and siblings take over. Whole epochs of a leaf
    repeat all its documents; the last one takes the longest prefix, in an order seeded by the
    epoch, that fits the budget. Sources without a weight are left out, sources without documents
    report 0; null and odd languages are "und"; documents without tokens are never taken;
    of repeated ids the longest text counts. ``domains`` names the domain of a source, by default its
    own. Tokens are counted where the texts lie, and no text is shuffled. Only the leaves' sums, one row for each source and language, reach
    the driver.
    """
    language = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    language = F.when(language == "", "und").otherwise(language)
    known = weights.select("source", "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    docs = documents.withColumn("language", language)
    sized = token_counts(docs, id_col, text_col, ("source", "language"), tokenizer).where("tokens > 0 and id is not null")
    sized = sized.groupBy("id").agg(F.max(F.struct("tokens", "source", "language")).alias("d")).select("id", "d.*")
    sized = written(sized.join(small(written(known, "known")).select("source"), "source", "left_semi"), "sized")
    sums = {(r["language"], r["source"]): r["tokens"] for r in sized.groupBy("language", "source").agg(F.sum("tokens").alias("tokens")).collect()}
    wanted = {r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] or 1)) for r in known.collect()}
    of_source: dict[str, float] = {}
    for (_, source), n in sums.items():
        of_source[source] = of_source.get(source, 0) + n
    if total is None:
        total = times * min((n * wanted[s][1] / wanted[s][0] for s, n in of_source.items() if wanted[s][0] > 0), default=0.0)
    leaves = {
        (domains.get(s, s), lang, s): (wanted[s][0] * n / of_source[s], float(n * wanted[s][1])) for (lang, s), n in sums.items()
    }
    plan = [(lang, s, *divmod(round(x, 6), sums[lang, s])) for (_, lang, s), x in budgets(leaves, total).items()]
    plan = [(lang, s, int(epochs), float(rest)) for lang, s, epochs, rest in plan]
    spark = documents.sparkSession
    plan = F.broadcast(spark.createDataFrame(plan, "language string, source string, epochs int, rest double"))

    placed = sized.join(plan, ["language", "source"])
    placed = placed.withColumn("at", F.xxhash64(F.lit(seed), "epochs", "id"))
    bits = max(1, math.ceil(math.log2(max(1, sized.count()) / IN_PART + 1)))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("at", 64 - bits))
    leaf = ["language", "source"]
    parts = placed.groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0)))
    placed = placed.join(parts, [*leaf, "bucket"])
    inside = F.sum("tokens").over(Window.partitionBy(*leaf, "bucket").orderBy("at", "id"))
    placed = placed.withColumn("last", F.when(F.col("before") + inside <= F.col("rest"), 1).otherwise(0))
    selection = placed.withColumn("copies", F.col("epochs") + F.col("last")).where("copies > 0").select("id", "source", "copies", "tokens")
    selection = written(selection, "selection")
    taken = selection.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens_taken"), F.count("*").alias("documents"), F.max("copies").alias("most_copies")
    )
    available = sized.groupBy("source").agg(F.sum("tokens").alias("tokens_available"))
    report = known.join(available, "source", "left").join(taken, "source", "left").fillna(0, ["tokens_available", "tokens_taken", "documents", "most_copies"])
    whole = taken.agg(F.greatest(F.sum("tokens_taken"), F.lit(1)).alias("whole")).first()["whole"] or 1
    report = report.select(
        "source", "target_share", (F.col("tokens_taken") / whole).alias("actual_share"), "tokens_available", "tokens_taken", "documents", "most_copies"
    )
    return selection.drop("tokens"), report
