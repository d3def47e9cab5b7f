"""Problem 1: consensus from several annotators, by a competence-and-spamming mixture."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from litspark.llm.components import components
from litspark.sources.tables import written

#: How a label can differ from the truth; the guess distribution of an annotator is over these.
KINDS = (
    "same", "points", "points_in", "sign", "sign_in", "swap", "digit", "letter", "double", "undouble", "insert", "drop", "many",
)
ROUNDS = 6
#: Annotators who give the same wrong label in this share of the items where both are wrong copy from each other.
COPYING, LEAST_SHARED = 0.3, 5
#: Annotators up to whom an item's readings stand in one row and parameters go to the tasks: 2,000 of 13 numbers are 0.2 MB.
#: More of them are joined, by shuffle.
AGENTS = 2_000
#: Cells of a table of items by annotators that a task holds at a time.
CELLS = 4_000_000
ITEM = ["table_id", "row_idx", "col_idx"]


def kind_of(truth: str, label: str) -> str:
    """How a label differs from the truth: one of KINDS."""
    if truth == label:
        return "same"
    if truth.replace(".", "") == label:
        return "points"
    if label.replace(".", "") == truth:
        return "points_in"
    if truth.replace("-", "") == label:
        return "sign"
    if label.replace("-", "") == truth:
        return "sign_in"
    start = len(os.path.commonprefix((truth, label)))
    a, b = truth[start:], label[start:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) == len(b):
        if len(a) == 1:
            return "digit" if "0" <= a <= "9" and "0" <= b <= "9" else "letter"
        two = a[1:-1] == b[1:-1] or a[1:] == b[:-1] or a[:-1] == b[1:]
        return "swap" if two and sorted(a) == sorted(b) else "many"
    if len(a) + len(b) == 1:
        # the letter beside the one put in or left out is the same in a doubling
        more = (label if b else truth)[start - 1 : start + 2]
        twice = (a or b) in (more[:1] if start else "", more[-1:] if len(more) > 2 or (not start and len(more) > 1) else "")
        return ("double" if twice else "insert") if b else "undouble" if twice else "drop"
    return "many"


def cell_readings(results: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, agent, label): the cells each reader gives for each table.

    Of a table and reader only the row with the largest id among those with parse_success = 1
    counts. Both minus signs read as "-", white space is collapsed; null and blank cells, null
    ids, and rows_json that is no list of lists give no reading.
    """
    last = (
        results.select("id", "table_id", "agent_idx", "rows_json", "parse_success")
        .where("parse_success = 1 and table_id is not null and agent_idx is not null and id is not null")
        .groupBy("table_id", F.col("agent_idx").alias("agent"))
        .agg(F.max_by("rows_json", "id").alias("rows_json"))
    )
    rows = last.select("table_id", "agent", F.posexplode(F.from_json("rows_json", "array<array<string>>")).alias("row_idx", "row"))
    cells = rows.select("table_id", "agent", "row_idx", F.posexplode("row").alias("col_idx", "label"))
    label = F.translate("label", "−–", "--")
    label = F.regexp_replace(F.regexp_replace(label, r"[\s\p{Z}]+", " "), r"^ | $", "")
    return cells.select(
        "table_id", F.col("row_idx").cast("long"), F.col("col_idx").cast("long"), F.col("agent").cast("long"), label.alias("label")
    ).where("label <> ''")


def _maximised(counts: np.ndarray, theta: np.ndarray, guess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximisation: competence, and the guess distribution over kinds, from the expected counts (annotator, kind)."""
    honest = theta / (theta + (1 - theta) * guess[:, 0])
    truthful = np.zeros_like(counts)
    truthful[:, 0] = counts[:, 0] * honest
    guessed = counts - truthful
    theta = (truthful.sum(1) + 4.0) / (counts.sum(1) + 5.0)
    return theta, (guessed + 0.5) / (guessed.sum(1, keepdims=True) + 0.5 * len(KINDS))


def _chances(theta: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Log probability of each kind of label of each annotator."""
    chance = (1 - theta)[:, None] * guess
    chance[:, 0] += theta
    return np.log(chance)


class _Items:
    """A batch of contested items as flat arrays: a row for each reading, and one for each reading and candidate."""

    def __init__(self, batch: pa.RecordBatch, groups: np.ndarray | None = None):
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
        size = lambda name: batch.column(name).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.readers, self.labels = size("agents"), size("candidates")
        self.agent, self.given, self.prior = flat("agents"), flat("given"), flat("prior")
        self.n = len(self.readers)
        self.item = np.repeat(np.arange(self.n), self.readers)
        self.first = np.cumsum(self.labels) - self.labels
        # readings by candidates
        times = self.labels[self.item]
        self.reading = np.repeat(np.arange(len(self.item)), times)
        candidate = np.arange(len(self.reading)) - np.repeat(np.cumsum(times) - times, times)
        item = self.item[self.reading]
        self.candidate = self.first[item] + candidate
        below = np.cumsum(self.labels**2) - self.labels**2
        self.kind = flat("kinds")[below[item] + candidate * self.labels[item] + self.given[self.reading]]
        self.weight = np.ones(len(self.item))
        if groups is not None:
            voice = groups[self.agent] + len(groups) * (self.first[self.item] + self.given)
            _, of, n = np.unique(voice, return_inverse=True, return_counts=True)
            self.weight = 1.0 / n[of]

    def posterior(self, chances: np.ndarray) -> np.ndarray:
        """Expectation: the probability of each candidate."""
        part = self.weight[self.reading] * chances[self.agent[self.reading], self.kind]
        score = self.prior + np.bincount(self.candidate, part, len(self.prior))
        odds = np.exp(score - np.repeat(np.maximum.reduceat(score, self.first), self.labels))
        return odds / np.repeat(np.add.reduceat(odds, self.first), self.labels)

    def counts(self, posterior: np.ndarray, agents: int) -> np.ndarray:
        at = self.agent[self.reading].astype(np.int64) * len(KINDS) + self.kind
        return np.bincount(at, posterior[self.candidate], agents * len(KINDS))

    def best(self, posterior: np.ndarray) -> np.ndarray:
        """The likeliest candidate of each item, by its place; the last of equals."""
        top = np.repeat(np.maximum.reduceat(posterior, self.first), self.labels)
        place = np.arange(len(posterior)) - np.repeat(self.first, self.labels)
        return np.maximum.reduceat(np.where(posterior == top, place, -1), self.first)


def _coded(known: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Items with annotators and labels by place, and the kind of each label (column) of each candidate (row)."""
    number, places = {k: i for i, k in enumerate(KINDS)}, {a: i for i, a in enumerate(known)}

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *item, agents, labels, words in b[[*ITEM, "agents", "labels", "words"]].itertuples(index=False):
                candidates = sorted(set(labels))
                place = {c: k for k, c in enumerate(candidates)}
                kinds = [number[kind_of(c, x)] for c in candidates for x in candidates]
                words = dict(words or ())
                prior = [words.get(c, 0.0) for c in candidates]
                out.append((*item, [places[a] for a in agents], [place[x] for x in labels], candidates, kinds, prior))
            yield pd.DataFrame(out, columns=[*ITEM, "agents", "given", "candidates", "kinds", "prior"])

    return code


def _over(coded: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """``part`` over the batches of each task; its tuples of columns as a table."""
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in part(b for b in batches if b.num_rows):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=fields)

    return coded.mapInArrow(run, schema)


def _fit(coded: DataFrame, agreed: np.ndarray, rounds: int, groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Competence and guess distributions after ``rounds`` of expectation and maximisation; a round is one scan."""
    agents = len(agreed)
    theta, guess = np.full(agents, 0.8), np.full((agents, len(KINDS)), 1.0 / len(KINDS))
    for _ in range(rounds):
        chances = _chances(theta, guess)

        def part(batches: Iterator[pa.RecordBatch], chances: np.ndarray = chances) -> Iterator[tuple]:
            whole = np.zeros(agents * len(KINDS))
            for b in batches:
                items = _Items(b, groups)
                whole += items.counts(items.posterior(chances), agents)
            at = np.flatnonzero(whole)
            yield at, whole[at]

        counts = np.zeros(agents * len(KINDS))
        for at, n in _over(coded, part, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[at] = n
        counts = counts.reshape(agents, len(KINDS))
        counts[:, 0] += agreed
        theta, guess = _maximised(counts, theta, guess)
    return theta, guess


def _alike(coded: DataFrame, chances: np.ndarray) -> DataFrame:
    """(agent, other, both, alike): of two annotators, items in which both are wrong, and in which by the same label.

    Counted by products of tables of items by annotators; pairs of an item's readers are never made.
    """
    agents = len(chances)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        whole = np.zeros((2, agents, agents))
        step = max(1, CELLS // max(1, agents))
        for b in batches:
            items = _Items(b)
            truth = items.best(items.posterior(chances))
            wrong = items.given != truth[items.item]
            for k, rows in enumerate((items.item, items.first[items.item] + items.given)):
                names, row = np.unique(rows[wrong], return_inverse=True)
                for low in range(0, len(names), step):
                    at = (row >= low) & (row < low + step)
                    table = np.zeros((min(step, len(names) - low), agents), np.float32)
                    table[row[at] - low, items.agent[wrong][at]] = 1
                    whole[k] += table.T @ table
        a, b = np.nonzero(np.triu(whole[0], 1))
        yield a, b, whole[0][a, b], whole[1][a, b]

    found = _over(coded, part, "agent long, other long, both double, alike double")
    return found.groupBy("agent", "other").agg(F.sum("both").alias("both"), F.sum("alike").alias("alike"))


def consensus(readings: DataFrame, rounds: int = ROUNDS, agents: int = AGENTS, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Consensus of (table_id, row_idx, col_idx, agent, label), and the reliability of each agent.

    Each label is the truth with the agent's competence, else drawn from the agent's own guess
    distribution over kinds of misreading; expectation-maximisation yields both. Agents who share
    most of their wrong labels count as one voice where they agree, and the fit is run again.

    First table: (table_id, row_idx, col_idx, label, posterior, readers, labels, agreement), one
    row per item; agreement is the share of readers who give the label; ties go to the last
    label in order. Second: (agent, reliability, group), where group is the least agent among
    those that copy from each other. A repeated (item, agent) counts its least label once, and
    ``unique`` tells that there are none; an item of one label has posterior 1.

    Up to ``agents`` annotators an item is one row with all its readings, and a round of the fit
    is one scan of the contested items with the parameters in the tasks. Beyond, readings stay
    rows, and parameters are joined to them.
    """
    if not unique:
        readings = readings.groupBy(*ITEM, "agent").agg(F.min("label").alias("label"))
    readings = written(readings.select(*ITEM, "agent", "label"), "readings")
    known = [r[0] for r in readings.select("agent").distinct().limit(agents + 1).collect()]
    # words that other tables use too are likelier than misreadings of them
    words = readings.where(F.col("label").rlike(r"\p{L}{3}")).groupBy(F.col("label").alias("candidate"))
    words = words.agg(F.log1p(F.count_distinct("table_id") - 1.0).alias("prior")).where("prior > 0")
    return _few(readings, words, sorted(known), rounds) if len(known) <= agents else _many(readings, words, rounds)


def _few(readings: DataFrame, words: DataFrame, known: list[int], rounds: int) -> tuple[DataFrame, DataFrame]:
    """Consensus where an item's readings fit a row."""
    spark = readings.sparkSession
    numbers = np.array(known, dtype=np.int64)
    items = readings.groupBy(*ITEM).agg(F.collect_list(F.struct("agent", "label")).alias("given"))
    items = items.select(*ITEM, "given.agent", "given.label").withColumn("labels", F.size(F.array_distinct("label")))
    items = written(items, "items")
    one = items.where("labels = 1")
    agreed = np.zeros(len(known))
    for agent, n in one.where("size(agent) > 1").select(F.explode("agent").alias("agent")).groupBy("agent").count().collect():
        agreed[np.searchsorted(numbers, agent)] = n
    contested = items.where("labels > 1").select(*ITEM, F.col("agent").alias("agents"), F.col("label").alias("labels"))
    named = contested.select(*ITEM, F.explode(F.array_distinct("labels")).alias("candidate")).where(F.col("candidate").rlike(r"\p{L}{3}"))
    named = named.join(words, "candidate").groupBy(*ITEM).agg(F.map_from_entries(F.collect_list(F.struct("candidate", "prior"))).alias("words"))
    contested = contested.join(named, ITEM, "left")
    kinds = "agents array<int>, given array<int>, candidates array<string>, kinds array<int>, prior array<double>"
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readings.select(*ITEM).schema)
    coded = written(contested.mapInPandas(_coded(known), f"{types}, {kinds}"), "coded")

    theta, guess = _fit(coded, agreed, rounds // 2)
    shared = _alike(coded, _chances(theta, guess)).where((F.col("both") >= LEAST_SHARED) & (F.col("alike") > COPYING * F.col("both")))
    groups = np.arange(len(known))
    for node, root in components(shared, "agent", "other").collect():
        groups[node] = root
    theta, guess = _fit(coded, agreed, rounds, groups)
    chances = _chances(theta, guess)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            x = _Items(b, groups)
            posterior = x.posterior(chances)
            best = x.best(posterior)
            label = b.column("candidates").flatten().take(pa.array(x.first + best))
            alike = np.bincount(x.item, x.given == best[x.item], x.n) / x.readers
            yield *(b.column(c) for c in ITEM), label, posterior[x.first + best], x.readers.astype(np.int32), x.labels.astype(np.int32), alike

    schema = f"{types}, label string, posterior double, readers int, labels int, agreement double"
    settled = _over(coded, settle, schema).union(
        one.select(*ITEM, F.col("label")[0], F.lit(1.0), F.size("agent"), F.lit(1), F.lit(1.0))
    )
    rows = [(a, float(t), known[g]) for a, t, g in zip(known, theta, groups.tolist())]
    return settled, spark.createDataFrame(rows, "agent long, reliability double, group long")


@F.pandas_udf(StringType())
def _kind(truth: pd.Series, label: pd.Series) -> pd.Series:
    return pd.Series([kind_of(t, x) for t, x in zip(truth, label)], dtype=object)


def _parameters(counts: DataFrame, before: DataFrame) -> DataFrame:
    """Maximisation over a table (agent, kind, theta, guess)."""
    joined = before.join(counts, ["agent", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    same = F.col("kind") == "same"
    honest = F.col("theta") / (F.col("theta") + (1 - F.col("theta")) * F.col("guess"))
    joined = joined.withColumn("truthful", F.when(same, F.col("n") * honest).otherwise(0.0))
    joined = joined.withColumn("guessed", F.col("n") - F.col("truthful"))
    by_agent = Window.partitionBy("agent")
    theta = (F.sum("truthful").over(by_agent) + 4.0) / (F.sum("n").over(by_agent) + 5.0)
    guess = (F.col("guessed") + 0.5) / (F.sum("guessed").over(by_agent) + 0.5 * len(KINDS))
    return joined.select("agent", "kind", theta.alias("theta"), guess.alias("guess"))


def _posterior(pairs: DataFrame, parameters: DataFrame) -> DataFrame:
    """Expectation: (item, candidate, posterior) of the contested items."""
    same = F.col("kind") == "same"
    chance = F.when(same, F.col("theta") + (1 - F.col("theta")) * F.col("guess")).otherwise((1 - F.col("theta")) * F.col("guess"))
    chances = parameters.select("agent", "kind", F.log(chance).alias("chance"))
    scored = pairs.join(chances, ["agent", "kind"]).groupBy(*ITEM, "candidate")
    scored = scored.agg((F.max("prior") + F.sum(F.col("weight") * F.col("chance"))).alias("score"))
    w = Window.partitionBy(*ITEM)
    odds = F.exp(F.col("score") - F.max("score").over(w))
    scored = scored.withColumn("odds", odds)
    return scored.select(*ITEM, "candidate", (F.col("odds") / F.sum("odds").over(w)).alias("posterior"))


def _fit_joined(pairs: DataFrame, agreed: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    agents = pairs.select("agent").union(agreed.select("agent")).distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind")
    parameters = agents.select("agent", kinds, F.lit(0.8).alias("theta"), F.lit(1.0 / len(KINDS)).alias("guess"))
    for _ in range(rounds):
        counts = pairs.join(_posterior(pairs, parameters), [*ITEM, "candidate"]).select("agent", "kind", F.col("posterior").alias("n"))
        counts = counts.union(agreed.select("agent", F.lit("same"), F.col("n").cast("double")))
        parameters = written(_parameters(counts.groupBy("agent", "kind").agg(F.sum("n").alias("n")), parameters), "parameters")
    return parameters, written(_posterior(pairs, parameters), "posterior")


def _many(readings: DataFrame, words: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Consensus where annotators are many: readings stay rows, and no item's are gathered.

    Copying is looked for between annotators who give one wrong label of an item.
    """
    given = readings.groupBy(*ITEM, "label").agg(F.count("*").alias("n"))
    given = written(given, "given")
    items = given.groupBy(*ITEM).agg(F.sum("n").cast("int").alias("readers"), F.count("*").cast("int").alias("labels"), F.min("label").alias("only"))
    items = written(items, "items")
    agreed = readings.join(items.where("labels = 1 and readers > 1").select(*ITEM), ITEM)
    agreed = written(agreed.groupBy("agent").agg(F.count("*").alias("n")), "agreed")
    candidates = given.join(items.where("labels > 1").select(*ITEM), ITEM).select(*ITEM, F.col("label").alias("candidate"))
    candidates = candidates.join(words, "candidate", "left").fillna(0.0, ["prior"])
    pairs = readings.join(candidates, ITEM).withColumn("kind", _kind("candidate", "label")).withColumn("weight", F.lit(1.0))
    pairs = written(pairs, "pairs")
    best = F.max_by("candidate", F.struct("posterior", "candidate"))
    _, posterior = _fit_joined(pairs, agreed, rounds // 2)
    top = posterior.groupBy(*ITEM).agg(best.alias("truth"))
    wrong = written(readings.join(top, ITEM).where("label <> truth").select(*ITEM, "agent", "label"), "wrong")
    other = wrong.select(*ITEM, F.col("agent").alias("other"), F.col("label").alias("label"))
    alike = wrong.join(other, [*ITEM, "label"]).where("agent < other").groupBy("agent", "other").agg(F.count("*").alias("alike"))
    alike = written(alike.where(F.col("alike") > COPYING * LEAST_SHARED), "alike")
    both = alike.join(wrong.select("agent", *ITEM), "agent").join(other.drop("label"), ["other", *ITEM])
    both = both.groupBy("agent", "other").agg(F.max("alike").alias("alike"), F.count("*").alias("both"))
    copied = both.where((F.col("both") >= LEAST_SHARED) & (F.col("alike") > COPYING * F.col("both")))
    groups = written(components(copied, "agent", "other").toDF("agent", "group"), "voices")
    voices = readings.join(groups, "agent", "left").withColumn("group", F.coalesce("group", "agent"))
    sizes = voices.groupBy(*ITEM, "label", "group").agg((1.0 / F.count("*")).alias("weight")).where("weight < 1")
    shared = voices.join(sizes, [*ITEM, "label", "group"]).select(*ITEM, "agent", F.col("weight").alias("shared"))
    pairs = written(pairs.join(shared, [*ITEM, "agent"], "left").withColumn("weight", F.coalesce("shared", "weight")).drop("shared"), "voiced")
    parameters, posterior = _fit_joined(pairs, agreed, rounds)
    top = posterior.groupBy(*ITEM).agg(best.alias("label"), F.max("posterior").alias("posterior"))
    settled = items.join(top, ITEM, "left").withColumn("label", F.coalesce("label", "only"))
    settled = settled.join(given, [*ITEM, "label"]).select(
        *ITEM, "label", F.coalesce("posterior", F.lit(1.0)).alias("posterior"), "readers", "labels", (F.col("n") / F.col("readers")).alias("agreement")
    )
    reliability = parameters.where("kind = 'same'").join(groups, "agent", "left").select(
        "agent", F.col("theta").alias("reliability"), F.coalesce("group", "agent").alias("group")
    )
    return settled, reliability
