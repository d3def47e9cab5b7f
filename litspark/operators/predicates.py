"""Conditions on library items compiled to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.operators.library import names_of

TEXT_FIELDS, LIST_FIELDS = ("title", "authors", "publication", "citation_key"), ("tags", "collections")
OPS = ("is", "isNot", "contains", "beginsWith", "gt", "lt")


def condition(field: str, op: str, value: str | int) -> Column:
    """A column that is true where the condition holds, never null.

    Text: letter case doesn't count for is, isNot, contains and beginsWith, and it does for gt
    and lt; a null passes isNot only. Year: a null passes nothing; contains and beginsWith look
    at its digits. Tags and collections: some name (isNot: none) fulfils it. Values are literal:
    no wildcards.
    """
    if op not in OPS:
        raise ValueError(f"operator {op!r} is none of {', '.join(OPS)}")
    if field in LIST_FIELDS:
        if op in ("gt", "lt"):
            raise ValueError(f"{op} needs an order, which {field} has not")
        low = str(value).lower()
        test = {"is": lambda n: n == low, "isNot": lambda n: n == low, "contains": lambda n: n.contains(low), "beginsWith": lambda n: n.startswith(low)}[op]
        found = F.coalesce(F.exists(F.transform(names_of(F.col(field)), lambda n: F.lower(n)), test), F.lit(False))
        return ~found if op == "isNot" else found
    if field == "year":
        col = F.col("year")
        out = {
            "is": lambda: col == int(value), "isNot": lambda: col != int(value), "gt": lambda: col > int(value), "lt": lambda: col < int(value),
            "contains": lambda: col.cast("string").contains(str(value)), "beginsWith": lambda: col.cast("string").startswith(str(value)),
        }[op]()
        return F.coalesce(out, F.lit(False))
    if field not in TEXT_FIELDS:
        raise ValueError(f"unknown field {field!r}")
    col, low = F.col(field), str(value).lower()
    out = {
        "is": lambda: F.lower(col) == low, "isNot": lambda: F.lower(col) != low, "contains": lambda: F.lower(col).contains(low),
        "beginsWith": lambda: F.lower(col).startswith(low), "gt": lambda: col > str(value), "lt": lambda: col < str(value),
    }[op]()
    return F.coalesce(out, F.lit(op == "isNot"))


def search(items: DataFrame, conditions: list[tuple[str, str, str | int]], match: str = "all") -> DataFrame:
    """Items that fulfil all or any of the conditions; no condition keeps all items."""
    if match not in ("all", "any"):
        raise ValueError("match is all or any")
    tests = [condition(*c) for c in conditions]
    if not tests:
        return items
    return items.where(reduce(lambda a, b: a & b if match == "all" else a | b, tests))


def years(col: Column, low: int = 0, high: int = 0) -> Column:
    """Year bounds, 0 for none; a null year fails a bound."""
    out = F.lit(True)
    if low:
        out = out & (F.coalesce(col, F.lit(0)) >= low)
    if high:
        out = out & col.isNotNull() & (col <= high)
    return out


def has_words(text: Column, words: list[str]) -> Column:
    """Whether every word stands in the text as a whole word, whatever its case."""
    tests = [F.coalesce(text, F.lit("")).rlike(r"(?iU)\b\Q" + w.replace("\\E", "") + r"\E\b") for w in words]
    return reduce(lambda a, b: a & b, tests, F.lit(True))
