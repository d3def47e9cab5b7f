"""Library metadata: pivots of field values, people, tags, collections, attachments, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litspark.sources.tables import small, written


def to_fields(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(item, field, value): one row for each non-null column value of each row."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.col(id_col).alias("item"), F.explode(pairs).alias("p")).select("item", "p.field", "p.value").where("value is not null")


def pivot_fields(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row for each item of (item, field, value) with a column for each name; a repeated field gives its greatest value.

    One aggregation with conditional maxima, so values combine before the shuffle.
    """
    return fields.groupBy("item").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def year_prefix(text: Column) -> Column:
    """The leading integer of the first four characters of a date text, 0 where there is none."""
    digits = F.trim(F.regexp_extract(F.substring(text, 1, 4), r"^\s*[+-]?[0-9]+", 0))
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0))


def author_display(people: Column) -> Column:
    """"Last, F." for one person, "Last, F. et al." for several, "[No Author]" for none; ``people`` are structs in order."""
    first = people[0]
    initial = F.when(F.length(first["firstName"]) > 0, F.concat(F.lit(", "), F.substring(first["firstName"], 1, 1), F.lit("."))).otherwise("")
    name = F.concat(F.coalesce(first["lastName"], F.lit("")), initial)
    n = F.coalesce(F.size(people), F.lit(0))
    return F.when(n <= 0, "[No Author]").when(n == 1, name).otherwise(F.concat(name, F.lit(" et al.")))


def author_list(people: Column) -> Column:
    """All persons in order as "Last, First; ..."; an empty list gives an empty text."""
    one = lambda p: F.concat_ws(", ", F.nullif(p["lastName"], F.lit("")), F.nullif(p["firstName"], F.lit("")))
    return F.coalesce(F.array_join(F.transform(people, one), "; "), F.lit(""))


def names_of(text: Column) -> Column:
    """The parts of a "; "-joined list, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")


def joined(df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """(key, out): the distinct names of each key, in order, joined by "; "."""
    return df.select(key, name).distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(name)), "; ").alias(out))


def usage(items: DataFrame, list_col: str, out: str) -> DataFrame:
    """(out, items): how many items carry each name of a "; "-joined list."""
    return items.select(F.explode(F.array_distinct(names_of(F.col(list_col)))).alias(out)).groupBy(out).agg(F.count("*").alias("items"))


def tree_paths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node, depth, path) of a forest (node, parent, name); roots have a null parent.

    The levels are joined one after the other until no child is left, and each is written, so that
    no level is made again for the next. A node whose parent is missing has no path.
    """
    level = written(nodes.where("parent is null").select("node", F.lit(0).alias("depth"), F.col("name").alias("path")), "level")
    out = level
    depth = 0
    while True:
        parents = level.select(F.col("node").alias("parent"), F.col("path").alias("above"))
        depth += 1
        level = nodes.join(small(parents), "parent").select("node", F.lit(depth).alias("depth"), F.concat_ws("/", "above", "name").alias("path"))
        level = written(level, "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def pick(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def year_histogram(items: DataFrame) -> DataFrame:
    """(year, items) of plausible years (over 1000)."""
    return items.where("year > 1000").groupBy("year").agg(F.count("*").alias("items"))


def coverage_gaps(items: DataFrame, old_year: int = 2015, least_share: float = 0.05, survey_words: str = "(?i)survey|review") -> DataFrame:
    """One row: (items, min_year, old_share, survey_share, lacks_old, lacks_surveys)."""
    dated = F.col("year") > 1000
    row = items.agg(
        F.count("*").alias("items"),
        F.min(F.when(dated, F.col("year"))).alias("min_year"),
        (F.count_if(dated & (F.col("year") < old_year)) / F.greatest(F.count_if(dated), F.lit(1))).alias("old_share"),
        (F.count_if(F.coalesce(F.col("tags"), F.lit("")).rlike(survey_words)) / F.greatest(F.count("*"), F.lit(1))).alias("survey_share"),
    )
    lacks_old = F.coalesce(F.col("min_year") >= old_year, F.lit(False)) | (F.col("old_share") < least_share)
    return row.withColumn("lacks_old", lacks_old).withColumn("lacks_surveys", F.col("survey_share") < least_share)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, each with the total; the total is a join of one row."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def truncated(text: Column, limit: int) -> Column:
    """The text cut to ``limit`` characters, dots included."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))
