"""Look-ups, anti joins, positional pairs and ordered unions of document structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators.tables import ordered


def lookup(facts: DataFrame, dimension: DataFrame, keys: list[str], value: str, default: Column, out: str | None = None) -> DataFrame:
    """facts with a dimension's value, the default where the dimension has no row. Dimensions are small, so the optimizer broadcasts them as far as their size allows."""
    found = facts.join(dimension.select(*keys, F.col(value).alias("_value")), keys, "left")
    return found.withColumn(out or value, F.coalesce("_value", default)).drop("_value")


def without_texts(rows: DataFrame, known: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """rows less those whose trimmed text is one of known's (of the same keys): captions that are no cells, boxes that repeat no cell. Texts meet by their digest."""
    digest = lambda df: df.withColumn("_digest", F.sha2(F.trim(text), 256))
    on = [*(keys or []), "_digest"]
    return digest(rows).join(digest(known).select(*on).distinct(), on, "left_anti").drop("_digest")


def without_ids(rows: DataFrame, known: DataFrame, key: str, dummies: tuple[int, ...] = (0, 0x80000000)) -> DataFrame:
    """rows less those whose id is one of known's; dummy ids are nobody's."""
    real = known.where(~F.col(key).isin(*dummies)).select(key).distinct()
    return rows.join(real, key, "left_anti")


def held(rows: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """rows that have content left."""
    return rows.join(content.select(*keys).distinct(), keys, "left_semi")


def zip_ranked(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, rank: str = "k") -> DataFrame:
    """The k-th row of left beside the k-th of right, for each key; what is left over stands alone."""
    ranked = lambda df, order: df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    return ranked(left, left_order).join(ranked(right, right_order), [*keys, rank], "full_outer")


def assemble(parts: list[DataFrame], key: str, order: str, line: str, sep: str = "\n\n") -> DataFrame:
    """key, text: the lines of all parts of a document, part after part, in the order inside each. parts: key, order, line."""
    every = None
    for k, part in enumerate(parts):
        one = part.select(key, F.lit(k).alias("_part"), order, line)
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(ordered(["_part", order], line, sep).alias("text"))


def without_double_rules(lines: DataFrame, keys: list[str], pos: str, line: str) -> DataFrame:
    """lines without rules that follow a rule, an empty line or nothing."""
    before = F.lag(line).over(Window.partitionBy(*keys).orderBy(pos))
    rule = F.col(line).startswith("---")
    return lines.withColumn("_drop", rule & (before.isNull() | before.startswith("---") | (before == ""))).where("not _drop").drop("_drop")


def natural_order(name: Column) -> Column:
    """Sorts names with a number by the number, then by the name."""
    return F.struct(F.coalesce(F.regexp_extract(name, "([0-9]+)", 1).try_cast("long"), F.lit(-1)), name)
