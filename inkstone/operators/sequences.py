"""Counters and positional joins in document order. All are window expressions over one partitioning of the documents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUTLINE_LEVELS = 7


def outline_numbers(df: DataFrame, keys: list[str], pos: str, level: str, out: str = "n") -> DataFrame:
    """The number of each heading: one more than the last of its level since a shallower one; 0 from level 8 on, without effect.

    Headings of one level between two shallower ones form a group, named by the place of the shallower one."""
    upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    lv = F.col(level)
    kind = dict(df.dtypes)[pos]
    none = F.lit("" if kind == "string" else -1).cast(kind)
    group: Column = F.lit(None).cast(kind)
    for k in range(1, OUTLINE_LEVELS + 1):
        group = F.when(lv == k, F.coalesce(F.max(F.when(lv < k, F.col(pos))).over(upto), none)).otherwise(group)
    grouped = df.withColumn("_group", group)
    return grouped.withColumn(out, F.when(lv <= OUTLINE_LEVELS, F.row_number().over(Window.partitionBy(*keys, level, "_group").orderBy(pos))).otherwise(F.lit(0)).cast("long")).drop("_group")


def numbers_with_reset(df: DataFrame, keys: list[str], pos: str, is_reset: Column, reset_to: Column, is_use: Column, out: str = "n", first: Column | None = None) -> DataFrame:
    """Running numbers of uses, from first (1) on; a reset sets the next number."""
    upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    island = df.withColumn("_island", F.sum(is_reset.cast("int")).over(upto))
    own = Window.partitionBy(*keys, "_island").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.first(F.when(is_reset, reset_to), ignorenulls=True).over(own), F.lit(1) if first is None else first)
    return island.withColumn(out, F.when(is_use, start + F.sum(is_use.cast("int")).over(own) - 1).cast("long")).drop("_island")


def asof_last(df: DataFrame, keys: list[str], pos: str, value: Column, out: str) -> DataFrame:
    """The last non-null value at or before each position."""
    upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(upto))


def parent_by_level(df: DataFrame, keys: list[str], pos: str, level: str, deepest: int, out: str = "parent") -> DataFrame:
    """The last record one level up."""
    upto = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    parent: Column = F.lit(None).cast("long")
    for k in range(1, deepest + 1):
        parent = F.when(F.col(level) == k, F.max(F.when(F.col(level) == k - 1, F.col(pos))).over(upto)).otherwise(parent)
    return df.withColumn(out, parent)


def ranges(df: DataFrame, keys: list[str], pos: str, start: str, length: Column) -> DataFrame:
    """end: where the next begins, or the length for the last."""
    return df.withColumn("end", F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(pos)), length))


def clip(left: DataFrame, right: DataFrame, keys: list[str], cell: int = 1024) -> DataFrame:
    """Overlaps of [start, end) ranges with the same keys. left: start, end; right: r_start, r_end.

    Ranges are dealt into cells of positions and meet only there, so a key with many ranges isn't compared all with all; of a pair that meets in
    several cells, the cell where the overlap begins counts."""
    at = lambda c: F.expr(f"cast(floor({c} / {cell}) as bigint)")
    cells = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(f"({b} - 1)"))))
    near = left.withColumn("_cell", cells("start", "end")).join(right.withColumn("_cell", cells("r_start", "r_end")), [*keys, "_cell"])
    found = near.where("start < r_end and r_start < end").where(F.col("_cell") == at("greatest(start, r_start)")).drop("_cell")
    return found.withColumn("clip_start", F.greatest("start", "r_start")).withColumn("clip_end", F.least("end", "r_end"))


def fold_rows(df: DataFrame, keys: list[str], pos: str, columns: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], out: str) -> DataFrame:
    """keys, pos, and what step gives for each row: a fold over the rows of each key in the order of pos.

    Rows are dealt and sorted by Spark and then run through step one by one in Arrow batches, so a group of any length takes time in proportion and
    no memory: only the state goes from row to row. step(state, values of columns) returns the next state and the row's results."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    given = ", ".join(f"`{c}` {types[c].simpleString()}" for c in [*keys, pos])
    result = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        state = known = None
        for batch in batches:
            found: list[tuple] = []
            own = [batch.column(k).to_pylist() for k in range(len(keys))]
            values = [batch.column(c).to_pylist() for c in columns]
            for key, row in zip(zip(*own, strict=True), zip(*values, strict=True), strict=True):
                if key != known:
                    state, known = start(), key
                state, made = step(state, row)
                found.append(made)
            made = [pa.array([f[k] for f in found], result.field(k).type) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in [*keys, pos]] + made, names=[*keys, pos, *names])

    rows = df.select(*dict.fromkeys([*keys, pos, *columns])).repartition(*keys).sortWithinPartitions(*keys, pos)
    return rows.mapInArrow(run, f"{given}, {out}")


def page_breaks(df: DataFrame, keys: list[str], pos: str, height: str, page_height: int) -> DataFrame:
    """The page of each block: a block that doesn't fit on what is left of a page that holds some begins the next."""

    def step(state: tuple[int, int], row: tuple) -> tuple[tuple[int, int], tuple]:
        (page, used), h = state, row[0] or 0
        over = used > 0 and used + h > page_height
        page, used = page + over, h if over else used + h
        return (page, used), (row[0], page)

    return fold_rows(df.withColumn(height, F.col(height).cast("long")), keys, pos, [height], lambda: (1, 0), step, f"{height} bigint, page bigint")
