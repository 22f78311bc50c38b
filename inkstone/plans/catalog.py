"""Registry of the engine's queries: name -> (Spark function, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.plans import blocks, bodies, files, packages, records, relations, rendered, scalars

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def catalog() -> dict[str, Entry]:
    return scalars.catalog() | relations.catalog() | blocks.catalog() | files.catalog() | records.catalog() | bodies.catalog() | packages.catalog() | rendered.catalog()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in catalog().items() if sql}
