"""Every catalogue query equals its SQL twin on the supplied tables; plans hold no row-wise Python and no cartesian product."""

import os
from pathlib import Path

import pytest

from inkstone.plans import catalog

DATA = "/root/testdata/sf0.001"
PAIRS = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {Path(f).stem} as from '{DATA}/{f}'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([int(r[i]) if hasattr(r[i], "quantize") else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", PAIRS)
def test_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of([tuple(r) for r in frame.collect()], frame.columns) == rows_of(found.fetchall(), columns)


@pytest.mark.parametrize("name", ["page_markdown", "outline_counter", "interval_clip", "page_break_fold", "table_markdown"])
def test_plans_stay_native(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_point_survives_without_training_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
