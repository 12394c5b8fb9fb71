"""Recorders of intermediate tables."""

from __future__ import annotations

import os
import threading

import pytest

from veldspar import tables
from veldspar.tables import drop_tables, materialise, recorded


def _there(path: str) -> bool:
    return os.path.isdir(path.removeprefix("file://"))


def test_nested_recorders_with_equal_contents(spark):
    with recorded() as outer:
        with recorded() as inner:
            materialise(spark.range(3))
            assert outer == inner and outer is not inner
        kept = materialise(spark.range(4))
    assert len(outer) == 2 and len(inner) == 1
    materialise(spark.range(5))
    assert len(outer) == 2
    spent = [inner[0]]
    drop_tables(spark, inner)
    assert not _there(spent[0]) and kept.count() == 4


def test_an_error_leaves_no_recorder_behind(spark):
    with recorded() as outer:
        with pytest.raises(ValueError), recorded() as inner:
            materialise(spark.range(1))
            raise ValueError
        materialise(spark.range(2))
    assert (len(outer), len(inner)) == (2, 1)


def test_threads_do_not_record_each_other(spark):
    with recorded() as outer:
        other = threading.Thread(target=lambda: materialise(spark.range(1)))
        other.start()
        other.join()
    assert outer == []


def test_what_is_too_large_is_not_broadcast(spark):
    """The planner's own estimate would broadcast these few rows."""
    plan = lambda right: spark.range(10).join(right, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(tables.sized(spark.range(5))) and "Broadcast" not in plan(tables.sized(spark.range(5), rows=2))
