"""What Catalyst makes of the operators."""

import pytest
from conftest import DATA

from cairn import splats
from cairn.operators import bounds, chunks, filters, order, transform


@pytest.fixture(scope="module")
def view(spark):
    return splats.view(spark, DATA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_and_columns_are_pruned(view):
    p = plan(filters.box(view, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)).select("row_id", "opacity"))
    assert "PushedFilters: [" in p and "LessThanOrEqual(x,1.0)" in p.rpartition("PushedFilters: [")[2]
    schema = p.rpartition("ReadSchema: ")[2]
    assert "scale_0" not in schema and "opacity" in schema


def test_transforms_and_packing_are_narrow(view):
    p = plan(transform.transform(view, (1, 2, 3), transform.euler_quaternion((10, 20, 30)), 2.0))
    assert "Exchange" not in p and "Python" not in p and "*(1) Project" in p


def test_top_k_keeps_no_more_than_k(view):
    assert "TakeOrderedAndProject" in plan(order.by_visibility(view, limit=10))


def test_aggregates_combine_before_they_move(view):
    for df in (bounds.oriented(view, "lod"), chunks.chunk_bounds(chunks.prepared(view, "row_id"))):
        p = plan(df)
        assert p.count("HashAggregate") >= 2 and "partial_min" in p and "Python" not in p


def test_bounds_are_the_only_thing_sent_for_codes(view):
    p = plan(order.first_codes(view))
    assert "SortMergeJoin" not in p and "Broadcast" in p
