"""The plans are those wanted: filters and columns reach the scan, no cross joins, no unneeded exchanges."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def plans(spark, sf):
    qs = entry.registry.queries()
    return lambda name: plan(qs[name](spark, sf))


def columns(text):
    """Columns of every scan, sorted."""
    return {tuple(sorted(re.findall(r"(\w+):", m))) for m in re.findall(r"ReadSchema: struct<(.*)>", text)}


def test_filters_reach_the_scan(plans):
    text = plans("time_range")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(log_time,1715000000000000000\).*LessThan\(log_time,1722000000000000000\)", text)
    assert "GreaterThanOrEqual(ts," in plans("offset_limit")


@pytest.mark.parametrize("name,wanted", [("topic_catalog", {("channel_id", "file_id", "msg_id", "topic")}), ("flatten_fixed_array", {("embedding", "vec_id")}), ("p5_found", {("data", "file_id", "log_time", "msg_id", "publish_time", "topic")}), ("p3_found", {("decodable", "file_id", "message_count", "topic"), ("file_id", "msg_id", "topic")})])
def test_only_needed_columns_are_read(plans, name, wanted):
    assert columns(plans(name)) == wanted


def test_nested_columns_are_pruned(plans):
    (seen,) = {c for c in columns(plans("p1_object_table"))}
    assert "regions" not in seen and "header" not in seen and "score" in seen


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p7_found"])
def test_no_products(plans, name):
    text = plans(name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_reshaping_needs_no_exchange(plans):
    for name in ("flatten_struct", "flatten_fixed_array", "project_nested", "metadata_unix_ns"):
        assert "Exchange" not in plans(name)
