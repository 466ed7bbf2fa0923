import datetime

import pytest

from tabscope.operators.filters import complete_rows, filter_rows, picker_values, same_table

BOATS = [(6.5, 120, "sloop"), (9.0, 300, "ketch"), (7.2, 180, "sloop"), (None, 150, "yawl"), (11.4, 410, "ketch"), (8.1, 240, "sloop"), (5.0, 95, "dinghy")]


@pytest.fixture(scope="module")
def boats(table):
    return table("metres double, sail bigint, rig string", BOATS)


@pytest.mark.parametrize(
    "column, op, value, expected",
    [
        ("rig", "eq", "ketch", 2),
        ("sail", "gt", 180, 3),
        ("sail", "gte", 180, 4),
        ("sail", "lt", 120, 1),
        ("sail", "lte", 120, 2),
        ("rig", "contains", "SLO", 3),
        ("rig", "contains", "^(yawl|dinghy)$", 2),
        ("sail", "contains", "0$", 6),
        ("metres", "gt", 0, 6),
        # A value of another kind is in no row.
        ("rig", "eq", 5, 0),
        ("sail", "eq", "ketch", 0),
        ("sail", "eq", "120", 0),
        ("sail", "eq", None, 0),
    ],
)
def test_predicates(boats, column, op, value, expected):
    assert filter_rows(boats, {column: {"op": op, "value": value}}).count() == expected


def test_values_of_another_kind_have_no_order(boats):
    with pytest.raises(TypeError):
        filter_rows(boats, {"rig": {"op": "gt", "value": 5}})


def test_conditions_are_combined_and_none_keeps_all(boats):
    both = {"rig": {"op": "eq", "value": "sloop"}, "sail": {"op": "gt", "value": 150}}
    assert filter_rows(boats, both).count() == 2
    assert filter_rows(boats, {}).count() == 7


def test_names_and_values_are_never_code(boats, table):
    with pytest.raises(KeyError):
        filter_rows(boats, {"1 = 1; drop table x": {"op": "eq", "value": 1}})
    with pytest.raises(ValueError):
        filter_rows(boats, {"metres": {"op": "__import__", "value": 1}})
    assert filter_rows(boats, {"rig": {"op": "eq", "value": "x' OR '1'='1"}}).count() == 0
    odd = table("`a.b` int, `c``d` int", [(1, 2), (3, 4)])
    assert filter_rows(odd, {"a.b": {"op": "gt", "value": 1}, "c`d": {"op": "eq", "value": 4}}).count() == 1


def test_nan_is_missing(table):
    df = table("x double", [(1.0,), (float("nan"),), (None,)])
    assert filter_rows(df, {"x": {"op": "gt", "value": 0}}).count() == 1
    assert complete_rows(df, ["x"]).count() == 1


def test_dates_compare_as_dates(table):
    df = table("d timestamp", [(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 6, 1),)])
    assert filter_rows(df, {"d": {"op": "gte", "value": datetime.datetime(2024, 3, 1)}}).count() == 1
    assert filter_rows(df, {"d": {"op": "lt", "value": "2024-03-01"}}).count() == 1


def test_picker_values_in_text_order(table):
    df = table("x int", [(10,), (9,), (None,), (10,), (100,)])
    assert [r[0] for r in picker_values(df, "x").collect()] == [10, 100, 9]


def test_same_table(table):
    a = table("x int, y string", [(1, "a"), (1, "a"), (2, "b")])
    assert same_table(a, a.orderBy("x"))
    assert not same_table(a, a.distinct())
    assert not same_table(a, a.withColumnRenamed("y", "z"))
    nan, null = (table("x double, y string", [(v, None)]) for v in (float("nan"), None))
    assert same_table(nan, null) and not same_table(null, table("x double, y string", [(1.0, None)]))
