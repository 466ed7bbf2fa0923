import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.functions import tails
from tabscope.operators import drift, significance
from tabscope.operators.drift import pair_of
from tests.conftest import as_dicts


# Published table values.
@pytest.mark.parametrize("t, dof, p", [(1.0, 10, 0.340893), (2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e9, 0.05), (0.0, 5, 1.0), (2.776445, 4, 0.05)])
def test_t_tail(t, dof, p):
    assert tails.t_two_sided(t, dof) == pytest.approx(p, abs=2e-6)
    assert tails.t_two_sided(-t, dof) == tails.t_two_sided(t, dof)


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (6.634897, 1, 0.01), (0.0, 3, 1.0), (0.554298, 5, 0.99)])
def test_chi_square_tail(x, dof, p):
    assert tails.chi_square_upper(x, dof) == pytest.approx(p, abs=1e-6)


def test_closed_forms_and_far_tails():
    assert tails.t_two_sided(3.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(3.0), rel=1e-12)
    assert tails.t_two_sided(1.5, 2) == pytest.approx(1 - 1.5 / math.sqrt(2 + 1.5**2), rel=1e-12)
    assert tails.chi_square_upper(7.0, 2) == pytest.approx(math.exp(-3.5), rel=1e-12)
    assert tails.chi_square_upper(9.0, 4) == pytest.approx(math.exp(-4.5) * 5.5, rel=1e-12)
    assert tails.chi_square_upper(5000.0, 3) == 0.0 or tails.chi_square_upper(5000.0, 3) < 1e-300
    assert 0 < tails.t_two_sided(40.0, 12.5) < 1e-12
    assert tails.chi_square_upper(1_000_300.0, 1_000_000) == pytest.approx(0.4159, abs=1e-3)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)


def column_pair(table, before, after, kind="double"):
    rows = lambda values: table(f"v {kind}", [(v,) for v in values])
    return pair_of(rows(before), rows(after))


def test_welch_finds_what_is_apart(table):
    found = as_dicts(significance.numeric_significance(column_pair(table, [9.0, 10.0, 11.0] * 10, [99.0, 100.0, 101.0] * 10), "v"))[0]
    assert found["applicable"] and found["significant"] and found["statistic"] < 0 and found["p_value"] < 1e-30
    assert (found["n_before"], found["n_after"]) == (30, 30)


def test_welch_against_a_worked_example(table):
    a = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9, 16.9, 20.1, 21.9, 22.6, 23.1, 19.6, 19.0, 21.7, 21.4]
    b = [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 24.4]
    found = as_dicts(significance.numeric_significance(column_pair(table, a, b), "v"))[0]
    assert found["p_value"] == pytest.approx(0.0083, abs=5e-4)


def test_welch_same_sample_and_missing_values(table):
    rng = random.Random(0)
    sample = [rng.gauss(50, 5) for _ in range(60)]
    shuffled = sample[:]
    rng.shuffle(shuffled)
    found = as_dicts(significance.numeric_significance(column_pair(table, [*sample, None, float("nan")], shuffled), "v"))[0]
    assert found["significant"] is False and found["n_before"] == 60 and found["p_value"] == pytest.approx(1.0)


@pytest.mark.parametrize("before, after, applicable, p", [([1.0], [1.0, 2.0], False, None), ([1.0, 1.0], [1.0, 1.0], True, None), ([1.0, 1.0], [2.0, 2.0], True, 0.0)])
def test_welch_edges(table, before, after, applicable, p):
    found = as_dicts(significance.numeric_significance(column_pair(table, before, after), "v"))[0]
    assert found["applicable"] is applicable and found["p_value"] == p
    assert (found["reason"] is None) is applicable
    if applicable:
        assert found["significant"] is (p == 0.0)


def test_chi_square(table):
    shifted = column_pair(table, ["A"] * 90 + ["B"] * 10, ["A"] * 10 + ["B"] * 90, "string")
    found = as_dicts(significance.categorical_significance(shifted, "v"))[0]
    # Two categories: |90 - 50| - 0.5 in four cells.
    assert found["statistic"] == pytest.approx(4 * 39.5**2 / 50) and found["dof"] == 1 and found["significant"]
    same = as_dicts(significance.categorical_significance(column_pair(table, ["A", "B"] * 50, ["A", "B"] * 50, "string"), "v"))[0]
    assert same["significant"] is False and same["p_value"] == 1.0
    three = column_pair(table, ["A"] * 10 + ["B"] * 20 + ["C"] * 30, ["A"] * 20 + ["B"] * 20 + ["C"] * 20, "string")
    found = as_dicts(significance.categorical_significance(three, "v"))[0]
    assert found["statistic"] == pytest.approx(2 * 25 / 15 + 2 * 25 / 25) and found["dof"] == 2


@pytest.mark.parametrize("before, after", [(["A"] * 5, ["A"] * 3), ([None, None], ["A", "B"]), ([None], [None])])
def test_chi_square_does_not_apply(table, before, after):
    found = as_dicts(significance.categorical_significance(column_pair(table, before, after, "string"), "v"))[0]
    assert found["applicable"] is False and found["reason"] and found["p_value"] is None


def test_conversion_rates(table):
    counts = [(200, 2000, 260, 2000), (100, 1000, 102, 1000), (0, 0, 10, 100), (150, 100, 10, 100), (-5, 100, 10, 100), (0, 100, 0, 100), (100, 100, 100, 100)]
    rows = [(i, *c) for i, c in enumerate(counts)]
    df = table("id int, count_a bigint, total_a bigint, count_b bigint, total_b bigint", rows)
    found = {r["id"]: r for r in as_dicts(significance.conversion_rates(df))}
    assert (found[0]["rate_a"], found[0]["rate_b"], found[0]["diff"]) == (0.1, 0.13, 0.03)
    assert found[0]["significant"] and found[0]["ci_low"] > 0 and found[0]["z"] == round(0.03 / math.sqrt(0.115 * 0.885 * 2 / 2000), 4)
    assert found[0]["p_value"] == pytest.approx(math.erfc(0.03 / math.sqrt(0.115 * 0.885 * 2 / 2000) / math.sqrt(2)), abs=1e-6)
    assert found[1]["significant"] is False and found[1]["ci_low"] < 0 < found[1]["ci_high"]
    assert [found[i]["applicable"] for i in range(2, 7)] == [False] * 5
    assert all(found[i]["reason"] and found[i]["p_value"] is None for i in range(2, 7))


def test_conversion_from_rows(table):
    rows = [("a", True)] * 20 + [("a", False)] * 80 + [("b", True)] * 40 + [("b", False)] * 60 + [("c", True)]
    found = as_dicts(significance.conversion_test(table("g string, hit boolean", rows), "g", "hit", "a", "b"))[0]
    assert (found["count_a"], found["total_a"], found["count_b"], found["total_b"]) == (20, 100, 40, 100) and found["significant"]


def test_linear_fit(table):
    rows = [(1.0, 2.1), (2.0, 3.9), (3.0, 6.2), (4.0, 7.8), (5.0, 10.1), (None, 1.0)]
    found = as_dicts(significance.linear_fit(table("x double, y double", rows), "x", "y"))[0]
    assert found["slope"] == pytest.approx(1.99) and found["intercept"] == pytest.approx(0.05) and found["n"] == 5
    assert found["p_value"] < 1e-3 and found["r2"] > 0.99


@pytest.mark.parametrize("rows, applicable, p", [([(1.0, 1.0)], False, None), ([(1.0, 1.0), (1.0, 2.0)], False, None), ([(1.0, 1.0), (2.0, 3.0)], True, 0.0), ([(1.0, 2.0), (2.0, 2.0)], True, 1.0), ([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], True, 1.0)])
def test_linear_fit_edges(table, rows, applicable, p):
    found = as_dicts(significance.linear_fit(table("x double, y double", rows), "x", "y"))[0]
    assert found["applicable"] is applicable and found["p_value"] == p


def test_tails_of_many_values_at_once():
    """Arrays give what their elements give, in all ranges of both distributions."""
    rng = np.random.default_rng(1)
    t, dof = np.append(rng.normal(0, 5, 300), [0.0, np.inf, -np.inf, 40.0, 1e-9]), np.append(10 ** rng.uniform(0, 9, 300), [3, 4, 5, 2, 7])
    assert tails.t_two_sided(t, dof) == pytest.approx([float(tails.t_two_sided(a, b)) for a, b in zip(t, dof, strict=True)], rel=1e-7, abs=1e-300)
    x, dof = np.append(10 ** rng.uniform(-3, 4, 300), [0.0, -1.0, np.inf]), np.append(10 ** rng.uniform(0, 4, 300).round(1), [1, 2, 3])
    assert tails.chi_square_upper(x, dof) == pytest.approx([float(tails.chi_square_upper(a, b)) for a, b in zip(x, dof, strict=True)], rel=1e-7, abs=1e-300)
    assert tails.log_gamma(np.array([0.5, 1, 2, 9.99, 10, 171.5, 1e6])) == pytest.approx([math.lgamma(v) for v in (0.5, 1, 2, 9.99, 10, 171.5, 1e6)], rel=1e-13, abs=1e-13)
    assert tails.normal_two_sided(np.array([0.0, 1.96, -3.0, 8.0])) == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in (0, 1.96, 3, 8)], rel=1e-9)


def test_each_segment_is_tested_as_if_alone(spark, table):
    rng = random.Random(6)
    rows = [(d, side, None if rng.random() < 0.1 else rng.gauss(10 + (d == "up") * 3 * (side == "b"), 2)) for d in ("up", "flat", None) for side in "ab" for _ in range(40)]
    rows += [("new", "b", 1.0), ("new", "b", 2.0), ("once", "a", 1.0), ("once", "b", 1.0), ("blank", "a", None)]
    df = table("depot string, side string, v double", rows)
    found = {r["segment"]: r for r in as_dicts(significance.segment_significance(drift.split_by_column(df, "side", "a", "b"), "v", "depot"))}
    assert found.keys() == {"up", "flat", None, "new", "once"}
    assert found["up"]["significant"] and found["flat"]["applicable"]
    assert not found["new"]["applicable"] and found["new"]["n_after"] == 2 and found["once"]["p_value"] is None
    for depot in ("up", "flat", None):
        own = df.where(F.col("depot").eqNullSafe(depot))
        alone = as_dicts(significance.numeric_significance(drift.split_by_column(own, "side", "a", "b"), "v"))[0]
        for name in ("statistic", "p_value", "n_before", "n_after", "significant"):
            assert found[depot][name] == pytest.approx(alone[name], rel=1e-12)
    with pytest.raises(KeyError):
        significance.segment_significance(drift.split_by_column(df, "side", "a", "b"), "v", "nope")
