import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import joins
from tabscope.operators.joins import join_dataframes, join_stats, suggest_join_keys
from tests.conftest import by

HOW = ["inner", "left", "right", "outer"]


@pytest.fixture(scope="module")
def harbour(table):
    berths = table("berth int, pier string", [(n, f"pier {n % 2}") for n in range(21, 26)])
    calls = table("call int, berth int, tons int", [(1, 21, 5), (2, 21, 6), (3, 23, 7), (4, 23, 8), (5, 26, 9)])
    return berths, calls


@pytest.mark.parametrize("how, rows", [("inner", 4), ("left", 7), ("right", 5), ("outer", 8)])
def test_row_counts(harbour, how, rows):
    joined = join_dataframes(*harbour, "berth", "berth", how)
    assert joined.count() == rows
    assert joined.columns == ["berth", "pier", "call", "tons"]


def test_stats_know_the_size_before_the_join(harbour):
    stats = by(join_stats(*harbour, "berth", "berth"), "how")
    assert [stats[h]["rows_result"] for h in HOW] == [4, 7, 5, 8]
    assert stats["left"]["match_rate"] == 0.4
    assert (stats["left"]["rows_a"], stats["left"]["rows_b"], stats["left"]["columns_result"]) == (5, 5, 4)


def test_text_never_meets_numbers(harbour):
    stats = by(join_stats(*harbour, "pier", "berth"), "how")
    assert stats["inner"]["rows_result"] == 0 and stats["outer"]["rows_result"] == 10 and stats["left"]["match_rate"] == 0


def brute(a, b, how):
    """Nested loops over (key, value) rows; a missing key equals a missing key."""
    pairs = [(x[0], x[1], y[1]) for x, y in itertools.product(a, b) if x[0] == y[0]]
    left = [(x[0], x[1], None) for x in a if x[0] not in {y[0] for y in b}]
    right = [(y[0], None, y[1]) for y in b if y[0] not in {x[0] for x in a}]
    return pairs + (left if how in ("left", "outer") else []) + (right if how in ("right", "outer") else [])


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("limit", [10**9, 3])
def test_against_nested_loops_with_hot_and_missing_keys(table, how, limit):
    rng = random.Random(1)
    keys = [None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    a = [(rng.choice(keys), f"a{i}") for i in range(40)]
    b = [(rng.choice(keys[:5] + [8, 9]), f"b{i}") for i in range(30)]
    da, db = table("k int, v string", a), table("k int, w string", b)
    joined = join_dataframes(da, db, "k", "k", how, hot_key_rows=limit)
    order = lambda r: tuple(str(x) for x in r)
    expected = sorted(brute(a, b, how), key=order)
    assert sorted((tuple(r) for r in joined.collect()), key=order) == expected
    assert by(join_stats(da, db, "k", "k"), "how")[how]["rows_result"] == len(expected)


def test_colliding_names(table):
    a, b = table("k int, z int, j int", [(1, 2, 3)]), table("k int, z int", [(9, 1)])
    joined = join_dataframes(a, b, "k", "z")
    assert joined.columns == ["k_a", "z_a", "j", "k_b", "z_b"]
    assert tuple(joined.first()) == (1, 2, 3, 9, 1)


def test_incompatible_and_nested_keys(table):
    numbers, texts = table("k int", [(1,)]), table("k string", [("1",)])
    with pytest.raises(TypeError):
        join_dataframes(numbers, texts, "k", "k")
    nested = numbers.select(F.struct("k").alias("k"))
    with pytest.raises(TypeError):
        join_dataframes(nested, nested, "k", "k")
    assert join_stats(nested, nested, "k", "k").first()["match_rate"] is None
    with pytest.raises(KeyError):
        join_dataframes(numbers, numbers, "k", "missing")


def test_match_rate_without_keys(table):
    empty = table("k int", [])
    assert join_stats(empty, table("k int", [(1,)]), "k", "k").first()["match_rate"] == 0.0


def test_suggested_keys(table):
    a = table("name string, user_id int, key int, day date", [])
    b = table("day date, key int, user_id int, other int", [])
    assert suggest_join_keys(a, b) == [(0, "key"), (0, "user_id"), (1, "day")]


def test_a_histogram_at_hand_takes_hot_keys_out(table, monkeypatch):
    """Hot keys on both sides, on one side only, and missing ones; nothing is counted again."""
    rng = random.Random(12)
    a = [(rng.choice([1, 2, 3, 4, None]), i) for i in range(60)] + [(7, i) for i in range(20)]
    b = [(rng.choice([1, 2, 5, None]), i) for i in range(60)] + [(8, i) for i in range(20)]
    da, db = table("k int, x int", a), table("k int, y int", b)
    histogram = joins.key_histogram(da, db, "k", "k")
    assert {r["key"]: (r["n_a"], r["n_b"]) for r in histogram.collect()} == {k: (sum(x[0] == k for x in a), sum(x[0] == k for x in b)) for k in (1, 2, 3, 4, 5, 7, 8, None)}
    monkeypatch.setattr(joins, "_histogram", None)
    order = lambda r: tuple(str(x) for x in r)
    for how in ("left", "right", "outer"):
        plain = sorted(map(tuple, join_dataframes(da, db, "k", "k", how).collect()), key=order)
        for limit in (5, 14, None):
            found = join_dataframes(da, db, "k", "k", how, hot_key_rows=limit, histogram=histogram)
            assert sorted(map(tuple, found.collect()), key=order) == plain
