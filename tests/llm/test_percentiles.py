import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tallyforge.llm")
from tallyforge.llm import percentiles, reqsketch
from tallyforge.llm.reqsketch import ERROR, Sketch


def off(values, share, found):
    """By how many ranks a found percentile misses."""
    values = np.sort(values)
    rank = max(1, math.ceil(share * len(values) - 1e-9))
    below, upto = np.searchsorted(values, found, "left") + 1, np.searchsorted(values, found, "right")
    return max(0, below - rank, rank - upto)


@pytest.mark.parametrize("kind", ["sorted", "reversed", "shuffled", "lognormal", "ties"])
def test_error_bound_holds_in_merged_parts(kind):
    rng = np.random.default_rng(3)
    n = 200_000
    values = {"sorted": np.arange(n), "reversed": np.arange(n)[::-1], "shuffled": rng.permutation(n), "lognormal": rng.lognormal(5, 2, n), "ties": rng.integers(0, 50, n)}[kind].astype(float)
    whole = Sketch(1)
    for k, part in enumerate(np.array_split(values, 37)):
        own = Sketch(k)
        for batch in np.array_split(part, 3):
            own.add(batch)
        whole.merge(Sketch.loads(own.dumps()))
    assert whole.n == n
    assert sum(len(x.values) for x in whole.levels) < 12_000
    for share, found in zip(percentiles.SHARES, whole.percentiles(list(percentiles.SHARES))):
        assert off(values, share, found) <= max(1, ERROR * n * (1 - share)), share


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=6 * reqsketch.K - 1), st.integers(1, 5))
def test_small_sets_are_exact(values, parts):
    whole = Sketch()
    for part in np.array_split(np.array(values), parts):
        own = Sketch()
        own.add(part)
        whole.merge(own)
    for share, found in zip(percentiles.SHARES, whole.percentiles(list(percentiles.SHARES))):
        assert off(np.array(values), share, found) == 0


def test_refuses_nan_and_other_sizes():
    with pytest.raises(ValueError):
        Sketch().add(np.array([1.0, math.nan]))
    with pytest.raises(ValueError):
        Sketch(k=8).merge(Sketch(k=16))
    assert Sketch().percentiles([0.5]) == [None]


def test_groups_nulls_and_days(spark):
    rows = [("a", "d1", float(i), "x") for i in range(1000)] + [("a", "d2", float(i), "x") for i in range(1000, 3000)]
    rows += [(None, "d1", 5.0, "x"), ("b", "d1", None, "x"), ("b", "d1", math.nan, "x"), ("c", None, math.inf, "x")] * 2
    df = spark.createDataFrame(rows, "key string, day string, v double, sketch string").repartition(7)
    daily = percentiles.sketch(df, ["key", "day"], "v")
    found = {(r["key"], r["share"]): r for r in percentiles.percentiles(percentiles.merge(daily, ["key"]), ["key"]).collect()}
    assert found["a", 0.5]["n_values"] == 3000
    for share in percentiles.SHARES:
        assert off(np.arange(3000.0), share, found["a", share]["value"]) <= max(1, ERROR * 3000 * (1 - share))
    assert found[None, 0.5]["value"] == 5.0 and found[None, 0.5]["n_values"] == 2
    assert found["b", 0.5]["value"] is None and (found["b", 0.5]["n_null"], found["b", 0.5]["n_nan"]) == (2, 2)
    assert found["c", 0.99]["value"] == math.inf
    alone = percentiles.percentiles(percentiles.merge(daily, []), []).collect()
    assert [r["n_values"] for r in alone] == [3004] * 5


def test_empty_table(spark):
    empty = spark.createDataFrame([], "key string, v double")
    assert percentiles.percentiles(percentiles.sketch(empty, ["key"], "v"), ["key"]).collect() == []


def test_repeated_runs_give_equal_sketches(spark):
    df = spark.range(50_000).selectExpr("cast(id % 3 as string) key", "cast(hash(id) as double) v").repartition(5, "v")
    runs = [{r["key"]: bytes(r["sketch"]) for r in percentiles.sketch(df, ["key"], "v").collect()} for _ in range(2)]
    assert runs[0] == runs[1]
