import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import ranking

few = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow]
)


def frame(spark, values):
    rows = [(f"id{i:04d}", v) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "id string, v long").repartition(5)


@few
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_ntile_equals_the_window_function(spark, values, buckets):
    df = frame(spark, values)
    order = [("v", False), "id"]
    native = F.ntile(buckets).over(Window.orderBy(F.desc("v"), "id"))
    both = df.select(ranking.ntile(df, order, buckets).alias("mine"), native.alias("native"))
    assert both.filter("mine != native").count() == 0


@few
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_row_number_equals_the_window_function(spark, values):
    df = frame(spark, values)
    numbered = ranking.number_rows(df, [("v", False), "id"], "mine")
    native = F.row_number().over(Window.orderBy(F.desc("v"), "id"))
    rows = numbered.select("mine", native.alias("native")).collect()
    assert len(rows) == len(values) and all(a == b for a, b in rows)


@pytest.mark.parametrize("values", [[5], [1, 2], [0] * 30 + [7, 9, 11], list(range(100)), [3, 3, 3, 8]])
def test_quantiles_interpolate(spark, values):
    fractions = [0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0]
    mine = ranking.exact_quantiles(frame(spark, values), "v", fractions)
    assert mine == pytest.approx(np.quantile(values, fractions).tolist())


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1.0, 10), (2.0, 1), (50.0, 9)], "v double, n long")
    expected = np.quantile([1.0] * 10 + [2.0] + [50.0] * 9, [0.25, 0.5, 0.55, 0.99])
    assert ranking.exact_quantiles(df, "v", [0.25, 0.5, 0.55, 0.99], "n") == pytest.approx(expected.tolist())


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(spark.createDataFrame([], "v long"), "v", [0.5]) == [None]


@pytest.mark.parametrize("size", [1, 2, 4, 23, 50])
def test_rank_quantile_score_equals_cutting_the_row_number(spark, size):
    df = frame(spark, [i % 3 for i in range(size)])
    scored = df.withColumn("score", ranking.rank_quantile_score(df, ["v", "id"], 5)).orderBy("v", "id").collect()
    places = np.arange(1, size + 1)
    edges = np.quantile(places, [0.2, 0.4, 0.6, 0.8])
    assert [r["score"] for r in scored] == [1 + int((p > edges + 1e-9).sum()) for p in places]


def test_no_window_without_partition_over_the_rows(spark):
    df = frame(spark, range(50))
    plan = df.withColumn("tile", ranking.ntile(df, ["v", "id"], 5))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("pivots, few", [(1, 1), (3, 2), (8, 30)])
def test_selection_in_many_rounds(spark, monkeypatch, pivots, few):
    monkeypatch.setattr(ranking, "_PIVOTS", pivots)
    monkeypatch.setattr(ranking, "_FEW", few)
    rng = random.Random(pivots)
    rows = [(rng.choice([7.5] * 9 + [rng.random(), -1.0, float("nan")]), rng.choice("abcé漢") * rng.randint(0, 2), rng.randint(1, 4)) for _ in range(60)]
    df = spark.createDataFrame(rows, "x double, k string, n long").repartition(3)
    place = lambda r: (r[0] != r[0], r[0] if r[0] == r[0] else 0.0, [-b for b in r[1].encode()] + [1])
    flat = [r for r in sorted(rows, key=place) for _ in range(r[2])]
    wanted = [0, 1, len(flat) // 3, len(flat) // 2, len(flat) - 1]
    total, found = ranking.rows_at(df, ["x", ("k", False)], lambda n: wanted, "n")
    assert total == len(flat)
    for r in wanted:
        assert found[r]["k"] == flat[r][1] and repr(found[r]["x"]) == repr(flat[r][0])


def test_one_value_on_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "_PIVOTS", 16)
    monkeypatch.setattr(ranking, "_FEW", 16)
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.col("id").cast("double")).alias("x"))
    values = sorted(500.0 if i % 3 == 0 else float(i) for i in range(30000))
    fractions = [0, 0.01, 0.1, 0.25, 0.5, 0.99, 1]
    assert ranking.exact_quantiles(df, "x", fractions) == pytest.approx(np.quantile(values, fractions).tolist())


def test_several_columns_at_once(spark):
    rows = [(float(i % 17), None if i % 5 else i, None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(4)
    got = ranking.quantiles_of(df, ["a", "b", "c"], [0.1, 0.5])
    assert got["a"] == pytest.approx(np.quantile([r[0] for r in rows], [0.1, 0.5]).tolist())
    assert got["b"] == pytest.approx(np.quantile([r[1] for r in rows if r[1] is not None], [0.1, 0.5]).tolist())
    assert got["c"] == [None, None]


def test_values_at_ranks_of_any_doubles_with_weights(spark):
    odd = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1e308, -1.5, 7.0, float("nan")]
    rows = [(v, float(i * i % 97), i % 3) for i, v in enumerate(odd * 30)] + [(None, 3.0, 2)]
    df = spark.createDataFrame(rows, "a double, b double, w int").repartition(4)
    found = ranking.values_at(df, ["a", "b"], range, "w")
    for column, (total, values) in found.items():
        at = ["a", "b"].index(column)
        order = sorted((r[at] for r in rows for _ in range(r[2]) if r[at] is not None), key=lambda v: (v != v, v if v == v else 0))
        assert total == len(order)
        assert [repr(values[k] + 0.0) for k in range(total)] == [repr(v + 0.0) for v in order]
