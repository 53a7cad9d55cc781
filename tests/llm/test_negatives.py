import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import negatives
from tillroll.llm.queries import QUERIES

SCHEMA = "id long, label int, vector array<long>, score double, leaf int"


def plain(rows, is_anchor, k=5, low=80, high=100):
    """All pairs; of rows repeating an id the smallest."""
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None for x in v):
            continue
        one[i] = min(one.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (own, va) in one.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-score(va, v), i, label) for i, (label, v) in one.items())
        for s, p, _ in [r for r in ranked if r[2] == own and r[1] != a][:k]:
            fits = [r for r in ranked if r[2] != own and -low * s <= -100 * r[0] <= -high * s]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def clustered(n, dims, seed, centres=12):
    rng = random.Random(seed)
    middle = [[rng.randint(-60, 90) for _ in range(dims)] for _ in range(centres)]
    rows = []
    for i in range(n):
        c = rng.randrange(centres)
        label = c % 4 if rng.random() < 0.8 else rng.randrange(4)
        rows.append((i, label, [x + rng.randint(-4, 4) for x in middle[c]]))
    return rows


def run(spark, rows, modulus=10, **options):
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % modulus == 0, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block": 7, "sample": 100, "fan": 3, "leaf": 5}, {"sample": 1}])
def test_against_all_pairs(spark, options):
    rows = clustered(400, 6, 1)
    expected = plain(rows, lambda a: a % 10 == 0)
    assert expected and run(spark, rows, **options) == expected


def test_ties_and_a_hot_vector(spark):
    rows = clustered(150, 4, 2) + [(1000 + k, k % 3, [50, 50, 50, 50]) for k in range(150)]
    assert run(spark, rows, block=16, sample=64, leaf=8) == plain(rows, lambda a: a % 10 == 0)


def test_other_numbers(spark):
    rows = clustered(200, 3, 3)
    got = run(spark, rows, positives=2, negatives=9, low=50, high=99, sample=50, leaf=8)
    one = [r for r in plain(rows, lambda a: a % 10 == 0, 9, 50, 99)]
    firsts = {}
    for a, p, *_ in plain(rows, lambda a: a % 10 == 0, 2, 0, 10**9):
        firsts.setdefault(a, set()).add(p)
    assert got == [r for r in one if r[1] in firsts.get(r[0], ())]


def test_large_components_are_exact(spark):
    rows = [(i, label, [x * 10**7 + i for x in v]) for i, label, v in clustered(120, 4, 4)]
    assert run(spark, rows) == plain(rows, lambda a: a % 10 == 0)
    with pytest.raises(OverflowError):
        run(spark, [(0, 0, [1 << 40]), (1, 0, [1 << 40])])


def test_subtrees_are_ruled_out(spark):
    rows = clustered(3000, 8, 5, centres=40)
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], SCHEMA)
    index = negatives.build(df, sample=1000, leaf=20)
    vectors = np.array([v for _, _, v in rows[:50]], float)
    scores = vectors @ np.array([v for _, _, v in rows], float).T
    low = np.sort(scores, axis=1)[:, -6]
    leaves = index.tree.visit(np.array([v for _, _, v in rows], float))
    found = index.tree.reachable(vectors, np.arange(50), low, np.full(50, np.inf))
    assert index.tree.leaves > 30
    visits = sum(map(len, found.values()))
    assert visits < 0.25 * 50 * index.tree.leaves  # most subtrees are eliminated
    for w in range(50):  # none that holds a result is
        assert all(w in found[leaf] for leaf in set(leaves[scores[w] >= low[w]].tolist()))


def test_awkward_rows(spark):
    rows = clustered(80, 3, 6)
    rows += [(None, 1, [1, 2, 3]), (500, None, [1, 2, 3]), (510, 1, None), (520, 1, [1, None, 3])]
    rows += [(0, 3, [9, 9, 9]), (0, 0, [80, 1, 1]), (10, 1, [5]), (20, 2, []), (530, 2, [1, 2, 3, 4])] + [rows[5]] * 3
    assert run(spark, rows) == plain(rows, lambda a: a % 10 == 0)
    assert run(spark, []) == [] and run(spark, [(1, None, [1])]) == []
    assert run(spark, [(0, 1, [])]) == []


def test_query(spark, tmp_path):
    rows = [(i, label, [x / 256 + 0.001 for x in v]) for i, label, v in clustered(300, 5, 7)]
    rows += [(301, 1, [float("nan")] * 5), (302, 1, [float("inf")] * 5), (303, 1, None), (304, None, [0.0] * 5)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["op12_gnat_negatives"](spark, str(tmp_path)).collect()))
    whole = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        for i, label, v in rows[:300]
    ]
    assert got == plain(whole, lambda a: a % 100 == 0)
