"""Large ordered tables go to tasks by their rows; token hits and nearest rows against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens import scale
from rosterlens.operators import linkage as lk
from rosterlens.operators import search as se


def test_ordered_tables_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "SMALL_BYTES", -1)
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    df = spark.range(1000).select((F.col("id") % 40).alias("k"), F.col("id").alias("o"))
    out = scale.numbered(df, ["k"], ["o"])
    assert out.rdd.getNumPartitions() == 20
    assert all(r.position == r.o // 40 + 1 for r in out.collect()) and out.count() == 1000


def test_token_pass_meets_each_name_once(spark):
    random.seed(4)
    words = "ab cd ef gh".split()
    left = [(i, random.randrange(3), " ".join(random.sample(words, 2)), "unmatched" if i % 4 else "matched", None if i % 4 else -i) for i in range(200)]
    left += [(5, 1, "ab cd", "unmatched", None), (201, None, "ab cd", "unmatched", None), (202, 1, None, "unmatched", None)]
    right = [(k, random.randrange(3), " ".join(random.sample(words, 3))) for k in range(5)] + [(1, 1, "ab cd ef"), (1, 1, "ab cd gh")]
    a = spark.createDataFrame(left, "id int, block int, name string, status string, linked int")
    b = spark.createDataFrame(right, "other int, block int, target string")
    out = lk.token_pass(a, b, ["block"], "id", "other", "name", ["target"], ["unmatched"])
    found = {}
    for i, block, name, status, _ in left:
        if status == "unmatched" and name and block is not None:
            found.setdefault(i, set()).update(o for o, k, t in right if k == block and set(name.split()) <= set(t.split()))
    for r in out.collect():
        one = found.get(r.id, set()) if r.id % 4 or r.id == 5 else set()
        assert r.linked == (min(one) if len(one) == 1 else (-r.id if r.status == "matched" else None)), r
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "max(other" in plan  # the least and the greatest candidate of a name, not each row's every one


@pytest.mark.parametrize("measure", ["distance", "dot"])
def test_nearest_by_few_exact_values(spark, measure):
    rng = np.random.default_rng(5)
    v = rng.integers(0, 3, (300, 4)).astype(float) + 1e6  # many ties, far from zero
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "id long, grp int, v array<double>")
    got = {}
    for r in se.nearest(df, df, ["grp"], "id", "v", "v", 5, measure, tile_rows=64).collect():
        got.setdefault(r.id, {})[r.place] = (r.other, r.value)
    for i in range(300):
        d = v @ v[i] if measure == "dot" else np.sqrt(((v - v[i]) ** 2).sum(1))
        others = sorted((j for j in range(300) if j % 2 == i % 2 and j != i), key=lambda j: ((-d[j] if measure == "dot" else d[j]), j))[:5]
        assert [got[i][k + 1][0] for k in range(5)] == others


def test_few_values_are_exact():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(70, 8))
    b[5] = np.nan
    whole, open_ = se.pair_values(a, b, "distance"), np.ones((40, 70), bool)
    at, cols, values = se.best_pairs(a, b, "distance", 3, lambda lo, hi: open_[lo:hi])
    assert np.array_equal(values, whole[at, cols])
    for i in range(40):
        assert set(np.argsort(whole[i], kind="stable")[:3].tolist()) <= set(cols[at == i].tolist())
