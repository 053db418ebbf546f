"""Split groups give what plain windows give, whatever the bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rosterlens.operators.exposure import spearman
from rosterlens.operators.groups import survival_share
from rosterlens.operators.joins import band_pairs
from rosterlens.operators.sequences import with_sequences
from rosterlens.scale import Ordered, hot_groups, lookup, numbered, quantiles, salted_join, value_ranks


def table(spark, n=400, seed=1):
    """One key holds more than half of all rows; order values repeat, ids do not."""
    r = random.Random(seed)
    rows = [("hot" if i % 3 else f"k{i % 7}", r.randint(0, 60), i, r.choice([1, 2, None, 5]), r.random())
            for i in range(n)]
    return spark.createDataFrame(rows, "k string, t long, id long, v long, x double").repartition(4)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("limit", [7, 40, 100_000])
def test_running_and_neighbours(spark, limit):
    df = table(spark)
    o = Ordered(df, ["k"], ["t", "id"], limit)
    assert (o._hot is not None) == (limit < 400)
    o = o.upto(s=("sum", F.col("v")), m=("max", F.col("v")), n=("sum", F.lit(1))).onward(
        back=("sum", F.col("v")), low=("min", F.when(F.col("v") == 5, F.struct("t", "id"))))
    o = o.before(pv=F.col("v"), pt=F.col("t")).after(nv=F.col("v")).whole(w=F.col("v"))
    w = Window.partitionBy("k").orderBy("t", "id")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    on = w.rowsBetween(0, Window.unboundedFollowing)
    want = df.select(
        "k", "id", F.sum("v").over(up).alias("s"), F.max("v").over(up).alias("m"), F.row_number().over(w).alias("n"),
        F.sum("v").over(on).alias("back"), F.min(F.when(F.col("v") == 5, F.struct("t", "id"))).over(on).alias("low"),
        F.lag("v").over(w).alias("pv"), F.lag("t").over(w).alias("pt"), F.lead("v").over(w).alias("nv"),
        F.sum("v").over(Window.partitionBy("k")).alias("w"))
    columns = ["k", "id", "s", "m", "n", "back", "low", "pv", "pt", "nv", "w"]
    assert rows_of(o.df, *columns) == rows_of(want, *columns)


def test_hot_groups_are_found(spark):
    hot = hot_groups(table(spark), ["k"], 100)
    assert [r.k for r in hot.collect()] == ["hot"]


def test_order_without_groups(spark):
    df = table(spark)
    got = rows_of(numbered(df, [], ["t", "id"], rows=30), "id", "position")
    want = df.withColumn("position", F.row_number().over(Window.orderBy("t", "id")))
    assert got == rows_of(want, "id", "position")


def test_sequences_split_inside_a_sequence(spark):
    r = random.Random(3)
    rows = [(1 if i % 5 else 2, 1, i, float(i), r.choice([1, 1, 1, 2]), r.randint(1, 3),
             r.choice(["pass", "shot", "dribble"])) for i in range(300)]
    df = spark.createDataFrame(rows, "game int, period int, action long, seconds double, team int, player int, type string")
    columns = ["game", "action", "seq", "seq_start", "seq_end", "seq_duration", "creates"]
    assert rows_of(with_sequences(df, rows=20), *columns) == rows_of(with_sequences(df), *columns)


@pytest.mark.parametrize("limit", [10, None])
def test_exact_quantiles_and_ranks(spark, limit):
    df = table(spark)
    got = {r.k: r for r in quantiles(df, ["k"], "x", {"a": 0.025, "b": 0.5, "c": 1.0}, limit).collect()}
    pdf = df.toPandas()
    for k, part in pdf.groupby("k"):
        want = np.quantile(part.x, [0.025, 0.5, 1.0])
        assert np.allclose([got[k].a, got[k].b, got[k].c], want, atol=1e-12)
    ranks = value_ranks(df, ["k"], "t", rows=limit).toPandas().set_index(["k", "t"])
    want = pdf.assign(r=pdf.groupby("k").t.rank())
    for row in want.itertuples():
        assert ranks.loc[(row.k, row.t), "middle_rank"] == row.r


def test_spearman_split(spark):
    df = table(spark)
    got = {r.k: r.spearman for r in spearman(df, ["k"], "t", "x", rows=10).collect()}
    for k, part in df.toPandas().groupby("k"):
        assert abs(got[k] - part.t.rank().corr(part.x.rank())) < 1e-9


def test_survival_share_split(spark):
    df = table(spark)
    got = rows_of(survival_share(df, df, ["k"], "t", "t", ["id"], rows=10), "id", "closeness")
    assert got == rows_of(survival_share(df, df, ["k"], "t", "t", ["id"]), "id", "closeness")


def test_salted_join_is_the_join(spark):
    a, b = table(spark), table(spark, 200, 2).withColumnsRenamed({"id": "id2", "t": "t2", "v": "v2", "x": "x2"})
    got = salted_join(a, b, ["k"], F.col("t") < F.col("t2"), ["id"], rows=20)
    want = a.join(b, "k").filter(F.col("t") < F.col("t2"))
    assert rows_of(got, "id", "id2") == rows_of(want, "id", "id2")


def test_band_pairs_split(spark):
    rows = [(1 if i % 4 else 2, i % 6, (i * 37) % 500) for i in range(240)]
    df = spark.createDataFrame(rows, "game int, player int, ms long")
    got = rows_of(band_pairs(df, ["game"], "player", "ms", 20, rows=8), "game", "player_a", "player_b", "n")
    pdf, want = df.toPandas(), {}
    recs = list(pdf.itertuples(index=False))
    for i, a in enumerate(recs):
        for b in recs[i + 1:]:
            if a.game == b.game and a.player != b.player and abs(a.ms - b.ms) <= 20:
                key = (a.game, min(a.player, b.player), max(a.player, b.player))
                want[key] = want.get(key, 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())


def test_lookup_keeps_every_row(spark):
    df = table(spark)
    small = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> 'k0'")
    out = lookup(df, small, ["k"])
    assert out.count() == df.count() and out.filter("n is null").select("k").distinct().count() == 1


def test_band_pairs_keep_what_links_need(spark):
    """Counts summed over blocks, in tiles of few players; the reduced counts give the links of all counts."""
    import collections
    import itertools

    from rosterlens.operators.graph import merged_kinds

    rng = np.random.default_rng(5)
    events = [(int(g), int(g) % 2, int(p), int(t)) for g, p, t in zip(rng.integers(0, 4, 260), rng.integers(0, 11, 260), rng.integers(0, 300, 260))]
    want = collections.Counter()
    for (g, team, p, t), (h, _, q, u) in itertools.combinations(events, 2):
        if g == h and p != q and abs(t - u) <= 9:
            want[team, min(p, q), max(p, q)] += 1
    df = spark.createDataFrame([*events, (None, 0, 1, 1), (0, 0, None, 1), (0, 0, 1, None)], "game int, team int, player long, ms long")
    for rows in (None, 2):
        counts = band_pairs(df, ["game", "team"], "player", "ms", 9, rows=rows, by=["team"])
        assert rows_of(counts, "team", "player_a", "player_b", "n") == sorted(((*k, n) for k, n in want.items()), key=repr)
        passes = spark.createDataFrame([(0, 1, 2, 3), (0, 2, 9, 2), (1, 0, 10, 5), (1, 3, 99, 4)], "team int, player_a long, player_b long, n long")
        some = band_pairs(df, ["game", "team"], "player", "ms", 9, rows=rows, by=["team"], keep=(2, 2), wanted=passes)
        a, b = (sorted(map(tuple, merged_kinds(passes, c, ["team"], least=2, partners=2).collect())) for c in (counts, some))
        assert a == b
    assert some.count() < counts.count()
