"""Hand-made cases and brute force on small fixtures."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.functions import edits as ed
from rosterlens.functions import numbers as nm
from rosterlens.functions import text as tx
from rosterlens.operators import checks as ck
from rosterlens.operators import cohorts as co
from rosterlens.operators import exposure as ex
from rosterlens.operators import graph as gh
from rosterlens.operators import groups as gr
from rosterlens.operators import joins as jn
from rosterlens.operators import linkage as lk
from rosterlens.operators import models as md
from rosterlens.operators import resample as rs
from rosterlens.operators import search as se
from rosterlens.operators import sequences as sq
from rosterlens.plans import upgrade as up


def test_exposure_against_loops(spark):
    r = random.Random(21)
    rows = [(g, r.choice("pq"), r.randint(1, 9), r.choice([0, 0, 15, 33, 61, 104]), r.random() < 0.4) for g in range(80)]
    df = spark.createDataFrame(rows, "game long, team string, player long, minutes long, starter boolean")
    for keys, of in ((["team", "player"], lambda x: (x[1], x[2])), (["player"], lambda x: (x[2],))):
        want = {}
        for x in rows:
            t = want.setdefault(of(x), [0, 0, 0])
            t[0], t[1], t[2] = t[0] + x[3], t[1] + (x[3] > 0), t[2] + x[4]
        got = {tuple(x[k] for k in keys): [x.minutes, x.games, x.starts] for x in ex.exposure(df, keys, starter=F.col("starter")).collect()}
        assert got == want


@pytest.mark.parametrize("days", [1, 5, 7, 26, 51])
def test_windows(spark, days):
    df = spark.range(1, days + 1).select(F.lit("x").alias("league"), F.col("id").cast("int").alias("game_day"))
    df = df.unionByName(spark.createDataFrame([("x", None)], "league string, game_day int"))
    got = {r.win: r["count"] for r in ex.assign_windows(df, ["league"]).groupBy("win").count().collect()}
    cut = -(-3 * days // 5)
    assert got == {k: n for k, n in {1: cut, 2: days - cut, None: 1}.items() if n}


def test_sequences_and_creation_against_loops(spark):
    r = random.Random(22)
    rows, at = [], 0
    for game in range(4):
        for period in (1, 2):
            team, player = 1, 1
            for _ in range(r.randint(1, 40)):
                team = 3 - team if r.random() < 0.25 else team
                player = 10 * team + r.randint(0, 3) if r.random() < 0.6 else 10 * team + player % 10
                rows.append((game, period, at, team, player, r.choice(["pass", "carry", "shot", "pass"]), float(at)))
                at += 1
    df = spark.createDataFrame(rows, "game int, period int, action int, team int, player int, type string, seconds double")
    want, number = {}, 0
    for i, x in enumerate(rows):
        new = i == 0 or rows[i - 1][:2] != x[:2]
        number = 1 if new else number + (rows[i - 1][3] != x[3])
        want[x[2]] = number
    seq = [(*x[:2], want[x[2]]) for x in rows]
    creates = {}
    for i, x in enumerate(rows):
        end = i + 1
        while end < len(rows) and seq[end] == seq[i] and rows[end][4] == rows[min(i + 1, len(rows) - 1)][4]:
            end += 1
        # the next action is another player's in the sequence, and the first shot from there on is in that player's run
        own = i + 1 < len(rows) and seq[i + 1] == seq[i] and rows[i + 1][4] != x[4]
        creates[x[2]] = own and any(rows[k][5] == "shot" for k in range(i + 1, end))
    assert {x.action: x.seq for x in sq.with_positions(sq.ordered(df)).df.collect()} == want
    assert {x.action: x.creates for x in sq.with_sequences(df).collect()} == creates


def test_band_is_inclusive(spark):
    rows = [(1, 10, 0), (1, 11, 5000), (1, 11, 5001), (1, 10, 10001), (2, 10, 0), (1, 10, 3)]
    df = spark.createDataFrame(rows, "block int, player long, ms long")
    got = [tuple(r) for r in jn.band_pairs(df, ["block"], "player", "ms", 5000).collect()]
    assert got == [(1, 10, 11, 4)]


def test_latest_values(spark):
    rows = [(1, "2016-05-15", 9.0), (1, "2016-06-01", 6.0), (1, "2016-07-01", 0.0), (1, "2016-09-01", 8.0), (2, "2016-06-01", 1.0),
            (2, "2016-06-01", 2.0)]
    df = spark.createDataFrame(rows, "player int, date string, value double").withColumn("date", F.to_date("date"))
    got = jn.as_of(df, "player", "date", "value", F.to_date(F.lit("2016-05-16")), F.to_date(F.lit("2016-08-31")))
    assert {r.player: (r.price, r.conflict) for r in got.collect()} == {1: (6.0, False), 2: (2.0, True)}
    with pytest.raises(ck.ContractError):
        jn.require_one_value(got)


def test_contract_stops_on_a_repeated_key(spark):
    once = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k int, name string")
    twice = spark.createDataFrame([(1, 5), (1, 6), (3, 7)], "k int, n int")
    with pytest.raises(Exception, match="right key repeated.*1"):
        jn.contracted(once, twice, ["k"]).select("k").collect()
    with pytest.raises(Exception, match="left key repeated.*1"):
        jn.contracted(twice, once, ["k"]).count()
    many = jn.contracted(twice, once, ["k"], "left", "many_to_one").collect()
    assert sorted(map(tuple, many)) == [(1, 5, "x"), (1, 6, "x"), (3, 7, None)]
    assert [tuple(r) for r in jn.contracted(once, once.withColumnRenamed("name", "other"), ["k"]).orderBy("k").collect()] == [
        (1, "x", "x"), (2, None, None)]


def test_recalibration_stops_on_a_falling_slope(spark):
    rows = spark.createDataFrame([("a", y, p) for p, ones in ((0.2, 7), (0.5, 5), (0.8, 3)) for y in [1] * ones + [0] * (10 - ones)], "g string, y int, p double")
    with pytest.raises(ValueError, match="slope not above 0"):
        md.logistic_recalibration(rows, ["g"], "y", "p")
    (got,) = md.logistic_recalibration(rows, ["g"], "y", "p", falling=True).collect()
    x, y = np.log([0.25, 1.0, 4.0]), np.log([7 / 3, 1.0, 3 / 7])  # a logit line goes through all three shares
    assert np.allclose([got["intercept"], got["slope"]], [0.0, (y[2] - y[0]) / (x[2] - x[0])])


def test_permuted_spearman(spark):
    data = [("s", i, float(v), a) for i, (v, a) in enumerate([(1, 3), (2, 3), (2, 9), (5, 1), (7, 4), (9, 8)])] + [("t", 9, 1.0, 2)]
    rows = spark.createDataFrame(data, "s string, id int, v double, a int")
    got = rs.permuted_spearman(rows, "s", "id", "v", "a", 5).collect()
    dealt = rs.permuted(rows, "s", "id", "v", 5).join(rows.select("id", "a"), "id").toPandas()
    assert len(got) == 10 and all(r["rho"] is None for r in got if r["s"] == "t")
    for r in (r for r in got if r["s"] == "s"):
        part = dealt[(dealt["replicate"] == r["replicate"]) & (dealt["s"] == "s")]
        assert np.isclose(r["rho"], part["v"].rank().corr(part["a"].rank()))
    (s, t) = rs.null_summary(spark.createDataFrame(got), ["s"]).orderBy("s").collect()
    rho = [r["rho"] for r in got if r["s"] == "s"]
    assert s["replicates"] == 5 and np.isclose(s["mean_rho"], np.mean(rho)) and np.isclose(s["largest_rho"], np.abs(rho).max()) and t["mean_rho"] is None


def test_mirror_labels_against_loops(spark):
    r = random.Random(23)
    day = lambda: f"{r.randint(2009, 2014)}-{r.choice(['02', '07', '09'])}-{r.choice(['01', '17'])}"
    moves = sorted({(r.randint(1, 12), day(), *r.choice([(4, 7), (7, 4)])) for _ in range(90)})
    moves = [(*m, r.choice([None, 0.0, 0.0, 8.5])) for m in moves]
    df = spark.createDataFrame(moves, "player int, date string, from_club int, to_club int, fee double").withColumn("date", F.to_date("date"))
    d = F.col("date")
    got = {(x.player, str(x.date), x.from_club): (x.label, x.n_mirrors) for x in co.mirror_labels(df, df, ["player"], co.months_before(d), co.months_after(d)).collect()}
    years = lambda text, k: f"{int(text[:4]) + k}{text[4:]}"
    for player, date, a, b, fee in moves:
        back = [m for m in moves if (m[0], m[2], m[3]) == (player, b, a) and years(date, -3) <= m[1] <= years(date, 3)]
        free = [m for m in back if not m[4]]
        before, after = any(m[1] < date for m in free), any(m[1] > date for m in free)
        label = ("paid_mirror" if back else "paid") if fee else "both" if before and after else "loan_return" if before else "loan_out" if after else "free_other"
        assert got[player, date, a] == (label, len(back))


def test_partners_against_loops(spark):
    r = random.Random(24)
    counts = [("t", a, b, r.randint(1, 6)) for a, b in itertools.combinations(range(9), 2) if r.random() < 0.7]
    kept = {(x.player_a, x.player_b) for x in gh.kept_links(spark.createDataFrame(counts, "team string, player_a int, player_b int, n long"), ["team"], partners=2).collect()}
    want = set()
    for node in range(9):
        near = sorted((-n, b if a == node else a) for _, a, b, n in counts if n >= 3 and node in (a, b))
        want |= {(min(node, o), max(node, o)) for _, o in near[:2]}
    assert kept == want


def test_anova_against_sums(spark):
    r = np.random.default_rng(25)
    rows = [(int(t), float(v)) for t, v in zip(r.integers(0, 4, 37), r.normal(2, 1, 37))]
    a = gr.anova(spark.createDataFrame(rows, "team int, v double"), ["team"], "v").collect()[0]
    by = [np.array([v for t, v in rows if t == k]) for k in range(4)]
    sizes, whole = np.array([len(x) for x in by]), np.mean([v for _, v in rows])
    msb = sum(len(x) * (x.mean() - whole) ** 2 for x in by) / 3
    msw = sum(((x - x.mean()) ** 2).sum() for x in by) / (37 - 4)
    k0 = (37 - (sizes ** 2).sum() / 37) / 3
    assert np.allclose([a.msb, a.msw, a.k0, a.icc], [msb, msw, k0, (msb - msw) / (msb + (k0 - 1) * msw)])


def test_shape_against_largest_remainders(spark):
    r = random.Random(26)
    groups = ["CB", "FB", "MID", "WIDE", "FWD"]
    minutes = {t: [r.choice([0, 400, 400, r.randint(1, 9000)]) for _ in groups] for t in range(60)}
    minutes = {t: ms for t, ms in minutes.items() if sum(ms)}
    rows = [(t, g, m) for t, ms in minutes.items() for g, m in zip(groups, ms)]
    got = {(x.team, x.grp): x.places for x in gr.shape(spark.createDataFrame(rows, "team long, grp string, minutes long"), "team", groups).collect()}
    for t, ms in minutes.items():
        want = [10 * m // sum(ms) for m in ms]
        for i in sorted(range(5), key=lambda i: (-(10 * ms[i] % sum(ms)), i))[:10 - sum(want)]:
            want[i] += 1
        assert [got[t, g] for g in groups] == want


def test_text(spark):
    rows = [("Zoë  Ærøskøbing-Nuñez", "zoe aeroskobing nunez"), (None, ""), ("ÐÞ", "dth"), (" \tŁódź!! 7 ", "lodz 7"), ("Ａｂｃ １２", "abc 12"), ("Cœur, Groß", "coeur gross"), ("Ǆ ﬀ", "dz ff")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert df.filter(tx.fold(F.col("raw")) != F.col("want")).count() == 0
    names = ["Goalkeeper", "Left Center Back", "Right Back", "Left Defensive Midfield", "Center Midfield", "Left Wing", "Right Attacking Midfield", "Left Midfield", "Center Forward", "Referee"]
    want = ["GK", "CB", "FB", "MID", "MID", "WIDE", "WIDE", "WIDE", "FWD", None]
    df = spark.createDataFrame(list(zip(names, want)), "raw string, want string")
    assert df.filter(~tx.position_group(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
    for name, group in tx.POSITION_GROUPS.items():
        assert df.limit(1).select(tx.mapped_position(F.lit(name))).first()[0] == group
    assert df.limit(1).select(tx.mapped_position(F.lit("Referee"))).first()[0] is None
    clubs = [(f"{w.upper()} Kräbbendorf {w}", "krabbendorf") for w in tx.CLUB_STOP_WORDS]
    assert spark.createDataFrame(clubs, "raw string, want string").filter(tx.fold_club(F.col("raw")) != F.col("want")).count() == 0
    edges = [1, 5, 30]
    bands = [(p, sum(p >= e for e in edges)) for p in (0, 1, 2, 4, 5, 29, 30, 31)]
    assert spark.createDataFrame(bands, "p long, b int").filter(nm.band(F.col("p"), edges) != F.col("b")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_best_two_are_the_true_ones(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(1, 14))).strip() or "a"
    near = lambda w: "".join(r.choice("xyz") if r.random() < 0.12 else c for c in w)
    right = [(100 + i, i % 3, word()) for i in range(40)] + [(300, 0, "same name here"), (301, 0, "same name here"), (302, 0, "")]
    left = [(i, i % 3, near(right[i][2]), word() if i % 4 else None) for i in range(40)] + [(90, 0, "same name here", None), (91, 7, "alone", ""), (92, 1, "", None)]
    a = spark.createDataFrame(left, "id int, block int, name string, nick string")
    b = spark.createDataFrame(right, "other int, block int, target string")
    got = {}
    for x in lk.best_two(a, b, ["block"], "id", "other", ["name", "nick"], "target", rows=5).collect():
        got.setdefault(x.id, {})[x.place] = (x.other, round(x.score, 9))
    hits = {(x.id, x.other) for x in lk.at_least(a, b, ["block"], "id", "other", ["name", "nick"], "target", 0.75, rows=5).collect()}
    for i, bl, n, k in left:
        s = sorted((-max(round(1 - edits(x, t) / max(len(x), len(t)), 9) for x in (n, k) if x), o) for o, br, t in right if br == bl and t and (n or k))
        assert got.get(i, {}) == {p + 1: (o, -v) for p, (v, o) in enumerate(s[:2])}
        assert {o for x, o in hits if x == i} == {o for v, o in s if -v >= 0.75}


def test_edit_distances_of_any_length():
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(r.randint(1, n)))
    names, others = ([word(12) for _ in range(30)] + [word(130) for _ in range(6)] + last for last in (["", "x" * 64, "ab" * 33], ["", "ab" * 32, "é"]))
    seen = 0
    for at, found in ed.distances(names, others):
        for i, row in zip(at, found):
            assert row.tolist() == [edits(names[i], o) for o in others]
            seen += 1
    assert seen == len(names)


def test_edits_of_all_pairs_of_a_block(spark):
    """Whatever the texts end with; null texts, keys and blocks, repeated rows, and tiles of two rows."""
    r = random.Random(9)
    word = lambda: None if r.random() < 0.1 else "".join(r.choice("abé1") for _ in range(r.randint(0, 9)))
    left, right = ([(None if i == 3 else i // 2, r.choice([0, 1, 2, None, last]), word()) for i in range(n)] for n, last in ((40, 7), (25, 8)))
    left, right = left + left[:4], right + right[:3]
    dfs = [spark.createDataFrame(rows, "id long, block int, text string") for rows in (left, right)]
    want = collections.Counter((a[0], b[0], None if None in (a[2], b[2]) else edits(a[2], b[2])) for a in left for b in right if a[1] is not None and a[1] == b[1])
    for rows in (2, None):
        found = lk.block_edits(dfs[0], dfs[1].withColumnRenamed("id", "other"), ["block"], "id", "other", "text", "text", rows)
        assert collections.Counter(tuple(x) for x in found.collect()) == want
    assert lk.block_edits(dfs[0].limit(0), dfs[1].withColumnRenamed("id", "other"), ["block"], "id", "other", "text", "text").count() == 0


def test_edit_option_has_every_pair_of_a_nation(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "Customer 12", 4), (2, "Customer 47", 4), (3, None, 4), (4, "x12", 5)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(8, "Supplier 12", 4), (9, "Customer 12", 4), (10, "y", 6)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = {tuple(x) for x in entry.queries()["X3_levenshtein_option"](spark, str(tmp_path)).collect()}
    assert found == {(1, 8, 5), (1, 9, 0), (2, 8, 7), (2, 9, 2), (3, 8, None), (3, 9, None)}


def test_best_two_meet_each_text_once(spark):
    """Copies of names and targets, ids and others that repeat or are null: no pair of copies is met."""
    left = spark.range(30_000).selectExpr("if(id % 3 = 0, null, id div 2) as id", "id % 2 as block", "concat('name ', id % 5) as name", "cast(null as string) as nick")
    right = spark.range(30_000).selectExpr("if(id = 4, null, 50000 - id div 2) as other", "if(id % 7 = 0, null, id % 2) as block", "concat('name ', id % 4) as target")
    best = lk.best_two(left, right, ["block"], "id", "other", ["name", "nick"], "target")
    got = {(x.id, x.place): (x.other, round(x.score, 9)) for x in best.filter("id < 200 or id is null").collect()}
    known = [(k, None if k == 4 else 50000 - k // 2, k % 2, k % 4) for k in range(30_000) if k % 7]
    for i in range(200):
        asked = {(k % 2, k % 5) for k in (2 * i, 2 * i + 1) if k % 3}
        pairs = {}
        for block, name in asked:
            for _, o, b, t in known:
                if b == block:
                    pairs[block, o] = max(pairs.get((block, o), 0), 1.0 if t == name else round(1 - 1 / 6, 9))
        want = sorted(((-v, o is not None, o or 0) for (_, o), v in pairs.items()))[:2]
        assert [got[i, p] for p in (1, 2)] == [(o if known_ else None, -v) for v, known_, o in want]


def test_assignment_against_permutations(spark):
    r = random.Random(27)
    rows = [(f"b{k}", i, j, round(r.random(), 3)) for k in range(4) for i in range(k + 1) for j in range(4)]
    df = spark.createDataFrame(rows, "blk string, r int, c int, score double")
    score = {x[:3]: x[3] for x in rows}
    got = {}
    for x in lk.assign(df, ["blk"], "r", "c").collect():
        got.setdefault(x.blk, {})[x.r] = x.c
    for k in range(4):
        own = got[f"b{k}"]
        best = max(sum(score[f"b{k}", i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(4), k + 1))
        assert len(set(own.values())) == len(own) == k + 1 and np.isclose(sum(score[f"b{k}", i, c] for i, c in own.items()), best)


def test_tiles_do_not_change_results(spark):
    r = np.random.default_rng(0)
    rows = [(i, "hot" if i % 3 else "cold", r.normal(size=4).tolist(), r.normal(size=4).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, grp string, a array<double>, b array<double>")
    near = {(x.id, x.place): x.other for x in se.nearest(df, df, ["grp"], "id", "a", "a", 3, tile_rows=7).collect()}
    for i, g, a, _ in rows:
        d = sorted((np.linalg.norm(np.subtract(a, o[2])), o[0]) for o in rows if o[1] == g and o[0] != i)
        assert [near[i, p] for p in (1, 2, 3)] == [x for _, x in d[:3]]
    own = {x.id: (x.rank, x.k) for x in se.own_ranks(df, ["grp"], "id", "a", "b", tile_rows=7).collect()}
    for i, g, a, b in rows:
        mates = [o for o in rows if o[1] == g]
        mine = np.linalg.norm(np.subtract(a, b))
        assert own[i] == (sum(np.linalg.norm(np.subtract(a, o[3])) <= mine + 1e-12 for o in mates), len(mates))


def test_shrinkage_against_direct_formula(spark):
    r = np.random.default_rng(1)
    n = 60
    league, minutes = r.integers(0, 3, n), r.uniform(450, 2000, n)
    psi = 40 / minutes
    y = 0.2 * league + 0.1 * np.log(minutes / 1000) + r.normal(size=n) * 0.3
    df = spark.createDataFrame([(i, "g", int(league[i]), float(minutes[i]), float(y[i]), float(psi[i])) for i in range(n)],
                               "id int, grp string, league int, minutes double, y double, psi double")
    x = md.league_inputs("league", [0, 1, 2], "minutes")
    fits = md.shrinkage_fits(df, ["grp"], x, F.col("y"), F.col("psi"))
    got = {v.id: v.theta for v in md.shrunk(df, fits, ["grp"], x, F.col("y"), F.col("psi")).collect()}
    X = np.column_stack([*(league == k for k in range(3)), np.log(minutes / 1000)]).astype(float)
    hat = X @ np.linalg.pinv(X.T @ X) @ X.T
    res = y - hat @ y
    tau2 = max(0.0, (res @ res - ((1 - np.diag(hat)) * psi).sum()) / (n - 4))
    w = 1 / (tau2 + psi)
    beta = np.linalg.solve(X.T @ (X * w[:, None]), X.T @ (w * y))
    xb = X @ beta
    want = xb + tau2 / (tau2 + psi) * (y - xb)
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-9)


@pytest.mark.parametrize("seed", [0, 1])
def test_plans_against_enumeration(spark, seed):
    r = random.Random(seed)
    shape = {"A": 2, "B": 1, "C": 1}
    own = [("k", i, r.choice("ABC"), round(r.random(), 3), 0.1) for i in range(5)]
    cand = [("k", 100 + i, r.choice("ABC"), float(r.randint(1, 9)), round(r.random() * 1.5, 3), 0.2, float(r.choice([-1, 1]))) for i in range(9)]
    o = spark.createDataFrame(own, "club string, id long, grp string, value double, sd double")
    c = spark.createDataFrame(cand, "club string, id long, grp string, price double, value double, sd double, score double")
    s = spark.createDataFrame([("k", g, n) for g, n in shape.items()], "club string, grp string, places int")
    budgets, caps = [6.0, 14.0], [1, 2, 3]
    got = {(p.fit, p.budget, p.cap): round(p.total, 9) for p in up.club_plans(o, c, s, ["A", "B", "C"], budgets, caps).collect()}
    want = {}
    pool = [(i, g, v, 0.0, None) for _, i, g, v, _ in own] + [(i, g, v, p, sc) for _, i, g, p, v, _, sc in cand]
    for ten in itertools.combinations(pool, 4):
        if any(sum(x[1] == g for x in ten) != n for g, n in shape.items()):
            continue
        bought = [x for x in ten if x[4] is not None]
        cost, total = sum(x[3] for x in bought), sum(x[2] for x in ten)
        for fit, b, k in itertools.product([False, True], budgets, caps):
            if cost <= b and len(bought) <= k and not (fit and any(x[4] <= 0 for x in bought)):
                want[fit, b, k] = max(want.get((fit, b, k), -1), round(total, 9))
    assert got == want
