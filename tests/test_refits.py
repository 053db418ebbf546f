"""Refits per replicate, nested elastic nets and dominance fronts against direct computation on small data."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from rosterlens.operators import elastic as el
from rosterlens.operators import graph as gh
from rosterlens.operators import refits as rf
from rosterlens.operators import resample as rs
from rosterlens.plans import upgrade as up

REPLICATES = 6


def ranks(x, weights=None):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def direct_fit(y, x, psi):
    """tau² by moments from the plain fit's residuals and leverages, then the weighted fit."""
    inverse = np.linalg.pinv(x.T @ x)
    residual = y - x @ inverse @ x.T @ y
    leverage = np.einsum("ij,jk,ik->i", x, inverse, x)
    tau2 = max(0.0, ((residual ** 2).sum() - ((1 - leverage) * psi).sum()) / (len(y) - x.shape[1]))
    w = 1 / (tau2 + psi)
    return tau2, np.linalg.pinv((x * w[:, None]).T @ x) @ (x * w[:, None]).T @ y


def test_replicates_against_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(160):
        league, team, grp = i % 2, (i % 2) * 10 + rng.integers(0, 4), "ab"[rng.integers(0, 2)]
        rows.append((i, int(league), int(team), grp, float(rng.integers(90, 900)), float(rng.normal(1, 0.4)), float(rng.integers(90, 900)), float(rng.normal(1, 0.4)), float(rng.gamma(2.0, 0.002)), int(rng.integers(2, 9))))
    rows += [(1000 + i, *rows[0][1:]) for i in range(3)]  # equal rows
    names = "player long, league int, team int, grp string, minutes double, y double, m2 double, y2 double, s double, n int"
    df = spark.createDataFrame(rows, names)
    mult = rs.draws(df, "league", "team", REPLICATES)
    phi = rs.bootstrap_dispersion(df, mult, "league", "team", "grp", "s")
    x = [(F.col("league") == 0).cast("double"), (F.col("league") == 1).cast("double"), F.log(F.col("minutes") / 1000)]
    fits = rf.bootstrap_fits(df, phi, mult, "league", "team", "grp", x, F.col("y"), "minutes", {"flat": [0, 1], "slope": [0, 1, 2]}, REPLICATES, per_part=16)
    levels = spark.createDataFrame([(r, g, w, 0.5 + 0.1 * r + 0.2 * g + 0.05 * w) for r in range(REPLICATES) for g in (0, 1) for w in (1, 2)], "replicate int, league int, win int, level double")
    boot = rf.MetricBootstrap(df, fits, levels, mult, "league", "team", "grp", x, F.col("y"), "minutes", F.col("y2"), "m2", REPLICATES, "slope", "flat", per_part=16)
    tags = F.array(F.lit("all"), F.concat(F.lit("league "), F.col("league").cast("string")))
    errors = {(r.replicate, r.subset, r.predictor): r for r in boot.errors(tags).collect()}
    rho = {(r.replicate, r.subset, r.predictor): r.value for r in boot.rank_correlations(tags).collect()}
    times = {(r.replicate, r.league, r.team): r.times for r in mult.collect()}
    got = {(r.replicate, r.grp, r.variant): r for r in fits.collect()}
    a = np.array([r[4:9] for r in rows])
    for rep in range(REPLICATES):
        drawn = np.repeat(np.arange(len(rows)), [times.get((rep, r[1], r[2]), 0) for r in rows])
        theta, first = {v: np.full(len(rows), np.nan) for v in ("flat", "slope")}, np.full(len(rows), np.nan)
        psi2 = np.full(len(rows), np.nan)
        for g in "ab":
            own = np.array([i for i in drawn if rows[i][3] == g])
            f = sum(rows[i][8] for i in own) / sum(rows[i][9] - 1 for i in own)
            psi = 8100 * f / a[:, 0]
            every = np.array([[r[1] == 0, r[1] == 1, np.log(r[4] / 1000)] for r in rows], float)
            for v, idx in (("flat", [0, 1]), ("slope", [0, 1, 2])):
                tau2, b = direct_fit(a[own, 1], every[own][:, idx], psi[own])
                assert np.isclose(got[rep, g, v].tau2, tau2, atol=1e-9) and got[rep, g, v].m == len(own)
                xb = every[:, idx] @ b
                mine = np.array([r[3] == g for r in rows])
                theta[v][mine] = (xb + tau2 / (tau2 + psi) * (a[:, 1] - xb))[mine]
                if v == "slope":
                    first[mine] = xb[mine]
                psi2[mine] = (8100 * f / a[:, 2])[mine]
        for subset in ("all", "league 0", "league 1"):
            pick = np.array([i for i in drawn if subset == "all" or f"league {rows[i][1]}" == subset])
            c = np.array([[0.5 + 0.1 * rep + 0.2 * rows[i][1] + 0.05 * w for w in (1, 2)] for i in pick])
            target = a[pick, 3] - c[:, 1]
            preds = {"P0": np.zeros(len(pick)), "P1": first[pick] - c[:, 0], "P2": a[pick, 1] - c[:, 0], "P3": theta["slope"][pick] - c[:, 0], "P4": theta["flat"][pick] - c[:, 0]}
            base = ((target - preds["P2"]) ** 2).sum()
            for k, p in preds.items():
                e, sse = errors[rep, subset, k], ((target - p) ** 2).sum()
                want = (len(pick), sse, sse - psi2[pick].sum(), (sse - psi2[pick].sum()) / (base - psi2[pick].sum()), sse / base)
                assert np.allclose((e.pairs, e.sse, e.tse, e.tse_ratio, e.raw_ratio), want, rtol=1e-7)
                if k == "P0":
                    assert e.slope is None
                else:
                    assert np.isclose(e.slope, np.polyfit(p, target, 1)[0], rtol=1e-6)
                    assert np.isclose(rho[rep, subset, k], np.corrcoef(ranks(np.round(p, 12)), ranks(np.round(target, 12)))[0, 1], atol=1e-6)


def test_refitted_correlation_against_repeated_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, int(rng.integers(0, 5)) + 10 * (i % 3), *rng.normal(5, 1, 4).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, s int, c int, x double, z double, a double, b double")
    mult = rs.draws(df, "s", "c", REPLICATES)
    times = {(r.replicate, r.s, r.c): r.times for r in mult.collect()}
    got = {r.replicate: r.value for r in rf.refitted_correlation(df, mult, ["s", "c"], [F.col("x"), F.col("z")], F.col("a"), F.col("b"), ["id"]).collect()}
    m = np.array([r[3:] for r in rows])
    for rep in range(REPLICATES):
        d = m[np.repeat(np.arange(len(rows)), [times.get((rep, r[1], r[2]), 0) for r in rows])]
        x = np.column_stack([np.ones(len(d)), d[:, :2]])
        e = [d[:, k] - x @ np.linalg.lstsq(x, d[:, k], rcond=None)[0] for k in (2, 3)]
        assert np.isclose(got[rep], np.corrcoef(ranks(np.round(e[0], 9)), ranks(np.round(e[1], 9)))[0, 1], atol=1e-6)


def slow_net(x, y, alpha, mix):
    """The penalised fit by small proximal steps."""
    w, n = np.zeros(x.shape[1]), len(y)
    rate = 1 / (np.linalg.norm(x, 2) ** 2 / n + alpha * (1 - mix))
    for _ in range(20_000):
        step = w - rate * (x.T @ (x @ w - y) / n + alpha * (1 - mix) * w)
        w = np.sign(step) * np.maximum(np.abs(step) - rate * alpha * mix, 0)
    return w


def test_path_without_penalty_is_least_squares():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 50, 6))
    y = rng.normal(size=(3, 50))
    gram, xy = np.einsum("kni,knj->kij", x, x) / 50, np.einsum("kni,kn->ki", x, y) / 50
    w, ended = el.coordinate_path(gram, xy, np.zeros((3, 1)), np.ones(3))
    assert ended.all() and all(np.allclose(w[k, 0], np.linalg.lstsq(x[k], y[k], rcond=None)[0], atol=1e-6) for k in range(3))


def test_nested_fits_against_rows(spark):
    rng = np.random.default_rng(6)
    n, tiers = 150, {"A": ["x0", "x1"], "B": ["x0", "x1", "x2", "x3"]}
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [0, 100, 5, -2]
    y = 2 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=n)
    df = spark.createDataFrame([(i, f"c{i % 11}", *map(float, x[i]), float(y[i])) for i in range(n)] + [(n, "c1", None, 1.0, 1.0, 1.0, 1.0)], "id long, cluster string, x0 double, x1 double, x2 double, x3 double, y double")
    rows, fits = el.nested_fits(df, tiers, "y", "cluster", folds=3, strengths=20)
    folds = {r.cluster: r for r in el.dealt(df, "cluster", 3).collect()}
    pred = {(r.id, r.tier): r.prediction for r in el.predicted(rows, fits, tiers).collect()}
    assert fits.count() == 8
    for f in fits.collect():
        cols = [int(c[1]) for c in tiers[f.tier]]
        outer = np.array([folds[f"c{i % 11}"].outer for i in range(n)])
        inner = np.array([folds[f"c{i % 11}"][f"inner_{f.outer}"] if outer[i] != f.outer else -1 for i in range(n)])
        train = outer != f.outer
        mean, sd = x[train][:, cols].mean(0), x[train][:, cols].std(0)
        z = (x[:, cols] - mean) / sd
        w = slow_net(z[train], y[train] - y[train].mean(), f.alpha, f.mix)
        assert np.allclose(np.array(f.coefficients) * sd, w, atol=1e-5) and f.ended and f.rows == train.sum()
        mse = []
        for i in range(3):
            a, b = train & (inner != i), train & (inner == i)
            own = slow_net(z[a] - z[a].mean(0), y[a] - y[a].mean(), f.alpha, f.mix)
            mse.append(((y[b] - y[a].mean() - (z[b] - z[a].mean(0)) @ own) ** 2).mean())
        assert np.isclose(f.error, np.mean(mse), rtol=1e-5)
        for i in np.flatnonzero(~train):
            assert np.isclose(pred[i, f.tier], f.intercept + x[i, cols] @ f.coefficients, atol=1e-9)
    assert pred[n, "A"] is None
    kept = el.kept_coefficients(fits, tiers, 3).collect()
    assert {r.input for r in kept if r.tier == "A"} <= {"x0", "x1"} and all(r.coefficient != 0 for r in kept)


def test_fronts_in_blocks_against_enumeration(spark):
    r = random.Random(3)
    rows = [("k", i, float(r.randint(1, 12)), round(r.random() + r.randint(0, 2), 3), 0.1 * (i % 3)) for i in range(23)]
    df = spark.createDataFrame(rows, "club string, id long, price double, value double, sd double")
    for block in (3, 256):
        got = {}
        for x in up.choices(df, ["club"], 3, 20.0, block).collect():
            assert np.isclose(x.cost, sum(rows[i][2] for i in x.in_ids)) and np.isclose(x.total, sum(rows[i][3] for i in x.in_ids)) and x.in_ids == sorted(set(x.in_ids))
            got.setdefault(x.a, []).append((x.cost, x.total))
        for a in (1, 2, 3):
            every = [(sum(s[2] for s in c), round(sum(s[3] for s in c), 9)) for c in itertools.combinations(rows, a)]
            for most in range(21):
                want = max((t for c, t in every if c <= most), default=None)
                assert max((t for c, t in got[a] if c <= most), default=None) == want


def test_broken_plans_are_found(spark):
    own = spark.createDataFrame([("k", 1, "A", 5.0, 0.1), ("k", 2, "A", 4.0, 0.1), ("k", 3, "B", 3.0, 0.1)], "club string, id long, grp string, value double, sd double")
    cand = spark.createDataFrame([("k", 10, "A", 7.0, 9.0, 0.1, 1.0), ("k", 11, "B", 2.0, 9.0, 0.1, -1.0)], "club string, id long, grp string, price double, value double, sd double, score double")
    shape = spark.createDataFrame([("k", "A", 2), ("k", "B", 1)], "club string, grp string, places int")
    plans = [("right", False, 9.0, 1, 7.0, [10], [2]), ("dear", False, 6.0, 1, 7.0, [10], [2]), ("many", False, 9.0, 1, 9.0, [10, 11], [2, 3]), ("group", False, 9.0, 1, 7.0, [10], [3]),
             ("unfit", True, 9.0, 1, 2.0, [11], [3]), ("stranger", False, 9.0, 1, 1.0, [99], [2]), ("none", False, 9.0, 0, 0.0, [], []), ("own", False, 9.0, 1, 0.0, [1], [2]), ("gap", False, 9.0, 1, 0.0, [], [2])]
    for name, fit, budget, cap, cost, ids, out in plans:
        p = spark.createDataFrame([("k", fit, budget, cap, cost, ids, out)], "club string, fit boolean, budget double, cap int, cost double, in_ids array<long>, out_ids array<long>")
        assert up.broken_plans(p, own, cand, shape).count() == (name not in ("right", "none")), name


def test_balanced_negatives(spark):
    r = random.Random(1)
    nodes = [("dense", i) for i in range(6)] + [("wide", 100 + i) for i in range(40)] + [("none", 200), ("none", 201)]
    every = list(itertools.combinations(range(6), 2))
    links = [("dense", *p) for p in every[:12]] + [("wide", 100 + a, 100 + b) for a, b in r.sample(list(itertools.combinations(range(40), 2)), 200)]
    n = spark.createDataFrame(nodes, "team string, player long")
    l = spark.createDataFrame(links, "team string, player_a long, player_b long")
    wanted = spark.createDataFrame([("dense", 5), ("wide", 90), ("none", 0)], "team string, n long")
    got = [tuple(x) for x in gh.balanced_negatives(n, l, wanted, ["team"], "player").collect()]
    assert len(got) == len(set(got)) and not set(got) & set(links) and all(a < b and (t, a) in nodes and (t, b) in nodes for t, a, b in got)
    assert sum(t == "dense" for t, *_ in got) == 3 and sum(t == "wide" for t, *_ in got) == 90


def test_learned_link_scores_and_features(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 3))
    pairs = [(a, b, int(v[a, 0] * v[b, 0] - v[a, 1] * v[b, 1] > 0)) for a, b in itertools.combinations(range(60), 2)]
    df = spark.createDataFrame(pairs, "player_a long, player_b long, y int")
    vectors = spark.createDataFrame([(i, [1.0, *map(float, x)]) for i, x in enumerate(v)], "player long, vec array<double>")
    odd = (F.col("player_a") + F.col("player_b")) % 2 == 1
    scored = gh.learned_link_scores(df.filter(odd), df.filter(~odd), vectors, "player", "vec")
    assert gh.auc(scored, [], F.col("y") == 1, "score").first().auc > 0.95
    rows = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 3.0, 3.0), (2, "z", 1.0, None), (3, None, 1.0, 5.0)], "player long, g string, m double, x double")
    got = {r.player: tuple(r)[1:] for r in gh.node_features(rows, "player", "g", ["a", "b"], {"x": F.col("x")}, F.col("m")).collect()}
    assert got == {1: (2.0, 0, 1, 0), 2: (0.0, 0, 0, 1), 3: (5.0, 0, 0, 1)}


def test_fronts_of_many_sets_at_once(spark):
    r = random.Random(8)
    rows = [(f"k{i % 5}", i, float(r.randint(1, 9)), float(r.randint(0, 9)), 0.1) for i in range(70)]
    df = spark.createDataFrame(rows, "club string, id long, price double, value double, sd double")
    seg, cost, total, var, ids = (np.array(x) for x in zip(*((int(c[1]), p, v, s * s, i) for c, i, p, v, s in rows)))
    held = up._Fronts(2, 15.0).singles(seg, cost, total, var, ids)
    direct = sorted((f"k{s}", int(a), c, t, [int(i) for i in x if i != up.NONE]) for s, a, c, t, x in zip(*held[:4], held[5]) if a)
    for block in (2, 256):
        got = sorted((x.club, x.a, x.cost, x.total, x.in_ids) for x in up.choices(df, ["club"], 2, 15.0, block).collect())
        assert got == direct
    for club in {c for c, *_ in rows}:
        for a in (1, 2):
            every = [(sum(x[2] for x in c), -sum(x[3] for x in c), sorted(x[1] for x in c)) for c in itertools.combinations([x for x in rows if x[0] == club], a)]
            front, best = [], -1.0
            for c, t, x in sorted(every):
                if c <= 15.0 and -t > best:
                    front.append((club, a, c, -t, x))
                    best = -t
            assert [x for x in direct if x[:2] == (club, a)] == front


def test_random_squads_take_the_first_of_all_rows(spark):
    import hashlib

    r = random.Random(4)
    rows = [(i, "A" if i % 3 else "B" if i % 2 else "C", float(r.randint(1, 9)), float(i)) for i in range(150)] + [(500, "D", 1.0, 1.0), (7, "A", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "id long, grp string, price double, value double").repartition(5)
    quotas = {"A": 3, "B": 1, "C": 2, "D": 2}
    got = {x.draw: (x.cost, x.value, x.players) for x in up.random_squads(df.withColumn("price", F.col("id") * 0.5), quotas, F.lit(1e9), 6).collect()}
    for d in range(6):
        mark = lambda i: (int(hashlib.md5(f"0-{d}-{i}".encode()).hexdigest()[:8], 16), i)  # noqa: E731, B023
        picked = [x for g, q in quotas.items() for x in sorted((x for x in rows if x[1] == g), key=lambda x: mark(x[0]))[:q]]
        assert got[d][2] == len(picked) and np.isclose(got[d][0], sum(x[0] * 0.5 for x in picked))
    plan = up.random_squads(df, quotas, F.lit(1e9), 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bound" in plan


def test_predictors_of_drawn_replicates():
    """P1 to P4 and the noise of a part's rows, a replicate without draws left out, one without a fit unknown."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    n, size = 150, 9
    x, y, m, y2, m2 = r.normal(size=(n, 3)), r.normal(size=n), r.uniform(90, 900, n), r.normal(size=n), r.uniform(90, 900, n)
    left = pa.table({"_x": pa.array(x.tolist()), "_y": y, "_m": m, "_y2": y2, "_m2": m2})
    b, phi, tau2 = r.normal(size=(size, 2, 3)), r.uniform(1, 2, size) / 100, r.uniform(0, 1, (size, 2))
    fits = [{"replicate": k, "variant": v, "phi": phi[k], "tau2": tau2[k, i], "mean": 0.3, "coefficients": b[k, i].tolist()} for k in range(size) if k != 4 for i, v in enumerate(("slope", "flat"))]
    side = {"_times": [{"replicate": k, "times": k} for k in range(1, size)], "_levels": [{"replicate": k, "c1": 0.1 * k, "c2": -0.2 * k} for k in range(size)], "_fits": fits}
    found = list(rf._predicted(left, pa.table({k: pa.array([v]) for k, v in side.items()}), size, ("slope", "flat")))
    assert len(found) > 1 and all(f[0].tolist() == f[1].tolist() == list(range(1, size)) for f in found)
    preds = [np.concatenate([f[3][i] for f in found], axis=1) for i in range(4)]
    target, noise = np.concatenate([f[2] for f in found], axis=1), sum(f[4] for f in found)
    for i, k in enumerate(range(1, size)):
        psi, line = 8100 * phi[k] / m, [0.3 + x @ b[k, j] for j in range(2)]
        theta = [xb + tau2[k, j] / (tau2[k, j] + psi) * (y - xb) - 0.1 * k for j, xb in enumerate(line)]
        want = [line[0] - 0.1 * k, y - 0.1 * k, *theta]
        assert np.allclose(target[i], y2 + 0.2 * k)
        for j in range(4):
            assert np.isnan(preds[j][i]).all() if k == 4 and j != 1 else np.allclose(preds[j][i], want[j])
        assert np.isnan(noise[i]) if k == 4 else np.isclose(noise[i], (8100 * phi[k] / m2).sum())
