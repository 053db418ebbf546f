"""Nested elastic nets from cross products alone.

    1 / (2 n) ||y - b - X w||^2 + alpha * mix * ||w||_1 + alpha * (1 - mix) / 2 * ||w||^2

Coordinate descent needs only sums of cross products, and so does the squared error of rows held out. One
pass over the rows adds those up per combination of folds; every fit of every tier, mix, strength and fold
is then a small problem on sums, whose size does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup
from ..session import checkpointed

# The mixes and strengths tried, and the strongest strength over the weakest.
MIXES = [0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
STRENGTHS = 100
SPAN = 1e-3


def dealt(clusters: DataFrame, cluster: str, folds: int, seed: int = 0) -> DataFrame:
    """Each cluster's outer fold, and for every outer fold left out its inner fold among the others: all by hash order."""
    from .resample import deal

    outer = checkpointed(deal(clusters.select(cluster).distinct(), [], [cluster], folds, seed).withColumnRenamed("fold", "outer"))
    out = outer
    for k in range(folds + 1):  # the last one deals all clusters, for the fit of all rows
        kept = outer.filter(F.col("outer") != k).select(cluster)
        inner = deal(kept, [], [cluster], folds, seed + 1 + k).withColumnRenamed("fold", f"inner_{k}")
        out = out.join(inner, cluster, "left")
    return checkpointed(out)


def fold_sums(rows: DataFrame, inputs: Sequence[str], target: str, folds: int) -> DataFrame:
    """Cross products of (1, inputs, target) per combination of outer and inner folds: at most folds * folds^folds rows, in truth at most one a cluster."""
    keys = ["outer", *[f"inner_{k}" for k in range(folds + 1)]]
    named = rows.select(*[F.coalesce(F.col(k), F.lit(-1)).cast("int").alias(k) for k in keys], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*inputs, target])])
    width = len(inputs) + 2
    most = 256

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], names=[*keys, "sums"])

        for batch in batches:
            fold = np.stack([batch.column(i).to_numpy() for i in range(len(keys))], axis=1)
            x = np.stack([np.ones(batch.num_rows), *(batch.column(len(keys) + i).to_numpy(zero_copy_only=False) for i in range(width - 1))], axis=1)
            known = ~np.isnan(x).any(1)
            fold, x = fold[known], x[known]
            kinds, of = np.unique(fold, axis=0, return_inverse=True)
            for i, kind in enumerate(kinds.tolist()):
                part = x[of.ravel() == i]
                held[tuple(kind)] = held.get(tuple(kind), 0) + part.T @ part
            if len(held) > most:
                yield out()
                held.clear()
        if held:
            yield out()

    schema = ", ".join(f"{k} int" for k in keys) + ", sums array<double>"
    partial = named.mapInArrow(sums, schema)
    # several partial sums of a key are added cell by cell
    cells = partial.select(*keys, F.posexplode("sums").alias("cell", "v")).groupBy(*keys, "cell").agg(F.sum("v").alias("v"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "v"))), lambda s: s["v"]).alias("sums"))


def _centred(s: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """n, means and centred cross products per row of the scaled inputs and the target, from raw sums (..., p + 2, p + 2)."""
    n = s[..., 0, 0]
    mean = s[..., 0, 1:] / np.maximum(n, 1)[..., None]
    cross = s[..., 1:, 1:] / np.maximum(n, 1)[..., None, None] - mean[..., :, None] * mean[..., None, :]
    return n, mean, cross / (scale[..., :, None] * scale[..., None, :])


def coordinate_path(gram: np.ndarray, xy: np.ndarray, alphas: np.ndarray, mixes: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (problem, strength, input) of many problems along their strengths, each started from the one before.

    Problems are per-row cross products gram (problem, p, p) and xy (problem, p). A round is two sweeps over the
    coordinates and then the exact solution for the signs these have settled on; it stands when it keeps those signs
    and no input left out would enter. Else the coefficients move towards it up to the first change of sign.
    Also whether each problem ended within the rounds.
    """
    problems, p = xy.shape
    w, out = np.zeros((problems, p)), np.zeros((problems, alphas.shape[1], p))
    ended = np.ones((problems, alphas.shape[1]), bool)
    diagonal = np.einsum("kjj->kj", gram)
    eye = np.arange(p)
    for a in range(alphas.shape[1]):
        live = np.arange(problems)
        for _ in range(rounds):
            g, thin, flat, wl, d = gram[live], (alphas[:, a] * mixes)[live], (alphas[:, a] * (1 - mixes))[live], w[live], diagonal[live]
            residual = xy[live] - np.einsum("kij,kj->ki", g, wl)
            for j in [*range(p)] * 2:
                r = residual[:, j] + d[:, j] * wl[:, j]
                new = np.where(d[:, j] > 1e-12, np.sign(r) * np.maximum(np.abs(r) - thin, 0) / np.maximum(d[:, j] + flat, 1e-12), 0.0)
                step = new - wl[:, j]
                if step.any():
                    residual -= g[:, :, j] * step[:, None]
                    wl[:, j] = new
            inside, sign = wl != 0, np.sign(wl)
            m = np.where(inside[:, :, None] & inside[:, None, :], g, 0.0)
            m[:, eye, eye] += np.where(inside, flat[:, None] + 1e-10 * d, 1.0)
            exact = np.linalg.solve(m, np.where(inside, xy[live] - thin[:, None] * sign, 0.0)[:, :, None])[:, :, 0]
            kept = ((exact * sign > 0) | ~inside).all(1)
            left_out = np.abs(xy[live] - np.einsum("kij,kj->ki", g, exact)) <= thin[:, None] * (1 + 1e-6) + 1e-9
            done = kept & (left_out | inside | (d <= 1e-12)).all(1)
            share = np.where(inside & (exact * sign <= 0), wl / np.where(wl == exact, 1.0, wl - exact), 1.0)
            t = np.minimum(share.min(1), 1.0)[:, None]
            moved = np.where(kept[:, None], exact, np.where(share <= t, np.where(t < 1, 0.0, exact), wl + t * (exact - wl)))
            w[live] = moved
            live = live[~done]
            if not len(live):
                break
        ended[live, a] = False
        out[:, a] = w
    return out, ended


def _tier(sums: np.ndarray, keys: np.ndarray, folds: int, mixes: np.ndarray, strengths: int) -> list[tuple]:
    """The chosen fit of each outer fold left out (and of all rows, as fold `folds`): all mixes, inner folds and outer folds side by side along their strengths."""
    p = sums.shape[1] - 2
    cases, grams, xys, alphas, mix = [], [], [], [], []
    for k in range(folds + 1):
        train = keys[:, 0] != k
        if not train.any() or sums[train, 0, 0].sum() < 2:
            continue
        whole = sums[train].sum(0)
        n, _, cross = _centred(whole, np.ones(p + 1))
        sd = np.sqrt(np.maximum(np.diagonal(cross)[:p], 0))
        scale = np.concatenate([np.where(sd > 1e-9 * np.maximum(np.abs(whole[0, 1:-1] / n), 1e-3), sd, 1.0), [1.0]])
        inner = np.stack([sums[train & (keys[:, 1 + k] == i)].sum(0) for i in range(folds)])
        _, mean, cross = _centred(whole, scale)
        top = max(np.abs(cross[:p, p]).max(), 1e-12)
        grid = np.stack([np.geomspace(top / m, top / m * SPAN, strengths) for m in mixes])
        n_i, mean_i, cross_i = _centred(whole - inner, scale)
        used = np.flatnonzero((inner[:, 0, 0] > 0) & (n_i > 1))
        both = np.concatenate([cross_i[used], cross[None]])  # the inner fits, then that of all training rows
        cases.append((k, n, scale, mean, inner, mean_i, used, grid, len(both)))
        grams.append(np.tile(both[:, :p, :p], (len(mixes), 1, 1)))
        xys.append(np.tile(both[:, :p, p], (len(mixes), 1)))
        alphas.append(np.repeat(grid, len(both), axis=0))
        mix.append(np.repeat(mixes, len(both)))
    if not cases:
        return []
    paths, ends = coordinate_path(*(np.concatenate(x) for x in (grams, xys, alphas, mix)))
    out, at = [], 0
    for k, n, scale, mean, inner, mean_i, used, grid, m in cases:
        path, ended = (x[at:at + len(mixes) * m].reshape(len(mixes), m, strengths, *x.shape[2:]) for x in (paths, ends))
        at += len(mixes) * m
        errors = np.zeros((len(mixes), strengths))
        for f, i in enumerate(used):
            # squared error of the held-out rows about the inner fit, from their sums moved to its means
            h, c = inner[i] / inner[i][0, 0], mean_i[i]
            about = (h[1:, 1:] - c[:, None] * h[None, 0, 1:] - h[1:, 0][:, None] * c[None, :] + c[:, None] * c[None, :]) / (scale[:, None] * scale[None, :])
            w = path[:, f]
            errors += about[p, p] - 2 * w @ about[:p, p] + np.einsum("maj,maj->ma", w @ about[:p, :p], w)
        best = np.unravel_index(int(np.argmin(errors)), errors.shape) if len(used) else (0, 0)
        w = path[best[0], -1, best[1]] / scale[:p]
        out.append((k, float(mixes[best[0]]), float(grid[best]), int(n), int(np.count_nonzero(w)), bool(ended[best[0]].all()), float(errors[best] / max(len(used), 1)),
                    float(mean[p] - mean[:p] @ w), w.tolist()))
    return out


FITS = "tier string, outer int, mix double, alpha double, rows long, nonzero int, ended boolean, error double, intercept double, coefficients array<double>"


def nested_fits(rows: DataFrame, tiers: Mapping[str, Sequence[str]], target: str, cluster: str, folds: int = 5, mixes: Sequence[float] = tuple(MIXES),
                strengths: int = STRENGTHS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows with their outer fold, and per tier and outer fold left out the chosen fit; `outer` = folds is the fit of all rows.

    Whole clusters are dealt to folds. `ended` is false where a fit of the chosen mix stopped at its rounds. Inputs are rescaled on the training rows. Mix and strength have the least mean
    squared error over inner folds; ties go to the earlier mix, then the stronger strength. Coefficients are those
    of the inputs as they are. Rows that lack an input or the target teach nothing. A tier is one small task.
    """
    inputs = list(dict.fromkeys(c for names in tiers.values() for c in names))
    rows = checkpointed(rows)  # read for the deal, the sums and the predictions
    placed = lookup(rows, dealt(rows, cluster, folds, seed), [cluster], "inner")
    sums = fold_sums(placed, inputs, target, folds)
    keys = ["outer", *[f"inner_{k}" for k in range(folds + 1)]]
    at = {name: [inputs.index(c) for c in names] for name, names in tiers.items()}
    grid = np.array(list(mixes))

    def fitted(key, table):
        width = len(inputs) + 2
        whole = np.array(table["sums"].tolist()).reshape(len(table), width, width)
        chosen = np.array([0, *[i + 1 for i in at[key[0]]], width - 1])
        order = np.lexsort(table[keys].to_numpy().T)  # the same fit in whatever order the sums arrive
        found = _tier(whole[order][:, chosen][:, :, chosen], table[keys].to_numpy()[order], folds, grid, strengths)
        return pd.DataFrame([(key[0], *f) for f in found], columns=[c.split(" ")[0] for c in FITS.split(", ")])

    spread = sums.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    fits = checkpointed(spread.groupBy("tier").applyInPandas(fitted, FITS))  # fold sums only: at most one row a cluster
    return placed.drop(*keys[1:]), fits


def predicted(rows: DataFrame, fits: DataFrame, tiers: Mapping[str, Sequence[str]], name: str = "prediction") -> DataFrame:
    """Each row once a tier, predicted by the fit that did not see its fold; null where an input is missing."""
    parts = [F.struct(F.lit(t).alias("tier"), F.array(*[F.col(c).cast("double") for c in names]).alias("_x")) for t, names in tiers.items()]
    widest = max(map(len, tiers.values()))
    padded = [F.struct(p["tier"].alias("tier"), F.concat(p["_x"], F.array_repeat(F.lit(0.0), widest - len(names))).alias("_x")) for p, names in zip(parts, tiers.values(), strict=True)]
    long = rows.withColumn("_t", F.explode(F.array(*padded))).select("*", "_t.tier", "_t._x").drop("_t")
    known = fits.select("tier", "outer", "intercept", F.concat("coefficients", F.array_repeat(F.lit(0.0), F.lit(widest) - F.size("coefficients"))).alias("_w"))
    joined = long.join(F.broadcast(known), ["tier", "outer"], "left")  # tiers x folds rows
    value = F.aggregate(F.zip_with("_x", "_w", lambda x, w: x * w), F.col("intercept"), lambda s, v: s + v)
    return joined.withColumn(name, value).drop("_x", "_w", "intercept")


def kept_coefficients(fits: DataFrame, tiers: Mapping[str, Sequence[str]], folds: int = 5) -> DataFrame:
    """The nonzero coefficients of each tier's fit of all rows, largest first: tier, place, input, coefficient."""
    from pyspark.sql import Window

    names = F.create_map(*[x for t, cols in tiers.items() for x in (F.lit(t), F.array(*[F.lit(c) for c in cols]))])
    each = fits.filter(F.col("outer") == folds).select("tier", F.posexplode(F.arrays_zip(names[F.col("tier")].alias("input"), F.col("coefficients").alias("coefficient"))).alias("i", "z"))
    kept = each.select("tier", "i", F.col("z.input").alias("input"), F.col("z.coefficient").alias("coefficient")).filter("coefficient <> 0")
    w = Window.partitionBy("tier").orderBy(F.desc(F.abs("coefficient")), "i")  # as many rows as inputs
    return kept.select("tier", F.row_number().over(w).alias("place"), "input", "coefficient")
