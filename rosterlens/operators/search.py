"""Nearest profiles, fit search and identification over pairs that are never written out.

Each block's vectors are cut into tiles of bounded size; a task takes two tiles, computes their
distances in numpy and hands on only what is asked for: the best n per row, a count, or sums.
A block holding most of the rows becomes many tiles and so many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import group_values, lookup, partitions

TILE_ROWS = 1024
#: Tiles of a search for the best few, which never holds a value for each pair of two tiles.
NEAREST_TILE_ROWS = 4096
_STRIP = 256


def tiled(rows: DataFrame, block: Sequence[str], id: str, vector: str, side: str,
          extra: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per tile: its ids, its vectors and other columns as arrays.

    Tiles are picked by a hash of the id, so a block's tiles are of about equal, bounded size.
    """
    sized = group_values(rows, block, _n=F.count(F.lit(1))) if block else rows.join(
        rows.agg(F.count(F.lit(1)).alias("_n")))
    tile = F.pmod(F.xxhash64(id), F.ceil(F.col("_n") / tile_rows)).cast("int")
    cell = F.struct(F.col(id).alias("id"), F.col(vector).alias("v"), *[F.col(c) for c in extra])
    tiles = F.max(F.ceil(F.col("_n") / tile_rows)).cast("int").alias(f"{side}_tiles")
    out = sized.groupBy(*block, tile.alias(f"{side}_tile")).agg(F.collect_list(cell).alias("_cells"), tiles)
    return out.select(*block, f"{side}_tile", f"{side}_tiles", *[
        F.col(f"_cells.{c}").alias(f"{side}_{c}") for c in ("id", "v", *extra)])


def _matrix(cells) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in cells])


def pair_values(a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """Euclidean distances, exact by differences, or dot products, of every row of a and b."""
    if measure == "dot":
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k][:, None] - b[:, k][None, :]) ** 2
    return np.sqrt(out)


def _values_at(a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """pair_values of row k of a with row k of b."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k] if measure == "dot" else (a[:, k] - b[:, k]) ** 2
    return out if measure == "dot" else np.sqrt(out)


def best_pairs(a: np.ndarray, b: np.ndarray, measure: str, n: int, allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of a, row of b and value of the pairs that may be among a row's n best, ties included.

    Products of matrices give each value up to a rounding error; what is within twice that of the n-th
    best is worked out exactly. ``allowed(lo, hi)`` masks the pairs of those rows of a.
    """
    found, last = [], min(n, len(b)) - 1
    far = (np.nan_to_num(b) ** 2).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        for lo in range(0, len(a), _STRIP):
            strip = a[lo:lo + _STRIP]
            near = (np.nan_to_num(strip) ** 2).sum(axis=1)
            rough = -2.0 * (strip @ b.T)
            if measure != "dot":
                rough += near[:, None] + (b ** 2).sum(axis=1)
            rough[~allowed(lo, lo + len(strip)) | np.isnan(rough)] = np.inf
            error = 1e-14 * (16 + a.shape[1]) * (near + far.max(initial=0.0))
            bound = np.partition(rough, last, axis=1)[:, last] + 4 * error
            at, cols = np.nonzero((rough <= bound[:, None]) & (rough < np.inf))
            found.append((at + lo, cols))
    at, cols = (np.concatenate([f[k] for f in found] or [np.zeros(0, int)]) for k in range(2))
    return at, cols, _values_at(a[at], b[cols], measure)


def _tile_pairs(left: DataFrame, right: DataFrame, block: Sequence[str]) -> DataFrame:
    """Every left tile with every right tile of its block.

    Both sides are copied once per tile of the other, so that the join's key is the tile pair
    itself: pairs spread evenly, even when one block holds all rows. The number of partitions is
    asked for, as a pair's work is far above its bytes.
    """
    def copied(tiles, other, side, far):
        count = other.groupBy(*block).agg(F.max(f"{far}_tiles").alias("_far"))
        sized = lookup(tiles, count, block, "inner") if block else tiles.join(count)
        out = sized.withColumn(f"{far}_tile", F.explode(F.sequence(F.lit(0), F.col("_far") - 1)))
        return out.drop("_far", f"{side}_tiles").repartition(partitions(tiles), *block, "l_tile", "r_tile")

    return copied(left, right, "l", "r").join(copied(right, left, "r", "l"), [*block, "l_tile", "r_tile"])


def nearest(left: DataFrame, right: DataFrame, block: Sequence[str], id: str, left_vector: str,
            right_vector: str, n: int, measure: str = "distance", right_id: str | None = None,
            home: str | None = None, seen: str | None = None, positive: bool = False,
            tile_rows: int = NEAREST_TILE_ROWS) -> DataFrame:
    """The n best right rows per left row within a block, ties by id: (id, other, value, place).

    The smallest distances, or the largest dot products (only above zero when ``positive``).
    Without ``right_id`` both sides are the same entities and none is its own candidate. With
    ``home`` (a left column) and ``seen`` (a right array column, an entity's own clubs) a
    candidate seen at the left row's home is left out before the best are taken.
    """
    lt = tiled(left, block, id, left_vector, "l", [home] if home else [], tile_rows)
    rt = tiled(right, block, right_id or id, right_vector, "r", [seen] if seen else [], tile_rows)
    schema = f"id {dict(left.dtypes)[id]}, other {dict(right.dtypes)[right_id or id]}, value double"
    sign = -1.0 if measure == "dot" else 1.0

    def best(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids, others = np.asarray(row["l_id"]), np.asarray(row["r_id"])
                at_home = np.asarray(row[f"l_{home}"]) if home else None
                clubs = [np.asarray(c if c is not None else []) for c in row[f"r_{seen}"]] if home else []

                def allowed(lo, hi):
                    ok = np.ones((hi - lo, len(others)), dtype=bool)
                    if right_id is None:
                        ok &= ids[lo:hi, None] != others[None, :]
                    for j, seen_at in enumerate(clubs):
                        if len(seen_at):
                            ok[:, j] &= ~np.isin(at_home[lo:hi], seen_at)
                    return ok

                at, cols, values = best_pairs(_matrix(row["l_v"]), _matrix(row["r_v"]), measure, n, allowed)
                ok = np.isfinite(values) & ((values > 0) | (not positive))
                at, cols, values = at[ok], cols[ok], values[ok]
                order = np.lexsort((others[cols], sign * values, at))
                at, cols, values = at[order], cols[order], values[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                yield pd.DataFrame({"id": ids[at], "other": others[cols], "value": values})[place < n]

    found = _tile_pairs(lt, rt, block).mapInPandas(best, schema)
    w = Window.partitionBy("id").orderBy(F.col("value") * sign, "other")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def own_ranks(rows: DataFrame, block: Sequence[str], id: str, first: str, second: str,
              tile_rows: int = TILE_ROWS) -> DataFrame:
    """Per row: its first vector's distance to its own second vector, how many second vectors of
    the block are at that distance or nearer (its own included), and the block's size."""
    lt = tiled(rows.withColumn("_own", _own_distance(first, second)), block, id, first, "l", ["_own"],
               tile_rows)
    rt = tiled(rows, block, id, second, "r", (), tile_rows)
    kind = dict(rows.dtypes)[id]

    def count(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = pair_values(_matrix(row.l_v), _matrix(row.r_v), "distance")
                ids, others = np.asarray(row.l_id), np.asarray(row.r_id)
                own = ids[:, None] == others[None, :]
                near = (d <= np.asarray(row.l__own)[:, None]) | own
                yield pd.DataFrame({"id": ids, "own": row.l__own, "rank": near.sum(axis=1),
                                    "k": np.full(len(ids), len(others))})

    pairs = _tile_pairs(lt, rt, block)
    parts = pairs.mapInPandas(count, f"id {kind}, own double, rank long, k long")
    return parts.groupBy("id").agg(
        F.first("own").alias("own"), F.sum("rank").alias("rank"), F.sum("k").alias("k"))


@F.pandas_udf(T.DoubleType())
def _pair_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same sums in the same order as pair_values, so that a row's own distance ties itself."""
    if not len(a):
        return pd.Series([], dtype="float64")
    d = _matrix(a) - _matrix(b)
    out = np.zeros(len(d))
    for k in range(d.shape[1]):
        out += d[:, k] ** 2
    return pd.Series(np.sqrt(out))


def _own_distance(first: str, second: str):
    return _pair_distance(F.col(first), F.col(second))


def pair_moments(rows: DataFrame, block: Sequence[str], id: str, first: str, second: str,
                 tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs, mean and standard deviation (n - 1) of the distances from every first to every
    second vector of the same block, over all blocks."""
    lt = tiled(rows, block, id, first, "l", (), tile_rows)
    rt = tiled(rows, block, id, second, "r", (), tile_rows)

    def sums(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = pair_values(_matrix(row.l_v), _matrix(row.r_v), "distance")
                yield pd.DataFrame({"n": [d.size], "mean": [d.mean()],
                                    "m2": [((d - d.mean()) ** 2).sum()]})

    parts = _tile_pairs(lt, rt, block).mapInPandas(sums, "n long, mean double, m2 double")
    n, mean = F.col("n"), F.col("mean")
    total = parts.agg(F.sum("n").alias("pairs"), (F.sum(n * mean) / F.sum(n)).alias("mean"),
                      F.sum("m2").alias("_within"), F.sum(n * mean * mean).alias("_square"))
    between = F.col("_square") - F.col("pairs") * F.col("mean") * F.col("mean")
    return total.select("pairs", "mean", F.sqrt((F.col("_within") + between) / (F.col("pairs") - 1)).alias("sd"))


def combined_ranks(rows: DataFrame, block: Sequence[str], id: str,
                   vectors: Sequence[tuple[str, str, float]], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Ranks by the sum of several distances, each over its own scale.

    Scaling a vector scales its distances, but a sum of distances is not one distance, so tiles
    carry each pair of vectors side by side.
    """
    def scaled(column, scale):
        return F.transform(column, lambda x: x / F.lit(scale))

    firsts = F.concat(*[scaled(a, s) for a, _, s in vectors])
    seconds = F.concat(*[scaled(b, s) for _, b, s in vectors])
    sizes = [F.size(F.col(a)).alias(f"_w{i}") for i, (a, _, _) in enumerate(vectors)]
    both = rows.select(*block, id, firsts.alias("_a"), seconds.alias("_b"), *sizes)
    widths = F.array(*[F.col(f"_w{i}") for i in range(len(vectors))])
    lt = tiled(both.withColumn("_ws", widths).withColumn("_pair", F.col("_b")), block, id, "_a", "l",
               ["_ws", "_pair"], tile_rows)
    rt = tiled(both, block, id, "_b", "r", (), tile_rows)
    kind = dict(rows.dtypes)[id]

    def count(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b, own = _matrix(row.l_v), _matrix(row.r_v), _matrix(row.l__pair)
                cuts = np.cumsum([0, *row.l__ws[0]])
                d = sum(pair_values(a[:, s:e], b[:, s:e], "distance") for s, e in zip(cuts, cuts[1:]))
                mine = np.zeros(len(a))
                for s, e in zip(cuts, cuts[1:]):
                    part = np.zeros(len(a))
                    for k in range(s, e):
                        part += (a[:, k] - own[:, k]) ** 2
                    mine += np.sqrt(part)
                ids, others = np.asarray(row.l_id), np.asarray(row.r_id)
                near = (d <= mine[:, None]) | (ids[:, None] == others[None, :])
                yield pd.DataFrame({"id": ids, "own": mine, "rank": near.sum(axis=1)})

    parts = _tile_pairs(lt, rt, block).mapInPandas(count, f"id {kind}, own double, rank long")
    return parts.groupBy("id").agg(F.first("own").alias("own"), F.sum("rank").alias("rank"))


def identification(ranked: DataFrame) -> DataFrame:
    """Rows with company in their block, hits, the share expected by chance, their difference and
    the mean reciprocal rank."""
    q = ranked.filter("k >= 2")
    hit = (F.col("rank") == 1).cast("double")
    return q.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hit.cast("long")).alias("hits"),
        F.sum(1 / F.col("k")).alias("by_chance"), F.avg(hit - 1 / F.col("k")).alias("statistic"),
        F.avg(1 / F.col("rank")).alias("mrr"))


def shared_neighbours(one: DataFrame, two: DataFrame, n: int) -> DataFrame:
    """Mean share of a row's n nearest that another run's n nearest hold too."""
    both = one.select("id", "other").join(two.select("id", "other"), ["id", "other"])
    per = both.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    everyone = one.select("id").distinct()
    share = F.coalesce("_n", F.lit(0)) / n
    return everyone.join(per, "id", "left").agg(F.avg(share).alias("share"), F.count(F.lit(1)).alias("rows"))


def same_league_share(near: DataFrame, leagues: DataFrame, league: str) -> DataFrame:
    """Mean over rows of the share of their neighbours in their own league."""
    l = leagues.select(F.col("id"), F.col(league).alias("_mine"))
    o = leagues.select(F.col("id").alias("other"), F.col(league).alias("_theirs"))
    j = lookup(lookup(near, l, ["id"], "inner"), o, ["other"], "inner")
    per = j.groupBy("id").agg(F.avg((F.col("_mine") == F.col("_theirs")).cast("double")).alias("_s"))
    return per.agg(F.avg("_s").alias("share"), F.count(F.lit(1)).alias("rows"))


def block_pair_counts(nodes: DataFrame, block: Sequence[str]) -> DataFrame:
    """Unordered pairs a block could form, counted without forming them."""
    n = F.col("_n")
    return nodes.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(
        *block, n.alias("nodes"), F.floor(n * (n - 1) / 2).alias("pairs"))


def seen_at(rows: DataFrame, player: str, club: str, name: str = "seen") -> DataFrame:
    """Per player the distinct clubs the player has rows at; as long as one player's history."""
    return rows.select(player, club).distinct().groupBy(player).agg(F.collect_set(club).alias(name))
