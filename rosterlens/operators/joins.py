"""Keyed, as-of, band and mirror joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import hot_rows, lookup
from .checks import held_once, require_empty


def contracted(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
               contract: str = "one_to_one") -> DataFrame:
    """A join whose result stops, when it is run, if a side that must hold each key once does not."""
    if contract.startswith("one"):
        left = held_once(left, on, "left key repeated")
    if contract.endswith("one"):
        right = held_once(right, on, "right key repeated")
    return lookup(left, right, on, how)


def outer_with_side(left: DataFrame, right: DataFrame, on: Sequence[str],
                    zero: Sequence[str] = ()) -> DataFrame:
    """Full outer join with the side each key came from; listed columns 0 where absent."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    side = (F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
            .otherwise("both"))
    out = a.join(b, list(on), "full_outer").withColumn("side", side).drop("_l", "_r")
    return out.na.fill(0, list(zero)) if zero else out


def as_of(rows: DataFrame, key: str, date: str, value: str, low: Column, high: Column,
          name: str = "price") -> DataFrame:
    """Per key the positive value on the latest date in [low, high], with that date; ``conflict``
    when that date holds two different values."""
    kept = rows.filter((F.col(value) > 0) & (F.col(date) >= low) & (F.col(date) <= high))
    per_day = kept.groupBy(key, date).agg(F.max(value).alias("_v"), F.min(value).alias("_w"))
    last = per_day.groupBy(key).agg(F.max_by(F.struct(date, "_v", "_w"), date).alias("_last"))
    return last.select(
        key, F.col("_last._v").alias(name), F.col(f"_last.{date}").alias(f"{name}_date"),
        (F.col("_last._v") != F.col("_last._w")).alias("conflict"))


def require_one_value(latest: DataFrame) -> DataFrame:
    require_empty(latest.filter("conflict"), "two values on the latest date")
    return latest.drop("conflict")


def as_of_after(entities: DataFrame, bounds: DataFrame, on: Sequence[str], rows: DataFrame, key: str,
                date: str, value: str, bound: str, high: Column, name: str = "price") -> DataFrame:
    """As-of with a lower bound per group: dates strictly after it, up to ``high``."""
    e = lookup(entities, bounds.select(*on, bound), on, "inner")
    kept = rows.filter((F.col(value) > 0) & (F.col(date) <= high))
    j = kept.join(e.select(key, bound), key).filter(F.col(date) > F.col(bound))
    return j.groupBy(key).agg(
        F.max_by(value, F.struct(date, value)).alias(name), F.max(date).alias(f"{name}_date"))


def with_fallback(entities: DataFrame, key: str, price: str, rows: DataFrame, date: str, value: str,
                  window: tuple[Column, Column], since: Column) -> DataFrame:
    """Value in the horizon's range, else the latest since a date, else the price itself.

    Both as-of values come from one pass over the rows.
    """
    low, high = window
    kept = rows.filter((F.col(value) > 0) & (F.col(date) >= since) & (F.col(date) <= high))
    inside = F.col(date) >= low
    order = F.struct(date, value)
    latest = kept.groupBy(key).agg(
        F.max_by(F.when(inside, F.col(value)), F.when(inside, order)).alias("_in"),
        F.max_by(value, order).alias("_any"))
    out = entities.join(latest, key, "left")
    how = F.when(F.col("_in").isNotNull(), "window").when(F.col("_any").isNotNull(), "carried")
    later = F.coalesce("_in", "_any", price)
    return out.withColumns({
        "how": how.otherwise("price"), "later": later,
        "outcome": F.log(later / F.col(price))}).drop("_in", "_any")


#: Players of a class in band_pairs, and event pairs looked at together.
CLASS, AT_ONCE = 3072, 1 << 22


class _Tile:
    """Counts of event pairs of two classes of players, as a matrix filled block by block."""

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.one, self.two = one, two
        self.counts = np.zeros(len(one) * len(two), np.int64)
        self.held, self.size = [], 0

    def add(self, left, right, width: int) -> None:
        """The pairs of two lists of events (place in the class, instant, times) at most ``width`` apart."""
        (p, t, n), (q, u, m) = (tuple(c[np.argsort(x[1], kind="stable")] for c in x) for x in (left, right))
        low, high = np.searchsorted(u, t - width, "left"), np.searchsorted(u, t + width, "right")
        upto = np.concatenate([[0], np.cumsum(high - low)])
        a = 0
        while a < len(t):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + AT_ONCE, "right")) - 1)
            met = (high - low)[a:b]
            i = np.repeat(np.arange(a, b), met)
            j = np.arange(upto[b] - upto[a]) + np.repeat(low[a:b] - (upto[a:b] - upto[a]), met)
            self.held.append((p[i] * len(self.two) + q[j], n[i] * m[j]))
            self.size += len(i)
            if self.size >= max(AT_ONCE, len(self.counts)):
                self.settle()
            a = b

    def settle(self) -> np.ndarray:
        if self.held:
            codes, times = (np.concatenate(x) for x in zip(*self.held, strict=True))
            if (times == 1).all():
                self.counts += np.bincount(codes, minlength=len(self.counts))
            else:
                np.add.at(self.counts, codes, times)
            self.held, self.size = [], 0
        return self.counts.reshape(len(self.one), len(self.two))

    def most_frequent(self, least: int, partners: int) -> np.ndarray:
        """Which pairs one of its ends has among its `partners` most frequent, ties to the lower, of those with `least` or more."""
        counts = self.settle()
        found = np.zeros(counts.shape, bool)
        for n, other, out in ((counts, self.two, found), (counts.T, self.one, found.T)):
            base = int(max(self.one[-1], self.two[-1])) + 2
            key = np.where(n >= least, n * base + (base - 1 - other), 0)
            k = min(partners, key.shape[1])
            bar = np.partition(key, key.shape[1] - k, axis=1)[:, key.shape[1] - k]
            out |= (key >= bar[:, None]) & (key > 0)
        return found


def band_pairs(events: DataFrame, block: Sequence[str], player: str, at: str, width: int, rows: int | None = None, by: Sequence[str] | None = None,
               keep: tuple[int, int] | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Per block and unordered pair of players, the pairs of their events at most ``width`` apart.

    ``at`` is a whole number. Counts are summed over the blocks of each of ``by``, some of the block's columns, all by default.
    Events of one player at one instant are combined first. The players of each of ``by`` are dealt to classes of about ``rows``;
    a task takes two classes and counts their pairs in one matrix, so no pair of events is written out or shuffled, and a pair of
    players is counted in one place. With ``keep``, a least count and a number of partners, only pairs are returned that one of the
    two tasks of an end may list among its most frequent partners (all that any end lists, and some more), and those ``wanted``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    by = list(block if by is None else by)
    others = [c for c in block if c not in by]
    cells = events.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*block, player, at]])).groupBy(*block, player, at).agg(F.count(F.lit(1)).alias("_n"))
    held = cells.groupBy(*by, player).agg(F.count(F.lit(1)).alias("_cells")).groupBy(*by).agg(F.count(F.lit(1)).alias("_players"), F.sum("_cells").alias("_cells"))
    limit = CLASS if rows is None else rows
    classes = held.select(*by, F.greatest(F.ceil(F.col("_players") / limit), F.ceil(F.col("_cells") / hot_rows(events, rows))).cast("int").alias("_classes"))
    place = lambda c: F.pmod(F.xxhash64(c), F.col("_classes")).cast("int")
    event = F.struct(F.col(player).alias("p"), F.col(at).cast("long").alias("t"), F.col("_n").alias("n"))
    packed = lookup(cells, classes, by, "inner").groupBy(*block, "_classes", place(F.col(player)).alias("_c")).agg(F.collect_list(event).alias("_e"))
    tiles = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_classes") - 1))).select(*block, "_c", "_e", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"))

    kind = events.schema[player].dataType
    fields = [*((c, to_arrow_type(events.schema[c].dataType)) for c in by), ("player_a", to_arrow_type(kind)), ("player_b", to_arrow_type(kind)), ("n", pa.int64())]
    schema = ", ".join([*(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in by), f"player_a {kind.simpleString()}, player_b {kind.simpleString()}, n bigint"])

    def counted(key, table: pa.Table, asked: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in fields})
        i, j = key[-2].as_py(), key[-1].as_py()
        lists = table.column("_e").combine_chunks()
        flat = lists.flatten()
        names = pc.unique(flat.field("p"))
        names = names.take(pc.sort_indices(names))
        code = pc.index_in(flat.field("p"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
        t, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in "tn")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        side = table.column("_c").to_numpy()
        spots: tuple[dict, dict] = {}, {}
        for row, spot in enumerate(zip(*(table.column(c).to_pylist() for c in others), strict=True) if others else [()] * table.num_rows):
            spots[int(side[row] != i)].setdefault(spot, []).append(np.arange(ends[row - 1] if row else 0, ends[row]))
        if i == j:
            spots = spots[0], spots[0]
        if not spots[0] or not spots[1]:
            return pa.table({n: pa.array([], t) for n, t in fields})
        one, two = (np.unique(code[np.concatenate([x for xs in s.values() for x in xs])]) for s in spots)
        tile = _Tile(one, two)
        for spot in spots[0].keys() & spots[1].keys():
            x, y = (np.concatenate(s[spot]) for s in spots)
            tile.add((np.searchsorted(one, code[x]), t[x], n[x]), (np.searchsorted(two, code[y]), t[y], n[y]), width)
        counts = tile.settle()
        if i == j:
            np.fill_diagonal(counts, 0)  # a player does not meet itself; the other pairs stand on both sides
        chosen = counts > 0
        if keep is not None:
            chosen = tile.most_frequent(*keep)
            if asked is not None and asked.num_rows:
                a, b = (pc.fill_null(pc.index_in(asked.column(c).combine_chunks(), value_set=names), -1).to_numpy(zero_copy_only=False) for c in ("player_a", "player_b"))
                for x, y in ((a, b), (b, a)):
                    both = np.isin(x, one) & np.isin(y, two)
                    chosen[np.searchsorted(one, x[both]), np.searchsorted(two, y[both])] = True
                chosen &= counts > 0
        if i == j:
            chosen = np.triu(chosen | chosen.T, 1)
        x, y = np.nonzero(chosen)
        total, x, y = counts[x, y], one[x], two[y]
        columns = [*(pa.array([key[k].as_py()], fields[k][1]).take(pa.array(np.zeros(len(total), np.int32))) for k in range(len(by))),
                   names.take(pa.array(np.minimum(x, y))), names.take(pa.array(np.maximum(x, y))), pa.array(total)]
        return pa.Table.from_arrays(columns, schema=pa.schema(fields))

    grouped = tiles.groupBy(*by, "_i", "_j")
    if wanted is None:
        return grouped.applyInArrow(lambda key, table: counted(key, table), schema)
    dealt = lookup(wanted.select(*by, *[F.col(c).cast(kind).alias(c) for c in ("player_a", "player_b")]), classes, by, "inner")
    a, b = place(F.col("player_a")), place(F.col("player_b"))
    dealt = dealt.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(by)], F.least(a, b).alias("_wi"), F.greatest(a, b).alias("_wj"), "player_a", "player_b")
    return grouped.cogroup(dealt.groupBy(*[f"_k{k}" for k in range(len(by))], "_wi", "_wj")).applyInArrow(counted, schema)


def expand_sides(games: DataFrame, keep: Sequence[str], home: str = "home",
                 away: str = "away") -> DataFrame:
    """Two rows per game: each team with its opponent."""
    sides = F.array(F.struct(F.col(home).alias("team"), F.col(away).alias("opponent"), F.lit(True).alias("at_home")),
                    F.struct(F.col(away).alias("team"), F.col(home).alias("opponent"), F.lit(False).alias("at_home")))
    return games.select(*keep, F.inline(sides))


def first_source(rows: DataFrame, sources: Mapping[str, DataFrame], on: Sequence[str],
                 column: str) -> DataFrame:
    """The column from the first source holding the key, with the source's name."""
    out = rows
    for name, table in sources.items():
        out = lookup(out, table.select(*on, F.col(column).alias(f"_s_{name}")), on)
    picked = [F.col(f"_s_{n}") for n in sources]
    origin = F.lit(None).cast("string")
    for n in reversed(list(sources)):
        origin = F.when(F.col(f"_s_{n}").isNotNull(), n).otherwise(origin)
    return out.withColumns({column: F.coalesce(*picked), "source": origin}).drop(
        *[f"_s_{n}" for n in sources])


def only_value(table: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose column has a single distinct value, with it."""
    per = table.groupBy(key).agg(F.min(column).alias(column), F.max(column).alias("_hi"))
    return per.filter(F.col(column) == F.col("_hi")).drop("_hi")


def on_nodes(pairs: DataFrame, nodes: DataFrame, block: Sequence[str], node: str,
             ends: Sequence[str] = ("player_a", "player_b")) -> DataFrame:
    """Pairs whose both ends are nodes of the block."""
    out = pairs
    for end in ends:
        out = out.join(nodes.select(*block, F.col(node).alias(end)).distinct(), [*block, end], "left_semi")
    return out


def first_values(rows: DataFrame, keys: Sequence[str], columns: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """Per key the first non-null value of each column; columns may come from different rows."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


