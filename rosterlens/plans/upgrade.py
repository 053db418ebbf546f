"""Upgrade plans for a club: its own players plus a few priced additions within a budget.

A plan fills a shape (places per group) exactly with own players, who cost nothing, and at most k
additions. Own players of a group are best taken from the top, so a group's part of a plan is
settled by how many additions it takes. Choices of additions are kept as fronts by count: a choice
that a cheaper one of as many beats is dropped. Fronts of disjoint candidates, and then of the groups,
are merged count by count. This is exact: a dropped part can be swapped for the one that beats it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.resample import hashed
from ..scale import Ordered, lookup, numbered, partitions
from ..session import checkpointed

# Budgets, caps on additions, z of the 90% interval, reasons in the order tried.
BUDGETS = [5_000_000, 10_000_000, 20_000_000, 40_000_000, 80_000_000]
CAPS = [1, 2, 3]
INTERVAL_Z = 1.645
REASONS = ["more places than signings", "too few candidates", "budget too small"]


def _first(numbered: DataFrame, shape: DataFrame, places: str, club: str, group: str) -> DataFrame:
    """The rows of each club and group numbered up to the places its shape has there, however many."""
    most = shape.groupBy(club, group).agg(F.max(places).alias("_most"))
    return lookup(numbered, most, [club, group], "inner").filter("_n <= _most").drop("_most")


def skyline(rows: DataFrame, keys: Sequence[str], k: int, price: str = "price", value: str = "value",
            id: str = "id") -> DataFrame:
    """Rows that can be in a best plan with at most k additions, and maybe some more.

    k times the rows better than every no-dearer row left are taken off. A row never taken has at
    least k rows no dearer and no worse, of which one is always free to take its place.
    """
    o = Ordered(rows.withColumns({"_v": -F.col(value), "_layer": F.lit(None).cast("int")}), keys, [price, "_v", id])
    for i in range(k):
        # in order of price, then falling value, then id: the best value left before each row
        best, before = f"_best{i}", f"_before{i}"
        o = o.upto(**{best: ("max", F.when(F.col("_layer").isNull(), F.col(value)))}).before(**{before: F.col(best)})
        beats = F.col("_layer").isNull() & F.coalesce(F.col(value) > F.col(before), F.lit(True))
        o = o.with_columns(_layer=F.when(beats, i).otherwise(F.col("_layer")))
    return o.df.filter("_layer is not null").select(*rows.columns)


def own_parts(own: DataFrame, shape: DataFrame, club: str, group: str, k: int) -> DataFrame:
    """Per club, group and number of additions: value and displaced variance of the own players
    left in; rows only where the own players suffice."""
    w = Window.partitionBy(club, group).orderBy(F.desc("value"), "id")
    top = _first(own.withColumn("_n", F.row_number().over(w)), shape, "places", club, group)
    joined = lookup(shape, top.select(club, group, "_n", "value", "sd", "id"), [club, group])
    counts = joined.groupBy(club, group, "places").agg(
        F.count("_n").alias("_own"),
        F.collect_list(F.struct("_n", "value", "sd", "id")).alias("_top"))
    part = counts.withColumn("a", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("places")))))
    kept = F.col("places") - F.col("a")
    part = part.filter(F.col("_own") >= kept)
    inside = F.expr("filter(_top, t -> t._n <= places - a)")
    out = F.expr("filter(_top, t -> t._n > places - a and t._n <= places)")
    total = F.aggregate(inside, F.lit(0.0), lambda s, t: s + t["value"])
    lost = F.aggregate(out, F.lit(0.0), lambda s, t: s + t["sd"] * t["sd"])
    return part.select(club, group, "a", total.alias("_value"), lost.alias("_var"),
                       F.transform(out, lambda t: t["id"]).alias("out_ids"))


#: Stands for no id after a choice's ids, which ascend.
NONE = np.iinfo(np.int64).max


class _Fronts:
    """Choices of up to k additions that no cheaper choice of as many beats, for many sets of candidates (`seg`) at once.

    Columns: seg, a (additions), cost, total, var, ids (ascending, then NONE) and rows: per part a choice may be made of that
    part's row, or -1. Of equal choices the one of smaller ids stands, which the union with further ids does not change.
    """

    #: Sums looked at together.
    AT_ONCE = 1 << 20

    def __init__(self, k: int, most: float):
        self.k, self.most = k, most

    def cut(self, seg, a, cost, total, var, ids, rows):
        """The rows worth keeping, by set and count in order of cost."""
        cost, total = np.round(cost, 6), np.round(total, 9)  # equal choices stay equal in whatever order they were summed
        order = np.flatnonzero(cost <= self.most)
        blank = bool(np.isnan(total[order]).any())
        order = order[np.lexsort((*(ids[order].T[::-1] if blank else ()), -total[order], cost[order], seg[order] * (self.k + 1) + a[order]))]
        code, c, t = seg[order] * (self.k + 1) + a[order], cost[order], total[order]
        if not len(order):
            return tuple(x[order] for x in (seg, a, cost, total, var, ids, rows))
        first = np.concatenate([[True], code[1:] != code[:-1]])
        tie = np.concatenate([[True], (code[1:] != code[:-1]) | (c[1:] != c[:-1]) | (t[1:] != t[:-1])])
        # the best total so far within a set and count: totals as ranks, raised from one set to the next
        values, rank = np.unique(t, return_inverse=True)
        best = np.maximum.accumulate(np.cumsum(first) * (len(values) + 1) + rank)
        start = np.flatnonzero(tie)
        better = first[start] | (best[start] > best[start - 1])
        if blank:
            # a missing total beats nothing and nothing dearer beats it: it stays as the cheapest only
            missing = np.isnan(t)
            upto = np.cumsum(missing) - missing
            before = upto - upto[np.flatnonzero(first)][np.cumsum(first) - 1]
            better = first[start] | (better & ~missing[start] & (before[start] == 0))
        group = np.cumsum(tie) - 1
        keep = better[group]
        order, group = order[keep], group[keep]
        if len(order) > better.sum():
            by = np.lexsort((*ids[order].T[::-1], group))
            order, group = order[by], group[by]
            order = order[np.concatenate([[True], group[1:] != group[:-1]])]
        return tuple(x[order] for x in (seg, a, cost, total, var, ids, rows))

    def merged(self, one, two):
        """Choices by count from two disjoint sets of candidates for each seg; a seg of one side only stays as it is."""
        both = np.intersect1d(one[0], two[0])
        alone = [tuple(x[~np.isin(side[0], both)] for x in side) for side in (one, two)]
        one, two = (tuple(x[at] for x in side) for side, at in ((side, np.isin(side[0], both)) for side in (one, two)))
        two = tuple(x[np.argsort(two[0], kind="stable")] for x in two)
        low, high = np.searchsorted(two[0], one[0], "left"), np.searchsorted(two[0], one[0], "right")
        upto = np.concatenate([[0], np.cumsum(high - low)])
        parts, at = [], 0
        while at < len(one[0]):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + self.AT_ONCE, "right")) - 1)
            n = (high - low)[at:end]
            i = np.repeat(np.arange(at, end), n)
            j = np.arange(upto[end] - upto[at]) + np.repeat(low[at:end] - (upto[at:end] - upto[at]), n)
            inside = (one[1][i] + two[1][j] <= self.k) & (one[2][i] + two[2][j] <= self.most + 1e-6)
            i, j = i[inside], j[inside]
            ids = np.sort(np.concatenate([one[5][i], two[5][j]], axis=1), axis=1)[:, :self.k]
            total = one[3][i] + two[3][j]
            apart = bool(np.isnan(total).any())  # then each count of one side is cut by itself first
            met = self.cut(one[0][i] * (self.k + 1) + one[1][i] if apart else one[0][i], one[1][i] + two[1][j], one[2][i] + two[2][j], total, one[4][i] + two[4][j], ids,
                           np.maximum(one[6][i], two[6][j]))
            parts.append(self.cut(met[0] // (self.k + 1), *met[1:]) if apart else met)
            at = end
        out = self.joined(parts) if len(parts) > 1 else parts[0] if parts else one
        return tuple(np.concatenate(x) for x in zip(out, *alone, strict=True))

    def joined(self, parts):
        return self.cut(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def singles(self, seg, cost, total, var, ids):
        """Choices of up to k among each set's candidates, by neighbours."""
        order = np.argsort(seg, kind="stable")
        seg, cost, total, var, ids = (x[order] for x in (seg, cost, total, var, ids))
        sets, first = np.unique(seg, return_index=True)
        place = np.arange(len(seg)) - np.repeat(first, np.diff([*first, len(seg)]))
        n = len(seg)
        # candidates are the leaves of their set's tree of halves; seg while merging: the set's place and the node
        at = np.searchsorted(sets, seg)
        low, high, node = np.zeros(n, np.int64), np.diff([*first, n])[at], np.ones(n, np.int64)
        while (open_ := high - low > 1).any():
            half = low + (high - low) // 2
            right = place >= half
            node = np.where(open_, 2 * node + right, node)
            low, high = np.where(open_ & right, half, low), np.where(open_ & ~right, half, high)
        width = 2 * (int(node.max(initial=1)) + 1)
        none, no_ids, nothing = np.zeros(n), np.full((n, self.k), NONE), np.full((n, 0), -1, np.int64)
        own = no_ids.copy()
        if self.k:
            own[:, 0] = ids
        fits = np.round(cost, 6) <= self.most if self.k else np.zeros(n, bool)
        here = at * width + node
        held = (np.concatenate([here, here[fits]]), np.concatenate([np.zeros(n, np.int64), np.ones(int(fits.sum()), np.int64)]), np.concatenate([none, np.round(cost, 6)[fits]]),
                np.concatenate([none, np.round(total, 9)[fits]]), np.concatenate([none, var[fits]]), np.concatenate([no_ids, own[fits]]), np.concatenate([nothing, nothing[fits]]))
        for depth in range(int(node.max(initial=1)).bit_length() - 1, 0, -1):
            spot, inside = held[0] // width, held[0] % width
            deep = inside >= 1 << depth
            odd = inside % 2 == 1
            lifted = (np.where(deep, spot * width + inside // 2, held[0]), *held[1:])
            met = self.merged(*(tuple(x[m] for x in lifted) for m in (deep & ~odd, deep & odd)))
            held = tuple(np.concatenate(x) for x in zip(met, (x[~deep] for x in lifted), strict=True))
        held = (held[0] // width, *held[1:])
        return (sets[held[0]], *held[1:])


_FRONT = [("a", pa.int32()), ("cost", pa.float64()), ("total", pa.float64()), ("var", pa.float64()), ("in_ids", pa.list_(pa.int64()))]
_FRONT_SQL = "a int, cost double, total double, var double, in_ids array<bigint>"
#: Candidates of one set whose choices are worked out together, and rows of all sets in a task's batch.
BLOCK, BATCH = 256, 30_000


def _id_lists(ids: np.ndarray) -> pa.Array:
    held = ids != NONE
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(held.sum(1))]).astype(np.int32), pa.array(ids[held], pa.int64()))


def _id_matrix(lists: pa.ChunkedArray, k: int) -> np.ndarray:
    lists = lists.combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.full((len(n), k), NONE)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _sets(table: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set by its keys, and a row of each set."""
    seg = np.zeros(table.num_rows, np.int64)
    for c in keys:
        codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        seg = np.unique(seg * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return seg, np.unique(seg, return_index=True)[1]


def _fronts_of(table: pa.Table, seg: np.ndarray, k: int, rows: np.ndarray):
    a, cost, total, var = (table.column(c).to_numpy() for c in ("a", "cost", "total", "var"))
    return seg, a.astype(np.int64), cost, total, var, _id_matrix(table.column("in_ids"), k), rows


def _batched(rows: DataFrame, keys: Sequence[str], n: int):
    """Sets of rows dealt to batches of many sets, as many partitions as asked: the rows are few for the work they make."""
    return rows.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(n))).repartition(n, "_batch").groupBy("_batch")


def choices(sky: DataFrame, keys: Sequence[str], k: int, most: float, block: int = BLOCK) -> DataFrame:
    """Per key the choices of 1 to k candidates worth keeping: a, cost, total, var, in_ids.

    Candidates in order of price are cut into blocks; blocks are disjoint, so their choices merge pairwise, count by count,
    round by round. A task takes the blocks of many keys and works on them together.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = numbered(sky, keys, ["price", "value", "id"], "_n")
    rows = checkpointed(ordered.select(*keys, F.expr(f"(_n - 1) div {block}").cast("int").alias("_b"), F.col("id").cast("long").alias("id"),
                                       F.col("price").cast("double").alias("price"), F.col("value").cast("double").alias("value"), (F.col("sd") * F.col("sd")).cast("double").alias("var")))
    known = rows.agg(F.max("_b"), F.count(F.lit(1))).first()
    last, batches = known[0] or 0, max(partitions(sky), -(-known[1] // BATCH))
    schema = ", ".join(f"{c} {sky.schema[c].dataType.simpleString()}" for c in keys) + ", _b int, " + _FRONT_SQL
    types = pa.schema([*((c, to_arrow_type(sky.schema[c].dataType)) for c in keys), ("_b", pa.int32()), *_FRONT])

    def as_rows(table: pa.Table, first: np.ndarray, b: pa.ChunkedArray, fronts) -> pa.Table:
        fronts = tuple(x[fronts[1] > 0] for x in fronts)
        seg, a, cost, total, var, ids, _ = fronts
        at = pa.array(first[seg])
        columns = [*(table.column(c).take(at) for c in keys), b.take(at), pa.array(a, pa.int32()), pa.array(cost), pa.array(total), pa.array(var), _id_lists(ids)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=types.names).cast(types)

    def leaf(table: pa.Table) -> pa.Table:
        seg, first = _sets(table, [*keys, "_b"])
        return as_rows(table, first, table.column("_b"), _Fronts(k, most).singles(seg, *(table.column(c).to_numpy() for c in ("price", "value", "var", "id"))))

    def pair(table: pa.Table) -> pa.Table:
        half = pa.chunked_array([pa.array(table.column("_b").to_numpy() // 2, pa.int32())])
        seg, first = _sets(table.append_column("_h", half), [*keys, "_h"])
        odd = table.column("_b").to_numpy() % 2 == 1
        held = _fronts_of(table, seg, k, np.full((table.num_rows, 0), -1, np.int64))
        empty = np.arange(len(first))
        nothing = empty, np.zeros(len(first), np.int64), *([np.zeros(len(first))] * 3), np.full((len(first), k), NONE), np.full((len(first), 0), -1, np.int64)
        one, two = (tuple(np.concatenate(x) for x in zip(nothing, (c[m] for c in held), strict=True)) for m in (~odd, odd))
        return as_rows(table, first, half, _Fronts(k, most).merged(one, two))

    fronts = _batched(rows, [*keys, "_b"], batches).applyInArrow(leaf, schema)
    while last:
        fronts = _batched(fronts, [*keys, F.expr("_b div 2")], batches).applyInArrow(pair, schema)
        last //= 2
    return fronts.drop("_b")


def club_plans(own: DataFrame, candidates: DataFrame, shape: DataFrame, groups: Sequence[str],
               budgets: Sequence[float] = tuple(BUDGETS), caps: Sequence[int] = tuple(CAPS), club: str = "club",
               group: str = "grp") -> DataFrame:
    """The best plan per club, fit condition, budget and cap on additions.

    ``candidates`` holds (club, id, group, price, value, sd, score); with the fit condition only
    those with a score above zero count. Cost, total, ids in and out, variance of the change. Of plans
    with the greatest total the cheapest stands, then the one of fewest additions, then of smallest ids.
    A club's groups meet in one task, which sees only the groups' choices worth keeping, of many clubs at once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    k, most = max(caps), max(budgets)
    groups = list(groups)
    both = candidates.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("fit"))
    both = both.filter((~F.col("fit") | (F.col("score") > 0)) & (F.col("price") <= most)).drop("score")
    base = own_parts(own, shape, club, group, k)
    sets = checkpointed(choices(skyline(both, [club, "fit", group], k), [club, "fit", group], k, most))
    none = base.filter("a = 0").select(club, F.explode(F.array(F.lit(False), F.lit(True))).alias("fit"), group, "a", F.lit(0.0).alias("cost"), F.col("_value").alias("total"),
                                       F.lit(0.0).alias("var"), F.array().cast("array<bigint>").alias("in_ids"), "out_ids")
    some = sets.join(base, [club, group, "a"]).select(club, "fit", group, "a", "cost", (F.col("total") + F.col("_value")).alias("total"), (F.col("var") + F.col("_var")).alias("var"),
                                                      "in_ids", "out_ids")
    asked = shape.groupBy(club).agg(F.count(F.lit(1)).alias("_groups"))
    parts = none.unionByName(some).join(asked, club)

    id_type = base.schema["out_ids"].dataType
    fields = [(club, to_arrow_type(own.schema[club].dataType)), ("fit", pa.bool_()), ("budget", pa.float64()), ("cap", pa.int32()), ("total", pa.float64()), ("cost", pa.float64()),
              ("in_ids", pa.list_(pa.int64())), ("out_ids", to_arrow_type(id_type)), ("var", pa.float64())]
    schema = (f"{club} {own.schema[club].dataType.simpleString()}, fit boolean, budget double, cap int, total double, cost double, in_ids array<bigint>, "
              f"out_ids {id_type.simpleString()}, var double")

    def best(table: pa.Table) -> pa.Table:
        fronts = _Fronts(k, most)
        seg, first = _sets(table, [club, "fit"])
        names = pc.index_in(table.column(group).combine_chunks(), value_set=pa.array(groups, table.schema.field(group).type))
        names = pc.fill_null(names, -1).to_numpy(zero_copy_only=False)
        # clubs with a choice in every group their shape asks for
        present = np.zeros((len(first), len(groups)), bool)
        present[seg[names >= 0], names[names >= 0]] = True
        whole = present.sum(1) == table.column("_groups").to_numpy()[first]
        plan, seen = None, np.zeros(len(first), bool)
        for g in range(len(groups)):
            at = np.flatnonzero((names == g) & whole[seg])
            rows = np.full((len(at), len(groups)), -1, np.int64)
            rows[:, g] = at
            step = fronts.joined([_fronts_of(table.take(pa.array(at)), seg[at], k, rows)])
            if plan is not None:
                # a club whose groups so far have no choice together has none at all
                lost = seen.copy()
                lost[plan[0]] = False
                step = fronts.merged(plan, tuple(x[~lost[step[0]]] for x in step))
            plan, seen = step, seen | (present[:, g] & whole)
        found = []
        order = np.lexsort((plan[1], plan[2], -plan[3], plan[0]))
        for b in budgets:
            for cap in caps:
                some = order[(plan[2][order] <= b + 1e-9) & (plan[1][order] <= cap)]
                if np.isnan(plan[3][some]).any():
                    # a missing total stands where it has the fewest additions
                    fewest = np.full(len(first), k + 1)
                    np.minimum.at(fewest, plan[0][some], plan[1][some])
                    some = some[np.lexsort((~(np.isnan(plan[3][some]) & (plan[1][some] == fewest[plan[0][some]])), plan[0][some]))]
                some = some[np.concatenate([[True], plan[0][some][1:] != plan[0][some][:-1]])] if len(some) else some
                found.append((some, np.full(len(some), float(b)), np.full(len(some), cap)))
        at, budget, cap = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = plan[6][at]
        lists = table.column("out_ids").combine_chunks().take(pa.array(rows[rows >= 0]))
        sizes = np.zeros(rows.shape, np.int64)
        sizes[rows >= 0] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        out_ids = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes.sum(1))]).astype(np.int32), lists.flatten())
        of = pa.array(first[plan[0][at]])
        columns = [table.column(club).take(of).combine_chunks(), table.column("fit").take(of).combine_chunks(), pa.array(budget, pa.float64()), pa.array(cap, pa.int32()),
                   pa.array(plan[3][at]), pa.array(plan[2][at]), _id_lists(plan[5][at]), out_ids, pa.array(plan[4][at])]
        return pa.Table.from_arrays(columns, names=[n for n, _ in fields]).cast(pa.schema(fields))

    batches = max(partitions(own), -(-sets.count() // (4 * BATCH)))
    return _batched(parts, [club, "fit"], batches).applyInArrow(best, schema)


def baselines(own: DataFrame, shape: DataFrame, club: str = "club", group: str = "grp") -> DataFrame:
    """The best ten of own players alone; clubs whose own players do not fill the shape stay out."""
    parts = own_parts(own, shape, club, group, 0)
    filled = parts.groupBy(club).agg(F.sum("_value").alias("base"), F.count(F.lit(1)).alias("_n"))
    asked = shape.groupBy(club).agg(F.count(F.lit(1)).alias("_all"))
    return filled.join(asked, club).filter(F.col("_n") == F.col("_all")).select(club, "base")


def with_gain(plans: DataFrame, base: DataFrame, club: str = "club") -> DataFrame:
    """Gain over the baseline and its interval from the players in one ten but not the other."""
    out = plans.join(base, club, "left").withColumn("gain", F.col("total") - F.col("base"))
    half = INTERVAL_Z * F.sqrt("var")
    return out.withColumns({"low": F.col("gain") - half, "high": F.col("gain") + half})


def infeasible(own: DataFrame, candidates: DataFrame, shape: DataFrame, budgets: Sequence[float],
               caps: Sequence[int], club: str = "club", group: str = "grp") -> DataFrame:
    """Per club, budget and cap the first reason no plan exists, null where one does."""
    counts = own.groupBy(club, group).agg(F.count(F.lit(1)).alias("_own"))
    needs = shape.join(counts, [club, group], "left").withColumn(
        "need", F.greatest(F.lit(0), F.col("places") - F.coalesce("_own", F.lit(0))))
    w = Window.partitionBy(club, group).orderBy("price", "id")
    cheap = _first(candidates.withColumn("_n", F.row_number().over(w)), needs, "need", club, group)
    fill = needs.join(cheap.select(club, group, "_n", "price"), [club, group], "left").groupBy(club, group, "need").agg(
        F.count("_n").alias("_have"), F.coalesce(F.sum(F.when(F.col("_n") <= F.col("need"), F.col("price"))), F.lit(0.0)).alias("_cost"))
    per = fill.groupBy(club).agg(F.sum("need").alias("needed"), F.max((F.col("_have") < F.col("need"))).alias("_few"),
                                 F.sum("_cost").alias("_cheapest"))
    grid = F.array(*[F.struct(F.lit(float(b)).alias("budget"), F.lit(c).alias("cap")) for b in budgets for c in caps])
    reason = (F.when(F.col("needed") > F.col("cap"), REASONS[0]).when(F.col("_few"), REASONS[1])
              .when(F.col("_cheapest") > F.col("budget"), REASONS[2]))
    return per.select("*", F.inline(grid)).select(club, "budget", "cap", "needed", reason.alias("reason"))


def broken_plans(plans: DataFrame, own: DataFrame, candidates: DataFrame, shape: DataFrame, club: str = "club", group: str = "grp") -> DataFrame:
    """Plans that break a rule: too dear, too many additions, an addition that is no candidate or
    does not fit, an own player bought, one left out who is not own, or a group not filled exactly."""
    key = [club, "fit", "budget", "cap"]
    bought = plans.select(*key, "cost", F.explode_outer("in_ids").alias("id"))
    known = candidates.select(club, "id", F.col("price").alias("_p"), F.col("score").alias("_s"), F.col(group).alias("_g"))
    j = bought.join(known, [club, "id"], "left").join(own.select(club, "id", F.lit(True).alias("_own")), [club, "id"], "left")
    bad = F.col("id").isNotNull() & (F.col("_p").isNull() | (F.col("fit") & ~(F.col("_s") > 0)) | F.col("_own").isNotNull())
    per = j.groupBy(*key).agg(F.count("id").alias("_n"), F.coalesce(F.sum("_p"), F.lit(0.0)).alias("_sum"), F.max(bad.cast("int")).alias("_bad"), F.first("cost").alias("cost"))
    rules = per.filter((F.col("_n") > F.col("cap")) | (F.col("_sum") > F.col("budget") + 1e-6) | (F.col("_bad") == 1)
                       | (F.abs(F.col("_sum") - F.col("cost")) > 1e-6)).select(*key)
    # each group's players: the best own ones up to its places, less those left out, and the additions
    best = Window.partitionBy(club, group).orderBy(F.desc("value"), "id")
    top = _first(own.withColumn("_n", F.row_number().over(best)), shape, "places", club, group).groupBy(club, group).agg(F.count(F.lit(1)).alias("_top"))
    left = plans.select(*key, F.explode("out_ids").alias("id")).join(own.select(club, "id", F.col(group).alias("_g")), [club, "id"], "left")
    moves = j.filter("id is not null").select(*key, F.col("_g").alias(group), F.lit(1).alias("_d")).unionByName(left.select(*key, F.col("_g").alias(group), F.lit(-1).alias("_d")))
    moves = moves.groupBy(*key, group).agg(F.sum("_d").alias("_d"))
    asked = plans.select(*key).join(shape.join(top, [club, group], "left"), club)
    filled = asked.join(moves, [*key, group], "left")
    unfilled = filled.filter(F.coalesce("_top", F.lit(0)) + F.coalesce("_d", F.lit(0)) != F.col("places")).select(*key)
    strange = moves.join(shape.select(club, group, "places"), [club, group], "left").filter("places is null").select(*key)
    return rules.unionByName(unfilled).unionByName(strange).distinct()


#: Parts of a group whose least hashes bound what a draw can take: so many of so many slices.
PARTS, SLICES = 16, 256


def random_squads(rows: DataFrame, quotas: dict[str, int], budget: Column, draws: int, seed: int = 0,
                  group: str = "grp", id: str = "id") -> DataFrame:
    """Per draw the first rows of each group in hash order up to its quota, kept within budget.

    The quota-th of the least hashes of some slices of a group is no less than the quota-th of all its rows, so only rows up to it
    are ordered: a few times slices by quota, however large the group. A group in too few of the slices is ordered whole.
    Every row is hashed for every draw, on all tasks: the rows are few for the work they make.
    """
    quota = F.create_map(*[F.lit(x) for p in quotas.items() for x in p])
    spread = rows.filter(F.col(group).isin(*quotas)).repartition(partitions(rows), id).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    spread = spread.withColumn("_h", hashed(F.lit(seed), F.col("draw"), F.col(id)))
    part = F.pmod(F.xxhash64(id), F.lit(SLICES))
    least = spread.filter(part < max(PARTS, 2 * max(quotas.values()))).groupBy("draw", group, part.alias("_part")).agg(F.min("_h").alias("_least"))
    bounds = least.groupBy("draw", group).agg(F.array_sort(F.collect_list("_least")).alias("_bounds")).select(
        "draw", group, F.get("_bounds", quota[F.col(group)] - 1).alias("_bound"))
    spread = lookup(spread, bounds, ["draw", group]).filter(F.col("_bound").isNull() | (F.col("_h") <= F.col("_bound")))
    w = Window.partitionBy("draw", group).orderBy("_h", id)
    picked = spread.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(quotas.values())).filter(
        F.col("_n") <= quota[F.col(group)])
    per = picked.groupBy("draw").agg(F.sum("price").alias("cost"), F.sum("value").alias("value"), F.count(F.lit(1)).alias("players"))
    return per.filter(F.col("cost") <= budget)


def cheapest_fill(drawn: DataFrame, quotas: dict[str, int], group: str = "grp") -> DataFrame:
    """Per replicate the rows each group has against its quota and the cost of the cheapest fill."""
    quota = F.create_map(*[F.lit(x) for p in quotas.items() for x in p])
    kept = drawn.filter(F.col(group).isin(*quotas))
    w = Window.partitionBy("replicate", group).orderBy("price", "id")
    top = kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max(quotas.values())).filter(
        F.col("_n") <= quota[F.col(group)])
    per = top.groupBy("replicate").agg(F.count(F.lit(1)).alias("filled"), F.sum("price").alias("cost"))
    return per.withColumn("short", F.col("filled") < sum(quotas.values()))


def squad_tally(records: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Replicates where a's squad does better than b's, is the same squad, or ties."""
    wide = records.groupBy(*by, "replicate").agg(*[
        F.max(F.when(F.col("predictor") == p, F.col(c))).alias(f"{c}_{p}") for p in (a, b) for c in ("squad", "actual")])
    same = F.col(f"squad_{a}") == F.col(f"squad_{b}")
    x, y = F.col(f"actual_{a}"), F.col(f"actual_{b}")
    return wide.groupBy(*by).agg(F.count_if(~same & (x > y)).alias("wins"), F.count_if(same).alias("identical"),
                                 F.count_if(~same & (x == y)).alias("ties"), F.count(F.lit(1)).alias("replicates"))
