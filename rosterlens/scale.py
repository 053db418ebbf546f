"""Order, rank, quantile and lookup work that survives one group holding most of the rows.

Spark sends all rows of a window partition to one task. The helpers here find the few groups too
large for that (a count per group, combined map-side), cut them into ordered chunks at sampled
bounds and pass only one carry row per chunk between the chunks. Results never depend on the
bounds. Inputs whose size Catalyst estimates as small are not looked at first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpointed

HOT_ROWS = 2_000_000
SAMPLES_PER_CHUNK = 50
SMALL_BYTES = 32 * 1024 * 1024
#: Rows a task of an ordered table should have in the mean, as its sorts and windows hold all of them several times.
TASK_ROWS = 50_000


def hot_rows(df: DataFrame, rows: int | None = None) -> int:
    """Rows above which a group is split: argument, then session setting, then default."""
    if rows is not None:
        return rows
    return int(df.sparkSession.conf.get("rosterlens.hotRows", str(HOT_ROWS)))


def is_small(df: DataFrame) -> bool:
    """Whether the files and tables a plan reads are together small enough for one task."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return sum(sizes) <= SMALL_BYTES


def settled(df: DataFrame) -> DataFrame:
    """A table worth reading several times: stored first when it is large and costly to derive."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(word in plan for word in ("Join", "Aggregate", "Window")) and not is_small(df):
        return checkpointed(df)
    return df


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, to be asked for by number where work per byte is high."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """All groups above the limit with their sizes, or None when there are none.

    There are at most as many as the limit goes into the rows, which bounds a broadcast of them.
    """
    explicit = rows is not None
    limit = hot_rows(df, rows)
    if not explicit and is_small(df):
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    found = checkpointed(counts)
    return None if found.isEmpty() else found


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """A large table in more tasks than the session's when its rows ask for it, each group whole in one of them."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if keys and tasks > partitions(df) else df


def _bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot: DataFrame, limit: int):
    """Split points of each hot group: evenly spaced in a hash sample of its order values."""
    chunks = F.ceil(F.col("_rows") / F.lit(limit)).cast("int")
    hot = hot.withColumn("_chunks", chunks).withColumn(
        "_every", F.greatest(F.lit(1), F.floor(F.col("_rows") / (chunks * SAMPLES_PER_CHUNK)))
    )
    sample = (
        df.join(F.broadcast(hot.withColumnsRenamed({k: f"_h_{k}" for k in keys})),
                reduce(lambda a, b: a & b,
                       [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True)))
        .filter(F.pmod(F.xxhash64(*order), F.col("_every")) == 0)
        .groupBy(*keys, "_chunks")
        .agg(F.array_sort(F.collect_set(F.struct(*order))).alias("_sample"))
    )
    points = F.expr(
        "transform(sequence(1, greatest(1, _chunks - 1)),"
        " i -> _sample[cast(floor(i * size(_sample) / _chunks) as int)])"
    )
    found = sample.select(*[F.col(k).alias(f"_h_{k}") for k in keys], points.alias("_points"))
    stored = checkpointed(found)
    return None if stored.isEmpty() else stored


class Ordered:
    """A table in a tie-free ascending order inside each group.

    The methods add columns and return a new Ordered; ``df`` is the table. All windows share one
    partitioning and one sort, so they cost a single shuffle.
    """

    OPS = {"sum": F.sum, "min": F.min, "max": F.max}

    def __init__(self, df, keys, order, rows=None, _state=None):
        self.keys, self.order = list(keys), list(order)
        if _state is not None:
            self._df, self._hot = df, _state
            return
        df = settled(df)
        hot, points = None, None
        if rows is not None or not is_small(df):
            sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
            total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
            if (largest or 0) > hot_rows(df, rows):
                hot = hot_groups(df, keys, rows)
            else:
                df = spread(df, self.keys, total or 0)
        if hot is not None:
            points = _bounds(df, keys, order, hot, hot_rows(df, rows))
        if points is None:
            self._df, self._hot = df, None
            return
        here = F.struct(*[F.col(c) for c in order])
        self._df = (
            df.join(F.broadcast(points),
                    reduce(lambda a, b: a & b,
                           [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], F.lit(True)),
                    "left")
            .withColumn("_chunk", F.coalesce(
                F.size(F.filter("_points", lambda p: p <= here)), F.lit(0)))
            .drop("_points", *[f"_h_{k}" for k in keys])
        )
        self._hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])

    def _next(self, df):
        return Ordered(df, self.keys, self.order, _state=self._hot) if self._hot is not None else (
            _plain(df, self.keys, self.order))

    def _window(self, ahead=False):
        """Rows before each row; ``ahead`` turns the order round, as a frame that starts at each
        row and runs to the end would be evaluated anew for every row."""
        part = self.keys + (["_chunk"] if self._hot is not None else [])
        order = [F.desc(c) if ahead else F.asc(c) for c in self.order]
        return Window.partitionBy(*part).orderBy(*order)

    def _chunk_rows(self, *aggs):
        """One row per chunk of the hot groups."""
        hot = self._df.join(
            F.broadcast(self._hot),
            reduce(lambda a, b: a & b,
                   [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in self.keys], F.lit(True)),
            "left_semi")
        return hot.groupBy(*self.keys, "_chunk").agg(*aggs)

    def _carry(self, df, carry):
        """Joins the carry rows, at most one per chunk, so their broadcast is bounded."""
        on = [*self.keys, "_chunk"]
        carry = carry.withColumnsRenamed({k: f"_k_{k}" for k in on})
        condition = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in on]
        joined = df.join(F.broadcast(carry), reduce(lambda a, b: a & b, condition), "left")
        return joined.drop(*[f"_k_{k}" for k in on])

    def _cumulate(self, values, ahead):
        w = self._window(ahead).rowsBetween(Window.unboundedPreceding, 0)
        df = self._df.select(
            "*", *[self.OPS[op](c).over(w).alias(n) for n, (op, c) in values.items()])
        if self._hot is None:
            return self._next(df)
        per = self._chunk_rows(*[self.OPS[op](c).alias(f"_c_{n}") for n, (op, c) in values.items()])
        frame = (1, Window.unboundedFollowing) if ahead else (Window.unboundedPreceding, -1)
        over = Window.partitionBy(*self.keys).orderBy("_chunk").rowsBetween(*frame)
        carry = per.select(*self.keys, "_chunk", *[
            self.OPS[op](f"_c_{n}").over(over).alias(f"_c_{n}") for n, (op, _) in values.items()])
        df = self._carry(df, carry)
        joint = {
            "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
            "min": lambda a, b: F.least(a, b),
            "max": lambda a, b: F.greatest(a, b),
        }
        for n, (op, _) in values.items():
            df = df.withColumn(n, joint[op](F.col(n), F.col(f"_c_{n}"))).drop(f"_c_{n}")
        return self._next(df)

    def upto(self, **values: tuple[str, Column]) -> Ordered:
        """Running value from the group's start to each row: name=(op, column)."""
        return self._cumulate(values, ahead=False)

    def onward(self, **values: tuple[str, Column]) -> Ordered:
        """Running value from each row to the group's end."""
        return self._cumulate(values, ahead=True)

    def whole(self, **values: Column) -> Ordered:
        """Sum over the whole group on each row."""
        part = self.keys + (["_chunk"] if self._hot is not None else [])
        w = Window.partitionBy(*part)
        df = self._df.select("*", *[F.sum(c).over(w).alias(n) for n, c in values.items()])
        if self._hot is None:
            return self._next(df)
        per = self._chunk_rows(*[F.sum(c).alias(f"_c_{n}") for n, c in values.items()])
        all_chunks = Window.partitionBy(*self.keys)
        carry = per.select(*self.keys, "_chunk", *[
            F.sum(f"_c_{n}").over(all_chunks).alias(f"_c_{n}") for n in values])
        df = self._carry(df, carry)
        for n in values:
            df = df.withColumn(n, F.coalesce(f"_c_{n}", n)).drop(f"_c_{n}")
        return self._next(df)

    def _neighbour(self, values, step):
        w = self._window()
        cell = F.struct(*[c.alias(n) for n, c in values.items()])
        df = self._df.withColumn("_near", F.lag(cell, step).over(w))
        near = F.col("_near")
        if self._hot is not None:
            pick = F.max_by if step > 0 else F.min_by
            per = self._chunk_rows(pick(cell, F.struct(*self.order)).alias("_edge"))
            over = Window.partitionBy(*self.keys).orderBy("_chunk")
            carry = per.select(*self.keys, "_chunk", F.lag("_edge", step).over(over).alias("_edge"))
            df = self._carry(df, carry)
            near = F.coalesce(F.col("_near"), F.col("_edge"))
        df = df.select("*", *[near[n].alias(n) for n in values]).drop("_near", "_edge")
        return self._next(df)

    def before(self, **values: Column) -> Ordered:
        """Values of the previous row, null on the first."""
        return self._neighbour(values, 1)

    def after(self, **values: Column) -> Ordered:
        """Values of the next row, null on the last."""
        return self._neighbour(values, -1)

    def with_columns(self, **columns: Column) -> Ordered:
        return self._next(self._df.withColumns(columns))

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_chunk")


def _plain(df, keys, order):
    out = Ordered.__new__(Ordered)
    out.keys, out.order, out._df, out._hot = list(keys), list(order), df, None
    return out


def numbered(df, keys, order, name="position", rows=None) -> DataFrame:
    """Row number from 1 in a tie-free ascending order inside each group."""
    return Ordered(df, keys, order, rows).upto(**{name: ("sum", F.lit(1))}).df


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None,
                rows: int | None = None) -> DataFrame:
    """Per group and distinct value: rows holding it, rows below it, rows in all, middle rank.

    Rows with the same value are combined first, so a value held by many rows is one row here.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("rows"))
    o = Ordered(counts, keys, [value], rows)
    o = o.upto(_upto=("sum", F.col("rows"))).whole(total=F.col("rows"))
    return o.df.select(
        *keys, value, "rows",
        (F.col("_upto") - F.col("rows")).alias("below"),
        "total",
        (F.col("_upto") - (F.col("rows") - 1) / 2).alias("middle_rank"),
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
              rows: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per name."""
    ranked = value_ranks(df, keys, value, rows=rows)
    aggs = []
    for name, p in probs.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)

        def held(spot):
            return (F.col("below") <= spot) & (spot < F.col("below") + F.col("rows"))

        # a value's share in the interpolation; one that holds both ends is taken as it is
        v, part = F.col(value).cast("double"), place - low
        share = (F.when(held(low) & held(high), v).when(held(low), v * (1 - part))
                 .when(held(high), v * part))
        aggs.append(F.sum(share).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join to a table holding each key once.

    The strategy is Spark's, by measured size. A hot key's rows are spread over several tasks by
    the adaptive skew join; a session that sets spark.sql.adaptive.forceOptimizeSkewedJoin has it
    do so even if a later step must shuffle again.
    """
    return big.join(small, list(on), how)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], condition: Column | None,
                spread: Sequence[str], rows: int | None = None) -> DataFrame:
    """Inner join of two row sets on shared keys, hot keys spread over several tasks.

    Each left row of a hot key goes to one salt, picked by a hash of ``spread``; the right rows of
    that key are copied to every salt. Other keys have one salt.
    """
    on = list(on)
    limit = hot_rows(left, rows)
    hot = hot_groups(left.select(*on), on, rows)
    if hot is None:
        joined = left.join(right, on)
        return joined if condition is None else joined.filter(condition)
    salts = F.broadcast(hot.select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts")))
    pick = F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    one = left.join(salts, on, "left").withColumn("_salt", pick).drop("_salts")
    two = (right.join(salts, on, "left")
           .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
           .drop("_salts"))
    joined = one.join(two, [*on, "_salt"]).drop("_salt")
    return joined if condition is None else joined.filter(condition)


def group_values(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Each row with aggregates of its group: combined map-side, then looked up."""
    per = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return lookup(df, per, keys, "inner")
