"""Contracts and reports on keys, text, totals and ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, quantiles


class ContractError(ValueError):
    """A table breaks a stated rule."""


def require_empty(df: DataFrame, what: str) -> None:
    """Stops with a few examples when rows are found."""
    found = df.limit(3).collect()
    if found:
        raise ContractError(f"{what}: {[r.asDict() for r in found]}")


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of a key held more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return lookup(df, twice, keys, "left_semi")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "duplicate key") -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    require_empty(twice, what)
    return df


def held_once(df: DataFrame, keys: Sequence[str], what: str = "duplicate key") -> DataFrame:
    """The rows, checked within the plan: running it stops at a key held more than once.

    Grouping deals rows by the keys, so a join on them needs no shuffle of its own, and the input is read once.
    """
    others = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in others])
    stop = F.raise_error(F.concat(F.lit(f"{what}: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return one.filter(F.when(F.col("_rows") == 1, F.lit(True)).otherwise(stop)).select(*df.columns)


# Marks of text decoded with the wrong table, or not unescaped.
SUSPICIOUS = ["Ã", "Â", "\\"]


def suspicious_text(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                    marks: Sequence[str] = tuple(SUSPICIOUS)) -> DataFrame:
    """(key, column, value) of the text columns present whose value holds a mark."""
    held = [c for c in columns if c in df.columns]
    long = df.select(*keys, *held).unpivot(list(keys), held, "column", "value")
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.col("value").contains(m)
    return long.filter(hit)


def extreme_totals(totals: DataFrame, by: str, keys: Sequence[str], n: int,
                   largest: bool = False) -> DataFrame:
    """The n lowest or highest totals under a full order."""
    first = F.desc(by) if largest else F.asc(by)
    return totals.orderBy(first, *keys).limit(n)


def with_counts(rows: DataFrame, events: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The number of matching events per row, 0 where none."""
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return rows.join(counts, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)))


def last_minutes(events: DataFrame, keys: Sequence[str], period: str, seconds: str) -> DataFrame:
    """Per key a map of period to its last minute, and eleven times their sum."""
    per = events.groupBy(*keys, period).agg(F.round(F.max(F.col(seconds)) / 60, 1).alias("_minute"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(period), F.col("_minute"))))
    return per.groupBy(*keys).agg(
        F.map_from_entries(pairs).alias("last_minutes"),
        (F.sum("_minute") * 11).alias("expected"))


def key_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by one side only, with the side."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    return both.withColumn("side", side).filter("side is not null").drop("_l", "_r")


def row_gaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side holds."""
    right = right.select(*left.columns)
    return (left.exceptAll(right).withColumn("side", F.lit("left_only"))
            .unionByName(right.exceptAll(left).withColumn("side", F.lit("right_only"))))


def orphans(facts: DataFrame, dimension: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How many facts no dimension row covers, and their summed value."""
    alone = facts.join(dimension.select(*keys).distinct(), list(keys), "left_anti")
    return alone.agg(F.count(F.lit(1)).alias("rows"),
                     F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))


def count_spread(units: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest, median and highest events per unit, units without events counted as 0."""
    per = with_counts(units, events, keys, "n")
    middle = quantiles(per, [], "n", {"median": 0.5})
    return per.agg(F.min("n").alias("lowest"), F.max("n").alias("highest"),
                   F.count_if(F.col("n") == 0).alias("empty")).join(middle)


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str],
              tolerance: float = 1e-9, exact: Sequence[str] = ()) -> DataFrame:
    """Keys whose values differ by more than the tolerance, or whose counts differ at all; a
    missing side counts as -1."""
    columns = [*values, *exact]
    a = left.select(*keys, *[F.col(c).alias(f"{c}_l") for c in columns])
    b = right.select(*keys, *[F.col(c).alias(f"{c}_r") for c in columns])
    j = a.join(b, list(keys), "full_outer")
    gap = {c: F.abs(F.coalesce(f"{c}_l", F.lit(-1)) - F.coalesce(f"{c}_r", F.lit(-1)))
           for c in columns}
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | (gap[c] > (0 if c in exact else tolerance))
    return j.filter(wrong)


def relative_gap(a: Column, b: Column) -> Column:
    """|a - b| over the largest of 1, |a| and |b|; both null 0, one null infinite."""
    size = F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    return (F.when(a.isNull() & b.isNull(), 0.0)
            .when(a.isNull() | b.isNull(), F.lit(float("inf")))
            .otherwise(F.abs(a - b) / size))


def reason(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The first reason that applies."""
    first, *rest = rules
    out = F.when(first[1], first[0])
    for name, holds in rest:
        out = out.when(holds, name)
    return out.otherwise(default)


def shared_ids(links: DataFrame, entity: str, linked: str) -> DataFrame:
    """Linked ids held by more than one entity."""
    per = links.filter(F.col(linked).isNotNull()).groupBy(linked)
    return per.agg(F.count_distinct(entity).alias("_n")).filter("_n > 1").select(linked)


def numeric_leaves(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, path, value) of every number in a table, arrays and structs opened."""
    parts: list[tuple[str, Column]] = []
    arrays: list[tuple[str, str]] = []

    def walk(path, column, kind):
        name = kind.typeName()
        if name == "struct":
            for f in kind.fields:
                walk(f"{path}.{f.name}", column.getField(f.name), f.dataType)
        elif name == "array":
            arrays.append((path, kind.elementType.typeName()))
        elif name in ("byte", "short", "integer", "long", "float", "double"):
            parts.append((path, column))

    for field in df.schema.fields:
        if field.name not in keys:
            walk(field.name, F.col(field.name), field.dataType)
    cells = F.array(*[F.struct(F.lit(p).alias("path"), c.cast("double").alias("value"))
                      for p, c in parts])
    numeric = [p for p, kind in arrays if kind in ("integer", "long", "float", "double")]
    for p in numeric:
        cells = F.concat(cells, F.transform(
            F.coalesce(F.col(p).cast("array<double>"), F.array().cast("array<double>")),
            lambda x, p=p: F.struct(F.lit(f"{p}.*").alias("path"), x.alias("value"))))
    out = df.select(*keys, F.explode(cells).alias("_leaf"))
    return out.select(*keys, "_leaf.path", "_leaf.value").filter("value is not null")


def number_report(leaves: DataFrame, ids: Sequence[str], ceiling: float = 10_000) -> DataFrame:
    """Numbers that are not finite, those at the ceiling or above outside id places, the largest."""
    free = ~F.col("path").isin(*ids)
    v = F.col("value")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    return leaves.agg(
        F.count_if(odd).alias("not_finite"), F.count_if(free & ~odd & (v >= ceiling)).alias("too_large"),
        F.max(F.when(free & ~odd, v)).alias("largest"))


def value_range(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Lowest, highest and the count outside the open interval (0, 1), per column."""
    long = df.unpivot(list(by), list(columns), "column", "value")
    v = F.col("value")
    return long.groupBy(*by, "column").agg(
        F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.count_if((v <= 0) | (v >= 1)).alias("outside"), F.count(v).alias("rows"))


def counts_table(df: DataFrame, row: str, column: str, classes: Sequence[str]) -> DataFrame:
    """Cross-tab with absent classes 0."""
    return df.groupBy(row).pivot(column, list(classes)).count().na.fill(0)


def null_counts(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
