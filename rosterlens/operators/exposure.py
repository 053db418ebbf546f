"""Season windows, exposure totals and value rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import group_values, lookup, value_ranks

# A season splits at this share of its days, and rates are per 90 minutes.
WINDOW_SHARE = 0.6
PER = 90.0


def boundary(day: Column, share: float = WINDOW_SHARE) -> Column:
    """Last day of the first window, from the last day of the season."""
    return F.ceil(F.lit(share) * day).cast("int")


def boundaries(games: DataFrame, by: Sequence[str], day: str = "game_day",
               share: float = WINDOW_SHARE) -> DataFrame:
    last = F.max(day)
    return games.groupBy(*by).agg(last.alias("last_day"), boundary(last, share).alias("boundary"))


def assign_windows(games: DataFrame, by: Sequence[str], day: str = "game_day",
                   share: float = WINDOW_SHARE, name: str = "win") -> DataFrame:
    """1 up to the group's boundary, 2 after it, null without a day."""
    cut = boundaries(games, by, day, share).select(*by, "boundary")
    window = F.when(F.col(day) <= F.col("boundary"), 1).when(F.col(day) > F.col("boundary"), 2)
    return lookup(games, cut, by).withColumn(name, window).drop("boundary")


def date_violations(games: DataFrame, by: Sequence[str], date: str, window: str = "win") -> DataFrame:
    """How far the dates of two windows overlap, per group."""
    in1, in2 = F.col(window) == 1, F.col(window) == 2
    edges = games.groupBy(*by).agg(
        F.min(F.when(in1, F.col(date))).alias("first_w1"),
        F.max(F.when(in1, F.col(date))).alias("last_w1"),
        F.min(F.when(in2, F.col(date))).alias("first_w2"),
        F.max(F.when(in2, F.col(date))).alias("last_w2"))
    late = in1 & (F.col(date) > F.col("first_w2"))
    early = in2 & (F.col(date) < F.col("last_w1"))
    gap = F.when(late, F.datediff(date, "first_w2")).when(early, F.datediff("last_w1", date))
    return lookup(games, edges, by).groupBy(*by).agg(
        F.count_if(late).alias("w1_after_first_w2"), F.count_if(early).alias("w2_before_last_w1"),
        F.first("first_w1").alias("first_w1"), F.first("last_w1").alias("last_w1"),
        F.first("first_w2").alias("first_w2"), F.first("last_w2").alias("last_w2"),
        F.coalesce(F.max(gap), F.lit(0)).cast("double").alias("largest_days"))


def exposure(rows: DataFrame, keys: Sequence[str], minutes: str = "minutes",
             starter: Column | None = None) -> DataFrame:
    """Summed minutes, games with minutes above zero and starts per key."""
    starts = [] if starter is None else [F.count_if(starter).alias("starts")]
    return rows.groupBy(*keys).agg(
        F.sum(minutes).alias("minutes"), F.count_if(F.col(minutes) > 0).alias("games"), *starts)


def exposure_grains(rows: DataFrame, team_keys: Sequence[str], keys: Sequence[str], label: str,
                    order: Sequence[str], minutes: str = "minutes") -> DataFrame:
    """Exposure by team and key and by key alone, each with the label of its first row.

    One pass over the rows at the finer grain; the coarser grain adds those up.
    """
    first = F.struct(*order)
    fine = rows.groupBy(*team_keys, *keys).agg(
        F.sum(minutes).alias("minutes"), F.count_if(F.col(minutes) > 0).alias("games"),
        F.min_by(label, first).alias("label"), F.min(first).alias("_first"))
    coarse = fine.groupBy(*keys).agg(
        F.sum("minutes").alias("minutes"), F.sum("games").alias("games"),
        F.min_by("label", "_first").alias("label"))
    return (fine.drop("_first").withColumn("grain", F.lit("team"))
            .unionByName(coarse.withColumn("grain", F.lit("entity")), allowMissingColumns=True))


def rate(value: Column, minutes: Column) -> Column:
    return value / minutes * PER


def per_ninety(rows: DataFrame, values: Mapping[str, str], minutes: str = "minutes") -> DataFrame:
    """Rates of the rows with minutes: name -> value column."""
    kept = rows.filter(F.col(minutes) > 0)
    return kept.withColumns({n: rate(F.col(v), F.col(minutes)) for n, v in values.items()})


def value_table(exposed: DataFrame, values: DataFrame, keys: Sequence[str],
                sums: Sequence[str], minutes: str = "minutes") -> DataFrame:
    """Summed values next to summed exposure, 0 where none, then the rate of the first sum."""
    totals = values.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in sums}
    joined = exposed.join(totals, list(keys), "left").withColumns(zero)
    return per_ninety(joined, {"per_ninety": sums[0]}, minutes)


def window_values(rows: DataFrame, keys: Sequence[str], sums: Sequence[str],
                  minutes: str = "minutes") -> DataFrame:
    """Exposure and value in one pass, when one table holds both."""
    totals = rows.groupBy(*keys).agg(
        F.sum(minutes).alias("minutes"), F.count_if(F.col(minutes) > 0).alias("games"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums])
    return per_ninety(totals, {"per_ninety": sums[0]})


def levels(rows: DataFrame, by: Sequence[str], value: str = "value",
           minutes: str = "minutes") -> DataFrame:
    """Value per 90 over a whole cell: a ratio of sums."""
    return rows.groupBy(*by).agg((PER * F.sum(value) / F.sum(minutes)).alias("level"))


def centred_rates(rows: DataFrame, by: Sequence[str], rate_column: str = "per_ninety",
                  value: str = "value", minutes: str = "minutes") -> DataFrame:
    joined = lookup(rows, levels(rows, by, value, minutes), by)
    return joined.withColumn("centred", F.col(rate_column) - F.col("level"))


def provider_minutes(links: DataFrame, key: str, how: str, minutes: str = "minutes",
                     link_pass: str = "link_pass", passes: int = 1) -> DataFrame:
    """Sum or largest of the minutes of an id's links made in the first passes."""
    agg = {"sum": F.sum, "max": F.max}[how]
    return links.filter(F.col(link_pass) <= passes).groupBy(key).agg(agg(minutes).alias("minutes"))


def season_main(rows: DataFrame, key: str, parts: Mapping[str, str], minimum: float,
                minutes: str = "minutes") -> DataFrame:
    """Per key its total and, per part (name -> column), the value with most minutes, ties to the
    lowest; keys below the minimum total left out."""
    out = rows.groupBy(key).agg(F.sum(minutes).alias("total"))
    out = out.filter(F.col("total") >= minimum)
    for name, column in parts.items():
        per = rows.groupBy(key, column).agg(F.sum(minutes).alias("_m"))
        main = per.groupBy(key).agg(F.min_by(column, F.struct(-F.col("_m"), column)).alias(name))
        out = out.join(main, key)
    return out


def window_pairs(table: DataFrame, keys: Sequence[str], window: str = "win",
                 columns: Sequence[str] = ("per_ninety", "minutes")) -> DataFrame:
    """One row per key found in both windows, each column once per window."""
    aggs = [F.max(F.when(F.col(window) == w, F.col(c))).alias(f"{c}_w{w}")
            for w in (1, 2) for c in columns]
    both = [F.count_if(F.col(window) == w).alias(f"_n{w}") for w in (1, 2)]
    out = table.groupBy(*keys).agg(*aggs, *both)
    return out.filter("_n1 > 0 and _n2 > 0").drop("_n1", "_n2")


def threshold_sensitivity(pairs: DataFrame, thresholds: Sequence[tuple[int, int]],
                          x: str = "per_ninety_w1", y: str = "per_ninety_w2",
                          m1: str = "minutes_w1", m2: str = "minutes_w2") -> DataFrame:
    """Pairs kept and correlations for each pair of minimum minutes; the grid is a constant."""
    grid = F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a, b in thresholds])
    kept = pairs.select("*", F.explode(grid).alias("_t")).select("*", "_t.*").drop("_t")
    kept = kept.filter((F.col(m1) >= F.col("t1")) & (F.col(m2) >= F.col("t2")))
    plain = kept.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("pairs"), F.corr(x, y).alias("pearson"))
    return plain.join(spearman(kept, ["t1", "t2"], x, y), ["t1", "t2"])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "spearman",
             rows: int | None = None) -> DataFrame:
    """Correlation of middle ranks per group; null where either side has no spread."""
    keys = list(keys)
    cells = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
             .groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_n")))
    ranked = {v: value_ranks(cells, keys, v, "_n", rows) for v in ("_x", "_y")}
    for v, r in ranked.items():
        centred = (F.col("middle_rank") - (F.col("total") + 1) / 2).alias(f"_r{v}")
        cells = lookup(cells, r.select(*keys, v, centred), [*keys, v], "inner")
    a, b, n = F.col("_r_x"), F.col("_r_y"), F.col("_n")
    sums = cells.groupBy(*keys).agg(
        F.sum(n * a * b).alias("_ab"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"))
    spread = (F.col("_aa") > 0) & (F.col("_bb") > 0)
    value = F.when(spread, F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))
    return sums.select(*keys, value.alias(name))


def population(table: DataFrame, keys: Sequence[str], window: str = "win", first: float = 450,
               second: float | None = None, minutes: str = "minutes",
               group: str | None = None, groups: Sequence[str] | None = None) -> DataFrame:
    """Keys with enough minutes in window 1, and in window 2 when a second minimum is given."""
    def enough(w, least):
        return table.filter((F.col(window) == w) & (F.col(minutes) >= least))

    out = enough(1, first)
    if groups is not None:
        out = out.filter(F.col(group).isin(*groups))
    if second is not None:
        late = enough(2, second).select(*keys, F.col(minutes).alias(f"{minutes}_w2"))
        out = out.join(late, list(keys))
    return out


def one_per_entity(rows: DataFrame, key: str, minutes: str, ties: Sequence[str]) -> DataFrame:
    """The whole row with most minutes per key, ties in the given order."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(-F.col(minutes), *ties)).alias("_row"))
    return best.select(key, "_row.*")


def cell_centred(rows: DataFrame, by: Sequence[str], columns: Sequence[str],
                 prefix: str = "c_") -> DataFrame:
    """Each column less its mean over the row's cell."""
    joined = group_values(rows, by, **{f"_mean_{c}": F.avg(c) for c in columns})
    return joined.withColumns(
        {f"{prefix}{c}": F.col(c) - F.col(f"_mean_{c}") for c in columns}
    ).drop(*[f"_mean_{c}" for c in columns])
