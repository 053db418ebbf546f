"""Cohorts of entities that moved: earliest moves, mirror moves and their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup

# The horizon of a mirror move in months, regular minutes in a season.
MIRROR_MONTHS = 36
REGULAR = 450


def months_before(date: Column, months: int = MIRROR_MONTHS) -> Column:
    return F.add_months(date, -months)


def months_after(date: Column, months: int = MIRROR_MONTHS) -> Column:
    return F.add_months(date, months)


def qualifying_moves(moves: DataFrame, main: DataFrame, player: str = "player", club: str = "main_club",
                     between: tuple[Column, Column] | None = None) -> DataFrame:
    """Moves in the window out of the player's main club to another club."""
    kept = moves if between is None else moves.filter(F.col("date").between(*between))
    kept = kept.filter(F.col("from_club") != F.col("to_club"))
    own = main.select(player, F.col(club).alias("from_club"))
    return lookup(kept, own, [player, "from_club"], "inner")


def earliest_moves(moves: DataFrame, player: str, order: Sequence[str], legacy: bool = False) -> DataFrame:
    """Per player the earliest move: the whole row, or in legacy form the first non-null value of
    each column, which can join a later move's fee to the earliest date."""
    rest = [c for c in moves.columns if c != player]
    at = F.struct(*order)
    if legacy:
        return moves.groupBy(player).agg(*[
            F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])
    return moves.groupBy(player).agg(F.min_by(F.struct(*rest), at).alias("_row")).select(player, "_row.*")


def mirror_labels(movers: DataFrame, moves: DataFrame, key: Sequence[str], low: Column, high: Column,
                  player: str = "player") -> DataFrame:
    """Each move labelled by the same player's moves between the swapped clubs within the horizon.

    A free mirror (fee null or 0) before the move makes it a loan's return, after it a loan out; a
    mirror on the same day counts, but as neither. ``low`` and ``high`` bound the mirror's date.
    """
    other = moves.select(
        player, F.col("to_club").alias("from_club"), F.col("from_club").alias("to_club"),
        F.col("date").alias("_date"), F.coalesce(F.col("fee") == 0, F.lit(True)).alias("_free"))
    # equal mirrors are combined, so a player's repeated swaps stay few
    other = other.groupBy(player, "from_club", "to_club", "_date").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_free").alias("_free"))
    meet = movers.select(player, "from_club", "to_club", "date", low.alias("_low"), high.alias("_high")).distinct()
    met = meet.join(other, [player, "from_club", "to_club"]).filter(F.col("_date").between(F.col("_low"), F.col("_high")))
    place = [player, "from_club", "to_club", "date"]
    flags = met.groupBy(*place).agg(
        F.sum("_n").alias("n_mirrors"),
        F.max(F.col("_free") & (F.col("_date") < F.col("date"))).alias("earlier"),
        F.max(F.col("_free") & (F.col("_date") > F.col("date"))).alias("later"),
        F.max(F.col("_date") == F.col("date")).alias("same_day"))
    out = lookup(movers, flags, place)
    no = F.lit(False)
    out = out.withColumns({"n_mirrors": F.coalesce("n_mirrors", F.lit(0)),
                           **{c: F.coalesce(c, no) for c in ("earlier", "later", "same_day")}})
    paid = F.coalesce(F.col("fee") > 0, no)
    label = (F.when(paid & (F.col("n_mirrors") > 0), "paid_mirror").when(paid, "paid")
             .when(F.col("earlier") & F.col("later"), "both").when(F.col("earlier"), "loan_return")
             .when(F.col("later"), "loan_out").otherwise("free_other"))
    return out.withColumn("label", label)


def cohort_rules(labelled: DataFrame, closing: Column) -> DataFrame:
    """Permanent moves (a free one on the closing day does not count) and the loan-out set."""
    permanent = F.col("label").isin("paid", "paid_mirror") | ((F.col("label") == "free_other") & ~closing)
    return labelled.withColumns({"permanent": permanent, "sensitivity": F.col("label") == "loan_out"})


def last_of_june(date: Column) -> Column:
    return (F.month(date) == 6) & (F.dayofmonth(date) == 30)


def label_counts(labelled: DataFrame, levels: dict[str, Column], labels: Sequence[str]) -> DataFrame:
    """Label by nested level, absent labels 0."""
    held, cells = F.lit(True), []
    for name, c in levels.items():
        held = held & F.coalesce(c, F.lit(False))
        cells.append(F.when(held, name))
    tagged = labelled.select("label", F.explode(F.array_compact(F.array(*cells))).alias("level"))
    return tagged.groupBy("level").pivot("label", list(labels)).count().na.fill(0)
