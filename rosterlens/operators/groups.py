"""Groups of entities: modal groups, consolidation, shapes, percentiles and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Ordered, lookup, quantiles, value_ranks


def modal_group(rows: DataFrame, keys: Sequence[str], group: str, minutes: str = "minutes",
                unknown: str = "UNKNOWN") -> DataFrame:
    """Group with most minutes, then most rows; a full tie is unknown; groups without minutes
    do not count. Also how many groups tie at the top."""
    per = rows.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(
        F.sum(minutes).alias("_m"), F.count(F.lit(1)).alias("_n")).filter("_m > 0")
    best = per.groupBy(*keys).agg(F.max(F.struct("_m", "_n")).alias("_best"))
    top = per.join(best, list(keys)).filter(F.struct("_m", "_n") == F.col("_best"))
    return top.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) == 1, F.min(group)).otherwise(unknown).alias(group),
        F.count(F.lit(1)).alias("tied"))


def resolved_group(entities: DataFrame, keys: Sequence[str], modal: DataFrame, mapped: DataFrame,
                   group: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Modal group, else the mapped one, else unknown, with the step that settled it."""
    out = lookup(entities, modal.select(*keys, F.col(group).alias("_a")), keys)
    out = lookup(out, mapped.select(*keys, F.col(group).alias("_b")), keys)
    held = F.when(F.col("_a") != unknown, F.col("_a"))
    step = F.when(held.isNotNull(), "rows").when(F.col("_b").isNotNull(), "mapped").otherwise("none")
    return out.withColumns({group: F.coalesce(held, "_b", F.lit(unknown)), "step": step}).drop("_a", "_b")


def consolidated(links: DataFrame, key: str, linked: str, status: str = "status") -> DataFrame:
    """Per entity the distinct linked ids, the id when there is exactly one, counts by status."""
    per = links.groupBy(key).agg(
        F.array_sort(F.collect_set(linked)).alias("ids"),
        F.count_if(F.col(status) == "matched").alias("matched"),
        F.count_if(F.col(status) != "matched").alias("unmatched"))
    return per.withColumn("id", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))))


def shared_id_cases(links: DataFrame, linked: str, player: str, team: str) -> DataFrame:
    """Ids on more than one link, by whether the players and the teams differ."""
    per = links.filter(F.col(linked).isNotNull()).groupBy(linked).agg(
        F.count(F.lit(1)).alias("links"), F.min(player).alias("_p"), F.max(player).alias("_q"),
        F.min(team).alias("_t"), F.max(team).alias("_u")).filter("links > 1")
    players, teams = F.col("_p") != F.col("_q"), F.col("_t") != F.col("_u")
    case = (F.when(~players & teams, "one player, several teams")
            .when(players & ~teams, "several players, one team")
            .when(players & teams, "several of both").otherwise("one player, one team"))
    return per.select(linked, "links", case.alias("case"))


def match_rates(links: DataFrame, by: str, statuses: Sequence[str], minutes: str = "minutes",
                least: float = 450, status: str = "status", matched: str = "matched") -> DataFrame:
    """Counts per status and minutes-weighted rates, per group and for all (null group)."""
    hit, m = F.col(status) == matched, F.col(minutes)
    enough = m >= least
    return links.rollup(by).agg(
        *[F.count_if(F.col(status) == s).alias(s) for s in statuses],
        F.try_divide(F.sum(F.when(hit, m).otherwise(0)), F.sum(m)).alias("rate"),
        F.try_divide(F.sum(F.when(hit & enough, m).otherwise(0)),
                     F.sum(F.when(enough, m).otherwise(0))).alias("rate_regular"))


# The band of ratios that counts as agreement.
AGREE = (0.8, 1.2)


def agreement(pairs: DataFrame, by: str, ratio: str = "ratio") -> DataFrame:
    """Median ratio and share within the band, per group and for all."""
    both = pairs.select(ratio, F.explode(F.array(F.col(by), F.lit("ALL"))).alias(by))
    shares = both.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(F.col(ratio).between(*AGREE).cast("int")).alias("within"))
    return shares.join(quantiles(both, [by], ratio, {"median": 0.5}), by)


def weighted_agreement(pairs: DataFrame, minutes: str, least: float, ratio: str = "ratio") -> DataFrame:
    """Share of minutes in pairs within the band, over all pairs and over the regular ones."""
    m, ok = F.col(minutes), F.col(ratio).between(*AGREE)
    enough = m >= least
    return pairs.agg(
        F.try_divide(F.sum(F.when(ok, m).otherwise(0)), F.sum(m)).alias("share"),
        F.try_divide(F.sum(F.when(ok & enough, m).otherwise(0)),
                     F.sum(F.when(enough, m).otherwise(0))).alias("share_regular"))


def anova(rows: DataFrame, cluster: Sequence[str], value: str) -> DataFrame:
    """Mean squares between and within clusters, k0 and the intraclass correlation."""
    v = F.col(value)
    per = rows.groupBy(*cluster).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.var_pop(v).alias("_var"))
    per = per.filter("_n > 0")
    total = per.agg(F.sum("_n").alias("_big"), F.count(F.lit(1)).alias("_k"),
                    F.sum(F.col("_n") * F.col("_n")).alias("_nn"),
                    (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_grand"))
    ss = per.join(total).groupBy("_big", "_k", "_nn").agg(
        F.sum(F.col("_n") * (F.col("_mean") - F.col("_grand")) ** 2).alias("_ssb"),
        F.sum(F.col("_n") * F.col("_var")).alias("_ssw"))
    msb, msw = F.col("_ssb") / (F.col("_k") - 1), F.col("_ssw") / (F.col("_big") - F.col("_k"))
    out = ss.select(F.col("_big").alias("n"), F.col("_k").alias("clusters"), msb.alias("msb"), msw.alias("msw"),
                    ((F.col("_big") - F.col("_nn") / F.col("_big")) / (F.col("_k") - 1)).alias("k0"))
    icc = (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("k0") - 1) * F.col("msw"))
    return out.withColumn("icc", icc)


# Fixed value: z of 0.975 plus z of 0.8.
DETECT_Z = 2.80158


def power(anova_row: DataFrame) -> DataFrame:
    """Design effect, effective rows and the smallest correlation the test would see."""
    out = anova_row.withColumn("design_effect", 1 + (F.col("k0") - 1) * F.col("icc"))
    out = out.withColumn("effective", F.col("n") / F.col("design_effect"))
    return out.withColumn("detectable", F.tanh(F.lit(DETECT_Z) / F.sqrt(F.col("effective") - 3)))


def between_share(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per column the share of the sum of squares that lies between groups."""
    long = rows.unpivot(list(by), list(columns), "column", "value").filter("value is not null")
    per = long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    grand = per.groupBy("column").agg((F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_g"))
    between = F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) ** 2)
    within = F.sum(F.col("_n") * F.col("_v"))
    return per.join(grand, "column").groupBy("column").agg((between / (between + within)).alias("share"))


def ratio_by_thirds(rows: DataFrame, exposure: str, top: str, bottom: str) -> DataFrame:
    """Ratio of medians of two columns in the lowest and the highest third of exposure."""
    cuts = quantiles(rows, [], exposure, {"_low": 1 / 3, "_high": 2 / 3})
    third = F.when(F.col(exposure) > F.col("_high"), "high").when(F.col(exposure) <= F.col("_low"), "low")
    tagged = rows.join(cuts).withColumn("third", third).filter("third is not null")
    medians = quantiles(tagged, ["third"], top, {"_t": 0.5}).join(
        quantiles(tagged, ["third"], bottom, {"_b": 0.5}), "third")
    return medians.select("third", (F.col("_t") / F.col("_b")).alias("ratio"))


def shape(minutes: DataFrame, team: str, groups: Sequence[str], places: int = 10,
          group: str = "grp", column: str = "minutes") -> DataFrame:
    """Places shared by largest remainder over whole minutes; a tie to the earlier group.

    Groups are a fixed list, so each team's shares are columns of its one row.
    """
    wide = minutes.groupBy(team).agg(*[
        F.coalesce(F.sum(F.when(F.col(group) == g, F.col(column))), F.lit(0)).cast("long").alias(f"_m{i}")
        for i, g in enumerate(groups)])
    m = [F.col(f"_m{i}") for i in range(len(groups))]
    wide = wide.withColumn("_total", sum(m[1:], m[0])).filter("_total > 0")
    whole = [F.floor(places * x / F.col("_total")) for x in m]
    rest = [(places * x) % F.col("_total") for x in m]
    left = F.lit(places) - sum(whole[1:], whole[0])
    ordered = F.array_sort(F.array(*[
        F.struct((-r).alias("r"), F.lit(i).alias("i")) for i, r in enumerate(rest)]))
    given = F.transform(F.slice(ordered, F.lit(1), left.cast("int")), lambda s: s["i"])
    cells = F.array(*[
        F.struct(F.lit(g).alias(group), (whole[i] + F.array_contains(given, F.lit(i)).cast("int"))
                 .cast("int").alias("places")) for i, g in enumerate(groups)])
    return wide.select(team, F.inline(F.when(left > 0, cells).otherwise(F.array(*[
        F.struct(F.lit(g).alias(group), whole[i].cast("int").alias("places"))
        for i, g in enumerate(groups)]))))


def percentiles(rows: DataFrame, by: Sequence[str], value: str, name: str = "pct") -> DataFrame:
    """Share of the group's rows strictly lower, in whole hundredths rounded down."""
    r = value_ranks(rows, by, value)
    pct = F.floor(100 * F.col("below") / F.col("total")).cast("long").alias(name)
    return lookup(rows, r.select(*by, value, pct), [*by, value])


def rank_among(rows: DataFrame, key: str, eligible: Column, score: str, name: str = "rank") -> DataFrame:
    """Rank from 1 by falling score, ties by key, of the eligible rows; null for the others."""
    kept = rows.filter(eligible & F.col(score).isNotNull()).select(key, (-F.col(score)).alias("_s"))
    o = Ordered(kept, [], ["_s", key]).upto(**{name: ("sum", F.lit(1))})
    return rows.join(o.df.select(key, name), key, "left")


def survival_share(reference: DataFrame, queries: DataFrame, by: Sequence[str], u: str, v: str,
                   ids: Sequence[str], name: str = "closeness", rows: int | None = None) -> DataFrame:
    """Per query value the share of its group's reference values at or above it."""
    refs = reference.groupBy(*by, F.col(u).alias("_v")).agg(F.count(F.lit(1)).alias("_refs"))
    asks = queries.select(*by, F.col(v).alias("_v")).distinct().withColumn("_refs", F.lit(0))
    points = refs.unionByName(asks).groupBy(*by, "_v").agg(F.sum("_refs").alias("_refs"))
    o = Ordered(points, by, ["_v"], rows).upto(_upto=("sum", F.col("_refs"))).whole(_all=F.col("_refs"))
    above = F.col("_all") - F.col("_upto") + F.col("_refs")
    shares = o.df.select(*by, "_v", F.try_divide(above, F.col("_all")).alias(name))
    return lookup(queries.withColumn("_v", F.col(v)), shares, [*by, "_v"]).select(*by, *ids, v, name)


def funnel(rows: DataFrame, by: str, steps: Mapping[str, Column]) -> DataFrame:
    """Counts of nested conditions per group and for all."""
    held, aggs = F.lit(True), []
    for name, c in steps.items():
        held = held & F.coalesce(c, F.lit(False))
        aggs.append(F.count_if(held).alias(name))
    return rows.rollup(by).agg(*aggs)


def class_counts(rows: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Counts per class, classes without rows 0. The class list is a constant."""
    spark = rows.sparkSession
    listed = spark.createDataFrame([(c,) for c in classes], f"{column} string")
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def edited(values: Column, removed: Column, added: Column) -> Column:
    """A list after an edit: its values without the removed ones, in order and once each, then those added that it lacks."""
    kept = F.array_except(values, removed)
    return F.concat(kept, F.array_except(added, kept))
